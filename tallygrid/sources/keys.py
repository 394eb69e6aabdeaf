"""Reading printed answer keys back from their HTML tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallygrid.functions.text import trim
from tallygrid.operators.answers import canonical_label, digits_of
from tallygrid.operators.integrity import key_checksum

# The references that escaped text has; the ampersand's last, as it begins them all.
REFERENCES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def _inside(html: Column, tag: str) -> Column:
    """What stands in each element of a tag that doesn't hold others of it."""
    return F.regexp_extract_all(html, F.lit(rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>"), F.lit(1))


def plain(markup: Column) -> Column:
    """Markup as text: no tags, references decoded, white space as single spaces."""
    text = F.regexp_replace(markup, r"(?s)<[^>]*>", "")
    for reference, character in REFERENCES:
        text = F.replace(text, F.lit(reference), F.lit(character))
    return trim(F.regexp_replace(text, r"\s+", " "))


def cells(html: Column, row: str = "tr", cell: str = "td") -> Column:
    """array<array<string>>: the texts of the cells of each row that has any; header rows have none."""
    rows = F.transform(_inside(F.coalesce(html, F.lit("")), row), lambda r: F.transform(_inside(r, cell), plain))
    return F.filter(rows, lambda r: F.size(r) > 0)


def read_keys(pages: DataFrame, html: str, keep: list[str]) -> DataFrame:
    """(keep, sheet, title, position, item, prompt, answer): the rows of the answer tables on each page.

    A sheet is a ``section`` with a heading ``h2`` and a table of item, prompt and answer;
    sheets and rows count from 0. Rows of fewer cells are no answers; an answer that is no
    whole number is null. Null pages have no sheets.
    """
    sheets = pages.select(*keep, F.posexplode(_inside(F.coalesce(F.col(html), F.lit("")), "section")).alias("sheet", "_section"))
    title, full = plain(F.get(_inside(F.col("_section"), "h2"), F.lit(0))), F.filter(cells(F.col("_section")), lambda r: F.size(r) >= 3)
    rows = sheets.select(*keep, "sheet", title.alias("title"), F.posexplode(full).alias("position", "_row"))
    at = lambda i: F.get("_row", F.lit(i))
    return rows.select(*keep, "sheet", "title", "position", at(0).alias("item"), at(1).alias("prompt"), at(2).try_cast("int").alias("answer"))


def key_of(answers: Column, slots: Column) -> Column:
    """The key of answers in order, each at the right of its slots; null if one doesn't fit or is missing."""
    labels = F.transform(answers, lambda a: canonical_label(a, slots))
    return F.when(~F.exists(labels, lambda x: x.isNull()), F.flatten(F.transform(labels, digits_of)))


def rebuilt_checksums(rows: DataFrame, keep: list[str], slots: int = 3) -> DataFrame:
    """(keep, sheet, title, questions, checksum): each sheet's answer-key checksum, from what its table says.

    ``slots``: how many digit slots each answer has. It shows whether a printed key belongs
    to a layout, and stands in for a layout that is missing.
    """
    listed = F.transform(F.array_sort(F.collect_list(F.struct("position", "answer"))), lambda r: r["answer"])
    sheets = rows.groupBy(*keep, "sheet", "title").agg(listed.alias("_answers"))
    return sheets.select(*keep, "sheet", "title", F.size("_answers").alias("questions"), key_checksum(key_of(F.col("_answers"), F.lit(slots))).alias("checksum"))
