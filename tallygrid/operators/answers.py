"""Answers in digit slots: canonical digits, accepted placements and grading.

A blank slot is ``_`` in a label and null among digits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANK = "_"


def digits_of(label: Column) -> Column:
    """A label's characters as nullable digits."""
    return F.transform(F.split(label, ""), lambda c: F.when(c != BLANK, c.cast("int")))


def canonical_label(answer: Column, slots: Column) -> Column:
    """The answer at the right of its slots; null where it doesn't fit."""
    text = answer.cast("string")
    return F.when(F.length(text) <= slots, F.lpad(text, slots, F.lit(BLANK)))


def accepted_labels(answer: Column, slots: Column) -> Column:
    """The placements that count as right: one if the answer fills its slots, else blanks or zeros before it, or blanks after."""
    text = answer.cast("string")
    shorter = F.array(F.lpad(text, slots, F.lit(BLANK)), F.lpad(text, slots, F.lit("0")), F.rpad(text, slots, F.lit(BLANK)))
    return F.when(F.length(text) == slots, F.array(text)).when(F.length(text) < slots, shorter)


def responses(rows: DataFrame, answer: str, slots: str) -> DataFrame:
    """The rows once for each accepted placement, with ``position``, ``label`` and ``digits``."""
    placed = rows.select("*", F.posexplode(accepted_labels(F.col(answer), F.col(slots))).alias("position", "label"))
    return placed.withColumn("digits", digits_of(F.col("label")))


def is_right(response: Column, answer: Column, slots: Column) -> Column:
    """Whether a response's digits (null for blank) are one of the accepted placements."""
    return F.exists(accepted_labels(answer, slots), lambda label: digits_of(label).eqNullSafe(response))


def place_names(slots: Column, index: Column) -> Column:
    """ones, tens or hundreds: the place of the slot at ``index`` from the left."""
    return F.get(F.array(F.lit("ones"), F.lit("tens"), F.lit("hundreds")), slots - index - 1)


def slots_of(counts: Column) -> Column:
    """The slot count of a sheet's questions: the number if all are equal, else ``variable``."""
    return F.when(F.array_min(counts) == F.array_max(counts), F.array_min(counts).cast("string")).otherwise(F.lit("variable"))
