"""Quality rules on repeated text, by a suffix array over each document's words.

Adjacent suffixes in sorted order share the longest prefixes, so the larger of a
suffix's two common prefix lengths is the longest repeat that starts there. Those
lengths end where a repeated substring can't be extended; the union of the spans
``[i, i + length)`` of at least ``min_span`` words is the repeated part of the
text. A document stays if that part, and the longest repeat, stay under limits.

Sorting doubles the compared prefix (1, 2, 4, ... words) and touches only suffixes
that are still tied, so text without repeats costs two or three passes.

Defined results: null, empty and blank texts have no words and all counts 0, and
fail the base rule of ten words; each row gives one row, repeated rows equal ones;
a null id stays null; an empty table gives an empty result; extra columns are
ignored. Whole texts are used; memory grows with the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrid.llm.words import filled, per_text, raw_bytes, slices, split_words, text_of

SYMBOLS = b"#*$%&|<>"
WORD_WINDOW = 5


def longest_repeats(ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each word, the words of the longest run from there that also starts elsewhere in its text."""
    n = len(ids)
    if n == 0:
        return np.zeros(0, np.int64)
    text = text_of(ends)
    stop = ends[1:][text]
    key = text * (int(ids.max()) + 1) + ids
    order = np.argsort(key, kind="stable")

    def ranked(slot: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first slot of each run of equal keys, and whether the run has company."""
        new = np.concatenate(([True], keys[1:] != keys[:-1]))
        first = slot[np.flatnonzero(new)]
        run = np.cumsum(new) - 1
        return first[run], np.bincount(run)[run] > 1

    slots = np.arange(n)
    first, tied = ranked(slots, key[order])
    rank = np.empty(n, np.int64)
    rank[order] = first
    levels, step = [rank.astype(np.int32)], 1
    slots = slots[tied]
    while len(slots):
        at = order[slots]
        after = at + step
        inside = after < stop[at]
        second = np.where(inside, rank[np.minimum(after, n - 1)] + 1, 0)
        key = rank[at] * (n + 1) + second
        by = np.argsort(key, kind="stable")
        order[slots] = at[by]
        first, tied = ranked(slots, key[by])
        rank = rank.copy()
        rank[at[by]] = first
        levels.append(rank.astype(np.int32))
        slots, step = slots[tied], step * 2

    common = np.zeros(n + 1, np.int64)  # between the suffixes in slots i - 1 and i
    near = np.flatnonzero(levels[0][order[1:]] == levels[0][order[:-1]])
    a, b, length = order[near], order[near + 1], np.zeros(len(near), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        inside = (a + length < stop[a]) & (b + length < stop[b])
        same = inside & (levels[k][np.minimum(a + length, n - 1)] == levels[k][np.minimum(b + length, n - 1)])
        length += same * (1 << k)
    common[near + 1] = length
    longest = np.empty(n, np.int64)
    longest[order] = np.maximum(common[:-1], common[1:])
    return longest


def covered(longest: np.ndarray, least: int) -> np.ndarray:
    """Whether each word lies in a repeat of at least ``least`` words."""
    at = np.flatnonzero(longest >= least)
    change = np.bincount(at, minlength=len(longest) + 1) - np.bincount(at + longest[at], minlength=len(longest) + 1)
    return np.cumsum(change)[: len(longest)] > 0


def _measure(batch: pa.RecordBatch, min_span: int) -> list[np.ndarray]:
    texts = filled(batch.column("text"))
    data, at = raw_bytes(texts)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    is_symbol = np.zeros(256, bool)
    is_symbol[list(SYMBOLS)] = True
    lines = ([x for x in t.as_buffer().to_pybytes().split(b"\n") if x and not x.isspace()] for t in texts)
    n_dup = np.fromiter((len(x) - len(set(x)) for x in lines), np.int64, len(texts))
    ids, ends, _ = split_words(texts)
    longest = longest_repeats(ids, ends)
    top = np.zeros(len(texts), np.int64)
    np.maximum.at(top, text_of(ends), longest)
    return [
        np.diff(ends),
        per_text(~space & ((data & 0xC0) != 0x80), at),
        per_text(is_symbol[data], at),
        n_dup,
        per_text(covered(longest, WORD_WINDOW), ends),
        per_text(covered(longest, min_span), ends),
        top,
    ]


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_span: int = 10) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_span_words, longest_repeat) for every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_span_words", "longest_repeat"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, _measure(batch, min_span))], names=["doc_id", *names])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{x} bigint" for x in names))


def judge(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_words: int = 10,
    max_repeat_percent: int = 20,
    min_span: int = 10,
    max_span_percent: int = 15,
    max_longest: int = 50,
) -> DataFrame:
    """The measures, ``base_failed`` and ``kept``.

    The base rule fails under ``min_words`` words, or when the five-word windows
    that occur twice cover over ``max_repeat_percent`` of the words. The method's
    own limits: repeats of ``min_span`` words or more cover at most
    ``max_span_percent`` of the words, and the longest has at most ``max_longest``.
    """
    got = measure(docs, id_col, text_col, min_span)
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat_percent)
    within = (F.col("n_span_words") * 100 <= F.col("n_words") * max_span_percent) & (F.col("longest_repeat") <= max_longest)
    return got.withColumn("base_failed", failed).withColumn("kept", ~failed & within)


#: Of the default limits: words in repeats of ten words or more lie in ten-word windows found twice,
#: and the longest repeat is over fifty words where a window of fifty-one is found twice.
ORACLE = r"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
w as (select r, k, s, hash(list_slice(ws, s, s + k - 1)) as h
      from (select r, ws, k, unnest(generate_series(1, len(ws) - k + 1)) as s from d, (values (5), (10), (51)) v(k) where len(ws) >= k)),
twice as (select r, k, s from (select *, count(*) over (partition by r, k, h) as n from w) where n > 1),
c as (select r, k, count(distinct place) as n from (select r, k, unnest(generate_series(s, s + k - 1)) as place from twice) group by r, k),
lines as (select r, unnest(string_split(t, chr(10))) as line from d),
dup as (select r, count(*) - count(distinct line) as n from lines where regexp_matches(line, '[^\x20\x09-\x0D]') group by r),
m as (select doc_id, len(ws)::bigint as n_words, length(array_to_string(ws, ''))::bigint as word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, coalesce(dup.n, 0)::bigint as n_dup_lines,
             coalesce(c5.n, 0)::bigint as n_repeat_words, coalesce(c10.n, 0)::bigint as n_span_words, c51.n is not null as long_repeat
      from d left join dup using (r) left join c c5 on c5.r = d.r and c5.k = 5 left join c c10 on c10.r = d.r and c10.k = 10 left join c c51 on c51.r = d.r and c51.k = 51),
b as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from m)
select *, not base_failed and 100 * n_span_words <= 15 * n_words and not long_repeat as kept from b
"""
