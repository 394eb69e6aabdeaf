"""Periodic runs of words: maximal stretches that repeat themselves at a fixed distance.

Every run has a period that is a Lyndon word, and that is the longest Lyndon word at
its place in one of two orders, an order of the words and its reverse. So a stack of
longest Lyndon words, built from right to left under both orders, names all periods
(place, next place); where the words go on alike from both places, the run is
extended to both sides. Comparing and extending ask for the longest common extension
of two places: a binary search over rolling hashes finds it and the words themselves
are then compared, so a hash that lies costs time, never a result. Extensions at the
distance last asked for are remembered, which keeps long runs linear.

Only stretches that can hold a run are scanned: a run of ``least`` words or more has
its words but one period twice, so each of its words lies in a sequence of
``least // 2`` words that the text repeats. These are found for many texts at once.

Defined results: null, empty and blank texts have no words and no runs; each row gives
one row, repeated rows equal ones; a null id stays null; an empty table gives an empty
result; other columns are ignored. Whole texts are scanned; memory grows with the
longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallygrid.llm.words import Runs, filled, mixed, slices, split_words, text_of

#: A run has so many words at least, and two periods.
LEAST = 12
#: A prime, and the base of rolling hashes modulo it.
PRIME, BASE = (1 << 61) - 1, 0x1D2C3B4A59687F
RUN = "struct<start: bigint, length: bigint, period: bigint>"


class _Extensions:
    """Longest common extensions of places in ``words``, by distance."""

    def __init__(self, words: list[int]) -> None:
        self.words, self.raw = words, np.array(words)
        self.sums, self.powers = [0], [1]
        for w in words:
            self.sums.append((self.sums[-1] * BASE + w + 1) % PRIME)
            self.powers.append(self.powers[-1] * BASE % PRIME)
        self.known: dict[int, tuple[int, int]] = {}

    def _hash(self, a: int, b: int) -> int:
        return (self.sums[b] - self.sums[a] * self.powers[b - a]) % PRIME

    def _grown(self, most: int, alike, verified) -> int:
        """The largest length up to ``most`` that is alike, by hashes and then by words."""
        low, high = 0, most
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if alike(middle) else (low, middle - 1)
        differ = np.flatnonzero(~verified(low))
        return low if not len(differ) else -1

    def right(self, i: int, j: int) -> int:
        """How many words are alike from i and from j on, i before j."""
        known = self.known.get(j - i)
        if known and known[0] - 1 <= i < known[1]:
            if i < known[0] and self.words[i] != self.words[j]:
                return 0
            self.known[j - i] = (min(i, known[0]), known[1])
            return known[1] - i
        most = len(self.words) - j
        found = self._grown(most, lambda k: self._hash(i, i + k) == self._hash(j, j + k), lambda k: self.raw[i : i + k] == self.raw[j : j + k])
        if found < 0 or (found < most and self.words[i + found] == self.words[j + found]):
            same = self.raw[i : i + most] == self.raw[j : j + most]
            found = most if same.all() else int(np.argmin(same))
        self.known[j - i] = (i, i + found)
        return found

    def left(self, i: int, j: int) -> int:
        """How many words are alike before i and before j, i before j."""
        found = self._grown(i, lambda k: self._hash(i - k, i) == self._hash(j - k, j), lambda k: self.raw[i - k : i] == self.raw[j - k : j])
        if found < 0 or (found < i and self.words[i - found - 1] == self.words[j - found - 1]):
            same = (self.raw[:i] == self.raw[j - i : j])[::-1]
            found = i if same.all() else int(np.argmin(same))
        return found


def runs_of(words: list[int], least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of ``least`` words or more, by start and period."""
    n, found = len(words), set()
    for reverse in (False, True):
        extensions, ends, seen = _Extensions(words), [0] * n, {}
        for i in range(n - 1, -1, -1):
            a, j, alike = words[i], i + 1, 0
            while j < n:
                alike = 0
                if a == words[j]:
                    alike = extensions.right(i, j)
                    less = reverse if j + alike == n else (words[i + alike] < words[j + alike]) != reverse
                else:
                    less = (a < words[j]) != reverse
                if not less:
                    break
                j = ends[j]
            ends[i] = j
            if j == n or not alike:
                continue
            period, end = j - i, j + alike
            if seen.get(period, (n, n))[0] <= i and seen[period][1] == end:
                continue
            start = i - extensions.left(i, j)
            if end - start >= 2 * period:
                seen[period] = (start, end)
                if end - start >= least:
                    found.add((start, end - start, period))
    return sorted((s, k, p) for s, k, p in found)


def stretches(ids: np.ndarray, ends: np.ndarray, least: int = LEAST) -> np.ndarray:
    """(first, after last) of the stretches of words whose texts repeat the sequences around each of them."""
    width, n = least // 2, len(ids)
    text = text_of(ends)
    at = np.flatnonzero(np.arange(n) + width <= ends[1:][text]) if n else np.zeros(0, np.int64)
    if not len(at):
        return np.zeros((0, 2), np.int64)
    key = Runs(mixed(ids.astype(np.uint64) + np.uint64(1))).hash(at, at + width) + mixed(text[at].astype(np.uint64) + np.uint64(1 << 40))
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    again = np.zeros(len(at), bool)
    again[order[1:]] |= same
    again[order[:-1]] |= same
    at = at[again]
    change = np.bincount(at, minlength=n + 1)[: n + 1] - np.bincount(at + width, minlength=n + 1)[: n + 1]
    covered = np.cumsum(change)[:n] > 0
    begins = covered & ~np.concatenate(([False], covered[:-1] & (text[1:] == text[:-1])))
    stops = covered & ~np.concatenate((covered[1:] & (text[1:] == text[:-1]), [False]))
    spans = np.stack((np.flatnonzero(begins), np.flatnonzero(stops) + 1), axis=1)
    return spans[spans[:, 1] - spans[:, 0] >= least]


def with_tails(ids: np.ndarray, ends: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Words whose texts repeat themselves from some word on where the seed is a multiple of ten."""
    counts, part = np.diff(ends), seeds // 10
    for k in np.flatnonzero((seeds % 10 == 0) & (counts > 0)):
        n, g = int(counts[k]), int(part[k])
        a = g % n
        period = 1 + (n - a) // (3 + g % 8)
        own = ids[ends[k] : ends[k + 1]]
        own[a:] = own[a + np.arange(n - a) % period]
    return ids


def _scanned(batch: pa.RecordBatch, least: int) -> pa.RecordBatch:
    ids, ends, distinct = split_words(filled(batch.column("text")))
    ids = with_tails(ids, ends, batch.column("seed").to_numpy())
    text, keep = text_of(ends), np.ones(len(ids), bool)
    counts, rows = np.zeros(len(ends) - 1, np.int64), []
    for a, b in stretches(ids, ends, least):
        here, at = text[a], a - ends[text[a]]
        for start, length, period in runs_of(ids[a:b].tolist(), least):
            rows.append((at + start, length, period))
            counts[here] += 1
            keep[a + start + period : a + start + length] = False
    fields = [pa.array([r[k] for r in rows], pa.int64()) for k in range(3)]
    offsets = pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32())
    left = np.concatenate(([0], np.cumsum(keep)))[ends]
    words = distinct.take(pa.array(ids[keep]))
    return pa.RecordBatch.from_pydict({
        "doc_id": batch.column("doc_id"),
        "n_words": pa.array(np.diff(ends)),
        "runs": pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(fields, ["start", "length", "period"])),
        "collapsed": pc.binary_join(pa.ListArray.from_arrays(pa.array(left, pa.int32()), words), pa.scalar(" ", pa.large_string())).cast(pa.string()),
    })


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, seed: Column | None = None) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) for every row.

    ``runs`` has (start, length, period) of each run, by start and period; ``collapsed``
    the words that no run holds after its first period, joined by spaces. A ``seed``
    that is a multiple of ten makes the text periodic from some word on before that, to
    try the detection out.
    """
    number = F.lit(1) if seed is None else F.coalesce(seed, F.lit(1))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), number.cast("bigint").alias("seed"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield _scanned(batch, least)

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_words bigint, runs array<{RUN}>, collapsed string")


def digest(found: DataFrame) -> DataFrame:
    """The number of runs, the longest of them (ties: smallest start, then period), and hashes of the runs and of what is left."""
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    text = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    rows = found.withColumn("longest", longest)
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("longest.start")).alias("start"), F.col("longest.length").alias("length"), (-F.col("longest.period")).alias("period"),
        F.expr("longest.length * 1000 div -longest.period").alias("exponent_milli"), F.sha2(text, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
