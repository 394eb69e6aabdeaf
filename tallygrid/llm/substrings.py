"""Substring deduplication by a relative Lempel-Ziv parse.

The reference is every document, cut into blocks at places that its own content
picks: the least hash of the word shingles in a window is the window's anchor, so
equal windows have equal anchors wherever they stand, and a maximal run of windows
with one anchor is a block. A block is known by 128 bits (anchor and content), and
the index keeps its source: the smallest document that has it, and the place there.

A document's matches grow block by block: from the first block that an earlier document
has, a match (start, length, source, place) goes on as long as the next block continues
in the same source. A match is a window long at least, so every one is a duplicate span.
Where it ends, or none starts although an anchor is known, it may go on for a part of the
block: there the windows of the block are compared one by one with those of all other
blocks of that anchor, and every one that the smallest document with it has earlier is a
match too. Matches that touch or overlap at one distance in one source are one maximal
match; and from left to right, the parse takes the match that reaches farthest from where
it stands: these are the document's factors. So what the matches cover, the factors do.

What moves between machines is a row for each block (about one for 22 words, and one
for a run of repeated words), not for each word; equal blocks meet in a partial sum
before the shuffle, blocks that very many documents share are joined by broadcast,
and windows at boundaries come from one document a distinct block.

Defined results: null text has no words; texts shorter than a window lose nothing;
rows of one id count as one document, so they never remove each other; a null id
is never smaller and removes and loses nothing; an empty table gives an empty
result; extra columns are ignored. Hashes are 128 bits, taken as exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrid.llm.common import join_hot, settle
from tallygrid.llm.words import MIX_A, Runs, filled, mixed, slices, split_words, text_of, word_hashes

SHINGLE = 8
FACTOR = "struct<start: int, length: int, source: {key}, place: int>"


def least_values(values: np.ndarray, width: int) -> np.ndarray:
    """For each start, the least of the next ``width`` values."""
    reach = 1
    while reach < width:
        step = min(reach, width - reach)
        values = np.minimum(values[:-step], values[step:])
        reach += step
    return values


def _runs(own: np.ndarray, *values: np.ndarray) -> np.ndarray:
    """Where the text or a value differs from the one before."""
    new = np.ones(len(own), bool)
    new[1:] = own[1:] != own[:-1]
    for v in values:
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def blocks(batch: pa.RecordBatch, window: int) -> pa.RecordBatch | None:
    """(doc_id, tag, lo, hi, anchor, block) of every block: its windows start at words lo to hi."""
    ids, ends, distinct = split_words(filled(batch.column("text")))
    if len(ids) < window:
        return None
    text, runs = text_of(ends), Runs(word_hashes(distinct)[ids])
    k = min(SHINGLE, window)
    at = np.arange(len(ids) - k + 1)
    anchor = least_values(runs.hash(at, at + k), window - k + 1)
    starts = np.arange(len(anchor))
    starts = starts[starts + window <= ends[1:][text[starts]]]
    if not len(starts):
        return None
    anchor, own = anchor[starts], text[starts]
    first = _runs(own, anchor)
    lo, hi, own = starts[first], starts[np.append(first[1:], len(starts)) - 1], own[first]
    content = mixed(runs.hash(lo, hi + window) + MIX_A)
    row = pa.array(own)
    return pa.RecordBatch.from_arrays(
        [
            batch.column("doc_id").take(row), batch.column("tag").take(row),
            pa.array((lo - ends[own]).astype(np.int32)), pa.array((hi - ends[own]).astype(np.int32)),
            pa.array(anchor[first].view(np.int64)), pa.array(content.view(np.int64)),
        ],
        names=["doc_id", "tag", "lo", "hi", "anchor", "block"],
    )


def parse(batch: pa.RecordBatch, window: int) -> pa.RecordBatch:
    """(doc_id, tag, factors, open) of each row's ``blocks``, which are in order.

    ``earlier`` blocks have a source and make factors; the others are open: their
    windows are to be compared.
    """
    listed = batch.column("blocks")
    flat = listed.flatten()
    own = np.repeat(np.arange(batch.num_rows), np.diff(listed.offsets.to_numpy()))
    lo, hi, place, earlier = (flat.field(n).to_numpy(zero_copy_only=False) for n in ("lo", "hi", "place", "earlier"))
    known = np.flatnonzero(earlier)
    source = flat.field("source").take(pa.array(known))
    named = source.dictionary_encode().indices.to_numpy()
    # a factor goes on where blocks touch and their places in one source do
    apart = lo[known] - place[known]
    after = np.cumsum(np.append(0, lo[known][1:] != hi[known][:-1] + 1)) if len(known) else known
    first = _runs(own[known], named, apart, after)
    last = np.append(first[1:], len(known)) - 1 if len(first) else first
    start = lo[known][first]
    factors = pa.StructArray.from_arrays(
        [pa.array(start), pa.array(hi[known][last] + np.int32(window) - start), source.take(pa.array(first)), pa.array(place[known][first])],
        names=["start", "length", "source", "place"],
    )
    rest = np.flatnonzero(~earlier)

    def lists(rows: np.ndarray, values: pa.Array) -> pa.Array:
        ends = np.append(0, np.cumsum(np.bincount(rows, minlength=batch.num_rows)))
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values)

    still = flat.take(pa.array(rest))
    still = pa.StructArray.from_arrays([still.field(n) for n in ("lo", "hi", "anchor")], names=["lo", "hi", "anchor"])
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id"), batch.column("tag"), lists(own[known][first], factors), lists(own[rest], still)],
        names=["doc_id", "tag", "factors", "open"],
    )


def boundary_windows(batch: pa.RecordBatch, window: int) -> pa.RecordBatch | None:
    """(doc_id, tag, anchor, hash, places) of each row's distinct windows in its open blocks."""
    ids, ends, distinct = split_words(filled(batch.column("text")))
    runs = Runs(word_hashes(distinct)[ids])
    listed = batch.column("open")
    flat, counts = listed.flatten(), np.diff(listed.offsets.to_numpy())
    if not len(flat):
        return None
    row = np.repeat(np.arange(batch.num_rows), counts)
    lo, hi, anchor = (flat.field(n).to_numpy() for n in ("lo", "hi", "anchor"))
    many = hi - lo + 1
    each = np.repeat(np.arange(len(lo)), many)
    at = np.arange(len(each)) - np.repeat(np.cumsum(many) - many, many) + lo[each]
    own = row[each]
    found = runs.hash(at + ends[own], at + ends[own] + window)
    by = np.lexsort((at, found, own))
    first = _runs(own[by], found[by])
    take = pa.array(own[by][first])
    places = pa.ListArray.from_arrays(pa.array(np.append(first, len(by)).astype(np.int32)), pa.array(at[by].astype(np.int32)))
    return pa.RecordBatch.from_arrays(
        [
            batch.column("doc_id").take(take), batch.column("tag").take(take), pa.array(anchor[each][by][first]),
            pa.array(found[by][first].view(np.int64)), places,
        ],
        names=["doc_id", "tag", "anchor", "hash", "places"],
    )


def greedy(batch: pa.RecordBatch) -> pa.RecordBatch:
    """(doc_id, tag, found): each row's factors, from its matches ``found``."""
    listed = batch.column("found")
    flat, ends = listed.flatten(), listed.offsets.to_numpy() - listed.offsets[0].as_py()
    row = np.repeat(np.arange(batch.num_rows), np.diff(ends))
    start, length, place = (flat.field(n).to_numpy().astype(np.int64) for n in ("start", "length", "place"))
    source = flat.field("source").dictionary_encode().indices.to_numpy()
    apart = start - place
    by = np.lexsort((start, apart, source, row))
    new = _runs(row[by], source[by], apart[by])
    run = np.cumsum(np.isin(np.arange(len(by)), new))
    # within a run of one source and distance, how far the matches so far reach; runs don't mix, as each is lifted above the last
    lift = run * (int((start + length).max(initial=0)) + 1)
    reach = np.maximum.accumulate((start + length)[by] + lift) - lift
    gap = np.ones(len(by), bool)
    gap[1:] = (run[1:] != run[:-1]) | (start[by][1:] > reach[:-1])
    first = np.flatnonzero(gap)
    last = np.append(first[1:], len(by)) - 1 if len(first) else first
    own, lo, hi, at = row[by][first], start[by][first], reach[last], by[first]
    chosen, order = [], np.lexsort((-hi, lo, own))
    text, done, best = -1, 0, -1
    for k in order.tolist() + [-1]:
        if k < 0 or own[k] != text:
            if best >= 0:
                chosen.append(best)
            if k < 0:
                break
            text, done, best = own[k], -1, -1
        if best >= 0 and lo[k] > done:  # no longer one that begins where the parse stands
            chosen.append(best)
            done, best = hi[best], -1
        if hi[k] <= done:
            continue
        if best < 0 and lo[k] > done:
            done = lo[k]
        if best < 0 or hi[k] > hi[best]:
            best = k
    take = np.array(chosen, np.int64)
    counts = np.bincount(own[take], minlength=batch.num_rows)
    values = [pa.array(lo[take].astype(np.int32)), pa.array((hi - lo)[take].astype(np.int32)), flat.field("source").take(pa.array(at[take])), pa.array(place[at[take]].astype(np.int32))]
    factors = pa.StructArray.from_arrays(values, names=["start", "length", "source", "place"])
    found = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), factors)
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tag"), found], names=["doc_id", "tag", "found"])


def _merged(found: list[dict] | None) -> list[list[int]]:
    """The word ranges [from, to) that the factors cover, in order."""
    spans: list[list[int]] = []
    for lo, hi in sorted((x["start"], x["start"] + x["length"]) for x in found or ()):
        if spans and lo <= spans[-1][1]:
            spans[-1][1] = max(hi, spans[-1][1])
        else:
            spans.append([lo, hi])
    return spans


def _left(words: list[bytes], spans: list[list[int]]) -> list[bytes]:
    left, at = [], 0
    for lo, hi in spans:
        left += words[at:lo]
        at = hi
    return left + words[at:]


def _without(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Each text without the words of its factors, and the spans of words that went."""
    n_words, n_removed, kept, spans = [], [], [], []
    for text, found in zip(filled(batch.column("text")), batch.column("found").to_pylist()):
        words = text.as_buffer().to_pybytes().split()
        spans.append(_merged(found))
        left = _left(words, spans[-1])
        n_words.append(len(words))
        n_removed.append(len(words) - len(left))
        kept.append(b" ".join(left))
    return pa.RecordBatch.from_arrays(
        [
            batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
            pa.array(spans, pa.list_(pa.list_(pa.int32()))), batch.column("found"), pa.array(kept, pa.binary()).cast(pa.string()),
        ],
        names=["doc_id", "n_words", "n_removed", "spans", "factors", "kept"],
    )


def _mapped(frame: DataFrame, cut, window: int, schema: str, cutting=slices) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from filter(None, (cut(x, window) for x in cutting(batches)))

    return frame.mapInArrow(run, schema)


def _sourced(rows: DataFrame, firsts: DataFrame, keys: tuple[str, str]) -> DataFrame:
    """``rows`` with the columns of ``firsts``, which has one row a key and the number ``n`` of rows it meets."""
    return join_hot(rows, settle(firsts, "substring-firsts"), keys, "n")


def factors(texts: DataFrame, window: int) -> DataFrame:
    """(doc_id, tag, found: [(start, length, source, place)]) of each row of (doc_id, tag, text) that has factors."""
    key = texts.schema["doc_id"].dataType.simpleString()
    named = texts.filter(F.col("doc_id").isNotNull())
    schema = f"doc_id {key}, tag bigint, lo int, hi int, anchor bigint, block bigint"
    indexed = settle(_mapped(named, blocks, window, schema), "substring-blocks")

    least = F.min(F.struct("doc_id", F.col("lo").alias("place"))).alias("first")
    reference = settle(indexed.groupBy("anchor", "block").agg(least, F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n")), "substring-reference")
    varied = reference.groupBy("anchor").agg(F.count(F.lit(1)).alias("blocks")).filter(F.col("blocks") > 1).select("anchor", F.lit(True).alias("varied"))
    shared = reference.join(varied, "anchor", "left").filter((F.col("first.doc_id") < F.col("last")) | F.col("varied"))
    shared = shared.select("anchor", "block", F.col("first.doc_id").alias("source"), F.col("first.place").alias("place"), F.coalesce("varied", F.lit(False)).alias("varied"), "n")

    known = _sourced(indexed, shared, ("anchor", "block")).withColumn("earlier", F.col("source") < F.col("doc_id")).filter(F.col("earlier") | F.col("varied"))
    listed = F.sort_array(F.collect_set(F.struct("lo", "hi", "anchor", "earlier", "source", "place"))).alias("blocks")
    schema = f"doc_id {key}, tag bigint, factors array<{FACTOR.format(key=key)}>, open array<struct<lo: int, hi: int, anchor: bigint>>"
    parsed = settle(_mapped(known.groupBy("doc_id", "tag").agg(listed), parse, window, schema, cutting=iter), "substring-parse")

    todo = parsed.filter(F.size("open") > 0).select(F.col("doc_id").alias("o_id"), F.col("tag").alias("o_tag"), "open")
    ends = named.join(todo, (F.col("doc_id") == F.col("o_id")) & (F.col("tag") == F.col("o_tag"))).select("doc_id", "tag", "text", "open")
    schema = f"doc_id {key}, tag bigint, anchor bigint, hash bigint, places array<int>"
    ends = settle(_mapped(ends, boundary_windows, window, schema), "substring-boundaries")
    least = F.min(F.struct("doc_id", F.col("places")[0].alias("place"))).alias("first")
    again = ends.groupBy("anchor", "hash").agg(least, F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n")).filter(F.col("first.doc_id") < F.col("last"))
    again = again.select("anchor", "hash", F.col("first.doc_id").alias("source"), F.col("first.place").alias("place"), "n")
    met = _sourced(ends, again, ("anchor", "hash")).filter(F.col("source") < F.col("doc_id"))
    one = F.transform("places", lambda p: F.struct(p.alias("start"), F.lit(window).alias("length"), F.col("source"), F.col("place")))
    every = parsed.filter(F.size("factors") > 0).select("doc_id", "tag", "factors").unionByName(met.select("doc_id", "tag", one.alias("factors")))
    matches = every.groupBy("doc_id", "tag").agg(F.flatten(F.collect_list("factors")).alias("found"))
    return settle(_mapped(matches, lambda x, _: greedy(x), window, f"doc_id {key}, tag bigint, found array<{FACTOR.format(key=key)}>", cutting=iter), "substring-factors")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50) -> DataFrame:
    """(doc_id, n_words, n_removed, spans, factors, kept) for every row.

    A word goes when a window of ``window`` words over it also starts in a document
    with a smaller id; windows are judged on the input. ``factors`` lists the parse,
    (start, length, source, place) in words, ``spans`` the removed word ranges [from, to)
    and ``kept`` has the other words, joined by spaces.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("tag"), F.col(text_col).cast("string").alias("text"))
    found = factors(texts, window).select(F.col("doc_id").alias("s_id"), F.col("tag").alias("s_tag"), "found")
    joined = texts.join(found, (F.col("doc_id") == F.col("s_id")) & (F.col("tag") == F.col("s_tag")), "left").select("doc_id", "text", "found")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from map(_without, slices(batches))

    key = texts.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(run, f"doc_id {key}, n_words bigint, n_removed bigint, spans array<array<int>>, factors array<{FACTOR.format(key=key)}>, kept string")


def rewrite(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50) -> DataFrame:
    """``docs`` with all columns, and every text without the words that ``dedup`` removes.

    A text that loses nothing stays as it is; another has its kept words joined by spaces.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("tag"), F.col(text_col).cast("string").alias("text"))
    found = factors(texts, window).select(F.col("doc_id").alias("s_id"), F.col("tag").alias("s_tag"), "found")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("tag"))
    joined = rows.join(found, (F.col("doc_id") == F.col("s_id")) & (F.col("tag") == F.col("s_tag")), "left")

    @F.arrow_udf("string")
    def cut(text: pa.Array, found: pa.Array) -> pa.Array:
        pairs = zip(filled(text), found.to_pylist())
        left = [b" ".join(_left(t.as_buffer().to_pybytes().split(), _merged(x))) if x else b"" for t, x in pairs]
        return pa.array(left, pa.binary()).cast(pa.string())

    # only texts that lose words travel to Python
    losing = F.col("found").isNotNull()
    shorter = cut(F.when(losing, F.col(f"row.{text_col}").cast("string")), F.col("found"))
    cleaned = joined.select("row", F.when(losing, shorter).otherwise(F.col(f"row.{text_col}")).alias("shorter"))
    return cleaned.select(*[F.col("shorter").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


ORACLE = r"""
with d as (select doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) as ws, row_number() over () as r from documents),
p as (select r, doc_id, ws, unnest(generate_series(1, len(ws) - 49)) as s from d where len(ws) >= 50),
w as (select r, doc_id, s, array_to_string(list_slice(ws, s, s + 49), ' ') as key from p),
f as (select key, min(doc_id) as first from w group by key having min(doc_id) < max(doc_id)),
c as (select distinct r, s + o as place from (select r, s, unnest(generate_series(0, 49)) as o from w join f using (key) where first < doc_id)),
g as (select r, list(place) as gone from c group by r),
k as (select doc_id, ws, coalesce(len(gone), 0) as n_removed, case when gone is null then ws else list_filter(ws, lambda x, i: not list_contains(gone, i)) end as kept from d left join g using (r))
select doc_id, len(ws)::bigint as n_words, n_removed::bigint as n_removed, sha256(array_to_string(kept, ' ')) as kept_sha256 from k
"""
