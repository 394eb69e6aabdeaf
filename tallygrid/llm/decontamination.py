"""Benchmark decontamination as a prefix-filtered set join (built-in functions only).

A benchmark item is the set of its windows of ``window`` consecutive words. To be
in a document whole, a window needs all its shingles (word pairs) there, so one
prefix token is necessary and enough: its rarest shingle by the counts over all
documents. Documents meet windows only on that token; the token's place in the
window gives the start (positional bound), the window must end inside the
document (length bound), and what is left is compared word by word.

One plan serves all sizes. A document is cut into rows of (id, place, shingle)
without its text; those meet the prefix tokens, hot ones apart, and the candidate
starts are gathered by document, which is read once more to compare the words. A
few windows are broadcast, which saves shuffling the rows and changes nothing else.

Defined results: null text, or text without words, has no words, no hits and is
clean; a null or wordless item has no window; a null item id counts for hits but
is no item; each input row gives one output row, repeated rows equal ones; with
an empty benchmark everything is clean; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallygrid.llm.common import join_hot, settle

#: Everything in ASCII but digits and lower-case letters, after lower-casing.
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Up to so many windows (a few hundred bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_WINDOWS = 100_000


def padded_words(text: Column) -> Column:
    """The words with one empty word before and one after them."""
    spaced = F.concat(F.lit(" "), F.coalesce(text, F.lit("")), F.lit(" "))
    return F.split(F.translate(spaced, UPPER, LOWER), BREAKS)


def item_windows(benchmark: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """(words, items): each distinct window and the items that hold it."""
    padded = benchmark.select(F.col(id_col).cast("string").alias("item"), padded_words(F.col(text_col)).alias("p"))
    words = padded.select("item", F.slice("p", F.lit(2), F.size("p") - 2).alias("w")).filter(F.size("w") > 0)
    starts = words.select("item", "w", F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))).alias("s"))
    cut = starts.select("item", F.slice("w", F.col("s"), F.lit(window)).alias("words"))
    return cut.groupBy("words").agg(F.collect_set("item").alias("items"))


def _shingle(words: Column, at: Column, pair: bool) -> Column:
    return F.xxhash64(F.get(words, at), F.get(words, at + 1)) if pair else F.xxhash64(F.get(words, at))


def _walk(texts: DataFrame, pair: bool, *columns: Column) -> DataFrame:
    """A row for each word with the shingle that starts there, and ``columns``; the texts stay behind."""
    at = texts.select("*", F.posexplode("p").alias("at", "word")).filter(F.col("at") > 0)
    key = F.xxhash64("word", F.get("p", F.col("at") + 1)) if pair else F.xxhash64("word")
    return at.select(*columns, key.alias("shingle"))


def prefixes(texts: DataFrame, windows: DataFrame, pair: bool, small: bool) -> DataFrame:
    """(shingle, offset, words, window, n): each window's rarest shingle, and how often documents have it.

    A window with a shingle that no document has drops out: it occurs nowhere.
    """
    last = F.size("words") - (1 if pair else 0) - 1
    places = windows.select("window", "words", F.explode(F.sequence(F.lit(0), last)).alias("offset"))
    places = places.select("window", "words", "offset", _shingle(F.col("words"), F.col("offset"), pair).alias("shingle"))
    wanted = places.select("shingle").distinct()
    if small:
        counts = _walk(texts, pair).join(F.broadcast(wanted), "shingle").groupBy("shingle").count()
    else:  # counted before they meet, so that a common shingle is a row a task
        counts = _walk(texts, pair).groupBy("shingle").count().join(wanted, "shingle")
    rated = places.join(counts, "shingle", "left")
    rarest = F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "offset", "shingle")).alias("r")
    chosen = rated.groupBy("window").agg(rarest, F.first("words").alias("words")).filter(F.col("r.n") > 0)
    return settle(chosen.select("r.shingle", "r.offset", "words", "window", "r.n"), "decon-prefixes")


def candidates(texts: DataFrame, windows: DataFrame, pair: bool, small: bool) -> DataFrame:
    """(doc_id, tag, start, words, window): where a window would have to start for its prefix token to stand there."""
    ours = windows.filter((F.size("words") > 1) == pair)
    keyed = prefixes(texts, ours, pair, small)
    rows = _walk(texts, pair, F.col("doc_id"), F.col("tag"), F.col("at"), (F.size("p") - 2).alias("n_words"))
    met = rows.join(F.broadcast(keyed), "shingle") if small else join_hot(rows, keyed, ("shingle",), "n")
    start = F.col("at") - F.col("offset")
    inside = (start >= 1) & (start + F.size("words") - 1 <= F.col("n_words"))
    return met.filter(inside).select("doc_id", "tag", start.alias("start"), "words", "window")


def find_windows(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_id_col: str, item_text_col: str, window: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, tag, n_words, hits) for every row, where ``hits`` lists (start, length, window), and (window, item)."""
    raw = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("tag"), F.col(text_col).cast("string").alias("text"))
    texts = raw.select("doc_id", "tag", padded_words(F.col("text")).alias("p"))
    cut = item_windows(benchmark, id_col=item_id_col, text_col=item_text_col, window=window)
    windows = settle(cut.withColumn("window", F.monotonically_increasing_id()), "decon-windows")
    kinds = {r["pair"]: r["count"] for r in windows.groupBy((F.size("words") > 1).alias("pair")).count().collect()}
    small = sum(kinds.values()) <= BROADCAST_WINDOWS
    found = candidates(texts, windows, True, small)
    if kinds.get(False):
        found = found.unionByName(candidates(texts, windows, False, small))
    near = F.collect_set(F.struct("start", "words", "window")).alias("near")
    # a document has at most a start for each of its words and each window that the word's token begins
    found = settle(found.groupBy(F.col("doc_id").alias("c_id"), F.col("tag").alias("c_tag")).agg(near), "decon-candidates")
    both = raw.join(found, F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("tag") == F.col("c_tag")), "left")
    both = both.select("doc_id", "tag", padded_words(F.col("text")).alias("p"), "near")
    same = F.filter("near", lambda x: F.slice("p", x["start"] + 1, F.size(x["words"])) == x["words"])
    hits = F.transform(same, lambda x: F.struct(x["start"].alias("start"), F.size(x["words"]).alias("length"), x["window"].alias("window")))
    judged = both.select("doc_id", "tag", (F.size("p") - 2).cast("long").alias("n_words"), hits.alias("hits"))
    return settle(judged, "decon-found"), windows.select("window", F.explode("items").alias("item"))


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 13,
    share: float = 0.05,
) -> DataFrame:
    """(doc_id, tag, n_words, n_hit, item_ids, contaminated) for every row.

    ``n_hit`` counts the document's words inside any occurrence of a window,
    ``item_ids`` lists the items with an occurring window, sorted as strings, and
    a document is contaminated when ``share`` of its words or more are hit.
    ``tag`` tells apart rows of one id with different texts.
    """
    found, windows = find_windows(docs, benchmark, id_col, text_col, item_id_col, item_text_col, window)
    hit = found.filter(F.size("hits") > 0)
    pairs = hit.select(F.col("doc_id").alias("h_id"), F.col("tag").alias("h_tag"), F.explode(F.array_distinct("hits.window")).alias("window"))
    pairs = settle(pairs, "decon-pairs")
    counts = pairs.groupBy("window").agg(F.count(F.lit(1)).alias("n"))
    named = join_hot(pairs, settle(windows.join(counts, "window"), "decon-items"), ("window",), "n")
    items = named.groupBy("h_id", "h_tag").agg(F.array_sort(F.collect_set("item")).alias("item_ids"))
    joined = found.join(items, F.col("doc_id").eqNullSafe(F.col("h_id")) & (F.col("tag") == F.col("h_tag")), "left")
    places = F.flatten(F.transform("hits", lambda h: F.sequence(h["start"], h["start"] + h["length"] - 1)))
    n_hit = F.when(F.size("hits") > 0, F.size(F.array_distinct(places))).otherwise(0).cast("long")
    return joined.select(
        "doc_id",
        "tag",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
        ((n_hit > 0) & (n_hit * round(1 / share) >= F.col("n_words"))).alias("contaminated"),
    )


def digest(result: DataFrame) -> DataFrame:
    return result.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


ORACLE = r"""
with w as (select item_id::varchar as item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from benchmark where text is not null),
x as (select distinct item, list_slice(ws, s, s + 12) as ws from (select item, ws, unnest(generate_series(1, greatest(len(ws) - 12, 1))) as s from w where len(ws) > 0)),
d as (select doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as ws, row_number() over () as r from documents),
p as (select r, ws as all_ws, unnest(generate_series(1, len(ws))) as s from d),
lengths as (select distinct len(ws) as n from x),
m as (select p.r, p.s, l.n, x.item from p, lengths l, x where p.s + l.n - 1 <= len(p.all_ws) and len(x.ws) = l.n and x.ws = list_slice(p.all_ws, p.s, p.s + l.n - 1)),
h as (select r, count(distinct place) as n_hit from (select r, unnest(generate_series(s, s + n - 1)) as place from m) group by r),
i as (select r, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as items from m group by r)
select doc_id, len(ws)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(items, '')) as items_sha256,
       coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(ws) as contaminated
from d left join h using (r) left join i using (r)
"""
