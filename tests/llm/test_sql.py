"""Queries that SQL can express, against DuckDB: on the small tables and on a fixture of odd rows."""

import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from oracle import SF, files, same_rows
from tallygrid.llm import common, decontamination, mixing, queries, substrings, urlfilter

needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables missing")

MID = SF.replace("0.001", "0.01")
PASSAGE = " ".join(f"p{i}" for i in range(70))
ITEM = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"
DOCS = [
    (1, None, "en", "a"), (2, "", "en", "a"), (3, " \t\n ", "de", None), (4, PASSAGE + " tail words here", "en", "a"),
    (5, "head " + PASSAGE, "en", "b"), (6, PASSAGE[:-4], "fr", "B"), (7, "x " * 49 + "x", "fr", "é"), (8, "x\x0bx " * 60, "fr", None),
    (9, "Intro. ALPHA, beta gamma (delta) epsilon zeta eta theta iota kappa lambda mu nu; and more", None, "a"),
    (10, ITEM + " " + ITEM, "en", "b"), (11, "short item", "en", "b"), (12, "a b c d e f g h i j k l m n o p q r s t u short item", "en", "zz"),
    (13, "word " * 400, "en", "b"), (14, "nbsp\xa0word É\x85x", "en", "b"), (15, PASSAGE + " " + PASSAGE, "en", "a"),
]
ITEMS = [(1, ITEM), (2, "short item"), (3, None), (4, " .. "), (5, "SHORT ITEM"), (20, "nu xi omicron")]


def frames():
    docs = pd.DataFrame(DOCS, columns=["doc_id", "text", "lang", "source"])
    return {"documents": docs, "benchmark": pd.DataFrame(ITEMS, columns=["item_id", "text"])}


def docs_of(spark):
    odd = {c: F.lit("clash") for c in ("tag", "n_words", "found", "size", "h", "row", "anchor", "start", "items", "target", "copies", "p", "at", "s_id")}
    return spark.createDataFrame(DOCS, "doc_id long, text string, lang string, source string").withColumns(odd)


def items_of(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("words", F.lit(1)).withColumn("item", F.lit(1))


@needs_data
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_small_tables(spark, name):
    same_rows(queries.QUERIES[name](spark, SF), queries.ORACLE_SQL[name], files())


def test_odd_rows_decontamination(spark):
    same_rows(decontamination.digest(decontamination.decontaminate(docs_of(spark), items_of(spark))), decontamination.ORACLE, frames())


@pytest.mark.parametrize("hot", [1000, 2])
def test_odd_rows_decontamination_without_broadcast(spark, monkeypatch, hot):
    monkeypatch.setattr(decontamination, "BROADCAST_WINDOWS", 0)
    monkeypatch.setattr(common, "HOT_ROWS", hot)
    same_rows(decontamination.digest(decontamination.decontaminate(docs_of(spark), items_of(spark))), decontamination.ORACLE, frames())


def shuffled(spark):
    """Bytes written to shuffles so far."""
    jvm = spark._jvm
    stages = spark._jsc.sc().statusStore().stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


@needs_data
def test_decontamination_without_broadcast_shuffles_little(spark, monkeypatch):
    docs, items = spark.read.parquet(f"{MID}/documents.parquet"), spark.read.parquet(f"{MID}/benchmark.parquet")
    want = sorted(map(tuple, decontamination.digest(decontamination.decontaminate(docs, items)).collect()))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    monkeypatch.setattr(decontamination, "BROADCAST_WINDOWS", 0)
    monkeypatch.setattr(common, "HOT_ROWS", 50)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled(spark)
        got = decontamination.digest(decontamination.decontaminate(docs, items)).collect()
        written = shuffled(spark) - before
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(map(tuple, got)) == want
    assert written < 6 * size, (written, size)


def test_decontamination_of_repeated_rows_null_ids_and_long_texts(spark):
    long = "filler " * 100_000 + ITEM
    rows = [(1, ITEM), (1, ITEM), (None, ITEM), (None, None), (2, long), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one = lambda df: sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["item_ids"], r["contaminated"]) for r in df.collect()), key=repr)
    got = one(decontamination.decontaminate(docs, items_of(spark)))
    hit, no = (15, 15, ["1", "20"], True), (0, 0, [], False)
    assert got == sorted([(1, *hit), (1, *hit), (None, *hit), (None, *no), (2, 100_015, 15, ["1", "20"], False), (3, *no)], key=repr)
    clean = one(decontamination.decontaminate(docs, items_of(spark).limit(0)))
    assert all(x[2:] == (0, [], False) for x in clean) and len(clean) == 6
    assert decontamination.decontaminate(docs.limit(0), items_of(spark)).count() == 0


def test_odd_rows_substrings(spark):
    got = substrings.dedup(docs_of(spark)).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
    same_rows(got, substrings.ORACLE, frames())


def test_rewrite_keeps_columns_and_untouched_texts(spark):
    docs = docs_of(spark)
    rows = {r["doc_id"]: r for r in substrings.rewrite(docs).collect()}
    kept = {r["doc_id"]: r for r in substrings.dedup(docs).collect()}
    before = {r["doc_id"]: r for r in docs.collect()}
    for i, row in rows.items():
        assert row.asDict().keys() == before[i].asDict().keys()
        assert row["text"] == (kept[i]["kept"] if kept[i]["n_removed"] else before[i]["text"])
        assert row["tag"] == "clash"


def test_odd_rows_mixing(spark):
    same_rows(mixing.mix(docs_of(spark)).select("doc_id", "size", "source_size", "target", "taken"), mixing.ORACLE, frames())


@pytest.mark.parametrize("hot", [1000, 2])
def test_mixing_without_broadcast_and_whole_rows(spark, monkeypatch, hot):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    monkeypatch.setattr(common, "HOT_ROWS", hot)
    same_rows(mixing.mix(docs_of(spark)).select("doc_id", "size", "source_size", "target", "taken"), mixing.ORACLE, frames())
    rows = mixing.mix(docs_of(spark), whole_rows=True)
    same_rows(rows.select("doc_id", "size", "source_size", "target", "taken"), mixing.ORACLE, frames())
    assert "lang" in rows.columns and rows.columns.count("size") == 1


def test_targets_of_many_sources_are_filled_by_ranges(spark):
    """More sources than fit one range, against the same rule in plain Python."""
    sizes = {None: 40} | {f"s{i:04d}": (i * i * 7919) % 1009 + 1 for i in range(3000)}
    rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long").repartition(16)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r["source"]: r["target"] for r in mixing.source_targets(rows, (3, 1, 2), 1.5, 2).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    order = sorted(sizes, key=lambda x: (x is None, x or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, still, want = 1.5 * sum(sizes.values()), sum(weight.values()), {}
    for s in sorted(order, key=lambda x: sizes[x] / weight[x]):
        want[s] = min(2 * sizes[s], left / still * weight[s])
        left, still = left - want[s], still - weight[s]
    assert got.keys() == want.keys()
    assert all(got[s] == pytest.approx(want[s]) for s in want)


@needs_data
def test_mixing_of_an_empty_table_and_of_one_hash(spark, monkeypatch):
    assert mixing.mix(docs_of(spark).limit(0)).collect() == []
    monkeypatch.setattr(mixing, "id_hash", lambda key: F.lit(7).cast("long"))
    got = {r["source"]: (r["taken"], r["copies"]) for r in mixing.mix(spark.createDataFrame([(i, "w " * 10, "ab"[i % 2]) for i in range(40)], "doc_id long, text string, source string")).collect()}
    assert set(got) == {"a", "b"} and all(copies in (0, 1, 2) and taken == 10 * copies for taken, copies in got.values())


def test_mixing_comes_near_its_targets(spark):
    got = mixing.mix(spark.read.parquet(f"{SF}/documents.parquet")).toPandas()
    by = got.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), most=("size", "max"), size=("source_size", "first"))
    assert ((by["taken"] - by["target"]).abs() <= by["most"] / 2 + 1e-6).all()
    assert by["target"].sum() == pytest.approx(1.5 * by["size"].sum())
    assert (got["taken"] <= 2 * got["size"]).all()


def test_mixing_budgets_are_nested(spark):
    docs = spark.createDataFrame([(i, "w " * (i % 7 + 1), "ab"[i % 2], "en") for i in range(300)], "doc_id long, text string, source string, lang string")
    small = {r["doc_id"]: r["copies"] for r in mixing.mix(docs, share=0.5).collect()}
    large = {r["doc_id"]: r["copies"] for r in mixing.mix(docs, share=0.9).collect()}
    assert all(small[i] <= large[i] for i in small) and sum(large.values()) > sum(small.values())


URLS = [
    (1, "http://a.b.example.com/x?q#f", "2024-01-15 00:00:00"), (2, "HTTPS://U@A.B.Example.com:80/x/", "2024-02-15 00:00:00"), (3, None, "2024-02-15 00:00:00"),
    (4, "notaurl", "2024-02-15 00:00:00"), (5, "http://b.example.com/", None), (6, "http://c.example.com/x", "2024-03-01 00:00:00"), (7, "http://example.com", "2024-02-29 23:59:59"),
    (8, "http://myexample.com/", "2024-03-15 00:00:00"),
]
ENTRIES = [
    ("l", "domain", "example.com", "block", "2024-02-01"), ("l", "domain", "example.com", "block", "2024-02-01"), ("l", "domain", "example.com", "retract", "2024-03-01"),
    ("m", "host", "b.example.com", "allow", "2024-01-01"), ("m", "url", "a.b.example.com/x", "block", "2024-02-01"), ("m", "domain", None, "block", "2024-02-01"), ("m", "domain", "x.y", "block", None),
    ("k", "domain", "com", "block", "2024-03-10"),
]


def test_url_filter(spark):
    captures = spark.createDataFrame(URLS + URLS[:1], "page_id long, url string, at string").select("page_id", "url", F.to_timestamp("at").alias("fetched"), F.lit(1).alias("host"), F.lit(1).alias("key"))
    got = {r["page_id"]: (r["list"], r["kept"]) for r in urlfilter.judge(captures, urlfilter.entries_frame(spark, ENTRIES)).collect()}
    assert got == {1: (None, True), 2: ("m", False), 3: (None, True), 4: (None, True), 5: (None, True), 6: (None, True), 7: ("l", False), 8: ("k", False)}
    assert urlfilter.judge(captures, urlfilter.entries_frame(spark, ENTRIES)).count() == len(URLS) + 1
    none = urlfilter.judge(captures, urlfilter.entries_frame(spark, []))
    assert none.filter("kept").count() == len(URLS) + 1
    assert urlfilter.judge(captures.limit(0), urlfilter.entries_frame(spark, ENTRIES)).count() == 0


def test_url_filter_without_broadcast(spark, monkeypatch):
    """Hot hosts, and captures without any, are dealt out over tasks."""
    monkeypatch.setattr(common, "HOT_ROWS", 2)
    captures = spark.createDataFrame(URLS * 5, "page_id long, url string, at string").select("page_id", "url", F.to_timestamp("at").alias("fetched"))
    judged = lambda: sorted(map(repr, urlfilter.judge(captures, urlfilter.entries_frame(spark, ENTRIES)).collect()))
    want = judged()
    monkeypatch.setattr(urlfilter, "BROADCAST_ROWS", 0)
    assert judged() == want and len(want) == 5 * len(URLS)


def test_ties_between_lists_and_very_long_urls(spark):
    day = "2024-02-01"
    tied = [("a", "host", "tie.example.com", "allow", day), ("b", "host", "tie.example.com", "block", day), ("c", "host", "tie.example.com", "block", day), ("a", "url", "long.example.com/" + "p" * 100_000, "block", day)]
    urls = ["http://tie.example.com/x", "http://tie.example.com/x", "http://long.example.com/" + "p" * 100_000, "http://long.example.com/" + "p" * 99_999, "http://" + "s." * 2_000 + "tie.example.com/"]
    captures = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("fetched", F.to_timestamp(F.lit("2024-03-01")))
    got = {r["page_id"]: (r["list"], r["action"]) for r in urlfilter.judge(captures, urlfilter.entries_frame(spark, tied)).collect()}
    assert got == {0: ("c", "block"), 1: ("c", "block"), 2: ("a", "block"), 3: (None, None), 4: (None, None)}
