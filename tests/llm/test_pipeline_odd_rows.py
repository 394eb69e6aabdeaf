"""The pipeline's stages on nulls, empty and long texts, repeated rows, clashing columns and empty tables."""

import random
import re
from collections import Counter

import pytest

import corpus_pipeline
from tallygrid.llm.common import settle
from tests_llm_plain import classes_of, removed_words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
COLUMNS = "doc_id long, text string, source string, size string, target string, copies string, taken int, key string, tag string, n int, h1 string, contaminated string, component_id long"
CLASHING = ("size", "target", "copies", "taken")


def some_rows():
    rng = random.Random(8)

    def words(n, stem="w"):
        return " ".join(f"{stem}{rng.randrange(10**6)}" for _ in range(n))

    passage, item, near = words(60), words(13, "item"), words(40)
    texts = [(1, words(30) + " " + passage), (2, passage + " " + words(20)), (3, None), (4, ""), (5, " \n "), (6, "one"), (7, near), (8, near + " more")]
    texts += [(9, item + " " + words(30)), (10, item + " " + words(400)), (11, words(60_000)), (12, "again " * 40_000), (13, "é" * 200_000)]
    texts += [(14, "twice " + near[::-1])] * 2 + [(None, words(25)), (None, None)]
    rows = [(i, t, [None, "a", "b"][k % 3], "s", "t", "c", 7, "k", "g", 5, "h", "yes", 1) for k, (i, t) in enumerate(texts)]
    return rows, [("q1", item), ("q2", None), (None, ""), ("q1", item)]


@pytest.fixture
def tables(spark, tmp_path):
    def write(rows, items, labels=()):
        spark.createDataFrame(rows, COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
        spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
        spark.createDataFrame(list(labels), "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
        return str(tmp_path)

    return write


def item_words(text):
    return ITEM_WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def contaminated(text, window):
    w = item_words(text)
    hit = {p for k in range(len(w) - len(window) + 1) if w[k : k + len(window)] == window for p in range(k, k + len(window))}
    return bool(hit) and 20 * len(hit) >= len(w)


def test_odd_rows_through_every_stage(spark, tables):
    rows, items = some_rows()
    sf_dir = tables(rows, items)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in docs.collect()]
        docs = settle(stage(spark, docs, sf_dir), f"test-odd-{name}")
        after = [tuple(r) for r in docs.collect()]
        texts = {r[0]: r[1] for r in before if r[0] is not None}
        if name != "source_mixing":
            assert docs.columns == columns
        if name == "quality_classifier":  # nothing to learn from: everything is kept
            assert Counter(after) == Counter(before)
        elif name == "ngram_jaccard_join":
            top = classes_of(texts, 5, 80)
            assert Counter(after) == Counter(r for r in before if r[0] is None or top[r[0]] == r[0])
            assert {r[0] for r in before} - {r[0] for r in after} == {8}
        elif name == "substring_dedup":
            gone = removed_words(texts, 50)
            assert sum(map(len, gone.values())) == 60
            assert Counter((r[0], *r[2:]) for r in after) == Counter((r[0], *r[2:]) for r in before)
            for r in after:
                if r[0] is not None:
                    assert WORD.findall(r[1] or "") == [w for k, w in enumerate(WORD.findall(texts[r[0]] or "")) if k not in gone[r[0]]]
        elif name == "benchmark_decontamination":
            window = item_words(items[0][1])
            assert Counter(after) == Counter(r for r in before if not contaminated(r[1], window))
            assert {r[0] for r in before} - {r[0] for r in after} == {9}
        else:
            assert docs.columns == [c for c in columns if c not in CLASHING] + ["size", "source_size", "target", "copies", "taken"]
            sizes = Counter()
            for r in before:
                sizes[r[2]] += len(WORD.findall(r[1] or ""))
            own = [columns.index(c) for c in columns if c not in CLASHING]
            whole = Counter(tuple(r[k] for k in own) for r in before)
            taken = Counter()
            for r in docs.collect():
                assert r["size"] == len(WORD.findall(r["text"] or "")) and r["source_size"] == sizes[r["source"]]
                assert 1 <= r["copies"] <= 2 and r["taken"] == r["copies"] * r["size"]
                taken[tuple(r[: len(own)])] += 1
            assert taken and not taken - whole


def test_empty_tables_through_every_stage(spark, tables):
    sf_dir = tables([], [])
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = settle(stage(spark, docs, sf_dir), f"test-empty-{name}")
        assert docs.count() == 0
    assert corpus_pipeline.run(spark, sf_dir).count() == 0
