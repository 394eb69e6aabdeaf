"""The pipeline's stages against plain Python on the smallest tables."""

import os
import re

import pytest

import corpus_pipeline
from oracle import SF
from tallygrid.llm.common import settle, table
from tests_llm_plain import classes_of, removed_words

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables missing")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "ngram_jaccard_join", "substring_dedup", "benchmark_decontamination", "source_mixing"]
    docs = table(spark, SF, "documents")
    columns = docs.columns
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        before = rows(docs)
        docs = settle(stage(spark, docs, SF), f"test-{name}")
        after = rows(docs)
        kept.append(len(after))
        if name != "source_mixing":
            assert docs.columns == columns
        if name == "quality_classifier":
            labels = {r["doc_id"]: r["quality"] for r in table(spark, SF, "labels").collect()}
            wrong = sum((i in after) != bool(q) for i, q in labels.items())
            assert set(after) <= set(before) and wrong <= 0.1 * len(labels)
        elif name == "ngram_jaccard_join":
            top = classes_of({i: r["text"] for i, r in before.items()}, 5, 80)
            assert set(after) == {i for i in before if top[i] == i}
        elif name == "substring_dedup":
            gone = removed_words({i: r["text"] for i, r in before.items()}, 50)
            assert set(after) == set(before)
            for i, r in after.items():
                words = WORD.findall(before[i]["text"] or "")
                assert WORD.findall(r["text"] or "") == [w for k, w in enumerate(words) if k not in gone[i]]
                assert r["n_chars"] == len(r["text"])
        elif name == "benchmark_decontamination":
            windows = set()
            for item in table(spark, SF, "benchmark").collect():
                w = ITEM_WORD.findall((item["text"] or "").lower())
                windows |= {tuple(w[k : k + 13]) for k in range(max(len(w) - 12, 1))} if w else set()
            for i, r in before.items():
                w = ITEM_WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or ""))
                hit = {p for n in {len(x) for x in windows} for k in range(len(w) - n + 1) if tuple(w[k : k + n]) in windows for p in range(k, k + n)}
                assert (i in after) == (not hit or 20 * len(hit) < len(w))
        else:
            assert set(after) <= set(before) and all(1 <= r["copies"] <= 2 and r["taken"] == r["copies"] * r["size"] for r in after.values())
            assert all(r["text"] == before[i]["text"] for i, r in after.items())
    assert kept == sorted(kept, reverse=True) and kept[-1] > 0


def test_run_gives_the_same_twice(spark):
    first, second = (sorted((r["doc_id"], r["taken"], r["text"]) for r in corpus_pipeline.run(spark, SF).collect()) for _ in range(2))
    assert first == second
