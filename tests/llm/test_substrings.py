"""The relative Lempel-Ziv parse: its factors, repetitive texts, hot keys and odd rows."""

import random

import pyarrow as pa
import pytest

from tallygrid.llm import common, substrings
from tests_llm_plain import WORD, removed_words


def loops(seed=5):
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(120)]
    texts = ["x " * 400, "x " * 90, "a b c " * 200, "a b c " * 30 + "tail " * 60, "y " * 49 + "x " * 60]
    for _ in range(40):
        lo = rng.randrange(60)
        head, tail = ([f"w{rng.randrange(9999)}" for _ in range(rng.randrange(80))] for _ in range(2))
        texts.append(" ".join(head + passage[lo : lo + rng.randrange(45, 70)] + tail))
    rng.shuffle(texts)
    return dict(enumerate(texts))


def kept(text, gone):
    return " ".join(w for i, w in enumerate(WORD.findall(text or "")) if i not in gone)


def maximal(factors):
    """No factor lies in another's reach, and none goes on another of its source and distance."""
    spans = [(f["start"], f["start"] + f["length"], f["source"], f["start"] - f["place"]) for f in factors]
    lone = all(b[1] > a[1] and b[0] > a[0] for a, b in zip(spans, spans[1:]))
    return lone and not any(a[2:] == b[2:] and a[0] <= b[0] <= a[1] for i, a in enumerate(spans) for j, b in enumerate(spans) if i != j)


def plain_parse(matches):
    """Of all runs of touching matches of one source and distance, from the left the one that reaches farthest."""
    runs = []
    for s, d, a, b in sorted((m["source"], m["start"] - m["place"], m["start"], m["start"] + m["length"]) for m in matches):
        if runs and runs[-1][:2] == [s, d] and a <= runs[-1][3]:
            runs[-1][3] = max(b, runs[-1][3])
        else:
            runs.append([s, d, a, b])
    covered = {i for _, _, a, b in runs for i in range(a, b)}
    return runs, covered


def test_greedy_factors_cover_what_the_matches_cover():
    rng = random.Random(12)
    lists = []
    for _ in range(400):
        lists.append([{"start": a, "length": rng.randrange(5, 12), "source": rng.randrange(3), "place": a - rng.choice([0, 1, -3])} for a in (rng.randrange(40) for _ in range(rng.randrange(0, 12)))])
    kind = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("source", pa.int64()), ("place", pa.int32())]))
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(400)), "tag": [0] * 400, "found": pa.array(lists, kind)})
    for given, found in zip(lists, substrings.greedy(batch).column("found").to_pylist()):
        runs, covered = plain_parse(given)
        assert {i for f in found for i in range(f["start"], f["start"] + f["length"])} == covered
        assert all([f["source"], f["start"] - f["place"], f["start"], f["start"] + f["length"]] in runs for f in found) and maximal(found)
        at = -1
        for f in found:  # each is the farthest of those that begin at or before where the parse stands
            stands = at if any(a <= at < b for _, _, a, b in runs) else min(a for _, _, a, b in runs if b > at)
            assert f["start"] + f["length"] == max(b for _, _, a, b in runs if a <= stands)
            at = f["start"] + f["length"]


@pytest.mark.parametrize("hot", [1000, 2])
def test_parse_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(common, "HOT_ROWS", hot)
    texts = loops()
    want = removed_words(texts, 50)
    words = {i: WORD.findall(t) for i, t in texts.items()}
    rows = substrings.dedup(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["kept"] for r in rows} == {i: kept(t, want[i]) for i, t in texts.items()}
    for r in rows:
        for f in r["factors"] or ():
            assert f["length"] >= 50 and f["source"] < r["doc_id"]
            here = words[r["doc_id"]][f["start"] : f["start"] + f["length"]]
            assert here == words[f["source"]][f["place"] : f["place"] + f["length"]]
        assert maximal(r["factors"] or ())


def test_long_copies_are_one_factor(spark):
    rng = random.Random(1)
    copied = " ".join(f"w{rng.randrange(10**6)}" for _ in range(2000))
    rows = substrings.dedup(spark.createDataFrame([(1, "before it " + copied), (2, copied)], "doc_id long, text string")).collect()
    (factor,) = next(r["factors"] for r in rows if r["doc_id"] == 2)
    assert (factor["start"], factor["length"], factor["source"], factor["place"]) == (0, 2000, 1, 2)


@pytest.mark.parametrize("text, most", [("word " * 10_000, 1), ("one two three " * 4_000, 1), ("one " * 500 + "two " * 500, 60)])
def test_repetitive_texts_make_few_blocks(text, most):
    batch = pa.RecordBatch.from_pydict({"doc_id": [1], "tag": [1], "text": [text]})
    assert substrings.blocks(batch, 50).num_rows <= most


def test_odd_rows(spark):
    long = " ".join(f"v{i % 7001}" for i in range(200_000))
    rows = [(1, long), (1, long), (2, long), (None, long), (None, None), (3, None), (4, ""), (5, "short")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"]) for r in substrings.dedup(frame).collect()), key=repr)
    n = 200_000
    assert got == sorted([(1, n, 0), (1, n, 0), (2, n, n), (None, n, 0), (None, 0, 0), (3, 0, 0), (4, 0, 0), (5, 1, 0)], key=repr)
    empty = substrings.dedup(frame.limit(0))
    assert empty.count() == 0 and "kept" in empty.columns
    assert substrings.rewrite(frame.limit(0)).count() == 0
