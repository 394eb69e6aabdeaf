"""Runs against plain Python: every period of every text tried, and odd rows."""

import hashlib
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from oracle import SF
from tallygrid.llm import periodic, queries

needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables missing")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(words, least=12):
    """Maximal stretches by period, and of equal stretches the smallest period."""
    found, n = {}, len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= 2 * q and not any((j + q - i) >= 2 * p and all(words[x] == words[x + p] for x in range(i, j + q - p)) for p in range(1, q) if q % p == 0):
                found[i, j + q - i, q] = None
            i = j + 1
    return sorted(r for r in found if r[1] >= least)


def plain_digest(doc_id, text):
    words = WORD.findall(text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
    runs = plain_runs(words)
    gone = {i for s, k, q in runs for i in range(s + q, s + k)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    lines = "".join(f"{s},{k},{q}\n" for s, k, q in runs)
    left = " ".join(w for i, w in enumerate(words) if i not in gone)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None, None, None)), best and 1000 * best[1] // best[2], sha(lines), sha(left))


def test_random_words_with_planted_repeats():
    rng = random.Random(5)
    for _ in range(1500):
        k = rng.choice([1, 2, 3, 8])
        words = [rng.randrange(k) for _ in range(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            p = [rng.randrange(k + 1) for _ in range(rng.randint(1, 9))]
            words += (p * rng.randint(2, 6))[: rng.randint(1, 40)]
        assert periodic.runs_of(words) == plain_runs(words)
        assert periodic.runs_of(words, 1) == plain_runs(words, 1)


def test_stretches_leave_out_no_run():
    rng = random.Random(6)
    texts = []
    for _ in range(300):
        words = [rng.randrange(30) for _ in range(rng.randint(0, 60))]
        p = [rng.randrange(30) for _ in range(rng.randint(1, 9))]
        texts.append(words + (p * 6)[: rng.randint(1, 50)] + [rng.randrange(30) for _ in range(rng.randint(0, 20))])
    ids, ends = np.array([w for t in texts for w in t]), np.cumsum([0] + [len(t) for t in texts])
    got = [[] for _ in texts]
    for a, b in periodic.stretches(ids, ends):
        k = int(np.searchsorted(ends, a, "right")) - 1
        got[k] += [(int(a - ends[k]) + s, n, q) for s, n, q in periodic.runs_of(ids[a:b].tolist())]
    assert got == [plain_runs(t) for t in texts] and any(got)


def test_lying_hashes_cost_no_result(monkeypatch):
    monkeypatch.setattr(periodic, "PRIME", 3)
    rng = random.Random(7)
    for _ in range(300):
        words = [rng.randrange(2) for _ in range(rng.randint(0, 40))]
        assert periodic.runs_of(words, 1) == plain_runs(words, 1)


def test_odd_rows(spark):
    texts = [None, "", " \t\n", "one", "a " * 11, "a " * 12, "a " * 12, "x\x0by " * 6, "é\xa0z " * 13, "w " * 120_000, "p q r s t u v " * 2 + "p", "a b " * 7 + "c " * 13 + "a b c " * 5]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("runs", "collapsed", "seed", "start", "longest")})
    found = {r["doc_id"]: r for r in periodic.detect(docs).collect()}
    assert len(found) == len(texts)
    assert [tuple(r) for r in found[9]["runs"]] == [(0, 120_000, 1)] and found[9]["collapsed"] == "w"
    for k, text in enumerate(texts):
        if k != 9:
            assert [tuple(r) for r in found[k]["runs"]] == plain_runs(WORD.findall(text or "")), k
    assert found[0]["collapsed"] == "" and found[0]["n_words"] == 0
    seeds = periodic.detect(docs.union(docs.select(F.lit(None).cast("long"), *docs.columns[1:])), seed=F.lit(None).cast("long"))
    assert seeds.filter("doc_id is null").count() == len(texts)
    assert periodic.digest(periodic.detect(docs.limit(0))).collect() == []


@needs_data
def test_query_over_the_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    short = {d["doc_id"]: d["text"] for d in docs if len(d["text"] or "") < 12_000}
    got = {r["doc_id"]: tuple(r) for r in queries.op13_periodic_runs(spark, SF).collect()}
    assert len(got) == len(docs) and any(r[1] for r in got.values())
    for doc_id, text in short.items():
        assert got[doc_id] == plain_digest(doc_id, text)
