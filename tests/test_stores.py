"""Replayed actions, replaced stores, matched requests: against plain Python, and what may go wrong."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from tallygrid.operators import records, requests
from tallygrid.sources import store

ACTION = "device_id string, seq long, kind string, position int"


def played(actions):
    stores = defaultdict(list)
    for device, seq, kind, position in sorted((a for a in actions if a[0] is not None and a[1] is not None), key=lambda a: a[:2]):
        kept = stores[device]
        if kind == "append":
            kept.append(seq)
        elif kind == "clear":
            kept.clear()
        elif kind == "delete" and position is not None and 0 <= position < len(kept):
            del kept[position]
    return sorted((d, i, s) for d, kept in stores.items() for i, s in enumerate(kept))


def test_replay_goes_as_a_list_goes(spark):
    rng = random.Random(9)
    kinds = ["append"] * 6 + ["delete"] * 3 + ["other", None]
    actions = [(rng.choice("abc"), i, rng.choice(kinds) if rng.random() > 0.02 else "clear", rng.choice([None, -1, 0, 1, 2, 5, 50])) for i in range(600)]
    actions += [(None, 1, "append", None), ("d", None, "append", None), ("e", 1, "clear", None), ("f", 1, "delete", 0)]
    rng.shuffle(actions)
    got = records.replayed(spark.createDataFrame(actions, ACTION).withColumn("_clear", F.lit(1)))
    assert sorted(map(tuple, got.collect())) == played(actions)
    assert records.replayed(spark.createDataFrame([], ACTION)).collect() == []


def test_a_store_is_replaced_whole_and_may_read_itself(spark, tmp_path):
    path = str(tmp_path / "s")
    assert store.load(spark, path, "v long").count() == 0
    assert store.replace(spark.range(5).toDF("v"), path) == (True, None)
    first = store.load(spark, path, "v long")
    assert store.replace(first.select((F.col("v") * 10).alias("v")), path).saved
    assert sorted(r["v"] for r in store.load(spark, path, "v long").collect()) == [0, 10, 20, 30, 40]
    assert first.count() == 5  # a reader of the version before still reads it
    assert store.replace(spark.range(0).toDF("v"), path).saved and store.load(spark, path, "v long").count() == 0
    assert len([p for p in (tmp_path / "s").iterdir() if p.is_dir()]) == 2
    store.drop(spark, path)
    assert store.load(spark, path, "v long").count() == 0


def test_a_failing_writer_loses_nothing(spark, tmp_path):
    path = str(tmp_path / "s")
    store.replace(spark.range(5).toDF("v"), path)
    bad = spark.range(8, numPartitions=4).select(F.when(F.col("id") == 6, F.raise_error(F.lit("no room"))).otherwise(F.col("id")).cast("long").alias("v"))
    answer = store.replace(bad, path)
    assert not answer.saved and answer.error
    assert sorted(r["v"] for r in store.load(spark, path, "v long").collect()) == [0, 1, 2, 3, 4]
    assert len([p for p in (tmp_path / "s").iterdir() if p.is_dir()]) == 1


def matched(asked, given, limit, horizon):
    out = {k: [] for k, _, _ in asked}
    for i, at, error in given:
        before = [(a, k) for k, j, a in asked if j == i and i is not None and at is not None and a is not None and a <= at]
        if before and at - max(before)[0] <= horizon:
            out[max(before)[1]].append((at, error is not None, error))
    rows = []
    for k, i, a in asked:
        got = sorted(out[k], key=lambda r: (r[0], r[1], r[2] or ""))
        status = "unanswered" if not got else "failed" if got[0][1] else "late" if got[0][0] - a > limit else "answered"
        rows.append((k, status, len(got) > 1, len(got), got[0][0] if got else None, got[0][2] if got else None))
    return sorted(rows)


def test_replies_go_to_the_last_request_before_them(spark):
    rng = random.Random(10)
    ids = ["hot"] * 8 + ["a", "b", None]
    asked = [(k, rng.choice(ids), rng.choice([None] + [rng.randrange(4000)] * 20)) for k in range(300)]
    given = [(rng.choice(ids), rng.randrange(4000), rng.choice([None, "e1", "e2"])) for _ in range(300)]
    at = F.timestamp_seconds("at").alias("at")
    left = spark.createDataFrame(asked, "key long, id string, at long").select("key", "id", at)
    right = spark.createDataFrame(given, "id string, at long, error string").select("id", at, "error")
    for limit, horizon in ((3, 20), (30, 30), (5, 10_000), (0, 0)):
        got = requests.matched(left, right, limit, horizon).select("key", "status", "repeated", "replies", F.unix_seconds("replied").alias("s"), "error")
        assert sorted(map(tuple, got.collect())) == matched(asked, given, limit, horizon)
    assert requests.matched(left.limit(0), right, 1, 2).count() == 0
    assert {r["status"] for r in requests.matched(left, right.limit(0), 1, 2).collect()} == {"unanswered"}
