"""Scratch folders: what the session names, a folder of its own in local mode, and nothing else."""

from types import SimpleNamespace

import pytest

from tallygrid.llm import common


def session(master, checkpoints=None):
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: None, setCheckpointDir=lambda path: None)
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: checkpoints), sparkContext=context)


def test_only_a_local_session_gets_a_folder_of_its_own():
    assert common.shared_dir(session("spark://host:7077", "hdfs:///scratch")) == "hdfs:///scratch"
    assert common.shared_dir(session("local[2]")).startswith("/")
    for master in ("spark://host:7077", "yarn", "k8s://host"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            common.shared_dir(session(master))


def test_hot_joins_lose_and_double_nothing(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    rows = spark.createDataFrame([(i, 0 if i % 3 else i % 7) for i in range(300)], "i long, k long")
    marks = rows.groupBy("k").count().filter("k <> 6").selectExpr("k", "k * 10 as m", "count as n")
    want = sorted(map(tuple, rows.join(marks.drop("n"), "k").select("i", "m").collect()))
    assert sorted(map(tuple, common.join_hot(rows, marks, ("k",), "n").select("i", "m").collect())) == want
    assert sorted(map(tuple, common.join_spread(rows, marks.drop("n"), "k", "i").select("i", "m").collect())) == want


def test_release_deletes_what_was_settled(spark):
    began = common.scratch_count()
    kept = common.settle(spark.range(3), "test-kept")
    common.settle(spark.range(4), "test-gone")
    common.release(spark, began, but="test-kept")
    assert common.scratch_count() == began + 1 and kept.count() == 3
    common.release(spark, began)
    assert common.scratch_count() == began
