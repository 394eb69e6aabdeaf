"""The trie against its SQL: the small tables, deep and shallow fixtures, odd rows."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from oracle import SF, same_rows
from tallygrid.llm import common, prefixtrie

SCHEMA = "conv_id long, turn long, role string, text string"


def same(spark, rows):
    clash = {c: F.lit("clash") for c in ("pos", "th", "size", "depth", "node", "parent", "n", "left", "below", "part", "member")}
    frame = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"})
    same_rows(prefixtrie.trie(spark.createDataFrame(rows, SCHEMA).withColumns(clash)), prefixtrie.ORACLE, {"conversations": frame})


def test_middle_table(spark):
    path = SF.replace("0.001", "0.01") + "/conversations.parquet"
    same_rows(prefixtrie.trie(spark.read.parquet(path)), prefixtrie.ORACLE, {"conversations": path})


def test_odd_rows(spark):
    rows = [
        (100, 0, "user", "a"), (100, 1, "bot", "bb"), (100, 2, "user", "ccc"), (101, 0, "user", "x"), (102, None, None, None), (102, 1, "user", "é\U0001f600"), (102, 1, "user", "é\U0001f600"),
        (103, 5, "user", "a"), (103, 5, "bot", "a"), (None, 0, "user", "lost"), (-5, 0, "user", "a"), (-105, 1, "user", "a"), (250, 0, "", ""), (251, 0, None, ""), (252, 0, "1:", "2"), (253, 0, "1", ":2"),
    ]
    same(spark, rows)


def test_copies_and_late_partings(spark):
    long = [("user" if t % 2 else "bot", f"t{t % 7}") for t in range(40)]
    rows = []
    for c in range(1000, 1040):
        for t, (role, text) in enumerate(long[: 40 if c % 3 else 25]):
            rows.append((c, t, role, text if (c % 5, t) != (0, 17) else "other"))
    same(spark, rows)


@pytest.mark.parametrize("hot", [5, 1000])
def test_a_hot_first_turn(spark, monkeypatch, hot):
    monkeypatch.setattr(common, "HOT_ROWS", hot)
    monkeypatch.setattr(prefixtrie, "RANGE", 7)
    same(spark, [(c, t, "user", "same" if t == 0 or c % 3 else f"{c % 4} {t}") for c in range(300) for t in range(c % 4 + 1)])


def test_no_conversations(spark):
    none = prefixtrie.trie(spark.createDataFrame([], SCHEMA))
    assert none.collect() == [] and none.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
