import math

import pytest
from pyspark.sql import functions as F

from tallygrid.operators import decode
from tallygrid.plans import documents

INF, NAN = float("inf"), float("nan")


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def doubles(values):
    return F.array(*[F.lit(float(v)) for v in values]) if values else F.array().cast("array<double>")


@pytest.mark.parametrize("scores, token, probability", [
    ([1, 3, 3], 1, 1 / (math.exp(-2) + 2)), ([5], 0, 1.0), ([NAN, 1, 2], 2, 0.0), ([NAN], 0, 0.0), ([], 0, 0.0),
    ([1, INF], 1, 0.0), ([-INF, -INF], 0, 0.0), ([-INF, 2], 1, 1.0),
])
def test_greedy_step(spark, scores, token, probability):
    got = one(spark, decode.greedy_step(doubles(scores)))
    assert got["token"] == token and got["probability"] == pytest.approx(probability)


def test_greedy_step_of_null(spark):
    assert one(spark, decode.greedy_step(F.lit(None).cast("array<double>"))) is None


def test_digit_table():
    assert len(set(decode.DIGIT_TOKENS)) == 100


T = decode.DIGIT_TOKENS


@pytest.mark.parametrize("tokens, limit, want", [
    ([2], 4, ("", True, True, None)),
    ([2, 2, 2], 4, ("", True, True, None)),
    ([2, T[7], 2, T[12]], 4, ("712", False, True, None)),
    ([2, 3], 4, ("", False, False, "unknown-nonnumeric-token")),
    ([2, None], 4, ("", False, False, "unknown-nonnumeric-token")),
    ([2, T[12], T[34]], 4, ("1234", False, True, None)),
    ([2, T[12], T[34], T[5]], 4, ("12345", False, False, "layout-length-contract")),
    ([2, T[12]], 1, ("12", False, False, "layout-length-contract")),
    ([], 4, ("", True, True, None)),
])
def test_decode(spark, tokens, limit, want):
    column = F.array(*[F.lit(t).cast("int") for t in tokens]) if tokens else F.array().cast("array<int>")
    assert tuple(one(spark, decode.decode(column, F.lit(limit)))) == want


@pytest.mark.parametrize("text, blank, valid, slots, optional, want", [
    ("5", False, True, 2, [0], [0]), ("55", False, True, 2, [0], []), ("", True, True, 3, [1, 0, 0, 9, -1, 0.5], [0, 1]),
    ("5", False, True, 3, [0], []), ("5", False, False, 2, [0], []), ("5", False, True, 2, [], []), ("555", False, True, 2, [0], []),
    ("5", False, True, 2, [None], [0]), ("5", False, True, None, [0], []), ("55", False, True, 3, [1, 2], [1]),
])
def test_blank_slots(spark, text, blank, valid, slots, optional, want):
    read = F.struct(F.lit(text).alias("text"), F.lit(blank).alias("blank"), F.lit(valid).alias("valid"))
    column = F.array(*[F.lit(x).cast("double") for x in optional]) if optional else F.array().cast("array<double>")
    assert one(spark, decode.blank_slots(read, F.lit(slots).cast("int"), column)) == want


@pytest.mark.parametrize("asked, want", [(None, 4), (0, 4), (NAN, 4), (2, 2), (9, 4), (-3, 1), (2.5, 2.5)])
def test_digit_limit(spark, asked, want):
    assert one(spark, decode.digit_limit(F.lit(asked).cast("double"))) == want


def test_confidence(spark):
    assert tuple(one(spark, decode.confidence(doubles([0.5, 1.0])))) == (0.5, 0.75)
    assert tuple(one(spark, decode.confidence(doubles([])))) == (0.0, 0.0)


def test_planes_and_bypass(spark):
    rgba = F.array(*[F.lit(x) for x in (0, 255, 51, 9, 255, 0, 102, 9)])
    assert one(spark, decode.planes(rgba)) == pytest.approx([-1, 1, 1, -1, -0.6, -0.2])
    assert one(spark, decode.pixels_or(doubles([1, 2]), doubles([3]), 2)) == [1, 2]
    assert one(spark, decode.pixels_or(doubles([1]), doubles([3]), 2)) == [3]


def test_recognize(spark):
    def scores(token):
        return [1.0 if i == token else 0.0 for i in range(600)]

    rows = spark.createDataFrame(
        [(1, [scores(T[7]), scores(2), scores(T[1])], ("", 2, None, [0.0])), (2, [scores(2)], ("cards", 2, 1.0, [0.0, 1.0])), (3, None, ("x", 1, 0.0, None))],
        "id int, steps array<array<double>>, contract struct<layout_family: string, slots: int, max_digits: double, optional: array<double>>",
    )
    got = {r["id"]: r["reading"] for r in decode.recognize(rows, "steps", "contract").collect()}
    assert got[1]["tokens"] == [2, T[7], 2] and got[1]["decoded"]["text"] == "7" and got[1]["blank_slots"] == [0]
    assert got[1]["layout_family"] == "unknown" and got[1]["limit"] == 4
    assert got[2]["decoded"]["blank"] and got[2]["blank_slots"] == [0, 1] and got[2]["limit"] == 1
    assert got[3]["tokens"] == [2] and got[3]["least"] == 0


def test_all_tasks_share_the_readings_of_a_small_file(spark, tmp_path):
    spark.range(0, 200, 1, 1).selectExpr("id as p_partkey", "cast(id % 50 as int) as p_size").write.parquet(f"{tmp_path}/part.parquet")
    read = documents.recognized_answers(spark, str(tmp_path)).withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
    assert len(read) > 4 and sum(r["count"] for r in read) == 200
