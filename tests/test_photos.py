import pytest
from pyspark.sql import functions as F

from tallygrid.operators import geometry
from tallygrid.sources import photos


def test_photos(spark, tmp_path):
    (tmp_path / "a.PNG").write_bytes(b"x" * 10)
    (tmp_path / "b.txt").write_bytes(b"x")
    got = {r["photo"]["name"]: r["photo"] for r in photos.read_photos(spark, str(tmp_path)).collect()}
    assert (got["a.PNG"]["type"], got["a.PNG"]["size"], got["a.PNG"]["error"]) == ("image/png", 10, "")
    assert got["b.txt"]["type"] == "" and got["b.txt"]["preview"]
    assert photos.read_photos(spark, str(tmp_path), content=True).filter(F.length("content") == 10).count() == 1


def test_requests(spark):
    rows = spark.createDataFrame([("1", "data:x"), ("0", "data:x"), (None, "data:x"), ("2", None)], "id string, image string")
    got = rows.select(photos.reply(F.col("id"), F.length("image"), photos.request_error(F.col("id"), F.col("image"))).alias("r")).collect()
    assert [(r["r"]["result"], r["r"]["error"]) for r in got] == [(6, None), (None, "missing id"), (None, "missing id"), (None, "missing image")]


def test_page_points_in_a_photo(spark):
    corners = [(10.0, 20.0), (110.0, 30.0), (100.0, 150.0), (5.0, 130.0)]
    rows = spark.createDataFrame([(x, y, corners) for x, y in ((0.1, 0.1), (0.9, 0.1), (0.9, 0.9), (0.1, 0.9), (0.5, 0.5))], "x double, y double, c array<struct<x: double, y: double>>")
    got = rows.select(*geometry.seen_at(F.col("x"), F.col("y"), (0.1, 0.1, 0.9, 0.9), F.col("c"))).collect()
    for have, want in zip(got, corners):
        assert tuple(have) == pytest.approx(want)
    # the middle is where the diagonals cross
    (ax, ay), (bx, by), (cx, cy), (dx, dy) = corners
    t = ((bx - ax) * (by - dy) - (by - ay) * (bx - dx)) / ((cx - ax) * (by - dy) - (cy - ay) * (bx - dx))
    assert tuple(got[4]) == pytest.approx((ax + t * (cx - ax), ay + t * (cy - ay)))
