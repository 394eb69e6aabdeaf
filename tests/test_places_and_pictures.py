"""Boxes in regions, photos turned back to pages, resampled pictures: against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from tallygrid.operators import decode, geometry

RECT = "x double, y double, width double, height double"


def holds(box, region, tol=0.002):
    (x, y, w, h), (rx, ry, rw, rh) = box, region
    return x - w >= rx - tol and x <= rx + rw + tol and y - h >= ry - tol and y <= ry + rh + tol


@pytest.mark.parametrize("scale", [0.001, 1.0, 700.0])
def test_pairs_of_boxes_and_regions_as_nested_loops_find_them(spark, scale):
    rng = random.Random(scale)
    size = lambda: scale * rng.choice([0, 0.001, 0.01, 0.1, 0.5, 3])
    place = lambda: scale * (rng.random() * 2 - 0.5)
    boxes = [(i, place(), place(), size() / 10, size() / 10) for i in range(300)]
    regions = [(i, place(), place(), size(), size()) for i in range(200)] + [(900, 0.1, 0.1, -1.0, 1.0)]
    want = {(b[0], r[0]) for b in boxes for r in regions if holds(b[1:], r[1:]) and min(r[3:]) >= 0}
    odd = [(1000, None, 0.1, 0.1, 0.1), (1001, float("nan"), 0.1, 0.1, 0.1)]
    found = geometry.containment(spark.createDataFrame(boxes + odd, f"id long, {RECT}"), spark.createDataFrame(regions + odd, f"id long, {RECT}"))
    got = [(r["id"], r["region_id"]) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want and want


def test_containment_needs_no_cross_join_and_takes_keys(spark):
    boxes = spark.createDataFrame([("a", 0.5, 0.5, 0.1, 0.1), ("b", 0.5, 0.5, 0.1, 0.1), (None, 0.5, 0.5, 0.1, 0.1)], f"layout string, {RECT}")
    regions = spark.createDataFrame([("a", 0.2, 0.2, 0.6, 0.6)], f"layout string, {RECT}")
    found = geometry.containment(boxes, regions, ("layout",))
    assert [r["layout"] for r in found.collect()] == ["a"]
    plan = geometry.containment(boxes, regions)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert geometry.containment(boxes.limit(0), regions).count() == 0 == geometry.containment(boxes, regions.limit(0)).count()


def test_all_tasks_share_the_pairs_of_small_files(spark):
    boxes = spark.range(0, 400, 1, 1).selectExpr("id", "id % 20 / 20D as x", "floor(id / 20) / 20D as y", "0.01D as width", "0.01D as height")
    regions = boxes.selectExpr("id", "x", "y", "0.15D + id % 3 / 20D as width", "0.2D as height")
    found = geometry.containment(boxes, regions)
    tasks = found.groupBy(F.spark_partition_id()).count().collect()
    pairs = sum(r["count"] for r in tasks)
    assert len(tasks) > 4 and max(r["count"] for r in tasks) < pairs / 2
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "NestedLoop" not in plan


def test_copies_that_go_to_disk_are_few(spark):
    boxes = spark.range(0, 1000, 1, 2).selectExpr("id", "id * 53 % 997 / 997D as x", "id * 71 % 991 / 991D as y", "0.01D as width", "0.01D as height")
    regions = boxes.selectExpr("id", "x", "y", "0.12D as width", "0.12D as height")
    context, group = spark.sparkContext, "copies of containment"
    context.setJobGroup(group, group)
    found = geometry.containment(boxes, regions).filter("id >= 0").count()
    context.setJobGroup("", "")
    jobs = [context.statusTracker().getJobInfo(j) for j in context.statusTracker().getJobIdsForGroup(group)]
    stages = {s for j in jobs for s in j.stageIds}
    store = context._jsc.sc().statusStore()
    written = [x.shuffleWriteRecords() for x in (store.lastStageAttempt(s) for s in stages) if x.status().toString() == "COMPLETE"]
    assert found > 10_000 and 1000 < max(written) <= 9 * 1000


def test_leaves_of_boxes_in_one_place_and_of_several_keys(spark):
    rng = random.Random(4)
    boxes = [(k, 0.5, 0.5, 0.01, 0.01) for k in "ab" for _ in range(100)] + [(rng.choice("ab"), rng.random(), rng.random(), 0.01, 0.01) for _ in range(400)]
    regions = [(rng.choice("abc"), rng.random(), rng.random(), 0.4 * rng.random(), 0.4 * rng.random()) for _ in range(150)]
    frame = lambda rows: spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], f"layout string, {RECT}, i int")
    found = geometry.containment(frame(boxes), frame(regions), ("layout",))
    want = sorted((b[0], i, j) for i, b in enumerate(boxes) for j, r in enumerate(regions) if b[0] == r[0] and holds(b[1:], r[1:]))
    assert sorted((r["layout"], r["i"], r["region_i"]) for r in found.collect()) == want and len(want) > 1000
    assert found.columns == ["layout", "x", "y", "width", "height", "i", *[f"region_{c}" for c in ("x", "y", "width", "height", "i")]]


def test_there_and_back(spark):
    rng, rows = random.Random(8), []
    for i in range(300):
        corners = [(x + rng.uniform(-0.15, 0.15), y + rng.uniform(-0.15, 0.15)) for x, y in ((0.1, 0.1), (0.9, 0.1), (0.9, 0.9), (0.1, 0.9))]
        rows.append((i, rng.random(), rng.random(), corners))
    frame = spark.createDataFrame(rows, "i long, u double, v double, corners array<struct<x: double, y: double>>")
    page = (0.0829, 0.0641, 0.9171, 0.9359)
    x, y = geometry.seen_at(F.col("u"), F.col("v"), page, F.col("corners"))
    back = geometry.rectified(frame.withColumn("px", x).withColumn("py", y), "px", "py", page, "corners").collect()
    assert max(max(abs(r["page_point"]["x"] - r["u"]), abs(r["page_point"]["y"] - r["v"])) for r in back) < 1e-6
    assert max(abs(r["px"] - r["u"]) for r in back) > 0.01


def test_corners_that_no_page_shows_give_null(spark):
    square = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]
    cases = [square, [(0.0, 0.0), (0.5, 0.5), (1.0, 1.0), (0.0, 1.0)], square[:3], [(0.0, 0.0)] * 4, None, [(None, 0.0), *square[1:]]]
    frame = spark.createDataFrame([(i, 0.25, 0.75, c) for i, c in enumerate(cases)], "i long, px double, py double, corners array<struct<x: double, y: double>>")
    got = {r["i"]: r["page_point"] for r in geometry.rectified(frame, "px", "py", (0.0, 0.0, 2.0, 4.0), "corners").collect()}
    assert tuple(got[0]) == (0.5, 3.0) and all(got[i] is None for i in range(1, 6))


def area_mean(pixels, w, h, size):
    share = lambda n, i, k: max(0.0, min((i + 1) * n / size, k + 1) - max(i * n / size, k)) * size / n
    return [sum(pixels[y * w + x] * share(w, c, x) * share(h, r, y) for y in range(h) for x in range(w)) for r in range(size) for c in range(size)]


@pytest.mark.parametrize("w, h, size", [(3, 2, 4), (7, 5, 3), (4, 4, 4), (1, 1, 3), (6, 1, 2)])
def test_resampling_is_the_mean_of_the_area(spark, w, h, size):
    pixels = [float((i * 37) % 256) for i in range(w * h)]
    frame = spark.createDataFrame([(1, pixels), (2, pixels[1:]), (3, None)], "i int, p array<double>")
    got = {r["i"]: r["q"] for r in frame.select("i", decode.resampled(F.col("p"), w, h, size).alias("q")).collect()}
    assert got[1] == pytest.approx(area_mean(pixels, w, h, size)) and got[2] is None and got[3] is None


def test_a_picture_stands_on_white(spark):
    rgba = [10, 20, 30, 255, 10, 20, 30, 0, 0, 0, 0, 51, 255, 255, 255, 255]
    row = spark.createDataFrame([(rgba,)], "p array<int>").select(decode.over_white(F.col("p"), 0).alias("r"), decode.prepared_picture(F.col("p"), 2, 2, 2).alias("m")).first()
    assert row["r"] == pytest.approx([10, 255, 204, 255])
    assert len(row["m"]) == 12 and row["m"][1] == pytest.approx(1) and row["m"][8] == pytest.approx(30 / 127.5 - 1)
