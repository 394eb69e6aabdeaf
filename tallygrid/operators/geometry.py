"""Boxes, regions and guide lines on a page with normalized coordinates.

A box's (x, y) is its bottom right corner; a region's is its top left.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def box_in_region(box: Column, region: Column, tolerance: float = 0.002) -> Column:
    """Whether a box struct(x, y, width, height) lies in a region of the same fields."""
    return (
        (box["x"] - box["width"] >= region["x"] - tolerance)
        & (box["x"] <= region["x"] + region["width"] + tolerance)
        & (box["y"] - box["height"] >= region["y"] - tolerance)
        & (box["y"] <= region["y"] + region["height"] + tolerance)
    )


def guide_lines(boxes: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """(group, guide_x, y1, y2) between each box and the next of its group: the middle of the gap, as high as the box."""
    following = Window.partitionBy(*group).orderBy(*order)
    left = F.lead(F.col("x") - F.col("width")).over(following)
    lines = boxes.select(*group, *order, ((F.col("x") + left) / 2).alias("guide_x"), (F.col("y") - F.col("height")).alias("y1"), F.col("y").alias("y2"))
    return lines.filter(F.col("guide_x").isNotNull())


def seen_at(x: Column, y: Column, page: tuple[float, float, float, float], corners: Column) -> tuple[Column, Column]:
    """Where a point of the page stands in a photo, from where its four anchors were found.

    ``page`` is the anchors' rectangle (left, top, right, bottom) on the page, and
    ``corners`` an array of struct(x, y) in the photo: top left, top right, bottom
    right, bottom left. The projective map is the closed form of a unit square's.
    """
    left, top, right, bottom = page
    u, v = (x - left) / (right - left), (y - top) / (bottom - top)
    a, b, c, d = (F.get(corners, F.lit(i)) for i in range(4))

    def coefficients(of: str) -> tuple[Column, Column, Column]:
        return b[of] - c[of], d[of] - c[of], a[of] - b[of] + c[of] - d[of]

    (x1, x2, x3), (y1, y2, y3) = coefficients("x"), coefficients("y")
    across = x1 * y2 - x2 * y1
    g, h = (x3 * y2 - x2 * y3) / across, (x1 * y3 - x3 * y1) / across
    depth = g * u + h * v + 1

    def place(of: str) -> Column:
        return (a[of] + (b[of] - a[of] + g * b[of]) * u + (d[of] - a[of] + h * d[of]) * v) / depth

    return place("x"), place("y")


#: Grids by size 2 ** -level: regions as large as a million pages go to the first, small ones to finer ones.
LEVELS = range(-20, 12)
#: A cell's side is its grid's size by this: more cells for tasks to share, more copies of a region on their disks.
FINER = 2
#: Boxes in a leaf at most.
LEAF = 32


def _cells(value: Column, level: Column) -> Column:
    return F.floor(value * F.pow(F.lit(2.0), level) * FINER).cast("long")


def _leaves(boxes: DataFrame, cell: list[str]) -> DataFrame:
    """The boxes of each cell in leaves (``_boxes``) with the bounds of their edges, as an R-tree is packed: strips by x, cut by y.

    Boxes that are partitioned by ``cell`` are not shuffled.
    """
    here = Window.partitionBy(*cell)
    strips = F.ceil(F.sqrt(F.count(F.lit(1)).over(here) / LEAF))
    strip = F.floor((F.row_number().over(here.orderBy("x")) - 1) / (strips * LEAF))
    leaf = F.floor((F.row_number().over(Window.partitionBy(*cell, "_strip").orderBy("y")) - 1) / LEAF)
    left, top = F.col("x") - F.col("width"), F.col("y") - F.col("height")
    bounds = [F.max(left).alias("_left"), F.min("x").alias("_right"), F.max(top).alias("_top"), F.min("y").alias("_bottom")]
    held = F.collect_list(F.struct(*[c for c in boxes.columns if c not in cell])).alias("_boxes")
    return boxes.withColumn("_strip", strip).withColumn("_leaf", leaf).groupBy(*cell, "_strip", "_leaf").agg(*bounds, held)


def containment(boxes: DataFrame, regions: DataFrame, keys: tuple[str, ...] = (), tolerance: float = 0.002) -> DataFrame:
    """All pairs of a row of ``boxes`` and a row of ``regions`` that holds it: a range join through cells.

    Both have x, y, width and height; boxes by their bottom right, regions by their top
    left corner. ``keys`` are columns that must be equal (such as a layout), none are
    needed. Columns of the regions are named with ``region_`` before them.

    A region, with its tolerance, goes to the grid of its size, whose cells are half of it
    to all of it, so it touches nine cells at most; a box's corner has one cell in each
    grid that has regions, so no pair comes twice. Only these copies are shuffled. In a
    cell, boxes that stand together are packed in leaves, and a region is compared with
    the boxes of those leaves alone whose bounds it meets, so what is compared stays near
    what is found. A leaf's boxes come again for each of its regions in the same order,
    so files of pairs compress well. The pairs themselves grow with boxes times regions.
    They come from tables of few bytes, so all the session's shuffle partitions share
    them, and neither side is broadcast. Boxes or regions with a null or NaN number are
    in no pair; a region of negative size holds nothing.
    """
    sides = [F.col(c).cast("double") for c in ("width", "height")]
    whole = reduce(Column.__and__, [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in ("x", "y", "width", "height")])
    span = F.greatest(*sides) + 2 * tolerance
    level = F.greatest(F.lit(LEVELS[0]), F.least(F.lit(LEVELS[-1]), F.floor(-F.log2(span)).cast("int")))
    named = regions.filter(whole & (F.least(*sides) >= 0)).withColumn("_level", F.when(span > 0, level).otherwise(F.lit(LEVELS[-1])))

    used = named.select("_level").distinct()

    def touched(low: Column, size: Column) -> Column:
        first, last = _cells(low - tolerance, F.col("_level")), _cells(low + size + tolerance, F.col("_level"))
        return F.explode(F.sequence(first, last))

    named = named.withColumn("_across", touched(F.col("x"), F.col("width"))).withColumn("_down", touched(F.col("y"), F.col("height")))
    renamed = named.select(*[F.col(c).alias(c if c in keys or c.startswith("_") else f"region_{c}") for c in named.columns])
    corners = boxes.filter(whole).withColumn("_level", F.explode(F.array(*map(F.lit, LEVELS))))
    corners = corners.join(F.broadcast(used), "_level", "left_semi")
    corners = corners.withColumn("_across", _cells(F.col("x"), F.col("_level"))).withColumn("_down", _cells(F.col("y"), F.col("_level")))
    cell = [*keys, "_level", "_across", "_down"]
    tasks = int(boxes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    box, region = ({c: F.col(f"{of}{c}") for c in ("x", "y", "width", "height")} for of in ("", "region_"))
    met = (
        (F.col("_left") >= region["x"] - tolerance)
        & (F.col("_right") <= region["x"] + region["width"] + tolerance)
        & (F.col("_top") >= region["y"] - tolerance)
        & (F.col("_bottom") <= region["y"] + region["height"] + tolerance)
    )
    near = _leaves(corners.repartition(tasks, *cell), cell).hint("merge").join(renamed.repartition(tasks, *cell), cell).filter(met)
    pairs = near.select(*keys, F.inline("_boxes"), *[c for c in renamed.columns if c not in cell])
    return pairs.filter(box_in_region(box, region, tolerance))


def homography(corners: Column) -> Column:
    """The nine numbers, row by row, of the map from the unit square to four corners (top left, top right, bottom right, bottom left).

    Null where no such map can be turned round: a corner or number is missing, or three
    corners lie on one line.
    """
    a, b, c, d = (F.get(corners, F.lit(i)) for i in range(4))

    def doubled(p: Column, q: Column, r: Column) -> Column:
        """Twice the area of a triangle, signed."""
        return (q["x"] - p["x"]) * (r["y"] - p["y"]) - (r["x"] - p["x"]) * (q["y"] - p["y"])

    extent = F.greatest(*[F.abs(p[k] - a[k]) for p in (b, c, d) for k in ("x", "y")])
    flat = [F.abs(doubled(*three)) <= 1e-9 * extent * extent for three in ((a, b, c), (b, c, d), (c, d, a), (d, a, b))]
    across = (b["x"] - c["x"]) * (d["y"] - c["y"]) - (d["x"] - c["x"]) * (b["y"] - c["y"])
    x3, y3 = a["x"] - b["x"] + c["x"] - d["x"], a["y"] - b["y"] + c["y"] - d["y"]
    g = (x3 * (d["y"] - c["y"]) - (d["x"] - c["x"]) * y3) / across
    h = ((b["x"] - c["x"]) * y3 - x3 * (b["y"] - c["y"])) / across
    rows = [[b[k] - a[k] + g * b[k], d[k] - a[k] + h * d[k], a[k]] for k in ("x", "y")]
    return F.when(F.size(corners) == 4, F.when(~reduce(Column.__or__, flat), F.array(*rows[0], *rows[1], g, h, F.lit(1.0))))


def inverse3(m: Column) -> Column:
    """The inverse of a 3x3 matrix of nine numbers, row by row; null if its determinant is zero."""
    at = lambda r, c: F.get(m, F.lit(3 * r + c))

    def minor(r: int, c: int) -> Column:
        (r1, r2), (c1, c2) = [[i for i in range(3) if i != k] for k in (r, c)]
        return (at(r1, c1) * at(r2, c2) - at(r1, c2) * at(r2, c1)) * (-1) ** (r + c)

    whole = at(0, 0) * minor(0, 0) + at(0, 1) * minor(0, 1) + at(0, 2) * minor(0, 2)
    return F.when(whole != 0, F.array(*[minor(c, r) / whole for r in range(3) for c in range(3)]))


def mapped(m: Column, x: Column, y: Column) -> Column:
    """struct(x, y) of a point under a projective map; null where the map is, or sends the point to no place."""
    at = lambda i: F.get(m, F.lit(i))
    depth = at(6) * x + at(7) * y + at(8)
    return F.when(depth != 0, F.struct(((at(0) * x + at(1) * y + at(2)) / depth).alias("x"), ((at(3) * x + at(4) * y + at(5)) / depth).alias("y")))


def rectified(rows: DataFrame, x: str, y: str, page: tuple[float, float, float, float], corners: str, out: str = "page_point") -> DataFrame:
    """``rows`` with ``out``, struct(x, y): where on the page a photo's point (x, y) stands; the inverse of ``seen_at``.

    ``page`` and ``corners`` are as there; ``corners`` that no page can show give null. The
    matrices are columns of their own, so that they are computed once a row.
    """
    left, top, right, bottom = page
    solved = rows.withColumn("_there", homography(F.col(corners))).withColumn("_back", inverse3(F.col("_there")))
    solved = solved.withColumn("_unit", mapped(F.col("_back"), F.col(x).cast("double"), F.col(y).cast("double")))
    place = F.struct((F.col("_unit.x") * (right - left) + left).alias("x"), (F.col("_unit.y") * (bottom - top) + top).alias("y"))
    return solved.withColumn(out, F.when(F.col("_unit").isNotNull(), place)).drop("_there", "_back", "_unit")
