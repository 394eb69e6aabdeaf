"""Registered queries over boxes, photos and keys on pages, with their SQL.

The tables hold none of these, so each query makes its own from the columns of whole
tables: they exercise the operators, and give the tables no new meaning.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tallygrid.operators import geometry
from tallygrid.plans.catalog import _read, query

_TOL = "0.002::double"


@query(f"""
with b as (select c_custkey, (c_custkey * 53 % 997) / 997.0::double as x, (c_custkey * 71 % 991) / 991.0::double as y, 0.01::double as w, 0.005::double as h from customer),
r as (select p_partkey, (p_partkey * 37 % 1009) / 1009.0::double as x, (p_partkey * 91 % 1013) / 1013.0::double as y, p_size / 500.0::double as w, p_size / 700.0::double as h from part)
select c_custkey, p_partkey from b, r
where b.x - b.w >= r.x - {_TOL} and b.x <= r.x + r.w + {_TOL} and b.y - b.h >= r.y - {_TOL} and b.y <= r.y + r.h + {_TOL}""")
def unkeyed_containment(spark, sf_dir):
    """Which of all regions hold which of all boxes, with nothing but their places to go by."""
    def spot(key: str, times: int, modulus: int) -> F.Column:
        return F.col(key) * times % modulus / float(modulus)

    boxes = _read(spark, sf_dir, "customer").select(
        "c_custkey", spot("c_custkey", 53, 997).alias("x"), spot("c_custkey", 71, 991).alias("y"), F.lit(0.01).alias("width"), F.lit(0.005).alias("height"),
    )
    regions = _read(spark, sf_dir, "part").select(
        "p_partkey", spot("p_partkey", 37, 1009).alias("x"), spot("p_partkey", 91, 1013).alias("y"), (F.col("p_size") / 500.0).alias("width"), (F.col("p_size") / 700.0).alias("height"),
    )
    return geometry.containment(boxes, regions).select("c_custkey", F.col("region_p_partkey").alias("p_partkey"))


_CORNER = "0.1::double + 0.05::double * embedding[{0}]::double", "0.9::double + 0.05::double * embedding[{0}]::double"
_FLAT = "vec_id % 10 = 0"


@query(f"""
with e as (
    select vec_id, 0.1 + 0.8 * ((vec_id * 37) % 101) / 101.0::double as u, 0.1 + 0.8 * ((vec_id * 61) % 103) / 103.0::double as v,
           {_CORNER[0].format(1)} as ax, {_CORNER[0].format(2)} as ay, {_CORNER[1].format(3)} as bx, {_CORNER[0].format(4)} as "by",
           {_CORNER[1].format(5)} as cx, {_CORNER[1].format(6)} as cy, {_CORNER[0].format(7)} as dx, {_CORNER[1].format(8)} as dy from embeddings),
k as (select *, ((ax - bx + cx - dx) * (dy - cy) - (dx - cx) * (ay - "by" + cy - dy)) / ((bx - cx) * (dy - cy) - (dx - cx) * ("by" - cy)) as g,
             ((bx - cx) * (ay - "by" + cy - dy) - (ax - bx + cx - dx) * ("by" - cy)) / ((bx - cx) * (dy - cy) - (dx - cx) * ("by" - cy)) as h from e)
select vec_id, round((ax + (bx - ax + g * bx) * u + (dx - ax + h * dx) * v) / (g * u + h * v + 1), 6) as photo_x,
       round((ay + ("by" - ay + g * "by") * u + (dy - ay + h * dy) * v) / (g * u + h * v + 1), 6) as photo_y,
       case when not {_FLAT} then round(20 + 160 * u, 6) end as page_x, case when not {_FLAT} then round(30 + 240 * v, 6) end as page_y
from k""")
def page_points(spark, sf_dir):
    """Points of a page, where photos of it from aslant show them, and from there back on the page; every tenth photo shows its corners on a line."""
    first, last = ([F.lit(base) + 0.05 * F.get("embedding", F.lit(i)).cast("double") for i in range(8)] for base in (0.1, 0.9))
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    corners = F.array(corner(first[0], first[1]), corner(last[2], first[3]), corner(last[4], last[5]), corner(first[6], last[7]))
    on_line = F.array(*[corner(F.lit(x), F.lit(x)) for x in (0.1, 0.4, 0.7, 0.9)])
    u, v = (0.1 + 0.8 * (F.col("vec_id") * a % b) / float(b) for a, b in ((37, 101), (61, 103)))
    rows = _read(spark, sf_dir, "embeddings").select("vec_id", u.alias("u"), v.alias("v"), corners.alias("true"))
    page = (20.0, 30.0, 180.0, 270.0)
    x, y = geometry.seen_at(20 + 160 * F.col("u"), 30 + 240 * F.col("v"), page, F.col("true"))
    seen = rows.withColumn("photo_x", x).withColumn("photo_y", y).withColumn("found", F.when(F.col("vec_id") % 10 == 0, on_line).otherwise(F.col("true")))
    back = geometry.rectified(seen, "photo_x", "photo_y", page, "found")
    return back.select("vec_id", *[F.round(c, 6).alias(n) for c, n in (("photo_x", "photo_x"), ("photo_y", "photo_y"), ("page_point.x", "page_x"), ("page_point.y", "page_y"))])
