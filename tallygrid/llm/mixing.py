"""Mixing sources to target weights by hash-threshold histograms (built-in functions only).

Every document has a 60-bit hash of its id. A source's budget becomes a hash
threshold: tokens are summed by source and leading hash bits, the bucket in
which the running sum passes the budget is found, and only that bucket is
histogrammed again by its next bits. Filtering by the threshold needs no sort,
and a rerun, or a run on other machines, takes the same documents. Budgets are
nested: a source that repeats takes all documents once before any twice, and a
larger budget takes what a smaller one takes, and more.

Defined results: null text or text without words has size 0 and takes 0; a null
source is a source of its own, last in order; repeated rows have one hash and are
taken together; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallygrid.llm.common import join_spread, settle, space_words

HASH_BITS = 60
#: Up to so many sources the per-source table (under 100 bytes a row) is broadcast.
BROADCAST_SOURCES = 20_000


def id_hash(key: Column) -> Column:
    """The first 60 bits of the md5 of the key as text; null has that of the empty text."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")


def running(rows: DataFrame, order: list[Column], sums: dict[str, Column], name: str) -> DataFrame:
    """``rows`` with the sums of all rows before each one in a total order.

    The rows are cut into ranges, one a task, and summed by range first, so no task
    gets them all; what is broadcast is a row for each shuffle partition.
    """
    parts = settle(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), name)
    own = {c: F.sum(x).alias(c) for c, x in sums.items()}
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.groupBy("part").agg(*own.values()).select("part", *[F.sum(c).over(earlier).alias(f"earlier_{c}") for c in sums])
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    total = [(F.coalesce(F.col(f"earlier_{c}"), zero) + F.coalesce(F.sum(x).over(inside), zero)).alias(c) for c, x in sums.items()]
    return parts.join(F.broadcast(before), "part").select(*rows.columns, *total)


def source_targets(by_source: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """Adds ``target`` to (source, source_size).

    Weights repeat over the sources in code point order, null last. Targets stop
    at ``most`` times the source's size and the excess goes to the others by
    weight. Filling from the source with the least room for its weight, the level
    at the first source that is not full is everyone's level.
    """
    ranked = running(by_source, [F.col("source").asc_nulls_last()], {"rank": F.lit(1)}, "mix-ranked")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    capped = ranked.withColumn("weight", weight.cast("double")).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    words, weighed = capped.agg(F.sum("source_size"), F.sum("weight")).first()
    room = F.col("cap") / F.col("weight")
    filled = running(capped, [room.asc(), F.col("rank").asc()], {"filled": F.col("cap"), "served": F.col("weight")}, "mix-filled")
    level = (F.lit(float(words or 0)) * F.lit(float(share)) - F.col("filled")) / (F.lit(weighed or 0.0) - F.col("served"))
    levelled = filled.withColumn("level", level).withColumn("full", F.col("cap") <= F.col("level") * F.col("weight"))
    (first,) = levelled.filter(~F.col("full")).agg(F.min(F.struct(room.alias("room"), "rank", "level"))).first()
    common = F.lit(first["level"] if first else 0.0)
    return levelled.select("source", "source_size", F.when(F.col("full"), F.col("cap")).otherwise(common * F.col("weight")).alias("target"))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    most: int = 2,
    bits: int = 12,
    whole_rows: bool = False,
) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) for every row.

    With ``whole_rows``, the columns of ``docs`` come first and those from ``size`` on
    follow; a column of ``docs`` by such a name gives way.

    ``share`` times all words are dealt to the sources by ``weights``, no source
    above ``most`` times its size. ``copies`` is how often the mix holds the
    document and ``taken`` is ``copies * size``. A source misses its target by
    half the size of its boundary document at most.
    """
    measures = (
        F.col(id_col).alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        F.size(space_words(F.col(text_col))).cast("long").alias("size"),
        id_hash(F.col(id_col)).alias("h"),
    )
    sized = settle(docs.select(*measures), "mix-sized")
    sources = settle(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most), "mix-targets")
    few = sources.count() <= BROADCAST_SOURCES
    small = (lambda df: F.broadcast(df)) if few else (lambda df: df)

    whole = F.least(F.lit(most), F.floor(F.col("target") / F.greatest(F.col("source_size"), F.lit(1))))
    plan = sources.withColumn("whole", whole.cast("long")).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))

    cut = plan.select(F.col("source").alias("c_source"), F.lit(0).cast("long").alias("prefix"), F.col("rest").alias("left"))
    for low in range(HASH_BITS - bits, -1, -bits):
        cut = _refine(sized, cut, low, bits, few)
    cut = cut.select("c_source", F.col("prefix").alias("threshold"), (F.col("left") * 2 >= F.col("tokens")).alias("inclusive"))

    per_source = plan.join(small(cut), F.col("source").eqNullSafe(F.col("c_source")), "left").select(
        F.col("source").alias("p_source"), "source_size", "target", "whole", "threshold", "inclusive"
    )
    picked = F.col("threshold").isNull() & (F.col("whole") < most) | (F.col("h") < F.col("threshold")) | ((F.col("h") == F.col("threshold")) & F.col("inclusive"))
    copies = F.col("whole") + F.coalesce(picked, F.lit(False)).cast("long")
    found = ("size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
    same = F.col("source").eqNullSafe(F.col("p_source"))
    # beyond a broadcast, a source of very many documents is dealt out
    named = per_source.withColumn("p_key", _named(F.col("p_source")))

    def planned(rows: DataFrame) -> DataFrame:
        if few:
            return rows.join(small(per_source), same)
        return join_spread(rows.withColumn("p_key", _named(F.col("source"))), named, "p_key", "doc_id")

    if not whole_rows:
        return planned(sized).select("doc_id", "source", *found)
    own = [c for c in docs.columns if c not in ("size", "source_size", "target", "copies", "taken")]
    rows = docs.select(*measures, F.struct(*own).alias("row"))
    return planned(rows).select("row.*", *found)


def _named(source: Column) -> Column:
    """A source as a key that isn't null."""
    return F.when(source.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), source))


def _refine(sized: DataFrame, cut: DataFrame, low: int, bits: int, few: bool) -> DataFrame:
    """One level: for each source still open, the bucket of its next ``bits`` bits that passes what is left.

    A source whose whole size fits drops out at the first level: all of it is taken.
    ``few``: the sources are broadcast; else documents are summed by bucket before they
    meet them, as at the first level all of a source have one prefix.
    """
    wanted = F.col("source").eqNullSafe(F.col("c_source")) & (F.shiftright("h", low + bits) == F.col("prefix"))
    if few:
        sums = sized.join(F.broadcast(cut), wanted).groupBy("c_source", "left", F.shiftright("h", low).alias("prefix")).agg(F.sum("size").alias("tokens"))
    else:
        buckets = sized.groupBy("source", F.shiftright("h", low).alias("bucket")).agg(F.sum("size").alias("held"))
        above = F.shiftright("bucket", bits) == F.col("prefix")
        sums = buckets.join(cut, F.col("source").eqNullSafe(F.col("c_source")) & above).select("c_source", "left", F.col("bucket").alias("prefix"), F.col("held").alias("tokens"))
    order = Window.partitionBy("c_source").orderBy("prefix")
    running = sums.withColumn("upto", F.sum("tokens").over(order)).filter(F.col("upto") > F.col("left"))
    first = running.groupBy("c_source").agg(F.min(F.struct("prefix", "tokens", "upto", "left")).alias("b"))
    return first.select("c_source", F.col("b.prefix").alias("prefix"), (F.col("b.left") - F.col("b.upto") + F.col("b.tokens")).alias("left"), F.col("b.tokens").alias("tokens"))


ORACLE = r"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
         ('0x' || left(md5(coalesce(doc_id::varchar, '')), 15))::bigint as h
  from documents),
s as (select source, sum(size)::bigint as source_size, (array[3, 1, 2])[1 + (row_number() over (order by source nulls last) - 1) % 3]::double as w
      from d group by source),
f as (select *, 2.0::double * source_size as cap, row_number() over (order by 2.0::double * source_size / w, source nulls last) as k from s),
l as (select *, (1.5::double * (select sum(source_size)::double from s) - coalesce(sum(cap) over (order by k rows between unbounded preceding and 1 preceding), 0))
             / sum(w) over (order by k rows between current row and unbounded following) as level from f),
t as (select source, source_size,
             case when cap <= level * w then cap else (select min_by(level, k) from l where not cap <= level * w) * w end as target from l),
b as (select *, least(2, floor(target / greatest(source_size, 1)))::bigint as whole from t),
c as (select d.doc_id, d.size, d.h, b.source_size, b.target, b.whole, b.target - b.whole * b.source_size as rest,
             sum(d.size) over (partition by d.source order by d.h) as upto,
             sum(d.size) over (partition by d.source, d.h) as tied
      from d join b on d.source is not distinct from b.source)
select doc_id, size, source_size, target,
       size * (whole + case when whole < 2 and (upto <= rest or ((rest - (upto - tied)) * 2 >= tied and rest >= upto - tied)) then 1 else 0 end) as taken
from c
"""
