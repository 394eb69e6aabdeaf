"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words: the space and U+0009 to U+000D.
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A key with over a thousandth of all rows, or over so many, is joined by broadcast.
HOT_SHARE, HOT_ROWS = 1000, 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only a local session that names none (tests) gets a folder of its own. A cluster
    must name one: its executors can't read each other's disks.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="tallygrid-")
        spark.sparkContext.setCheckpointDir(path)
    return path


#: The scratch tables that this process wrote and has not released.
_written: list[str] = []


def settle(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back.

    Cuts the lineage: what follows survives lost executors without recomputing
    what came before, and a frame used twice is computed once. The tables stay
    until ``release``, as a result may still read them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tallygrid/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, since: int = 0, but: str | None = None) -> None:
    """Deletes the scratch tables from the ``since``-th on, ``but`` for the newest of that name.

    Only for when no result that reads them is still to be computed.
    """
    kept = next((x for x in reversed(_written) if but and f"/{but}-" in x), None)
    for path in [x for x in _written[since:] if x != kept]:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        _written.remove(path)


def join_hot(rows: DataFrame, marks: DataFrame, keys: tuple[str, ...], n: str) -> DataFrame:
    """``rows`` joined with ``marks``, whose column ``n`` tells how many of ``rows`` have the key.

    Both are read twice, so they should be settled. Marks that meet more than a
    ``HOT_SHARE``-th of all pairs go by broadcast: there are fewer than ``HOT_SHARE`` of
    them, whatever the input. So no task gets all rows of a hot key.
    """
    pairs = marks.agg(F.sum(n)).first()[0] or 0
    least = max(pairs // HOT_SHARE, HOT_ROWS)
    hot, cold = marks.filter(F.col(n) > least).drop(n), marks.filter(F.col(n) <= least).drop(n)
    if pairs <= least or not hot.take(1):
        return rows.join(marks.drop(n), list(keys))
    rest = rows.join(F.broadcast(hot.select(*keys)), list(keys), "left_anti")
    return rows.join(F.broadcast(hot), list(keys)).unionByName(rest.join(cold, list(keys)))


def hot_parts(rows: DataFrame, key: str) -> DataFrame:
    """(key, parts): for each key with more than a ``HOT_SHARE``-th of the rows, how many tasks should share them.

    There are fewer than ``HOT_SHARE`` such keys, so it can be broadcast. ``rows`` are read twice.
    """
    least = max(rows.count() // HOT_SHARE, HOT_ROWS)
    parts = F.ceil(F.count(F.lit(1)) / least).cast("int")
    return settle(rows.groupBy(key).agg(parts.alias("parts")).filter(F.col("parts") > 1), "hot-keys")


def join_spread(rows: DataFrame, wide: DataFrame, key: str, by: str) -> DataFrame:
    """``rows`` joined with ``wide``, whose rows may be large: those of hot keys are copied to several tasks.

    ``rows`` should be settled. What is broadcast is a number for each hot key, and all
    copies together are as few. ``by`` deals out a hot key's rows.
    """
    hot = hot_parts(rows, key)
    if not hot.take(1):
        return rows.join(wide, key)
    dealt = deal(rows.join(F.broadcast(hot), key, "left"), by)
    return dealt.join(copied(wide.join(F.broadcast(hot), key, "left")), [key, "part"]).drop("part")


def deal(rows: DataFrame, *by: str) -> DataFrame:
    """``rows`` with ``part``, out of as many as their column ``parts`` says, in its place."""
    part = F.pmod(F.xxhash64(*by), F.coalesce("parts", F.lit(1)).cast("long")).cast("int")
    return rows.withColumn("part", part).drop("parts")


def copied(rows: DataFrame) -> DataFrame:
    """A copy of each row for each of its ``parts``."""
    return rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")


def scratch_count() -> int:
    return len(_written)


def remainder(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo ``n``; -1 for a null key."""
    return F.coalesce(F.crc32(key.cast("string")) % n, F.lit(-1))


def space_words(text: Column) -> Column:
    """Words between white space as an array; empty for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")
