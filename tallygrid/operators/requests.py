"""Requests and their replies: who was answered, how, and how late."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def matched(requests: DataFrame, replies: DataFrame, limit: float, horizon: float) -> DataFrame:
    """One row a request: (key, id, at, status, repeated, replies, replied, error).

    ``requests`` have a unique ``key``, the ``id`` that replies carry, and the time
    ``at`` (timestamp); ``replies`` have id, at, and ``error`` (null for a result). A
    reply belongs to the last request of its id that is not after it, if that is at most
    ``horizon`` seconds before it; others belong to none. status is of the first reply:
    failed with an error, late after more than ``limit`` seconds, answered, or unanswered
    without one. ``repeated``: more than one reply. ``replied`` and ``error`` are the
    first reply's; of replies at one instant that with a result comes first. Of requests
    of an id at one instant the one with the largest key is the last.

    Rows go by id and stretch of time, each stretch with the last request of the one
    before, so an id with very many rows is dealt out over its time. Rows without id or
    time match nothing.
    """
    micros = F.unix_micros(F.col("at").cast("timestamp"))
    reach, most = int(horizon * 1_000_000), int(limit * 1_000_000)
    none = F.lit(None)
    asked = requests.select("id", micros.alias("us"), F.col("key"), none.cast("string").alias("error"), F.lit(0).alias("kind"))
    given = replies.select("id", micros.alias("us"), none.cast(requests.schema["key"].dataType).alias("key"), F.col("error").cast("string").alias("error"), F.lit(1).alias("kind"))
    rows = asked.unionByName(given).filter(F.col("id").isNotNull() & F.col("us").isNotNull()).withColumn("stretch", F.floor(F.col("us") / max(reach, 1)))
    latest = rows.filter("kind = 0").groupBy("id", "stretch").agg(F.max(F.struct("us", "key")).alias("last"))
    carried = latest.select("id", F.col("last.us").alias("us"), F.col("last.key").alias("key"), none.cast("string").alias("error"), F.lit(0).alias("kind"), (F.col("stretch") + 1).alias("stretch"))
    order = Window.partitionBy("id", "stretch").orderBy("us", "kind", "key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.last(F.when(F.col("kind") == 0, F.struct("us", "key")), ignorenulls=True).over(order)
    placed = rows.unionByName(carried).withColumn("request", last).filter("kind = 1 and request is not null").filter(F.col("us") - F.col("request.us") <= reach)
    found = placed.select(F.col("request.key").alias("key"), F.col("us"), "error")
    every = requests.select("key", "id", "at", none.cast("long").alias("us"), none.cast("string").alias("error"), F.lit(True).alias("own"))
    found = found.select("key", none.cast(requests.schema["id"].dataType).alias("id"), none.cast(requests.schema["at"].dataType).alias("at"), "us", "error", F.lit(False).alias("own"))
    first = F.min(F.when(~F.col("own"), F.struct("us", F.col("error").isNotNull().alias("bad"), "error"))).alias("first")
    whole = every.unionByName(found).groupBy("key").agg(F.max("id").alias("id"), F.max("at").alias("at"), F.count_if(~F.col("own")).alias("replies"), first)
    waited = F.col("first.us") - F.unix_micros(F.col("at").cast("timestamp"))
    return whole.select(
        "key", "id", "at", _status(waited, most).alias("status"), (F.col("replies") > 1).alias("repeated"), "replies",
        F.timestamp_micros("first.us").alias("replied"), F.col("first.error").alias("error"),
    )


def _status(waited: Column, most: int) -> Column:
    return F.when(waited.isNull(), F.lit("unanswered")).when(F.col("first.bad"), F.lit("failed")).when(waited > most, F.lit("late")).otherwise(F.lit("answered"))
