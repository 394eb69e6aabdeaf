"""Connected components of a link table, by alternating large and small stars.

Every step is a minimum by node, summed before the shuffle, and a join back, so a
node with very many links is never gathered in one place. Each half step is
written to the shared folder, and the loop ends when a whole step changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrid.llm.common import settle


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Links every node's larger (or smaller) neighbours to the least node around it."""
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        both = both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = settle(both.groupBy(F.col("u").alias("w")).agg(F.least(F.min("v"), F.col("w")).alias("m")), "star-least")
    joined = both.join(least, F.col("u") == F.col("w"))
    if large:
        out = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("w").alias("a"), F.col("m").alias("b")))
    return settle(out.filter(F.col("a") != F.col("b")).distinct(), "star-links")


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(links: DataFrame, name: str) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): the least node that links lead to.

    Nodes without links, or linked only with themselves, are not listed.
    """
    links = settle(links.filter(F.col("a") != F.col("b")).distinct(), name)
    state = _state(links)
    while state[0]:
        links = _star(_star(links, large=True), large=False)
        before, state = state, _state(links)
        if state == before:
            break
    nodes = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.unionByName(nodes.select(F.col("root").alias("node"), "root").distinct())
