"""Connected components of a link table, by alternating large and small stars.

Each round hangs every node's larger neighbours on its smallest one, then does the same for smaller
neighbours, until all nodes of a component hang on its smallest node. Rounds are written to the shared
folder, so a lost executor costs one round, and only a count and a checksum come back to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlapse.llm.common import stage


def _lowest(links: DataFrame) -> DataFrame:
    """The smallest neighbour of each ``a``; written first, so that the join after it can split hot nodes."""
    low = links.groupBy("a").agg(F.min("b").alias("low"))
    return stage(low.select(F.col("a").alias("node"), F.least("a", "low").alias("low")), "lowest")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("u").alias("a"), F.col("v").alias("b")).unionByName(
        edges.select(F.col("v").alias("a"), F.col("u").alias("b"))
    )
    joined = both.where("b > a").join(_lowest(both), F.col("a") == F.col("node"))
    return joined.select(F.col("b").alias("u"), F.col("low").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.col("u").alias("a"), F.col("v").alias("b"))
    low = _lowest(down)
    joined = down.join(low, F.col("a") == F.col("node")).where("b <> low")
    return (
        joined.select(F.col("b").alias("u"), F.col("low").alias("v"))
        .unionByName(low.select(F.col("node").alias("u"), F.col("low").alias("v")))
        .distinct()
    )


def _state(edges: DataFrame) -> tuple:
    checksum = F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))
    return tuple(edges.agg(F.count(F.lit(1)), checksum).first())


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node that it is connected to; nodes without links are left out.

    ``links`` has two long columns ``u`` and ``v``; direction, repeats and links to itself don't matter.
    """
    edges = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = stage(edges, "links")
    before, now = None, _state(edges)
    while now != before and now[0]:
        edges = stage(_large_star(edges), "large-star")
        edges = stage(_small_star(edges), "small-star")
        before, now = now, _state(edges)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
