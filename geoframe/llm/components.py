"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut


def _least(edges: DataFrame, key: str, value: str) -> DataFrame:
    return edges.groupBy(key).agg(F.min(value).alias("low"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = _least(both, "a", "b").withColumn("low", F.least("low", "a"))
    return both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = _least(down, "a", "b")
    rest = down.join(low, "a").filter("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return rest.union(low.select("a", F.col("low").alias("b"))).filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``edges`` has long columns a and b.  Returns node and component, the smallest node
    that it reaches, for each node with an edge to another node.

    Every round moves only per-node minima and ends in stars; rows stay at most as many as
    the edges.  The number of rounds grows with the logarithm of the longest chain."""
    edges = cut(edges.filter("a is not null and b is not null and a <> b").select("a", "b").distinct())
    mark = None
    while True:
        edges = cut(_small_star(_large_star(edges)))
        state = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h"), F.sum(F.xxhash64("b", "a") % 1_000_003).alias("s")).first()
        if tuple(state) == mark:
            break
        mark = tuple(state)
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.union(stars.select(F.col("component").alias("node"), "component").distinct())
