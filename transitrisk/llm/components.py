"""Connected components of an undirected link table by alternating large-star
and small-star steps (Kiveris et al., 2014). Every step is an aggregate and a
join; nothing but a checksum reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transitrisk.llm.common import stored


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for every node that has
    a link to another. Self links and repeated links are harmless."""
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    before = None
    while True:
        edges = stored(_small_star(_large_star(edges)), "components")
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    # every edge now points at the root of its star
    return (edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
            .unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct())


def _large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the least of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("least"))
    return (both.where("v > u").join(least, "u")
            .select(F.col("v").alias("u"), F.col("least").alias("v")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the least of them (u > v holds)."""
    least = edges.groupBy("u").agg(F.min("v").alias("least"))
    moved = (edges.join(least, "u").where("v <> least")
             .select(F.col("v").alias("u"), F.col("least").alias("v")))
    return moved.unionByName(least.select("u", F.col("least").alias("v"))).distinct()
