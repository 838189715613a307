"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarnwell.durable import checkpointed


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 50) -> DataFrame:
    """(node, component): every node of an edge list with the smallest node of its component.

    Kiveris et al., "Connected Components in MapReduce and Beyond" (2014): each round links the neighbours of a node to its smallest one,
    first the larger, then the smaller ones, until nothing changes; the number of rounds grows with the logarithm of the longest path.
    Neighbourhoods are joined with their minimum and never collected. Links stay in the shared folder between rounds; nothing goes to the driver but a sum.
    """
    e = edges.select(F.least(a, b).alias("v"), F.greatest(a, b).alias("u")).filter("v != u").distinct()
    e = checkpointed(e)
    before = None
    for _ in range(rounds):
        both = e.select(F.col("u").alias("x"), F.col("v").alias("y")).union(e.select(F.col("v").alias("x"), F.col("u").alias("y")))
        low = both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("m"))
        large = both.join(low, "x").filter("y > x").select(F.col("m").alias("v"), F.col("y").alias("u")).filter("v != u").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.filter("v != m").select(F.col("m").alias("v"), F.col("v").alias("u")).union(low.select(F.col("m").alias("v"), "u")).distinct()
        e = checkpointed(small)
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")).alias("h")).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"no components after {rounds} rounds")
    leaves = e.groupBy("u").agg(F.min("v").alias("component"))
    roots = e.select(F.col("v").alias("u")).distinct().join(leaves.select("u"), "u", "left_anti").select("u", F.col("u").alias("component"))
    return leaves.union(roots).select(F.col("u").alias("node"), "component")
