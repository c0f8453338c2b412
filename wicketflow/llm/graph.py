"""Connected components as DataFrame jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for each node of the undirected edges; root is the smallest node of its component.

    Alternating large-star and small-star steps until the edges are stars. Each step groups by node with partial
    aggregation and joins back, so that a node with many edges is split like any skewed join; each result is
    checkpointed. Loops and nulls are left out; no edges give no rows.
    """
    x, y = F.col(f"`{a}`"), F.col(f"`{b}`")
    now = edges.where(x != y).select(F.greatest(x, y).alias("hi"), F.least(x, y).alias("lo")).distinct().checkpoint()
    seen = None
    while True:
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("h")).first()
        if state == seen or not state["n"]:
            break
        seen = state
        both = now.select(F.col("hi").alias("v"), F.col("lo").alias("w")).unionByName(now.select(F.col("lo").alias("v"), F.col("hi").alias("w")))
        # checkpointed, so that the join reads two shuffles and a node with many edges is split like any skewed key
        least = both.groupBy("v").agg(F.min("w").alias("m")).select("v", F.least("v", "m").alias("m")).checkpoint()
        large = both.where("w > v").join(least, "v").where("w != m").select(F.col("w").alias("hi"), F.col("m").alias("lo")).distinct()
        large = large.checkpoint()
        least = large.groupBy("hi").agg(F.min("lo").alias("m")).checkpoint()
        small = large.join(least, "hi").where("lo != m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        now = small.unionByName(least.select("hi", F.col("m").alias("lo"))).distinct().checkpoint()
    roots = now.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
