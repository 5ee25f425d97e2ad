"""Connected components of an edge table, by alternating stars; every round is cut in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.tables import stored


def components(pairs: DataFrame) -> DataFrame:
    """node, component (smallest node connected to it) for every node of the pairs (a, b).

    Large star, then small star, until neither changes an edge: O(log**2 n) rounds.  Per-node minima
    are partial aggregates and edges are re-keyed by minimum, so a hub of any degree stays spread.
    """
    edges = pairs.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).where("u < v").distinct()
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("u"), "v").where("u < v").distinct()
        lower = large.select(F.col("v").alias("x"), F.col("u").alias("y"))
        small_min = lower.groupBy("x").agg(F.min("y").alias("m"))
        small = lower.join(small_min, "x").select(F.col("m").alias("u"), F.col("y").alias("v")).unionByName(small_min.select(F.col("m").alias("u"), F.col("x").alias("v")))
        edges = stored(small.where("u < v").distinct(), "components")
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if before == now:
            break
        before = now
    out = edges.select(F.col("v").alias("node"), F.col("u").alias("component"))
    return out.unionByName(edges.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())
