"""Connected components of an edge table, by alternating large and small stars (any size, any skew)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, settle


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b): root is the smallest node that links reach.

    Each round turns every node's neighbours towards the smallest one; minima are pre-aggregated before the
    shuffle, and edges stay a table, so a node with very many edges is never gathered in one task.
    """
    state = lambda x: x.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    now = settle(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    mark = state(now)  # stars around their least nodes are done after one round
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        large = both.join(least, F.col("a") == F.col("k")).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        large = settle(large, "large")  # at most a row an edge; equal ones go below
        down = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "k")
        small = large.join(down, F.col("a") == F.col("k")).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(down.select(F.col("k").alias("a"), F.col("m").alias("b")))
        before, now = now, settle(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "small")
        release(before, large)
        seen = state(now)
        if seen == mark:
            break
        mark = seen
    roots = now.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
    return roots.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
