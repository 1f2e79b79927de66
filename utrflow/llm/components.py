"""Connected components by alternating large-star and small-star steps, each a few skew-safe joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from utrflow.plans.storage import join_sized, release, written


def _with_least(pairs: DataFrame, total: int) -> DataFrame:
    """(u, v, m): each pair with the least of u and all of u's partners."""
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("n"))
    return join_sized(pairs, least, "u", "n", total).drop("n")


def _stars(edges: DataFrame) -> bool:
    """Whether each node has one edge to its root, and no root has one."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("up")), F.struct(F.col("v").alias("x"), F.lit(0).alias("up")))).alias("e"))
    return ends.groupBy("e.x").agg(F.sum("e.up").alias("ups"), F.min("e.up").alias("root")).filter("ups > 1 or (ups = 1 and root = 0)").isEmpty()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root), written, for each node of the edges: the root is the smallest node of its component. Edges are undirected."""
    now = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u != v").distinct(), "edges")
    total = now.count()
    while total and not _stars(now):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = written(_with_least(both, 2 * total).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct(), "large")
        small = _with_least(large, total).select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        last, now = now, written(small.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).filter("u != v").distinct(), "edges")
        release(last, large)
        total = now.count()
    roots = written(now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()), "roots")
    release(now)
    return roots
