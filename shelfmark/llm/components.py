"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.work import durable


def _starred(pairs: DataFrame, bound: DataFrame) -> DataFrame:
    """Pairs (u, v) become (v, least neighbour of u). The bound is dealt anew before the join, so
    that adaptive execution can split a hot u."""
    joined = pairs.join(bound.hint("rebalance"), "u").select(F.col("v").alias("u"), F.col("least").alias("v"))
    return joined.filter(F.col("u") != F.col("v"))


def _is_forest_of_stars(edges: DataFrame) -> bool:
    """Whether every u has one v, and no v is a u."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above"))
    ends = ends.unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("below"), F.lit(1).alias("above")))
    sums = ends.groupBy("node").agg(F.sum("below").alias("below"), F.sum("above").alias("above"))
    return sums.filter((F.col("below") > 1) | ((F.col("below") > 0) & (F.col("above") > 0))).isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``label``, the least node of its component, for each node of (a, b).

    Each step keeps at most as many edges as there were. A large star ties all larger
    neighbours of a node to its least one, a small star all smaller ones; the end is reached
    when each component is a star around its least node, after a number of rounds that grows
    with the square of the logarithm of the number of nodes.
    """
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    now = durable(now.filter(F.col("u") != F.col("v")).distinct())
    while not _is_forest_of_stars(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("least"))
        large = durable(_starred(both.filter(F.col("v") > F.col("u")), least).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("least"))
        now = durable(_starred(large, least).union(least).toDF("u", "v").distinct())
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots)
