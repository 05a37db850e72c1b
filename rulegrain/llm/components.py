"""Connected components by alternating large-star and small-star steps.

Every step is a minimum per node, combined before it is shuffled, and a join back; edges only ever
point nearer to the smallest node, so a node with any number of neighbours is never collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulegrain.llm.storage import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours move to its smallest neighbour."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("m").alias("a"), "b").filter("a < b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours move to the smallest of them."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    moved = edges.join(least, "b").filter("a > m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return moved.union(least.select(F.col("m").alias("a"), "b")).distinct()


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) of all nodes but the smallest of each component, from edges (a, b), a < b."""
    now = scratch.write(edges.select("a", "b").distinct())
    seen = _digest(now)
    while seen[0]:
        following = scratch.write(_small_star(_large_star(now)))
        scratch.drop(now)
        now, before = following, seen
        seen = _digest(now)
        if seen == before:
            break
    return now.select(F.col("b").alias("node"), F.col("a").alias("component"))
