"""Connected components by alternating star contraction, every round a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import stored


def _larger_to_smallest(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours move to the smallest of the node and its neighbours."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("m").alias("a"), "b").filter("a < b").distinct()


def _smaller_to_smallest(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours move to the smallest of those neighbours. ``edges`` have a < b."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    moved = edges.join(least, "b").select(F.col("m").alias("a"), F.col("a").alias("b")).filter("a < b")
    return moved.union(least.select(F.col("m").alias("a"), "b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """Columns node and root (the smallest node reachable) for every node of ``edges`` (a, b) that is not its own root.

    Neighbours are only ever reduced to their minimum, with partial sums before the shuffle, so a node
    with very many of them does not gather in one task.
    """
    now = stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct())
    while True:
        new = stored(_smaller_to_smallest(stored(_larger_to_smallest(now))))
        # stars with the root at their centre: no node is both a centre and a leaf, and no leaf has two
        marks = new.select("a", "b").join(new.select(F.col("b").alias("a")).distinct(), "a", "left_semi").limit(1)
        twice = new.groupBy("b").count().filter("count > 1").limit(1)
        if not marks.count() and not twice.count():
            return new.select(F.col("b").alias("node"), F.col("a").alias("root"))
        now = new
