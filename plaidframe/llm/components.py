"""Connected components of a graph whose edges are rows, by large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of the edges ``(u, v)``; the component is its smallest node.

    Each step links the neighbours of a node to the smallest of them: first those above
    the node, then those below.  The number of steps grows with the logarithm of the
    longest path.  Minima are partial aggregates, so a node with very many neighbours is no
    single task.  Steps are written to the checkpoint folder; only counts reach the driver.
    """
    current = cut(edges.where(F.col("u") != F.col("v"))
                  .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = _state(current)
    while before[0]:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (both.where(F.col("v") > F.col("u")).join(least, "u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")))
        large = large.where(F.col("u") != F.col("v")).distinct()
        # now every edge points from u down to v < u
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        step = (small.select(F.col("v").alias("u"), F.col("m").alias("v"))
                .unionByName(small.select("u", F.col("m").alias("v")))
                .where(F.col("u") != F.col("v")).distinct())
        current = cut(step)
        after = _state(current)
        if after == before:
            break
        before = after
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return (current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
            .groupBy("node").agg(F.min("component").alias("component")))
