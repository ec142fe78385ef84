"""Connected components of an edge table, without a driver-side graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.core.shared import written


def _mark(edges: DataFrame) -> tuple:
    """Order-free digest of an edge table, to see whether a round changed it."""
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")),
                    F.bit_xor(F.xxhash64("b", "a"))).first()
    return tuple(row)


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest node around it."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    return (both.join(least, "a").where("b > a")
            .select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge; root is the smallest node of its component.

    ``edges`` has comparable columns ``a`` and ``b``; loops, repeated and
    reversed edges are fine, nulls are ignored.  Stars are contracted
    alternately until nothing changes (logarithmically many rounds); each round
    is a shared table.  A hub's rows are split by Spark's skew join, its
    minimum is combined before the shuffle.
    """
    now = written(edges.where("a <> b").select("a", "b").distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        after = written(_small_star(_large_star(now)), "stars")
        new = _mark(after)
        now = after
        if new == mark:
            break
        mark = new
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
