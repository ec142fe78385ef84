"""Exact algebra on run tables: rows (keys..., x0, x1), half-open.

Runs that start at the same pixel collapse before the shuffle, so one scan
line never holds more rows than it has distinct start pixels however many
masks cover it.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merge_runs(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Union of the runs of each key as maximal, non-touching runs."""
    longest = runs.where("x1 > x0").groupBy(*keys, "x0").agg(F.max("x1").alias("x1"))
    line = Window.partitionBy(*keys).orderBy("x0")
    reach = F.max("x1").over(line.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum("_starts").over(line.rowsBetween(Window.unboundedPreceding, 0))
    return (longest.withColumn("_starts", F.when(F.col("x0") <= reach, 0).otherwise(1))
            .withColumn("_island", island)
            .groupBy(*keys, "_island").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"))
            .drop("_island"))


def layered(groups: dict[str, DataFrame], keys: Sequence[str]) -> DataFrame:
    """Cut several unions at each other's edges.

    Returns (keys, x0, x1, <name>...) where each named boolean says whether
    that union covers the piece.  A sweep over +1/-1 edges; edges at the same
    pixel collapse before the shuffle.
    """
    return layers(stacked(groups), list(groups), keys)


def stacked(groups: dict[str, DataFrame]) -> DataFrame:
    """The runs of all groups in one table, their name in ``layer``."""
    return reduce(DataFrame.unionByName, [runs.withColumn("layer", F.lit(name)) for name, runs in groups.items()])


def layers(runs: DataFrame, names: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """``layered`` over one table whose column ``layer`` names the group of each run."""
    edge = lambda x, sign: F.struct(F.col(x).alias("x0"), F.lit(sign).cast("long").alias("d"))
    edges = runs.where("x1 > x0").select(*keys, "layer", F.explode(F.array(edge("x0", 1), edge("x1", -1))).alias("_e"))
    edges = edges.groupBy(*keys, F.col("_e.x0").alias("x0")).agg(*[
        F.sum(F.when(F.col("layer") == n, F.col("_e.d")).otherwise(0)).alias(f"_d_{n}") for n in names])
    line = Window.partitionBy(*keys).orderBy("x0")
    sofar = line.rowsBetween(Window.unboundedPreceding, 0)
    return edges.select(
        *keys, "x0", F.lead("x0").over(line).alias("x1"),
        *[(F.sum(f"_d_{n}").over(sofar) > 0).alias(n) for n in names]).where("x1 is not null")
