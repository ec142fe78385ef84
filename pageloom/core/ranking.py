"""Row numbers, running sums and order statistics that survive a hot key.

A plain ``row_number() OVER (PARTITION BY key ...)`` sends every row of a key
to one task.  Each helper here takes a *bucket*: a column that never decreases
along the requested order (a day, a numeric cell).  Rows are windowed inside
``(keys, bucket)`` and shifted by a prefix sum over the much smaller table of
bucket totals, which map-side aggregation builds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _bucket_offsets(bucketed: DataFrame, keys: Sequence[str], totals: dict[str, Column]) -> DataFrame:
    """Per (keys, _bucket): the sum of each total over the earlier buckets."""
    summed = bucketed.groupBy(*keys, "_bucket").agg(*[c.alias(f"_t_{n}") for n, c in totals.items()])
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    earlier = whole.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    return summed.select(
        *keys,
        "_bucket",
        *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_before_{n}") for n in totals],
        *[F.sum(f"_t_{n}").over(whole).alias(f"_all_{n}") for n in totals],
    )


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[Column], bucket: Column,
           name: str = "position", total: str | None = None) -> DataFrame:
    """Add the 1-based position of each row inside its key group."""
    bucketed = df.withColumn("_bucket", bucket)
    offsets = _bucket_offsets(bucketed, keys, {"n": F.count(F.lit(1))})
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    out = (bucketed.withColumn("_local", F.row_number().over(inside))
           .join(offsets, [*keys, "_bucket"])
           .withColumn(name, F.col("_local") + F.col("_before_n")))
    if total:
        out = out.withColumn(total, F.col("_all_n"))
    return out.drop("_bucket", "_local", "_before_n", "_all_n")


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[Column], bucket: Column,
                value: Column, name: str) -> DataFrame:
    """Add the sum of ``value`` over the rows strictly before each row."""
    bucketed = df.withColumn("_bucket", bucket).withColumn("_value", value)
    offsets = _bucket_offsets(bucketed, keys, {"v": F.sum("_value")})
    inside = (Window.partitionBy(*keys, "_bucket").orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, -1))
    return (bucketed.withColumn("_local", F.coalesce(F.sum("_value").over(inside), F.lit(0)))
            .join(offsets, [*keys, "_bucket"])
            .withColumn(name, F.col("_local") + F.col("_before_v"))
            .drop("_bucket", "_value", "_local", "_before_v", "_all_v"))


def previous_row(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column,
                 carried: Sequence[str], prefix: str = "prev_") -> DataFrame:
    """Add the ``carried`` columns of the preceding row (a ``lag`` for hot keys)."""
    bucketed = df.withColumn("_bucket", bucket)
    picked = F.struct(*[F.col(c) for c in carried])
    last = bucketed.groupBy(*keys, "_bucket").agg(
        F.max_by(picked, F.struct(*[F.col(c) for c in order])).alias("_last"))
    by_bucket = Window.partitionBy(*keys).orderBy("_bucket")
    last = last.select(*keys, "_bucket", F.lag("_last").over(by_bucket).alias("_carry"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    joined = bucketed.withColumn("_lag", F.lag(picked).over(inside)).join(last, [*keys, "_bucket"])
    source = F.coalesce("_lag", "_carry")
    return joined.select(*df.columns, *[source[c].alias(prefix + c) for c in carried])


def value_ranks(df: DataFrame, keys: Sequence[str], value: str, bucket: Column) -> DataFrame:
    """(keys, value, n, first_index, total): where each distinct value sits in sorted order.

    ``first_index`` is 0-based.  Equal values collapse before the shuffle, so
    neither a hot key nor a hot value is held in one task.
    """
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n")).withColumn("_bucket", bucket)
    offsets = _bucket_offsets(counts, keys, {"n": F.sum("n")})
    inside = (Window.partitionBy(*keys, "_bucket").orderBy(value)
              .rowsBetween(Window.unboundedPreceding, -1))
    return (counts.withColumn("_local", F.coalesce(F.sum("n").over(inside), F.lit(0)))
            .join(offsets, [*keys, "_bucket"])
            .select(*keys, value, "n",
                    (F.col("_local") + F.col("_before_n")).alias("first_index"),
                    F.col("_all_n").alias("total")))


def value_at(value: str, index: Column) -> Column:
    """Aggregate over ``value_ranks`` rows: the value at a 0-based index."""
    holds = (F.col("first_index") <= index) & (index < F.col("first_index") + F.col("n"))
    return F.max(F.when(holds, F.col(value)))


def quantile(value: str, p: float, total: str = "total") -> Column:
    """Aggregate over ``value_ranks`` rows: the linearly interpolated quantile.

    Both neighbours are weighted and added with one rounding (a fused multiply
    and add), as DuckDB does: any other order of rounding tips ties.
    """
    at = (F.col(total) - 1) * F.lit(p)
    low = F.floor(at)
    below, above = value_at(value, low).cast("double"), value_at(value, F.ceil(at)).cast("double")
    share = F.max(at - low)
    return fused(below, 1 - share, above * share)


def fused(a: Column, b: Column, c: Column) -> Column:
    """a * b + c rounded once, from exact products and sums of halves."""
    def halves(v: Column) -> tuple[Column, Column]:
        high = v * 134217729.0 - (v * 134217729.0 - v)
        return high, v - high
    (a1, a2), (b1, b2) = halves(a), halves(b)
    product = a * b
    lost = a2 * b2 - (product - a1 * b1 - a2 * b1 - a1 * b2)
    total = product + c
    part = total - product
    return total + ((product - (total - part)) + (c - part) + lost)
