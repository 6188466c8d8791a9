"""Aggregations that need more than one pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, Window as W


def _magnitude(v: Column) -> Column:
    """A non-decreasing function of ``v`` whose steps of 1 are about one percent of the value."""
    log = F.log2(F.abs(v)) + 1100
    return F.when(v == 0, F.lit(0.0)).otherwise(F.signum(v) * F.least(log, F.lit(2200.0)) * 64)


def group_median(df: DataFrame, keys: Sequence[str], value: str, target: str = "median", n_parts: int = 1024) -> DataFrame:
    """Exact interpolated median per group, without holding a group in one task.

    Equal values are counted first. Every value falls in an ordered bucket (about one percent wide) and an ordered part
    of it; both follow from the value alone. Bucket counts tell in which bucket the middle ranks lie, part counts in
    which part, and only the values of that part are sorted. Everything that grows with the rows is shuffled by
    (group, bucket, part), so a group holding most rows is spread like any other; the tables keyed by group alone have
    one row per bucket.
    """
    keys = list(keys)
    v = F.col(value).cast("double")
    place = F.floor(_magnitude(F.col("_v")) * n_parts)
    counts = (df.where(v.isNotNull()).groupBy(*keys, v.alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
              .withColumn("_p", place).withColumn("_b", F.floor(F.col("_p") / n_parts)))
    parts = counts.groupBy(*keys, "_b", "_p").agg(F.sum("_c").alias("_c"))
    buckets = parts.groupBy(*keys, "_b").agg(F.sum("_c").alias("_c"))

    low, high = F.floor((F.col("_n") + 1) / 2), F.floor(F.col("_n") / 2) + 1

    def ranks(counted: DataFrame, within: Sequence[str], order: str, start: Column) -> DataFrame:
        """Add the ranks (_begin, _end] covered by each row and keep the rows that cover a middle rank."""
        running = F.sum("_c").over(W.partitionBy(*within).orderBy(order).rowsBetween(W.unboundedPreceding, 0))
        covered = counted.withColumn("_end", start + running).withColumn("_begin", F.col("_end") - F.col("_c"))
        return covered.where((F.col("_end") >= low) & (F.col("_begin") < high))

    total = buckets.withColumn("_n", F.sum("_c").over(W.partitionBy(*keys)))
    bucket = ranks(total, keys, "_b", F.lit(0)).select(*keys, "_b", "_n", F.col("_begin").alias("_start"))
    part = ranks(parts.join(bucket, [*keys, "_b"]), [*keys, "_b"], "_p", F.col("_start")).select(
        *keys, "_p", "_n", F.col("_begin").alias("_start"))
    middle = ranks(counts.drop("_b").join(part, [*keys, "_p"]), [*keys, "_p"], "_v", F.col("_start"))
    return middle.groupBy(*keys).agg(((F.min("_v") + F.max("_v")) / 2).alias(target))


def complete_groups(df: DataFrame, key: str, size: int) -> DataFrame:
    """Rows whose key occurs exactly ``size`` times."""
    keep = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == size).select(key)
    return df.join(keep, key, "left_semi")


def pivot_mean(df: DataFrame, keys: Sequence[str], column: str, values: Sequence, measures: Sequence[str],
               fill: float | None = None, separator: str = "|") -> DataFrame:
    """Mean per key and pivot value, with the pivot values given; names are ``measure|value``, or ``value`` alone."""
    aggs = [F.avg(m).alias(m) for m in measures]
    wide = df.groupBy(*keys).pivot(column, list(values)).agg(*aggs)
    single = len(measures) == 1
    out = wide.select(*keys, *[
        F.col(f"`{v}`" if single else f"`{v}_{m}`").alias(f"{m}{separator}{v}" if separator else str(v))
        for m in measures for v in values])
    return out if fill is None else out.na.fill(fill)


def share_missing(value: Column) -> Column:
    """Percent of rows without a value."""
    return F.lit(100.0) * F.avg(F.when(value.isNull(), F.lit(1.0)).otherwise(F.lit(0.0)))
