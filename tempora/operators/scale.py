"""Standard and min-max scaling as statistics tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

SCALERS = ("standard", "minmax")


def fit_scaler(df: DataFrame, kind: str, keys: Sequence[str], value: str = "value") -> DataFrame:
    """(keys, shift, scale) per group. A constant group gets scale 1.

    ``standard`` uses the population deviation. One partial aggregation; the result has one row per group.
    """
    if kind not in SCALERS:
        raise ValueError(f"unknown scaler {kind!r}")
    v = F.col(value).cast("double")
    constant = F.min(v) == F.max(v)
    if kind == "standard":
        shift, width = F.avg(v), F.stddev_pop(v)
    else:
        shift, width = F.min(v), F.max(v) - F.min(v)
    return df.groupBy(*keys).agg(shift.alias("shift"), F.when(constant, F.lit(1.0)).otherwise(width).alias("scale"))


def scale(df: DataFrame, scaler: DataFrame | None, keys: Sequence[str], value: str = "value") -> DataFrame:
    if scaler is None:
        return df
    out = df.join(scaler, list(keys)).withColumn(value, (F.col(value) - F.col("shift")) / F.col("scale"))
    return out.select(*df.columns)


def unscale(df: DataFrame, scaler: DataFrame | None, keys: Sequence[str], value: str = "value") -> DataFrame:
    if scaler is None:
        return df
    out = df.join(scaler, list(keys)).withColumn(value, F.col(value) * F.col("scale") + F.col("shift"))
    return out.select(*df.columns)
