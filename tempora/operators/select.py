"""Projections, filters, repairs and key lookups."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from ..functions.dates import label_between, lookup


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def project(df: DataFrame, index: str, columns: Sequence[str]) -> DataFrame:
    return df.select(index, *columns)


def label_slice(df: DataFrame, start: str | None, end: str | None, ts: str = "ts") -> DataFrame:
    """Rows whose timestamp label lies between two inclusive, possibly shortened labels."""
    return df.where(label_between(ts, start, end))


def key_lookup(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of ``df`` whose key is in ``keys``."""
    return df.join(keys.select(*on), list(on), "left_semi")


def missing_keys(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Keys asked for that ``df`` does not hold; a strict lookup requires this to be empty."""
    return keys.select(*on).distinct().join(df.select(*on), list(on), "left_anti")


def strict_key_lookup(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    if not missing_keys(df, keys, on).isEmpty():
        raise KeyError(f"some keys on {list(on)} are absent")
    return key_lookup(df, keys, on)


def drop_incomplete(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    return df.na.drop("any", subset=list(subset) if subset else None)


def drop_sentinel(df: DataFrame, column: str, sentinel: str) -> DataFrame:
    return df.where(F.col(column) != sentinel)


def fill_zero(value) -> Column:
    return F.coalesce(_col(value), F.lit(0.0))


def floor_zero(pred) -> Column:
    """Negative predictions become 0; NULL stays NULL."""
    pred = _col(pred)
    return F.when(pred < 0, F.lit(0.0)).otherwise(pred)


def round_half_even(value, decimals: int) -> Column:
    return F.bround(_col(value), decimals)


def normalise_id(value) -> Column:
    """'71634.0' or 71634.0 -> '71634'."""
    return _col(value).cast("double").cast("long").cast("string")


def repair_count(text) -> Column:
    """Text starting with 'M' (a censored small count) -> 1, otherwise the integer; any other text is an error."""
    text = _col(text)
    return F.when(text.startswith("M"), F.lit(1)).otherwise(text.cast("int"))


def map_codes(df: DataFrame, column: str, mapping: dict, target: str) -> DataFrame:
    return df.withColumn(target, lookup(column, mapping))


def series_subset(obs: DataFrame, dimension: DataFrame, condition: Column, key: str = "series_id") -> DataFrame:
    """Observations of the series whose dimension row fulfils ``condition``."""
    return obs.join(dimension.where(condition).select(key), key, "left_semi")


def varying_features(x_long: DataFrame, feature: str = "idx", value: str = "value") -> DataFrame:
    """Features that are not constant over all rows; a feature with missing values counts as varying."""
    v = F.col(value)
    stats = x_long.groupBy(feature).agg(F.min(v).alias("lo"), F.max(v).alias("hi"), F.count(v).alias("n_value"),
                                        F.count(F.lit(1)).alias("n_row"))
    varying = (F.col("lo") != F.col("hi")) | ((F.col("n_value") < F.col("n_row")) & (F.col("n_row") > 1))
    return stats.where(varying).select(feature)


def drop_constant_features(x_long: DataFrame, feature: str = "idx", value: str = "value",
                           fit_on: DataFrame | None = None) -> DataFrame:
    """Remove constant features; ``fit_on`` restricts the rows looked at (e.g. the training days)."""
    keep = varying_features(fit_on if fit_on is not None else x_long, feature, value)
    return x_long.join(keep, feature, "left_semi")


def last_wins(df: DataFrame, keys: Sequence[str], order: Iterable[Column]) -> DataFrame:
    """One row per key: the last one in the stated order.

    ``max_by`` over the ordering struct keeps this a partial aggregation, so a key with many rows is reduced
    before the shuffle.
    """
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(*keys, *[F.col("_row")[c].alias(c) for c in rest])


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")
