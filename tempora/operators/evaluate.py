"""Comparison of many models' predictions with the observations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.dates import label_between
from .windows import ordinal_index

METRICS = ("rmse", "mae", "mape_at", "mse")
Windows = dict[str, tuple[str | None, str | None]]


def in_windows(df: DataFrame, windows: Windows) -> DataFrame:
    """Add ``window``: one row per named label range holding the timestamp."""
    names = [F.when(label_between("ts", lo, hi), F.lit(name)) for name, (lo, hi) in windows.items()]
    return df.withColumn("window", F.explode(F.array_compact(F.array(*names))))


def _named(preds: DataFrame, models: Sequence[str] | None) -> list[str]:
    """The models to compare: those listed, otherwise those that predict anything."""
    return list(models) if models is not None else sorted(r[0] for r in preds.select("model").distinct().collect())


def common_cells(obs: DataFrame, preds: DataFrame, windows: Windows, by: Sequence[str] = (),
                 models: Sequence[str] | None = None) -> DataFrame:
    """Observations inside the windows at the times that every model predicts; a listed model without rows has none.

    The time list is one row per step; the pairs (model, time) are reduced before they are shuffled.
    """
    by = list(by)
    pairs = preds.select(*by, "model", "ts").distinct()
    n_models = len(_named(preds, models))
    shared = pairs.groupBy(*by, "ts").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == n_models)
    return in_windows(obs, windows).join(shared.select(*by, "ts"), [*by, "ts"], "left_semi")


def error_sums(obs: DataFrame, preds: DataFrame, windows: Windows, at: float = 5.0,
               by: Sequence[str] = (), models: Sequence[str] | None = None) -> DataFrame:
    """Additive error terms per (window, by, model, series), also for a model that misses a series altogether.

    Every table of the report, global or per series, is a roll-up of this one small table, so observations and
    predictions are joined and shuffled once however many metrics and windows are asked for. ``n_cell`` counts the
    cells that should have been predicted.
    """
    by = list(by)
    models = _named(preds, models)
    cells = common_cells(obs, preds, windows, by, models).withColumnRenamed("value", "obs")
    expected = cells.groupBy("window", *by, "series_id").agg(
        F.count(F.lit(1)).alias("n_cell"), F.count(F.when(F.col("obs") >= at, 1)).alias("n_at"))
    expected = expected.withColumn("model", F.explode(F.array(*[F.lit(m) for m in models]).cast("array<string>")))
    diff = F.col("pred") - F.col("obs")
    large = F.col("obs") >= F.lit(float(at))
    sums = (
        cells.join(preds.select(*by, "model", "series_id", "ts", F.col("value").alias("pred")), [*by, "series_id", "ts"])
        .groupBy("window", *by, "model", "series_id")
        .agg(F.count(diff).alias("n"), F.sum(diff * diff).alias("se"), F.sum(F.abs(diff)).alias("ae"),
             F.count(F.when(large, diff)).alias("n_large"), F.sum(F.when(large, F.abs(diff) / F.col("obs"))).alias("ape"))
    )
    keys = ["window", *by, "model", "series_id"]
    return expected.join(sums, keys, "left").select(
        *keys, *[F.coalesce(c, F.lit(0)).alias(c) if c in ("n", "n_large") else F.col(c)
                 for c in ("n", "se", "ae", "n_large", "ape", "n_cell", "n_at")])


def roll_up(sums: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Metrics per ``keys``, all cells pooled; a metric with a missing prediction is NULL."""
    total = sums.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("n", "se", "ae", "n_large", "ape", "n_cell", "n_at")])
    full, full_at = F.col("n") == F.col("n_cell"), F.col("n_large") == F.col("n_at")
    mse = F.when(full, F.col("se") / F.col("n"))
    return total.select(
        *keys, F.sqrt(mse).alias("rmse"), F.when(full, F.col("ae") / F.col("n")).alias("mae"),
        F.when(full_at & (F.col("n_at") > 0), 100 * F.col("ape") / F.col("n_large")).alias("mape_at"), mse.alias("mse"))


def global_errors(sums: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return roll_up(sums, ["window", *by, "model"])


def series_errors(sums: DataFrame, metric: str, models: Sequence[str], series: Sequence[str] | None = None,
                  labels: dict[str, str] | None = None) -> DataFrame:
    """One metric per series with the models as columns: ``window, __time_series__, <models>, __index__``.

    ``series`` gives the order behind ``__index__``; ``labels`` replaces ids by names.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}")
    per = roll_up(sums, ["window", "model", "series_id"])
    wide = per.groupBy("window", "series_id").pivot("model", list(models)).agg(F.first(metric))
    if series is not None:
        wide = ordinal_index(wide, "series_id", series)
    if labels is not None:
        from ..functions.dates import lookup
        wide = wide.withColumn("series_id", lookup("series_id", labels))
    return wide.withColumnRenamed("series_id", "__time_series__")


def aggregate_daily(df: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Sum to days before evaluating; ``extra`` keeps e.g. the model."""
    return (df.groupBy(*extra, "series_id", F.to_date("ts").cast("timestamp_ntz").alias("ts"))
            .agg(F.sum("value").alias("value")))


def aggregate_hourly(df: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    from ..functions.dates import truncate_to
    return df.groupBy(*extra, "series_id", truncate_to("ts", 3600).alias("ts")).agg(F.sum("value").alias("value"))


def only_times(df: DataFrame, times: DataFrame) -> DataFrame:
    """Keep the steps listed in ``times(ts)``, e.g. those with an event."""
    return df.join(times.select("ts"), "ts", "left_semi")


def r2_scores(actual: DataFrame, pred: DataFrame, keys: Sequence[str], units: Sequence[str],
              weights: str = "uniform") -> DataFrame:
    """R-squared per ``keys``, averaged over the outputs (steps); ``weights='variance'`` weighs by their spread.

    ``actual`` holds (units, day, step, y), ``pred`` (units, ..., day, step, pred). A constant output scores 1 when
    it is met exactly, else 0.
    """
    pairs = pred.join(actual, [*units, "day", "step"])
    y, p = F.col("y"), F.col("pred")
    per_step = pairs.groupBy(*keys, "step").agg(
        F.sum((y - p) * (y - p)).alias("res"), (F.var_pop(y) * F.count(y)).alias("tot"), (F.min(y) == F.max(y)).alias("flat"))
    score: Column = F.when(F.col("flat"), F.when(F.col("res") == 0, 1.0).otherwise(0.0)).otherwise(
        1 - F.col("res") / F.col("tot"))
    if weights == "uniform":
        return per_step.groupBy(*keys).agg(F.avg(score).alias("score"))
    weight = F.when(F.col("flat"), F.lit(0.0)).otherwise(F.col("tot"))
    return per_step.groupBy(*keys).agg(
        F.coalesce(F.sum(score * weight) / F.sum(weight), F.avg(score)).alias("score"))
