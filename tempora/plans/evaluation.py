"""Evaluation report over training and test windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..operators.evaluate import Windows, error_sums, global_errors, series_errors
from ..session import materialize
from ..sources.tables import write_report


def stack_predictions(named: dict[str, DataFrame]) -> DataFrame:
    """Several models' (series_id, ts, value) tables as one table with a ``model`` column."""
    out = None
    for name, df in named.items():
        part = df.select(F.lit(name).alias("model"), "series_id", "ts", "value")
        out = part if out is None else out.unionByName(part)
    return out


def evaluate(obs: DataFrame, preds: DataFrame, windows: Windows, models: Sequence[str], at: float = 5.0,
             series: Sequence[str] | None = None, labels: dict[str, str] | None = None, store: str | None = None,
             force: bool = False) -> dict[str, DataFrame]:
    """Global error table plus the per-series tables of MAPE, RMSE and MAE.

    All tables are roll-ups of one stored table of error sums, whose size is windows * models * series.
    """
    sums = materialize(error_sums(obs, preds.where(F.col("model").isin(list(models))), windows, at, models=models), "errors")
    out = {"global": global_errors(sums).withColumn("at", F.lit(float(at)))}
    for metric in ("mape_at", "rmse", "mae"):
        out[metric] = series_errors(sums, metric, models, series, labels)
    if store:
        for window in windows:
            write_report(out["global"].where(F.col("window") == window).drop("window"), f"{store}/errors_{window}set", force)
    return out
