"""Error metrics as aggregate expressions.

A missing prediction or observation makes the metric NULL instead of being skipped.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _strict_avg(value: Column, wanted: Column | None = None) -> Column:
    wanted = F.lit(True) if wanted is None else wanted
    rows = F.count(F.when(wanted, F.lit(1)))
    values = F.count(F.when(wanted, value))
    return F.when(rows == values, F.avg(F.when(wanted, value)))


def mse(obs: Column, pred: Column) -> Column:
    return _strict_avg((pred - obs) * (pred - obs))


def rmse(obs: Column, pred: Column) -> Column:
    return F.sqrt(mse(obs, pred))


def mae(obs: Column, pred: Column) -> Column:
    return _strict_avg(F.abs(pred - obs))


def mape_at(obs: Column, pred: Column, at: float = 5.0) -> Column:
    """Percent error over the cells with ``obs >= at``; NULL when there is none."""
    return F.lit(100.0) * _strict_avg(F.abs(pred - obs) / obs, obs >= F.lit(float(at)))


def all_errors(obs: Column, pred: Column, at: float = 5.0) -> dict[str, Column]:
    return {"rmse": rmse(obs, pred), "mae": mae(obs, pred), "mape_at": mape_at(obs, pred, at), "mse": mse(obs, pred)}
