"""Fit-predict and optimise-fit-predict jobs."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..functions.dates import label_between
from ..operators import models
from ..operators.grid import densify, steps_per_day
from ..operators.models.base import Fitted
from ..operators.reshape import day_matrix_long, day_vectors, feature_frame, rows_from_steps
from ..operators.scale import fit_scaler, scale, unscale
from ..operators.select import drop_constant_features, floor_zero
from ..operators.tune import best_params, grid_search, param_combinations, resumable_search
from ..operators.windows import prefix_split
from ..session import materialize
from ..sources.tables import write_predictions, write_table


@dataclass
class Job:
    """What a run needs besides its two input tables."""

    estimator: str
    train: tuple[str | None, str | None]
    day_features: Sequence[str]
    step_features: Sequence[str] = ()
    one_hot: Sequence[str] = ()
    window: tuple[str | None, str | None] = (None, None)
    start_time: str = "00:00:00"
    end_time: str = "23:45:00"
    step_seconds: int = 900
    scaler_x: str | None = None
    scaler_y: str | None = None
    reduce: bool = True
    reduce_on: str = "all"
    positional_split: bool = False
    floor: str = "original"
    decimals: int | None = 3
    name: str | None = None

    @property
    def model(self) -> str:
        return self.name or self.estimator


@dataclass
class Prepared:
    """Day matrix, targets (scaled on the fly if asked for) and split, over stored tables."""

    x: DataFrame
    y: DataFrame
    split: DataFrame
    y_scaler: DataFrame | None

    def train(self) -> tuple[DataFrame, DataFrame]:
        days = self.split.where("is_train").select("day")
        return self.x.join(days, "day", "left_semi"), self.y.join(days, "day", "left_semi")


def prepare(obs: DataFrame, features: DataFrame, job: Job, series: Sequence[str] | None = None) -> Prepared:
    """Slice, densify, align, reshape, split and scale.

    The features form one day matrix for all series (calendar-sized); the targets stay long. Both are written once
    because tuning, fitting and predicting all read them. ``obs`` should be a stored table: filling gaps reads its
    series, its days and its values.
    """
    inside = label_between("ts", *job.window)
    obs = obs.where(inside)
    if series is not None:
        obs = obs.where(F.col("series_id").isin(list(series)))
    obs = obs.select("series_id", "ts", "value")
    grid = dict(start_time=job.start_time, end_time=job.end_time, step_seconds=job.step_seconds)
    obs_days = obs.select(F.to_date("ts").alias("day")).distinct()
    frame, at_step, at_day = feature_frame(features.where(inside), job.step_features, job.day_features, job.one_hot,
                                           keep_days=obs_days, **grid)
    n_steps = steps_per_day(job.start_time, job.end_time, job.step_seconds)

    x_long = day_matrix_long(frame, at_step, at_day, n_steps)
    split = materialize(prefix_split(frame.select("day"), *job.train, positional=job.positional_split), "split")
    train_days = split.where("is_train").select("day")
    if job.reduce:
        seen = x_long.join(train_days, "day", "left_semi") if job.reduce_on == "train" else None
        x_long = drop_constant_features(x_long, fit_on=seen)
    if job.scaler_x:
        stats = fit_scaler(x_long.join(train_days, "day", "left_semi"), job.scaler_x, ["idx"])
        x_long = scale(x_long, stats, ["idx"])
    x = materialize(day_vectors(x_long), "x")

    dense = densify(obs, **grid).join(frame.select("ts"), "ts", "left_semi")
    y = materialize(dense.select("series_id", "day", "step", F.col("value").alias("y")), "y")
    y_scaler = None
    if job.scaler_y:
        keys = ["series_id", "step"]
        y_scaler = materialize(fit_scaler(y.join(train_days, "day", "left_semi"), job.scaler_y, keys, "y"), "yscaler")
        y = scale(y, y_scaler, keys, "y")
    return Prepared(x, y, split, y_scaler)


def predict_rows(fitted: Fitted, data: Prepared, job: Job) -> DataFrame:
    """Predictions of all days as (model, series_id, ts, value).

    ``floor='scaled'`` cuts at 0 before the scaling is undone, ``'original'`` after it.
    """
    pred = models.predict(fitted, data.x, floor=job.floor == "scaled")
    pred = unscale(pred, data.y_scaler, ["series_id", "step"], "pred")
    if job.floor == "original":
        pred = pred.withColumn("pred", floor_zero("pred"))
    rows = rows_from_steps(pred.drop("param_idx"), job.step_seconds, job.start_time, "pred", job.decimals)
    return rows.select(F.lit(job.model).alias("model"), "series_id", "ts", "value")


def fit_predict(obs: DataFrame, features: DataFrame, job: Job, params: dict | None = None,
                series: Sequence[str] | None = None, store: str | None = None,
                force: bool = False) -> tuple[DataFrame, Fitted]:
    """Fit with given parameters, shared by all series, and predict every day of the window."""
    data = prepare(obs, features, job, series)
    fitted = models.fit(job.estimator, *data.train(), params)
    if store:
        models.save_model(fitted, f"{store}/fit/{job.model}", force, vars(job))
        fitted = models.load_model(obs.sparkSession, f"{store}/fit/{job.model}")
    preds = predict_rows(fitted, data, job)
    if store:
        write_predictions(preds, f"{store}/prediction", job.window[0] or "", job.window[1] or "", force)
    return preds, fitted


@dataclass
class Optimised:
    predictions: DataFrame
    cv_results: DataFrame
    best: DataFrame
    fitted: Fitted


def optimise_fit_predict(obs: DataFrame, features: DataFrame, job: Job, grid: dict | Sequence[dict], n_splits: int = 5,
                         shuffle: bool = False, seed: int = 0, series: Sequence[str] | None = None,
                         store: str | None = None, force: bool = False, ledger: str | None = None) -> Optimised:
    """Grid search per series, refit with each series' best parameters, predict.

    With a ``ledger`` folder the search can be killed and called again, and a series that fails is reported in
    ``cv_results`` and left out of the rest instead of ending the run.
    """
    spark = obs.sparkSession
    data = prepare(obs, features, job, series)
    x_train, y_train = data.train()

    def keep(df: DataFrame, name: str) -> DataFrame:
        """Written once: to the store if there is one."""
        if not store:
            return materialize(df, name)
        return spark.read.schema(df.schema).parquet(write_table(df, f"{store}/optimize/{job.model}/{name}", force))

    if ledger:
        cv = keep(resumable_search(job.estimator, x_train, y_train, grid, ledger, n_splits, shuffle, seed), "cv_results")
    else:
        cv = keep(grid_search(job.estimator, x_train, y_train, grid, n_splits, shuffle, seed), "cv_results")
    best = keep(best_params(cv), "best_params")
    fitted = models.fit(job.estimator, x_train, y_train, param_combinations(grid),
                        chosen=best.select("series_id", "param_idx"))
    if store:
        models.save_model(fitted, f"{store}/fit/{job.model}", force, vars(job))
        fitted = models.load_model(spark, f"{store}/fit/{job.model}")
    preds = predict_rows(fitted, data, job)
    if store:
        write_predictions(preds, f"{store}/prediction", job.window[0] or "", job.window[1] or "", force)
    return Optimised(preds, cv, best, fitted)
