"""Wide/long, day matrices and back to time rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.dates import day_start, seconds, time_of_day
from ..session import materialize
from .encode import categories, one_hot
from .grid import clock_seconds, day_grid, densify, fill_forward_backward
from .stats import pivot_mean


def wide_to_long(df: DataFrame, index: str = "ts", series: Sequence[str] | None = None) -> DataFrame:
    """One column per series -> (series_id, ts, value)."""
    series = list(series or [c for c in df.columns if c != index])
    typed = df.select(index, *[F.col(f"`{s}`").cast("double").alias(s) for s in series])
    return (typed.unpivot([index], series, "series_id", "value")
            .select("series_id", F.col(index).alias("ts"), "value"))


def long_to_wide(df: DataFrame, series: Sequence[str], index: str = "ts", value: str = "value") -> DataFrame:
    """(series_id, ts, value) -> one column per listed series; (series, ts) is unique."""
    return df.groupBy(index).pivot("series_id", list(series)).agg(F.first(value))


def feature_frame(features: DataFrame, step_features: Sequence[str], day_features: Sequence[str],
                  one_hot_features: Sequence[str] = (), start_time: str = "00:00:00", end_time: str = "23:45:00",
                  step_seconds: int = 900, keep_days: DataFrame | None = None) -> tuple[DataFrame, list[str], list[str]]:
    """Complete, encoded features per grid step: (day, step, ts, features...).

    Step features must be given for every step. Day features may be given at midnight only: they are filled forward,
    then backward, over the grid of the feature days. Rows with a missing feature are dropped, unless it is one-hot; ``keep_days`` then
    restricts the days. The filled table is stored, so that the many indicator columns are a plain projection of a
    file. Also returns the names of the step and of the day features after encoding.
    """
    days = features.select(F.to_date("ts").alias("day")).distinct()
    grid = day_grid(days, start_time, end_time, step_seconds)
    frame = grid.join(features.select("ts", *day_features), "ts", "left")
    if day_features:
        frame = fill_forward_backward(frame, day_features)
    frame = frame.join(features.select("ts", *step_features), "ts")
    plain = [c for c in frame.columns if c not in one_hot_features]  # a missing category has all its indicators at 0
    frame = frame.na.drop("any", subset=plain)
    if keep_days is not None:
        frame = frame.join(keep_days, "day", "left_semi")
    frame = materialize(frame, "features")
    known = categories(features, one_hot_features)
    frame = one_hot(frame, one_hot_features, drop_last=True, values=known)

    def names(group: Sequence[str]) -> list[str]:
        plain = [f for f in group if f not in known]
        return plain + [f"{f}={v}" for f in group if f in known for v in known[f][:-1]]

    return frame, names(step_features), names(day_features)


def align_xy(obs: DataFrame, features: DataFrame, step_features: Sequence[str], day_features: Sequence[str],
             one_hot_features: Sequence[str] = (), start_time: str = "00:00:00", end_time: str = "23:45:00",
             step_seconds: int = 900) -> tuple[DataFrame, list[str], list[str]]:
    """Dense observations (series_id, ts, value) joined to :func:`feature_frame` on the time step."""
    frame, at_step, at_day = feature_frame(features, step_features, day_features, one_hot_features, start_time,
                                           end_time, step_seconds)
    dense = densify(obs, start_time, end_time, step_seconds)
    return dense.join(frame.drop("day", "step"), "ts"), at_step, at_day


def feature_names(step_features: Sequence[str], day_features: Sequence[str], n_steps: int) -> list[str]:
    return [f"{f}-T{i}" for f in step_features for i in range(n_steps)] + list(day_features)


def day_matrix_long(frame: DataFrame, step_features: Sequence[str], day_features: Sequence[str],
                    n_steps: int) -> DataFrame:
    """(day, idx, value): the flattened step features, feature-major, then the day features of the first step.

    ``frame`` has one row per (day, step). One projection without a shuffle; the width n_features * n_steps exists
    only as rows.
    """
    at_step = [F.struct((F.lit(i * n_steps) + F.col("step")).cast("int").alias("idx"), F.col(f"`{f}`").cast("double").alias("value"))
               for i, f in enumerate(step_features)]
    offset = len(step_features) * n_steps
    at_day = [F.struct(F.lit(offset + j).alias("idx"), F.col(f"`{f}`").cast("double").alias("value"))
              for j, f in enumerate(day_features)]
    empty = F.array().cast("array<struct<idx:int,value:double>>")
    cells = F.array(*at_step) if at_step else empty
    if at_day:
        cells = F.concat(cells, F.when(F.col("step") == 0, F.array(*at_day)).otherwise(empty))
    return frame.select("day", F.explode(cells).alias("c")).select("day", "c.idx", "c.value")


def day_vectors(x_long: DataFrame, fill: float | None = None) -> DataFrame:
    """(day, idx, value) -> (day, x ARRAY<DOUBLE>) ordered by idx, one entry for every idx of the table.

    A day without a cell gets ``fill`` in its place, NULL if none is given; estimators leave days with a NULL out. A
    group has one entry per feature.
    """
    every = x_long.agg(F.collect_set("idx").alias("i")).scalar()
    own = x_long.groupBy("day").agg(F.collect_list(F.struct("idx", "value")).alias("c")).withColumn("every", every)
    missing = F.array_except("every", F.transform("c", lambda c: c["idx"]))
    blank = F.lit(fill).cast("double")
    full = F.array_sort(F.concat("c", F.transform(missing, lambda i: F.struct(i.alias("idx"), blank.alias("value")))))
    return own.select("day", F.transform(full, lambda c: c["value"]).alias("x"))


def day_time_pivot(df: DataFrame, day_step_features: Sequence[str], midnight_features: Sequence[str],
                   times: Sequence[str]) -> DataFrame:
    """Per day the step features pivoted over the clock times, plus features taken from the midnight row."""
    base = df.withColumn("day", F.to_date("ts")).withColumn("time", time_of_day("ts"))
    at_midnight = base.where(F.col("time") == "00:00:00").select("day", *midnight_features)
    if not day_step_features:
        return at_midnight
    return pivot_mean(base, ["day"], "time", times, day_step_features).join(at_midnight, "day", "left")


def rows_from_day_arrays(pred: DataFrame, step_seconds: int = 900, start_time: str = "00:00:00", column: str = "pred",
                         decimals: int | None = 3) -> DataFrame:
    """(series_id, day, ARRAY) -> (series_id, ts, value), rounded half-even."""
    rows = pred.select("series_id", "day", F.posexplode(column).alias("step", "value"))
    return rows_from_steps(rows, step_seconds, start_time, "value", decimals)


def rows_from_steps(pred: DataFrame, step_seconds: int = 900, start_time: str = "00:00:00", column: str = "pred",
                    decimals: int | None = 3) -> DataFrame:
    """(series_id, day, step, value) -> (series_id, ts, value); other columns are kept."""
    ts = day_start("day") + seconds(F.lit(clock_seconds(start_time)) + F.col("step") * step_seconds)
    value = F.col(column) if decimals is None else F.bround(column, decimals)
    rest = [c for c in pred.columns if c not in ("series_id", "day", "step", column)]
    return pred.select(*rest, "series_id", ts.alias("ts"), value.alias("value"))
