"""Comparison of several models' predictions with the observations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tempora.functions.dates import day_start, truncate_to
from tempora.operators.evaluate import (aggregate_daily, aggregate_hourly, error_sums, global_errors, only_times,
                                        series_errors)
from tempora.operators.joins import common_times
from tempora.plans.evaluation import evaluate, stack_predictions
from tempora.session import materialize

from .base import DAILY_DENSE, daily_dense, event_counts, query, table, weekday

MODELS = ["last_week", "mean", "weekday"]
SERIES = ["5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH", "1-URGENT"]
WINDOWS = {"train": ("1995-01-10", "1999-12-31 23:45:00"), "test": ("2000", "2001-06")}


def _predictions(dense):
    """Three models on daily counts: the training mean, the training mean per weekday (not given for the first of a
    month) and the value seven days before (not given where that day is absent)."""
    train = F.year("day") < 2000
    mean = dense.where(train).groupBy("series_id").agg(F.bround(F.avg("value"), 3).alias("p"))
    by_day = dense.where(train).groupBy("series_id", weekday().alias("wd")).agg(F.bround(F.avg("value"), 3).alias("p"))
    cells = dense.select("series_id", "ts", "day", weekday().alias("wd"))
    return materialize(stack_predictions({
        "mean": cells.join(mean, "series_id").withColumnRenamed("p", "value"),
        "weekday": cells.where(F.dayofmonth("day") != 1).join(by_day, ["series_id", "wd"]).withColumnRenamed("p", "value"),
        "last_week": dense.select("series_id", day_start(F.date_add("day", 7)).alias("ts"), "value"),
    }), "preds")


def _inputs(spark, sf_dir):
    dense = materialize(daily_dense(spark, sf_dir), "dense")
    return dense.select("series_id", "ts", "value"), _predictions(dense)


_PREDS = DAILY_DENSE + """, pm AS (SELECT series_id, round_even(avg(value), 3) AS p FROM ddense WHERE year(day) < 2000 GROUP BY 1),
pw AS (SELECT series_id, isodow(day) AS wd, round_even(avg(value), 3) AS p FROM ddense WHERE year(day) < 2000 GROUP BY 1, 2),
preds AS (SELECT 'mean' AS model, series_id, day, p AS pred FROM ddense JOIN pm USING (series_id)
  UNION ALL SELECT 'weekday', d.series_id, d.day, p FROM ddense d JOIN pw ON pw.series_id = d.series_id AND pw.wd = isodow(d.day) WHERE day(d.day) <> 1
  UNION ALL SELECT 'last_week', series_id, day + 7, value FROM ddense),
shared AS (SELECT day FROM preds GROUP BY 1 HAVING count(DISTINCT model) = 3),
win AS (SELECT 'train' AS "window", day FROM shared WHERE day >= DATE '1995-01-10' AND day < DATE '2000-01-01'
  UNION ALL SELECT 'test', day FROM shared WHERE day >= DATE '2000-01-01' AND day < DATE '2001-06-01'),
cells AS (SELECT "window", model, series_id, d.value AS obs, p.pred FROM win JOIN ddense d USING (day) JOIN preds p USING (series_id, day))"""
_METRICS = {"rmse": "sqrt(avg((pred - obs) ** 2))", "mae": "avg(abs(pred - obs))",
            "mape_at": "100 * avg(CASE WHEN obs >= 2 THEN abs(pred - obs) / obs END)", "mse": "avg((pred - obs) ** 2)"}
_ALL = ", ".join(f"round({e}, 6) AS {n}" for n, e in _METRICS.items())


def _rounded(df, keys):
    return df.select(*keys, *[F.round(c, 6).alias(c) for c in df.columns if c not in keys])


@query("q30_common_dates", f"WITH {_PREDS} SELECT day FROM win WHERE \"window\" = 'train'")
def common_dates_query(spark, sf_dir):
    obs, preds = _inputs(spark, sf_dir)
    inside = obs.where((F.col("ts") >= "1995-01-10") & (F.col("ts") < "2000-01-01"))
    return common_times(inside, preds).select(F.to_date("ts").alias("day"))


@query("q31_global_errors", f"WITH {_PREDS} SELECT \"window\", model, {_ALL} FROM cells GROUP BY 1, 2")
def global_errors_query(spark, sf_dir):
    sums = error_sums(*_inputs(spark, sf_dir), WINDOWS, at=2)
    return _rounded(global_errors(sums), ["window", "model"])


def _per_series(metric):
    cols = ", ".join(f"max(CASE WHEN model = '{m}' THEN v END) AS {m}" for m in MODELS)
    index = "CASE series_id " + " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(SERIES)) + " END"
    return (f"WITH {_PREDS}, e AS (SELECT \"window\", model, series_id, round({_METRICS[metric]}, 6) AS v FROM cells GROUP BY 1, 2, 3) "
            f"SELECT \"window\", series_id AS __time_series__, {cols}, {index} AS __index__ FROM e GROUP BY 1, 2")


def _series_query(metric):
    def run(spark, sf_dir):
        sums = error_sums(*_inputs(spark, sf_dir), WINDOWS, at=2)
        return _rounded(series_errors(sums, metric, MODELS, SERIES), ["window", "__time_series__", "__index__"])
    return run


for _name, _metric in (("q32_series_mape", "mape_at"), ("q33_series_rmse", "rmse"), ("q34_series_mae", "mae")):
    query(_name, _per_series(_metric))(_series_query(_metric))


# ---- variants: daily and hourly sums, event steps only, per class ----------------------------------------------------

_QUARTERS = """quarter AS (SELECT event_type AS series_id, time_bucket(INTERVAL 15 MINUTE, ts) AS ts, count(*)::DOUBLE AS value FROM events GROUP BY 1, 2),
avgs AS (SELECT series_id, hour(ts) AS h, round_even(avg(value), 3) AS p FROM quarter GROUP BY 1, 2),
qp AS (SELECT q.series_id, q.ts, q.value AS obs, a.p AS pred FROM quarter q JOIN avgs a ON a.series_id = q.series_id AND a.h = hour(q.ts))"""


def _quarter_inputs(spark, sf_dir):
    obs = event_counts(spark, sf_dir, 900)
    means = obs.groupBy("series_id", F.hour("ts").alias("h")).agg(F.bround(F.avg("value"), 3).alias("p"))
    preds = obs.withColumn("h", F.hour("ts")).join(means, ["series_id", "h"]).select(
        F.lit("hour_mean").alias("model"), "series_id", "ts", F.col("p").alias("value"))
    return obs, preds


def _variant(obs, preds, by=()):
    sums = error_sums(obs, preds, {"all": (None, None)}, at=2, by=by)
    return _rounded(global_errors(sums, by), ["window", *by, "model"])


@query("q35_agg_daily_eval", f"""WITH {_QUARTERS}, g AS (SELECT series_id, ts::DATE AS t, sum(obs) AS obs, sum(pred) AS pred FROM qp GROUP BY 1, 2)
SELECT 'all' AS "window", 'hour_mean' AS model, {_ALL} FROM g""")
def daily_eval_query(spark, sf_dir):
    obs, preds = _quarter_inputs(spark, sf_dir)
    return _variant(aggregate_daily(obs), aggregate_daily(preds, ["model"]))


@query("q36_agg_hour_eval", f"""WITH {_QUARTERS}, g AS (SELECT series_id, date_trunc('hour', ts) AS t, sum(obs) AS obs, sum(pred) AS pred FROM qp GROUP BY 1, 2)
SELECT 'all' AS "window", 'hour_mean' AS model, {_ALL} FROM g""")
def hourly_eval_query(spark, sf_dir):
    obs, preds = _quarter_inputs(spark, sf_dir)
    return _variant(aggregate_hourly(obs), aggregate_hourly(preds, ["model"]))


@query("q37_event_filter_eval", f"""WITH {_QUARTERS}, times AS (SELECT DISTINCT time_bucket(INTERVAL 15 MINUTE, ts) AS ts FROM events WHERE event_type = 'error' AND value > 20)
SELECT 'all' AS "window", 'hour_mean' AS model, {_ALL} FROM qp WHERE ts IN (SELECT ts FROM times)""")
def event_filter_query(spark, sf_dir):
    """Only the quarter hours with a large error event count."""
    obs, preds = _quarter_inputs(spark, sf_dir)
    large = (F.col("event_type") == "error") & (F.col("value") > 20)
    times = table(spark, sf_dir, "events").where(large).select(truncate_to("ts", 900).alias("ts")).distinct()
    return _variant(only_times(obs, times), preds)


@query("q38_class_eval", f"""WITH o AS (SELECT o_orderstatus AS class, o_orderpriority AS series_id, o_orderdate AS ts, count(*)::DOUBLE AS obs FROM orders GROUP BY 1, 2, 3),
m AS (SELECT class, series_id, round_even(avg(obs), 3) AS pred FROM o GROUP BY 1, 2)
SELECT 'all' AS "window", class, 'mean' AS model, {_ALL} FROM o JOIN m USING (class, series_id) GROUP BY class""")
def class_eval_query(spark, sf_dir):
    """The same evaluation with one result per class of the counted orders."""
    obs = materialize(table(spark, sf_dir, "orders").groupBy(
        F.col("o_orderstatus").alias("class"), F.col("o_orderpriority").alias("series_id"),
        day_start(F.to_date("o_orderdate")).alias("ts")).agg(F.count(F.lit(1)).cast("double").alias("value")), "class")
    means = obs.groupBy("class", "series_id").agg(F.bround(F.avg("value"), 3).alias("p"))
    preds = obs.join(means, ["class", "series_id"]).select(
        "class", F.lit("mean").alias("model"), "series_id", "ts", F.col("p").alias("value"))
    return _variant(obs, preds, ["class"])


@query("q55_evaluation_job", f"""WITH {_PREDS}, e AS (SELECT "window", model, series_id, {_ALL} FROM cells GROUP BY 1, 2, 3),
g AS (SELECT "window", model, {_ALL} FROM cells GROUP BY 1, 2)
SELECT 'global' AS report, "window", '*' AS series_id, model, mape_at, rmse, mae FROM g
UNION ALL SELECT 'series', "window", series_id, model, mape_at, rmse, mae FROM e""")
def evaluation_job_query(spark, sf_dir):
    """The whole report: global errors and the three per-series tables, stacked."""
    tables = evaluate(*_inputs(spark, sf_dir), WINDOWS, MODELS, at=2, series=SERIES)
    per = None
    for metric in ("mape_at", "rmse", "mae"):
        long = tables[metric].unpivot(["window", "__time_series__"], MODELS, "model", metric)
        per = long if per is None else per.join(long, ["window", "__time_series__", "model"])
    per = per.select(F.lit("series").alias("report"), "window", F.col("__time_series__").alias("series_id"), "model",
                     "mape_at", "rmse", "mae")
    total = tables["global"].select(F.lit("global").alias("report"), "window", F.lit("*").alias("series_id"), "model",
                                    "mape_at", "rmse", "mae")
    return _rounded(total.unionByName(per), ["report", "window", "series_id", "model"])
