"""Stores and end-to-end jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tempora.functions.dates import format_padded, parse_timestamp
from tempora.operators import models
from tempora.operators.models import ha
from tempora.operators.grid import day_grid
from tempora.operators.reshape import day_time_pivot, long_to_wide, rows_from_steps
from tempora.plans.prediction import Job, fit_predict, optimise_fit_predict
from tempora.session import fresh_path, materialize
from tempora.sources.tables import (read_days, read_delimited, read_joined, read_manifest, read_observations, read_periods,
                                    write_predictions, write_report, write_table, write_wide)

from .averages import _CV, _TUPLES
from .base import (CALENDAR, DAILY, HOURLY_DENSE, ORDER_DAYS, daily_dense, day_vectors_of, event_counts, hourly_dense,
                   holidays_for, month, order_counts, order_days, periods_for, query, weekday)


@query("q52_store_roundtrip", f"WITH {DAILY} SELECT series_id, day::TIMESTAMP AS ts, value FROM daily")
def store_roundtrip_query(spark, sf_dir):
    """Tab separated text with a header, written and read with a stated schema."""
    obs = order_counts(spark, sf_dir)
    path = fresh_path(spark, "text")
    obs.select("series_id", format_padded("ts").alias("ts"), "value").write.csv(path, sep="\t", header=True)
    back = read_delimited(spark, path, "series_id STRING, ts STRING, value DOUBLE", sep="\t")
    return back.select("series_id", parse_timestamp("ts").alias("ts"), "value")


@query("q52_joined_files", """SELECT strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS ts, count(*) AS n,
  count(*) FILTER (o_orderpriority = '1-URGENT') AS n_urgent FROM orders GROUP BY 1""")
def joined_files_query(spark, sf_dir):
    """Two CSV files joined on their time column."""
    obs = order_counts(spark, sf_dir).withColumn("ts", format_padded("ts"))
    first = write_table(obs.groupBy("ts").agg(F.sum("value").cast("long").alias("n")), fresh_path(spark, "a"), fmt="csv")
    urgent = F.sum(F.when(F.col("series_id") == "1-URGENT", F.col("value")).otherwise(0)).cast("long")
    second = write_table(obs.groupBy("ts").agg(urgent.alias("n_urgent")), fresh_path(spark, "b"), fmt="csv")
    return read_joined(spark, [first, second], ["ts STRING, n BIGINT", "ts STRING, n_urgent BIGINT"])


@query("q52_wide_files", f"WITH {HOURLY_DENSE} SELECT series_id, ts, value FROM hdense")
def wide_files_query(spark, sf_dir):
    """The wide CSV layout (label column, one column per series), written, read back and melted."""
    series = ["click", "error", "purchase", "signup", "view"]
    path = write_wide(hourly_dense(spark, sf_dir), fresh_path(spark, "wide"), series)
    return read_observations(spark, [path], series)


@query("q52_day_lists", f"""WITH {ORDER_DAYS}, {CALENDAR} SELECT 'holiday' AS kind, day AS start_day, day AS end_day FROM holidays
UNION ALL SELECT 'period', start_day, end_day FROM periods""")
def day_lists_query(spark, sf_dir):
    """The headerless date list and the ``start;end`` list, written as text and read back."""
    days = order_days(spark, sf_dir)
    a, b = fresh_path(spark, "days"), fresh_path(spark, "periods")
    holidays_for(days).write.csv(a)
    periods_for(days).write.csv(b, sep=";")
    single = read_days(spark, a).select(F.lit("holiday").alias("kind"), F.col("day").alias("start_day"), F.col("day").alias("end_day"))
    return single.unionByName(read_periods(spark, b).select(F.lit("period").alias("kind"), "start_day", "end_day"))


@query("q52_model_store", f"""WITH {_TUPLES} SELECT series_id, wd, mon, round(avg(value), 6) AS pred,
  'orders' AS source, 'ha' AS estimator FROM t GROUP BY 1, 2, 3""")
def model_store_query(spark, sf_dir):
    """A model saved as tables with its manifest and loaded again."""
    y = materialize(daily_dense(spark, sf_dir).select("series_id", "day", "step", F.col("value").alias("y")), "y")
    x = day_vectors_of(y.select("day").distinct(), weekday() + 1, month())
    path = models.save_model(models.fit("ha", x, y), fresh_path(spark, "model"), infos={"source": "orders"})
    loaded = models.load_model(spark, path)
    infos = read_manifest(spark, f"{path}/manifest")
    return ha.as_table(loaded).select(
        "series_id", F.col("x")[0].cast("int").alias("wd"), F.col("x")[1].cast("int").alias("mon"), F.round("pred", 6).alias("pred"),
        F.lit(infos["source"]).alias("source"), F.lit(loaded.choice).alias("estimator"))


@query("q52_report_and_predictions", f"""WITH {DAILY} SELECT 'mean' AS model, series_id, round_even(avg(value), 2) AS value FROM daily GROUP BY 2
UNION ALL SELECT 'top', series_id, max(value) FROM daily GROUP BY 2""")
def report_sink_query(spark, sf_dir):
    """Predictions stored by model, then a rounded report as CSV."""
    obs = order_counts(spark, sf_dir)
    folder = fresh_path(spark, "prediction")
    means = obs.groupBy("series_id").agg(F.avg("value").alias("mean"), F.max("value").alias("top"))
    write_predictions(means.unpivot(["series_id"], ["mean", "top"], "model", "value"), folder, "1995-01-01 00:00:00", "2001-08-01")
    stored = spark.read.parquet(f"{folder}/1995-01-01_2001-08-01").select("model", "series_id", "value")
    report = write_report(stored, f"{folder}/report")
    return read_delimited(spark, report, "model STRING, series_id STRING, value DOUBLE")


def _hour_features(counts):
    """Calendar of the event days on the hourly grid; the day name is given at midnight only."""
    days = materialize(counts.select(F.to_date("ts").alias("day")).distinct(), "days")
    hours = day_grid(days, "00:00:00", "23:00:00", 3600)
    return hours.select("ts", F.when(F.col("step") == 0, F.date_format("day", "EEEE")).alias("day_en"))


_HOURLY_JOB = dict(estimator="ha", train=("2024-01-01", "2024-01-21 23:00:00"), day_features=["day_en"], one_hot=["day_en"],
                   window=("2024", "2024-01-30 23:00:00"), end_time="23:00:00", step_seconds=3600)
_WEEKDAY_MEANS = """SELECT 'ha' AS model, d.series_id, d.ts, round_even(m.p, 3) AS value FROM hdense d JOIN (
  SELECT series_id, step, isodow(day) AS wd, avg(value) AS p FROM hdense WHERE day <= DATE '2024-01-21' GROUP BY 1, 2, 3) m
  ON m.series_id = d.series_id AND m.step = d.step AND m.wd = isodow(d.day)"""


@query("q53_fit_predict_job", f"WITH {HOURLY_DENSE} {_WEEKDAY_MEANS}")
def fit_predict_query(spark, sf_dir):
    """Slice, densify, align, one-hot, scale, fit, store, reload, predict, unscale, floor, round."""
    counts = event_counts(spark, sf_dir)
    job = Job(scaler_y="minmax", **_HOURLY_JOB)
    return fit_predict(counts, _hour_features(counts), job, {"method": "mean"}, store=fresh_path(spark, "job"))[0]


@query("q53_lr_job", f"WITH {HOURLY_DENSE} " + _WEEKDAY_MEANS.replace("'ha'", "'lr'"))
def lr_job_query(spark, sf_dir):
    """Least squares on the weekday indicators, scaled features and targets: every step predicts its weekday mean."""
    counts = event_counts(spark, sf_dir)
    job = Job(**{**_HOURLY_JOB, "estimator": "lr"}, scaler_x="standard", scaler_y="standard")
    return fit_predict(counts, _hour_features(counts), job, store=fresh_path(spark, "job"))[0]


@query("q53_single_series_job", f"WITH {HOURLY_DENSE} {_WEEKDAY_MEANS} WHERE d.series_id = 'click'")
def single_series_query(spark, sf_dir):
    counts = event_counts(spark, sf_dir)
    return fit_predict(counts, _hour_features(counts), Job(**_HOURLY_JOB), series=["click"])[0]


_HOURS = [f"{h:02d}:00:00" for h in range(24)]


@query("q53_standalone_average", f"""WITH {HOURLY_DENSE}, k AS (SELECT *, isodow(day) - 1 AS wd, sum(value) FILTER (step < 6) OVER (PARTITION BY series_id, day) > 2 AS busy FROM hdense),
f AS (SELECT d.day, list((d.step >= 8 AND d.step < 18 AND isodow(d.day) < 6)::INT ORDER BY d.step) AS open FROM (SELECT DISTINCT day, step FROM hdense) d GROUP BY 1),
m AS (SELECT series_id, step, open, avg(value) AS p FROM hdense JOIN f USING (day) WHERE day <= DATE '2024-01-21' GROUP BY 1, 2, 3)
SELECT h.series_id, h.ts, round_even(m.p, 3) AS value FROM hdense h JOIN f USING (day) JOIN m ON m.series_id = h.series_id AND m.step = h.step AND m.open = f.open""")
def standalone_average_query(spark, sf_dir):
    """The older layout: a step feature pivoted over the clock times makes the tuple of a day."""
    dense = materialize(hourly_dense(spark, sf_dir), "dense")
    wide = long_to_wide(dense, ["click"]).withColumn("open", (F.hour("ts").between(8, 17) & (F.weekday("ts") < 5)).cast("int"))
    pivot = day_time_pivot(wide.withColumn("flag", F.lit(1)), ["open"], ["flag"], _HOURS)
    x = materialize(pivot.select("day", F.array(*[F.col(f"`open|{t}`") for t in _HOURS], F.col("flag").cast("double")).alias("x")), "x")
    y = dense.select("series_id", "day", "step", F.col("value").alias("y"))
    early = F.col("day") <= "2024-01-21"
    pred = models.predict(models.fit("ha", x.where(early), y.where(early)), x)
    return rows_from_steps(pred.drop("param_idx"), 3600)


_JOB_CV = _CV + """, a AS (SELECT series_id, param_idx, avg(score) AS score FROM cv WHERE split = 'test' GROUP BY 1, 2),
best AS (SELECT series_id, param_idx FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY score DESC, param_idx) AS rn FROM a) WHERE rn = 1),
fin AS (SELECT series_id, wd, mon, avg(value) AS p0, median(value) AS p1 FROM t WHERE year(day) < 2000 GROUP BY 1, 2, 3)"""


@query("q54_optimise_job", f"""WITH {_JOB_CV} SELECT 'tuned' AS model, t.series_id, t.day::TIMESTAMP AS ts,
  round_even(CASE param_idx WHEN 0 THEN p0 ELSE p1 END, 3) AS value FROM t JOIN best USING (series_id) JOIN fin USING (series_id, wd, mon)""")
def optimise_query(spark, sf_dir):
    """Grid search per series on the training years, refit with the best parameters, predict every day."""
    counts = order_counts(spark, sf_dir)
    features = order_days(spark, sf_dir).select(F.col("day").cast("timestamp_ntz").alias("ts"), (weekday() + 1).alias("wd"),
                                                month().alias("mon"))
    job = Job("ha", ("1995", "1999-12-31 00:00:00"), ["wd", "mon"], end_time="00:00:00", step_seconds=86400, name="tuned")
    return optimise_fit_predict(counts, features, job, {"method": ["mean", "median"]}, store=fresh_path(spark, "job")).predictions


@query("q54_optimise_en_job")
def optimise_en_query(spark, sf_dir):
    """Grid search over an elastic net with shuffled folds, per series, on calendar indicators."""
    counts = order_counts(spark, sf_dir)
    features = order_days(spark, sf_dir).select(F.col("day").cast("timestamp_ntz").alias("ts"), F.date_format("day", "EEEE").alias("wd"),
                                                F.date_format("day", "MMMM").alias("mon"))
    job = Job("en", ("1995", "1999-12-31 00:00:00"), ["wd", "mon"], one_hot=["wd", "mon"], end_time="00:00:00", step_seconds=86400)
    grid = {"alpha": [0.001, 0.01, 0.1], "l1_ratio": [0.25, 1.0]}
    return optimise_fit_predict(counts, features, job, grid, shuffle=True, seed=1).predictions
