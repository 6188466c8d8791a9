"""Scalers, folds and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tempora.operators.scale import fit_scaler, scale, unscale
from tempora.operators.windows import count_days, kfold, prefix_split

from .base import DAILY_DENSE, ORDER_DAYS, daily_dense, order_days, query


def _scaled(spark, sf_dir, kind):
    dense = daily_dense(spark, sf_dir).select("series_id", "day", "value")
    stats = fit_scaler(dense.where(F.year("day") < 2000), kind, ["series_id"])
    return dense, stats, scale(dense, stats, ["series_id"])


_STATS = """, stats AS (SELECT series_id, avg(value) AS m, stddev_pop(value) AS sd, min(value) AS lo, max(value) AS hi
  FROM ddense WHERE year(day) < 2000 GROUP BY 1)"""


@query("q22_standard_scale", f"""WITH {DAILY_DENSE}{_STATS} SELECT series_id, day,
  round((value - m) / CASE WHEN sd = 0 THEN 1 ELSE sd END, 6) AS value FROM ddense JOIN stats USING (series_id)""")
def standard_scale_query(spark, sf_dir):
    return _scaled(spark, sf_dir, "standard")[2].withColumn("value", F.round("value", 6))


@query("q23_minmax_scale", f"""WITH {DAILY_DENSE}{_STATS} SELECT series_id, day,
  round((value - lo) / CASE WHEN hi = lo THEN 1 ELSE hi - lo END, 6) AS value FROM ddense JOIN stats USING (series_id)""")
def minmax_scale_query(spark, sf_dir):
    """Statistics of the training years only; later values may leave [0, 1]."""
    return _scaled(spark, sf_dir, "minmax")[2].withColumn("value", F.round("value", 6))


@query("q24_inverse_scale", f"WITH {DAILY_DENSE} SELECT series_id, day, value FROM ddense")
def inverse_scale_query(spark, sf_dir):
    _, stats, scaled = _scaled(spark, sf_dir, "standard")
    return unscale(scaled, stats, ["series_id"]).withColumn("value", F.round("value", 6))


@query("q28_train_split", f"""WITH {ORDER_DAYS}, r AS (SELECT day, day >= DATE '1996-01-01' AND day < DATE '1998-01-01' AS inside,
  row_number() OVER (ORDER BY day) AS rn FROM days)
SELECT day, inside::INT AS in_window, (rn <= (SELECT count(*) FROM r WHERE inside))::INT AS in_prefix FROM r""")
def train_split_query(spark, sf_dir):
    """Training days by date, and as the same number of days from the front of the table."""
    days = order_days(spark, sf_dir)
    by_date = prefix_split(days, "1996", "1997-12-31 23:45:00")
    by_place = prefix_split(days, "1996", "1997-12-31 23:45:00", positional=True)
    return by_date.select("day", F.col("is_train").cast("int").alias("in_window")).join(
        by_place.select("day", F.col("is_train").cast("int").alias("in_prefix")), "day")


@query("q28_count_train_days", """SELECT count(DISTINCT o_orderdate::DATE) AS n_days FROM orders
WHERE o_orderdate >= '1996-01-01' AND o_orderdate <= '1997-12-31'""")
def count_days_query(spark, sf_dir):
    return count_days(order_days(spark, sf_dir), "1996-01-01 00:00:00", "1997-12-31 00:00:00")


@query("q29_kfold", f"""WITH {ORDER_DAYS} SELECT day, (ntile(5) OVER (ORDER BY day) - 1)::INT AS fold,
  (ntile(5) OVER (ORDER BY md5(day::VARCHAR || '|1')) - 1)::INT AS shuffled_fold FROM days""")
def kfold_query(spark, sf_dir):
    days = order_days(spark, sf_dir)
    shuffled = kfold(days, 5, shuffle=True, seed=1).withColumnRenamed("fold", "shuffled_fold")
    return kfold(days, 5).join(shuffled, "day")
