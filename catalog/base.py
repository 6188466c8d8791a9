"""Registry, shared inputs and the SQL fragments that describe them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tempora.functions.dates import day_start, truncate_to, weekday_id
from tempora.operators.grid import densify
from tempora.session import materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- observations -------------------------------------------------------------------------------------------------

def event_counts(spark, sf_dir, step_seconds: int = 3600) -> DataFrame:
    """Events per type and time step, stored once because gap filling reads it several times."""
    counts = (table(spark, sf_dir, "events")
              .groupBy(F.col("event_type").alias("series_id"), truncate_to("ts", step_seconds).alias("ts"))
              .agg(F.count(F.lit(1)).cast("double").alias("value")))
    return materialize(counts, "events")


def order_counts(spark, sf_dir) -> DataFrame:
    """Orders per priority and day at midnight."""
    counts = (table(spark, sf_dir, "orders")
              .groupBy(F.col("o_orderpriority").alias("series_id"), day_start(F.to_date("o_orderdate")).alias("ts"))
              .agg(F.count(F.lit(1)).cast("double").alias("value")))
    return materialize(counts, "orders")


def hourly_dense(spark, sf_dir) -> DataFrame:
    return densify(event_counts(spark, sf_dir), "00:00:00", "23:00:00", 3600)


def daily_dense(spark, sf_dir) -> DataFrame:
    return densify(order_counts(spark, sf_dir), "00:00:00", "00:00:00", 86400)


def order_days(spark, sf_dir) -> DataFrame:
    """Distinct order days, stored: one row per calendar day, read many times by the calendar joins."""
    return materialize(table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day")).distinct(), "days")


def daily_targets(spark, sf_dir) -> DataFrame:
    return daily_dense(spark, sf_dir).select("series_id", "day", "step", F.col("value").alias("y"))


def day_vectors_of(days: DataFrame, *features) -> DataFrame:
    """(day, x) with x built from expressions on ``day``."""
    return days.select("day", F.array(*[f.cast("double") for f in features]).alias("x"))


def weekday():
    return weekday_id("day")


def month():
    return F.month("day")


HOURLY = """hourly AS (SELECT event_type AS series_id, date_trunc('hour', ts) AS ts, count(*)::DOUBLE AS value
  FROM events GROUP BY 1, 2)"""
HOURLY_DENSE = HOURLY + """, hdense AS (
  SELECT s.series_id, d.day + to_hours(t.h) AS ts, d.day, t.h::INT AS step, coalesce(o.value, 0) AS value
  FROM (SELECT DISTINCT series_id FROM hourly) s
  CROSS JOIN (SELECT DISTINCT ts::DATE AS day FROM hourly) d CROSS JOIN range(24) t(h)
  LEFT JOIN hourly o ON o.series_id = s.series_id AND o.ts = d.day + to_hours(t.h))"""
DAILY = """daily AS (SELECT o_orderpriority AS series_id, o_orderdate::DATE AS day, count(*)::DOUBLE AS value
  FROM orders GROUP BY 1, 2)"""
DAILY_DENSE = DAILY + """, ddense AS (
  SELECT s.series_id, d.day, coalesce(o.value, 0) AS value
  FROM (SELECT DISTINCT series_id FROM daily) s CROSS JOIN (SELECT DISTINCT day FROM daily) d
  LEFT JOIN daily o ON o.series_id = s.series_id AND o.day = d.day)"""
ORDER_DAYS = "days AS (SELECT DISTINCT o_orderdate::DATE AS day FROM orders)"

# ---- holidays and school periods, by rule for the years of the data -------------------------------------------------

# Month and day of the public holidays, first and last day of the school holidays.
HOLIDAYS = [(1, 1), (5, 1), (5, 8), (7, 14), (8, 15), (11, 1), (11, 11), (12, 25)]
PERIODS = [((1, 1), (1, 6)), ((2, 10), (2, 25)), ((4, 6), (4, 21)), ((7, 6), (9, 2)), ((10, 20), (11, 4)),
           ((12, 22), (12, 31))]


def _make_date(month: int, day: int):
    return F.make_date("y", F.lit(month), F.lit(day))


def holidays_for(days: DataFrame) -> DataFrame:
    years = days.select(F.year("day").alias("y")).distinct()
    return years.select(F.explode(F.array(*[_make_date(m, d) for m, d in HOLIDAYS])).alias("day"))


def periods_for(days: DataFrame) -> DataFrame:
    years = days.select(F.year("day").alias("y")).distinct()
    spans = F.array(*[F.struct(_make_date(*a).alias("start_day"), _make_date(*b).alias("end_day")) for a, b in PERIODS])
    return years.select(F.explode(spans).alias("p")).select("p.start_day", "p.end_day")


CALENDAR = (
    "years AS (SELECT DISTINCT year(day) AS y FROM days), holidays AS (SELECT make_date(y, m, d) AS day FROM years, (VALUES "
    + ", ".join(f"({m}, {d})" for m, d in HOLIDAYS) + ") h(m, d)), "
    "periods AS (SELECT make_date(y, m1, d1) AS start_day, make_date(y, m2, d2) AS end_day FROM years, (VALUES "
    + ", ".join(f"({a[0]}, {a[1]}, {b[0]}, {b[1]})" for a, b in PERIODS) + ") p(m1, d1, m2, d2)), "
    """bridges AS (SELECT DISTINCT b AS day FROM (
         SELECT CASE isodow(day) WHEN 4 THEN day + 1 WHEN 2 THEN day - 1 END AS b FROM holidays)
       WHERE b IS NOT NULL AND NOT EXISTS (SELECT 1 FROM periods WHERE b BETWEEN start_day AND end_day)),
    flags AS (SELECT day, isodow(day) - 1 AS wd,
         CASE WHEN EXISTS (SELECT 1 FROM periods p WHERE d.day BETWEEN p.start_day AND p.end_day) THEN 1 ELSE 0 END AS school_holiday,
         CASE WHEN d.day IN (SELECT day FROM bridges) THEN 1 ELSE 0 END AS extra_day_off,
         CASE WHEN d.day IN (SELECT day FROM holidays) THEN 1 ELSE 0 END AS holiday FROM days d),
    cats AS (SELECT *, CASE WHEN wd = 6 OR holiday = 1 OR extra_day_off = 1 THEN 'DIJFP'
         WHEN school_holiday = 1 AND wd = 5 THEN 'SAVS' WHEN school_holiday = 1 THEN 'JOVS'
         WHEN wd = 5 THEN 'SAHV' ELSE 'JOHV' END AS category1 FROM flags),
    cats2 AS (SELECT *, CASE WHEN category1 <> 'JOHV' THEN category1 || '_2' WHEN wd = 0 THEN 'LHV_2'
         WHEN wd IN (1, 3) THEN 'JMHV_2' WHEN wd = 2 THEN 'MHV_2' ELSE 'VHV_2' END AS category2 FROM cats)"""
)
