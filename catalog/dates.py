"""Calendar and date functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tempora.functions import dates as D
from tempora.functions.calendar import (CATEGORY1_EN, CATEGORY1_ID, CATEGORY2_EN, CATEGORY2_ID, day_flags, flag_members,
                                        period_days, with_categories)
from tempora.operators.grid import day_grid, fill_forward_backward
from tempora.operators.select import label_slice
from tempora.operators.windows import place_in_order
from tempora.plans.calendar_table import calendar_table
from tempora.session import materialize

from .base import (CALENDAR, DAILY, HOURLY, ORDER_DAYS, event_counts, holidays_for, order_counts,
                   order_days, periods_for, query, table)


@query("q03_label_slice", f"""WITH {DAILY}
SELECT series_id, day, value FROM daily
WHERE strftime(day, '%Y-%m-%d %H:%M:%S') >= '1996' AND strftime(day, '%Y-%m-%d %H:%M:%S') <= '1998-03'""")
def label_slice_query(spark, sf_dir):
    """The slice is taken before the counts, on the column that the file has."""
    rows = label_slice(table(spark, sf_dir, "orders"), "1996", "1998-03", "o_orderdate")
    return rows.groupBy(F.col("o_orderpriority").alias("series_id"), F.to_date("o_orderdate").alias("day")).agg(F.count(F.lit(1)).cast("double").alias("value"))


@query("q03_sorted_days", """SELECT day, (row_number() OVER (ORDER BY day))::INT AS place FROM
(SELECT DISTINCT o_orderdate::DATE AS day FROM orders)""")
def sorted_days_query(spark, sf_dir):
    days = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    return place_in_order(days, ["day"]).withColumn("place", F.col("place").cast("int"))


@query("q06_grid_overshoot", """WITH span AS (SELECT event_type AS series_id, ts::DATE AS day,
  date_trunc('second', min(ts)) AS lo, date_trunc('second', max(ts)) AS hi FROM events GROUP BY 1, 2),
n AS (SELECT *, ceil(date_diff('second', lo, hi) / 1500.0)::BIGINT AS n FROM span)
SELECT series_id, day, k::INT AS k, lo + to_seconds(k * 1500) AS ts, lo + to_seconds((k + 1) * 1500) AS next_ts
FROM (SELECT *, unnest(range(n + 1)) AS k FROM n)""")
def grid_overshoot_query(spark, sf_dir):
    """A 25-minute grid from the first to the last event of each day; its last stamp is at or after the end."""
    second = D.from_epoch_seconds(D.epoch_seconds("ts"))
    span = (table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("series_id"), F.to_date("ts").alias("day"))
            .agg(F.min(second).alias("lo"), F.max(second).alias("hi")))
    grid = span.select("series_id", "day", F.posexplode(D.timestamp_list("lo", "hi", 1500)).alias("k", "ts"))
    return grid.withColumn("next_ts", D.next_timestamp("ts", 1500))


_FR = "['Lundi', 'Mardi', 'Mercredi', 'Jeudi', 'Vendredi', 'Samedi', 'Dimanche']"


@query("q07_date_scalars", f"""SELECT event_id, strftime(ts, '%Y-%m-%d-%H') || '-' || (minute(ts) // 15)::VARCHAR AS id_15,
  strftime(ts, '%Y-%m-%d-%H') || '-' || (minute(ts) // 30)::VARCHAR AS id_30, strftime(ts, '%Y-%m-%d-%H') AS id_60,
  (hour(ts) = 7)::INT AS is_hour_7, (minute(ts) = 15)::INT AS is_quarter_1, (minute(ts) = 30)::INT AS is_half_1,
  epoch_us(ts) // 1000000 AS unix_s, epoch_us(ts) // 1000 AS unix_ms, strftime(ts, '%Y-%-m-%-d %-H:%-M:%-S') AS text_ts,
  (isodow(ts) - 1)::INT AS day_id, {_FR}[isodow(ts)] AS day_fr, dayname(ts) AS day_en, dayname(ts) AS day_text,
  month(ts)::INT AS month_id, monthname(ts) AS month_en, (strftime(ts, '%m-%d') = '12-24')::INT AS dec_24,
  (strftime(ts, '%m-%d') = '12-31')::INT AS dec_31 FROM events""")
def date_scalars_query(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    day = D.weekday_id("ts")
    return ev.select(
        "event_id", D.bucket_id("ts", 15).alias("id_15"), D.bucket_id("ts", 30).alias("id_30"),
        D.bucket_id("ts", 60).alias("id_60"), D.is_hour("ts", 7).alias("is_hour_7"),
        D.is_quarter("ts", 1).alias("is_quarter_1"), D.is_half("ts", 1).alias("is_half_1"),
        D.epoch_seconds("ts").alias("unix_s"), D.epoch_millis("ts").alias("unix_ms"),
        D.format_timestamp("ts").alias("text_ts"), day.alias("day_id"), D.day_name(day).alias("day_fr"),
        D.day_name(day, french=False).alias("day_en"), D.day_name_en("ts").alias("day_text"),
        F.month("ts").alias("month_id"), D.month_name_en("ts").alias("month_en"),
        D.is_month_day("ts", "12-24").alias("dec_24"), D.is_month_day("ts", "12-31").alias("dec_31"))


@query("q08_local_to_utc", f"""WITH {ORDER_DAYS}, local AS (SELECT day + to_hours(h) AS ts FROM days, range(24) t(h)),
u AS (SELECT ts, ts AT TIME ZONE 'Europe/Paris' AS z FROM local),
f AS (SELECT ts, z, (z AT TIME ZONE 'Europe/Paris') <> ts AS gap,
  ((z - INTERVAL 1 HOUR) AT TIME ZONE 'Europe/Paris') = ts OR ((z + INTERVAL 1 HOUR) AT TIME ZONE 'Europe/Paris') = ts AS twice FROM u)
SELECT ts, CASE WHEN NOT gap AND NOT twice THEN z AT TIME ZONE 'UTC' END AS utc, gap::INT AS is_gap,
  (twice AND NOT gap)::INT AS is_overlap FROM f""")
def local_to_utc_query(spark, sf_dir):
    """Every hour of the order days read as Paris time; hours that do not exist or exist twice are flagged."""
    hours = day_grid(order_days(spark, sf_dir), "00:00:00", "23:00:00", 3600)
    return hours.select("ts", *[c.alias(n) for n, c in D.local_to_utc("ts", "Europe/Paris").items()])


@query("q09_school_period_join", f"WITH {ORDER_DAYS}, {CALENDAR} SELECT day, school_holiday FROM flags")
def school_period_query(spark, sf_dir):
    days = order_days(spark, sf_dir)
    return flag_members(days, period_days(periods_for(days)), "school_holiday")


@query("q10_holiday_flags", f"WITH {ORDER_DAYS}, {CALENDAR} SELECT day, school_holiday, extra_day_off, holiday FROM flags")
def holiday_flags_query(spark, sf_dir):
    days = order_days(spark, sf_dir)
    return day_flags(days, holidays_for(days), periods_for(days))


def _case(column: str, mapping: dict) -> str:
    literal = lambda v: str(v) if isinstance(v, int) else f"'{v}'"
    return f"CASE {column} " + " ".join(f"WHEN {literal(k)} THEN {literal(v)}" for k, v in mapping.items()) + " END"


@query("q11_day_categories", f"""WITH {ORDER_DAYS}, {CALENDAR} SELECT day, category1, category2,
  {_case('category1', CATEGORY1_ID)} AS category1_id, {_case('category1', CATEGORY1_EN)} AS category1_en,
  {_case('category2', CATEGORY2_ID)} AS category2_id, {_case('category2', CATEGORY2_EN)} AS category2_en FROM cats2""")
def day_categories_query(spark, sf_dir):
    days = order_days(spark, sf_dir)
    out = with_categories(day_flags(days, holidays_for(days), periods_for(days)))
    return out.drop("school_holiday", "extra_day_off", "holiday")


_WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
_MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October",
           "November", "December"]


def _flags(column: str, values) -> str:
    return ", ".join(f"""({column} = '{v}')::INT AS "{v}" """ for v in values)


@query("q12_calendar_table", f"""WITH bounds AS (SELECT min(o_orderdate) + INTERVAL 6 HOUR AS lo, max(o_orderdate) AS hi FROM orders),
grid AS (SELECT lo + to_seconds(k * 21600) AS ts FROM (SELECT lo, unnest(range(ceil(date_diff('second', lo, hi) / 21600.0)::BIGINT + 1)) AS k FROM bounds)),
days AS (SELECT DISTINCT ts::DATE AS day FROM grid), {CALENDAR},
codes AS (SELECT hms, (row_number() OVER (ORDER BY first) - 1)::INT AS code FROM (SELECT strftime(ts, '%H:%M:%S') AS hms, min(ts) AS first FROM grid GROUP BY 1))
SELECT g.ts, wd::INT AS "Day_id", {_FR}[wd + 1] AS "Day_fr", dayname(c.day) AS "Day_en", {_flags('dayname(c.day)', _WEEKDAYS)},
  school_holiday AS "School_holidays_france_zoneC", extra_day_off AS "Extra_day_off_france", holiday AS "Holidays_france",
  month(c.day)::INT AS "Month_id", monthname(c.day) AS "Month_en", {_flags('monthname(c.day)', _MONTHS)},
  k.hms AS hour_minute_second, k.code AS hour_minute_second_numerical,
  (k.code = 0)::INT AS "0", (k.code = 1)::INT AS "1", (k.code = 2)::INT AS "2", (k.code = 3)::INT AS "3",
  category2 AS "Category2", {_flags('category2', CATEGORY2_ID)}, {_case('category2', CATEGORY2_ID)} AS "Day_category2_id",
  {_case('category2', CATEGORY2_EN)} AS "Day_category2_en", category1 AS "Category1", {_flags('category1', CATEGORY1_ID)},
  {_case('category1', CATEGORY1_ID)} AS "Day_category1_id", {_case('category1', CATEGORY1_EN)} AS "Day_category1_en",
  (strftime(c.day, '%m-%d') = '12-24')::INT AS "24_december", (strftime(c.day, '%m-%d') = '12-31')::INT AS "31_december"
FROM grid g JOIN cats2 c ON c.day = g.ts::DATE JOIN codes k ON k.hms = strftime(g.ts, '%H:%M:%S')""")
def calendar_table_query(spark, sf_dir):
    """A six-hour grid over the order dates, starting at 06:00, so that clock code 0 is 06:00."""
    orders = table(spark, sf_dir, "orders")
    bounds = orders.agg((F.min("o_orderdate") + D.seconds(6 * 3600)).alias("lo"), F.max("o_orderdate").alias("hi"))
    grid = materialize(bounds.select(F.explode(D.timestamp_list("lo", "hi", 6 * 3600)).alias("ts")), "grid")
    days = grid.select(F.to_date("ts").alias("day")).distinct()
    return calendar_table(grid, holidays_for(days), periods_for(days))


@query("q13_ffill_bfill", f"""WITH {HOURLY}, given AS (SELECT d.day + to_hours(h) AS ts,
  CASE WHEN h = 0 AND isodow(d.day) <> 1 THEN d.total END AS total FROM
  (SELECT ts::DATE AS day, sum(value) AS total FROM hourly GROUP BY 1) d, range(24) t(h))
SELECT ts, coalesce(last_value(total IGNORE NULLS) OVER (ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  first_value(total IGNORE NULLS) OVER (ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS total FROM given""")
def fill_query(spark, sf_dir):
    """A day feature given at midnight, and not on Mondays; the first day is a Monday, so both fills are needed."""
    counts = event_counts(spark, sf_dir)
    totals = counts.groupBy(F.to_date("ts").alias("day")).agg(F.sum("value").alias("total"))
    hours = day_grid(totals, "00:00:00", "23:00:00", 3600)
    given = hours.select("ts", F.when((F.col("step") == 0) & (D.weekday_id("day") != 0), F.col("total")).alias("total"))
    return fill_forward_backward(given, ["total"])
