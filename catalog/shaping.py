"""Joins, gap filling, alignment, encoding, windows and day matrices."""

from __future__ import annotations

from pyspark.sql import functions as F

from tempora.functions.dates import is_month_day, month_name_en, parse_day_month_year, weekday_id
from tempora.operators.encode import one_hot
from tempora.operators.grid import day_grid, densify
from tempora.operators.joins import left_join_all
from tempora.operators.reshape import (align_xy, day_matrix_long, day_time_pivot, feature_frame, long_to_wide,
                                       rows_from_day_arrays, wide_to_long)
from tempora.operators.select import (drop_incomplete, drop_sentinel, normalise_id, repair_count, strict_key_lookup,
                                      varying_features)
from tempora.operators.windows import lag_lead

from .base import (HOURLY, HOURLY_DENSE, ORDER_DAYS, event_counts, hourly_dense, order_days, query, table)


@query("q02_multi_file_left_join", """WITH base AS (SELECT DISTINCT o_orderdate AS ts FROM orders),
n AS (SELECT o_orderdate AS ts, count(*) AS n_orders, max(o_totalprice) AS top_price FROM orders GROUP BY 1),
u AS (SELECT o_orderdate AS ts, count(*) AS n_urgent FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1)
SELECT ts, (isodow(ts) - 1)::INT AS day_id, n_orders, top_price, n_urgent FROM base LEFT JOIN n USING (ts) LEFT JOIN u USING (ts)""")
def left_join_query(spark, sf_dir):
    """Three tables on one key: a calendar, the day totals and the urgent orders, which miss some days."""
    orders = table(spark, sf_dir, "orders")
    ts = F.col("o_orderdate").alias("ts")
    calendar = orders.select(ts).distinct().withColumn("day_id", weekday_id("ts"))
    totals = orders.groupBy(ts).agg(F.count(F.lit(1)).alias("n_orders"), F.max("o_totalprice").alias("top_price"))
    urgent = orders.where(F.col("o_orderpriority") == "1-URGENT").groupBy(ts).agg(F.count(F.lit(1)).alias("n_urgent"))
    return left_join_all([calendar, totals, urgent], "ts")


@query("q04_clean_repair", """WITH g AS (SELECT o_orderdate, o_orderpriority AS p, o_orderstatus AS s, 3 * count(*) AS n FROM orders GROUP BY 1, 2, 3)
SELECT o_orderdate::DATE AS day, '71' || p[1] || (ascii(s) - 65)::VARCHAR AS series_id, CASE WHEN n < 5 THEN 1 ELSE n END::INT AS total
FROM g WHERE NOT (p = '3-MEDIUM' AND s = 'P') AND NOT (p = '4-NOT SPECIFIED' AND s = 'O')""")
def clean_repair_query(spark, sf_dir):
    """Text columns with sentinels, gaps and censored counts, cleaned to typed daily totals."""
    p, s = F.col("o_orderpriority"), F.col("o_orderstatus")
    groups = table(spark, sf_dir, "orders").groupBy("o_orderdate", p, s).agg((F.count(F.lit(1)) * 3).alias("n"))
    ident = F.concat(F.lit("71"), F.substring(p, 1, 1), (F.ascii(s) - 65).cast("string"), F.lit(".0"))
    absent = (p == "4-NOT SPECIFIED") & (s == "O")
    dirty = groups.select(
        F.date_format("o_orderdate", "dd/MM/yyyy").alias("JOUR"),
        F.when((p == "3-MEDIUM") & (s == "P"), "?").when(~absent, ident).alias("ID"),
        F.when(F.col("n") < 5, "Moins de 5").otherwise(F.col("n").cast("string")).alias("NB"))
    clean = drop_sentinel(drop_incomplete(dirty), "ID", "?")
    return clean.select(parse_day_month_year("JOUR").alias("day"), normalise_id("ID").alias("series_id"),
                        repair_count("NB").alias("total"))


@query("q05_densify_15min", """WITH o AS (SELECT event_type AS series_id, time_bucket(INTERVAL 15 MINUTE, ts) AS ts, count(*)::DOUBLE AS value
  FROM events GROUP BY 1, 2)
SELECT s.series_id, d.day + to_seconds(k * 900) AS ts, d.day, k::INT AS step, coalesce(o.value, 0) AS value
FROM (SELECT DISTINCT series_id FROM o) s CROSS JOIN (SELECT DISTINCT ts::DATE AS day FROM o) d CROSS JOIN range(96) t(k)
LEFT JOIN o ON o.series_id = s.series_id AND o.ts = d.day + to_seconds(k * 900)""")
def densify_query(spark, sf_dir):
    return densify(event_counts(spark, sf_dir, 900), "00:00:00", "23:45:00", 900)


_FEATURES = """fday AS (SELECT ts::DATE AS day, sum(value) AS total FROM hourly GROUP BY 1),
feat AS (SELECT d.day + to_hours(h) AS ts, d.day, h::INT AS step, (h BETWEEN 8 AND 18)::INT AS busy, h * d.total AS load,
  dayname(d.day) AS day_en, d.total FROM fday d, range(24) t(h) WHERE NOT (h = 23 AND isodow(d.day) = 7))"""


def _features(counts):
    """Step features at every hour but Sunday 23:00; day features at midnight only."""
    totals = counts.groupBy(F.to_date("ts").alias("day")).agg(F.sum("value").alias("total"))
    hours = day_grid(totals, "00:00:00", "23:00:00", 3600)
    hours = hours.where(~((F.col("step") == 23) & (weekday_id("day") == 6)))
    midnight = F.col("step") == 0
    return hours.select(
        "ts", F.col("step").between(8, 18).cast("int").alias("busy"), (F.col("step") * F.col("total")).alias("load"),
        F.when(midnight, F.date_format("day", "EEEE")).alias("day_en"), F.when(midnight, F.col("total")).alias("total"))


_KEPT_DAYS = ["Friday", "Monday", "Saturday", "Sunday", "Thursday", "Tuesday"]
_DAY_FLAGS = ", ".join(f"(day_en = '{d}')::INT AS is_{d.lower()}" for d in _KEPT_DAYS)


@query("q14_align_xy", f"""WITH {HOURLY_DENSE}, {_FEATURES}
SELECT series_id, o.ts, value, busy, load, total, {_DAY_FLAGS} FROM hdense o JOIN feat f ON f.ts = o.ts""")
def align_query(spark, sf_dir):
    counts = event_counts(spark, sf_dir)
    out, at_step, at_day = align_xy(counts, _features(counts), ["busy", "load"], ["day_en", "total"], ["day_en"],
                                    "00:00:00", "23:00:00", 3600)
    return out.select("series_id", "ts", "value", *at_step, "total",
                      *[F.col(f"day_en={d}").alias(f"is_{d.lower()}") for d in _KEPT_DAYS])


_MONTHS = ["April", "August", "December", "February", "January", "July", "June", "March", "May", "November", "October"]


@query("q15_onehot_drop_last", f"""WITH {ORDER_DAYS}, m AS (SELECT day, CASE WHEN strftime(day, '%m-%d') <> '12-24' THEN monthname(day) END AS mon FROM days)
SELECT day, {", ".join(f"(coalesce(mon, '') = '{m}')::INT AS is_{m.lower()}" for m in _MONTHS)} FROM m""")
def one_hot_query(spark, sf_dir):
    """Month names without the last category; 24 December has none and gives all zeros."""
    named = F.when(is_month_day("day", "12-24") == 0, month_name_en("day"))
    days = order_days(spark, sf_dir).withColumn("mon", named)
    return one_hot(days, ["mon"], name=lambda _, v: f"is_{v.lower()}")


_SHIFTS = """lag(value, 2) OVER w AS "value::t-2", lag(value, 1) OVER w AS "value::t-1", value, lead(value, 1) OVER w AS "value::t+1\""""


@query("q16_lag_lead_xy", f"""WITH {HOURLY_DENSE}, p AS (SELECT series_id, ts, step AS hour, value * 2 AS target, {_SHIFTS},
  row_number() OVER w AS rn, count(*) OVER (PARTITION BY series_id) AS n FROM hdense WINDOW w AS (PARTITION BY series_id ORDER BY ts))
SELECT series_id, ts, hour, target, "value::t-2", "value::t-1", value, "value::t+1" FROM p WHERE rn > 2 AND rn <= n - 1""")
def lag_lead_xy_query(spark, sf_dir):
    dense = hourly_dense(spark, sf_dir).withColumn("hour", F.col("step")).withColumn("target", F.col("value") * 2)
    return lag_lead(dense, ["hour", "value"], ["value"], 2, 1, targets=["target"], keys=["series_id"], block=256)


@query("q17_lag_lead_x", f"""WITH {HOURLY}, wide AS (SELECT ts, sum(value) AS value, count(*) AS n_types FROM hourly GROUP BY 1),
p AS (SELECT ts, n_types, {_SHIFTS}, row_number() OVER w AS rn, count(*) OVER () AS n FROM wide WINDOW w AS (ORDER BY ts))
SELECT ts, n_types, "value::t-2", "value::t-1", value, "value::t+1" FROM p WHERE rn > 2 AND rn <= n - 1""")
def lag_lead_x_query(spark, sf_dir):
    """One row per time step and no series key; lags count rows, not hours."""
    wide = event_counts(spark, sf_dir).groupBy("ts").agg(F.sum("value").alias("value"), F.count(F.lit(1)).alias("n_types"))
    return lag_lead(wide, ["n_types", "value"], ["value"], 2, 1, block=256)


_HOURS = [f"{h:02d}:00:00" for h in range(24)]


_TYPES = ["click", "error", "purchase", "signup", "view"]


@query("q18_day_time_pivot", f"""WITH {HOURLY_DENSE}, wide AS (SELECT ts, day, step,
  {", ".join(f"sum(value) FILTER (series_id = '{f}') AS {f}" for f in _TYPES)} FROM hdense GROUP BY 1, 2, 3)
SELECT day, {", ".join(f'''avg({f}) FILTER (step = {h}) AS "{f}|{t}"''' for f in _TYPES for h, t in enumerate(_HOURS))},
  (isodow(day) - 1)::INT AS day_id, (day = (SELECT min(day) FROM hdense))::INT AS first_day FROM wide GROUP BY day""")
def day_time_pivot_query(spark, sf_dir):
    wide = long_to_wide(hourly_dense(spark, sf_dir), _TYPES)
    first = wide.agg(F.min("ts").alias("t")).scalar()
    wide = wide.withColumn("day_id", weekday_id("ts")).withColumn("first_day", (F.to_date("ts") == F.to_date(first)).cast("int"))
    return day_time_pivot(wide, _TYPES, ["day_id", "first_day"], _HOURS)


@query("q18_key_lookup", f"""WITH {HOURLY}, totals AS (SELECT ts::DATE AS day, sum(value) AS n FROM hourly GROUP BY 1),
quiet AS (SELECT day FROM totals WHERE n < (SELECT avg(n) FROM totals))
SELECT series_id, ts, value FROM hourly WHERE ts::DATE IN (SELECT day FROM quiet)""")
def key_lookup_query(spark, sf_dir):
    """All observations of the days below the average day, looked up by key with a check that every key exists."""
    counts = event_counts(spark, sf_dir).withColumn("day", F.to_date("ts"))
    totals = counts.groupBy("day").agg(F.sum("value").alias("n"))
    quiet = totals.where(F.col("n") < totals.agg(F.avg("n")).scalar()).select("day")
    return strict_key_lookup(counts, quiet, ["day"]).select("series_id", "ts", "value")


_MATRIX = f"{HOURLY}, {_FEATURES}" + """, x AS (
  SELECT day, step AS idx, busy::DOUBLE AS value FROM feat UNION ALL SELECT day, 24 + step, load FROM feat
  UNION ALL SELECT day, 48, total FROM feat WHERE step = 0
  """ + "".join(f"UNION ALL SELECT day, {49 + i}, (day_en = '{d}')::INT FROM feat WHERE step = 0 " for i, d in enumerate(_KEPT_DAYS)) + ")"


def _matrix(spark, sf_dir):
    counts = event_counts(spark, sf_dir)
    frame, at_step, at_day = feature_frame(_features(counts), ["busy", "load"], ["total", "day_en"], ["day_en"],
                                           "00:00:00", "23:00:00", 3600)
    return day_matrix_long(frame, at_step, at_day, 24)


@query("q19_day_matrix", f"WITH {_MATRIX} SELECT day, idx, value FROM x")
def day_matrix_query(spark, sf_dir):
    return _matrix(spark, sf_dir)


@query("q20_constant_features", f"WITH {_MATRIX} SELECT idx FROM x GROUP BY idx HAVING min(value) <> max(value)")
def constant_features_query(spark, sf_dir):
    return varying_features(_matrix(spark, sf_dir))


@query("q21_day_array_to_rows", f"WITH {HOURLY_DENSE} SELECT series_id, ts, round_even(value / 7, 3) AS value FROM hdense")
def day_array_query(spark, sf_dir):
    dense = hourly_dense(spark, sf_dir)
    cells = F.array_sort(F.collect_list(F.struct("step", "value")))
    arrays = dense.groupBy("series_id", "day").agg(F.transform(cells, lambda c: c["value"] / 7).alias("pred"))
    return rows_from_day_arrays(arrays, 3600)


@query("q21_wide_and_back", f"WITH {HOURLY_DENSE} SELECT series_id, ts, value FROM hdense")
def wide_and_back_query(spark, sf_dir):
    """The wide observation table (one column per series) and its long form."""
    series = _TYPES
    return wide_to_long(long_to_wide(hourly_dense(spark, sf_dir), series), "ts", series)
