"""Raw totals and profiles to observations, and the dimension table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tempora.functions.calendar import day_flags, with_categories
from tempora.functions.dates import day_start, lookup
from tempora.operators.joins import grouped_ids, unmatched
from tempora.operators.select import last_wins, map_codes, series_subset
from tempora.operators.windows import place_in_order
from tempora.plans.observations import (HOUR_SLOTS, clean_profiles, clean_totals, disaggregate, missing_share,
                                        observation_table, profile_table, slot_time)
from tempora.session import materialize

from .base import CALENDAR, holidays_for, order_days, periods_for, query, table

# Which profile stands for which order priority.
PROFILE_OF = {"1-URGENT": "101", "2-HIGH": "102", "3-MEDIUM": "103", "4-NOT SPECIFIED": "104", "5-LOW": "105"}
EVENT_IDS = {"click": "101", "error": "102", "purchase": "103", "signup": "104", "view": "105"}


def _categories(days):
    days = materialize(days, "days")
    return with_categories(day_flags(days, holidays_for(days), periods_for(days))).select("day", F.col("category1").alias("category"))


def _raw_profiles(spark, sf_dir):
    """Percent of a type's events per day category and hour, as raw text rows; one category of signup is unknown."""
    ev = table(spark, sf_dir, "events").select("event_type", F.to_date("ts").alias("day"), F.hour("ts").alias("h"))
    per_hour = (ev.join(_categories(ev.select("day").distinct()), "day").groupBy("event_type", "category", "h")
                .agg(F.count(F.lit(1)).alias("n")))
    per_hour = materialize(per_hour, "profile")
    total = per_hour.groupBy("event_type", "category").agg(F.sum("n").alias("total"))
    slots = F.array(*[F.lit(s) for s in HOUR_SLOTS])
    unknown = (F.col("event_type") == "signup") & (F.col("category") == "SAVS")
    return per_hour.join(total, ["event_type", "category"]).select(
        F.when(unknown, "ND").otherwise(slots[F.col("h")]).alias("TRNC_HORR_60"),
        F.concat(lookup("event_type", EVENT_IDS), F.lit(".0")).alias("ID_REFA_LDA"), F.col("category").alias("CAT_JOUR"),
        (100 * F.col("n") / F.col("total")).alias("pourc_validations"))


def _raw_totals(spark, sf_dir):
    """Orders per priority and day as raw text rows, split in two parts by status; small counts are censored."""
    orders = table(spark, sf_dir, "orders")
    n = orders.groupBy("o_orderdate", "o_orderpriority", "o_orderstatus").agg((F.count(F.lit(1)) * 4).alias("n"))
    return n.select(
        F.date_format("o_orderdate", "dd/MM/yyyy").alias("JOUR"),
        F.concat(lookup("o_orderpriority", PROFILE_OF), F.lit(".0")).alias("ID_REFA_LDA"),
        F.when(F.col("n") < 5, "Moins de 5").otherwise(F.col("n").cast("string")).alias("NB_VALD"),
        F.concat(F.lit("S"), F.substring("o_orderpriority", 1, 1)).alias("CODE_STIF_ARRET"))


_PROFILE = """ed AS (SELECT event_type, ts::DATE AS day, hour(ts) AS h FROM events), days AS (SELECT DISTINCT day FROM ed), """ + CALENDAR + """,
eids AS (SELECT * FROM (VALUES """ + ", ".join(f"('{k}', '{v}')" for k, v in EVENT_IDS.items()) + """) v(event_type, id)),
ph AS (SELECT event_type, category1 AS category, h, count(*) AS n FROM ed JOIN cats2 USING (day) GROUP BY 1, 2, 3),
pp AS (SELECT id AS series_id, category, h, 100 * n / sum(n) OVER (PARTITION BY event_type, category) AS pct FROM ph JOIN eids USING (event_type)),
pk AS (SELECT * FROM pp WHERE NOT (series_id = '104' AND category = 'SAVS')),
full_ids AS (SELECT series_id FROM pk GROUP BY 1 HAVING count(DISTINCT category) = 5)"""


@query("q39_profile_pivot", f"""WITH {_PROFILE} SELECT series_id, category, """ + ", ".join(
    f"round(coalesce(max(pct) FILTER (h = {h}), 0), 6) AS \"{s}\"" for h, s in enumerate(HOUR_SLOTS)) +
    " FROM pk WHERE series_id IN (SELECT series_id FROM full_ids) GROUP BY 1, 2")
def profile_pivot_query(spark, sf_dir):
    """Hour profiles of the series that have one for all five day categories."""
    wide = profile_table(clean_profiles(_raw_profiles(spark, sf_dir)))
    return wide.select("series_id", "category", *[F.round(F.col(f"`{s}`"), 6).alias(s) for s in HOUR_SLOTS])


@query("q39_slot_times", f"""WITH {_PROFILE} SELECT series_id, category, lpad(h::VARCHAR, 2, '0') || ':00:00' AS time, round(pct, 6) AS percent FROM pk""")
def slot_times_query(spark, sf_dir):
    """The cleaned profile in long form with clock times for the slot labels."""
    clean = clean_profiles(_raw_profiles(spark, sf_dir))
    return clean.select("series_id", "category", slot_time("slot").alias("time"), F.round("percent", 6).alias("percent"))


def _spread_sql(tail: str) -> str:
    """Both calendars (event days and order days) are one calendar over all days here."""
    body = _PROFILE.replace("days AS (SELECT DISTINCT day FROM ed)",
                            "days AS (SELECT DISTINCT day FROM ed UNION SELECT DISTINCT o_orderdate::DATE FROM orders)")
    ids = ", ".join(f"('{k}', '{v}')" for k, v in PROFILE_OF.items())
    return f"""WITH {body}, oids AS (SELECT * FROM (VALUES {ids}) v(o_orderpriority, id)),
part AS (SELECT o_orderdate::DATE AS day, id AS series_id, CASE WHEN 4 * count(*) < 5 THEN 1 ELSE 4 * count(*) END AS n
  FROM orders JOIN oids USING (o_orderpriority) GROUP BY 1, 2, o_orderstatus),
tot AS (SELECT day, series_id, sum(n) AS total FROM part GROUP BY 1, 2),
cell AS (SELECT i.series_id, d.day, c.category1 AS category, t.total FROM (SELECT series_id FROM full_ids INTERSECT SELECT series_id FROM tot) i
  CROSS JOIN (SELECT DISTINCT day FROM tot) d JOIN cats2 c ON c.day = d.day LEFT JOIN tot t ON t.series_id = i.series_id AND t.day = d.day),
spread AS (SELECT cell.series_id, cell.day, g.h, coalesce(total * coalesce(pct, 0) / 100, 0) AS value, total IS NULL AS missing
  FROM cell CROSS JOIN range(24) g(h) LEFT JOIN pk ON pk.series_id = cell.series_id AND pk.category = cell.category AND pk.h = g.h)
{tail}"""


def _spread(spark, sf_dir):
    totals = materialize(clean_totals(_raw_totals(spark, sf_dir)), "totals")
    profiles = materialize(profile_table(clean_profiles(_raw_profiles(spark, sf_dir))), "profiles")
    return disaggregate(totals, profiles, _categories(order_days(spark, sf_dir)))


@query("q40_disaggregate", _spread_sql("""SELECT series_id, day + to_hours(h) AS ts, round(value, 6) AS value FROM spread"""))
def disaggregate_query(spark, sf_dir):
    return _spread(spark, sf_dir).select("series_id", "ts", F.round("value", 6).alias("value"))


@query("q40_missing_share", _spread_sql("""SELECT round(100 * avg(missing::INT), 6) AS missing_percent
FROM (SELECT DISTINCT series_id, day, missing FROM spread)"""))
def missing_share_query(spark, sf_dir):
    return missing_share(_spread(spark, sf_dir)).withColumn("missing_percent", F.round("missing_percent", 6))


@query("q40_observation_table", _spread_sql("""SELECT series_id, strftime(day, '%Y-%m') AS month, h::INT AS hour, sum(round(value, 6)::DECIMAL(18, 6))::DOUBLE AS value
FROM spread WHERE series_id IN ('101', '105') GROUP BY 1, 2, 3"""))
def observation_table_query(spark, sf_dir):
    """The whole dataset job with the station filter, summed per month and hour of day."""
    stations = table(spark, sf_dir, "orders").select(F.substring("o_orderpriority", 1, 1).alias("d")).distinct().select(
        F.concat(F.lit("S"), F.col("d")).alias("stop_code"),
        F.when(F.col("d").isin("1", "5"), "Metro").otherwise("Train").alias("mode"))
    out = observation_table(materialize(_raw_totals(spark, sf_dir), "raw"), materialize(_raw_profiles(spark, sf_dir), "raw"),
                            _categories(order_days(spark, sf_dir)), stations, F.col("mode") == "Metro")
    return out.groupBy("series_id", F.date_format("ts", "yyyy-MM").alias("month"), F.hour("ts").alias("hour")).agg(
        F.sum(F.round("value", 6).cast("decimal(18,6)")).cast("double").alias("value"))


def _nation_orders(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return (orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
            .groupBy(F.col("c_nationkey").cast("string").alias("series_id"), day_start(F.to_date("o_orderdate")).alias("ts"))
            .agg(F.count(F.lit(1)).cast("double").alias("value")))


def _nations(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").withColumn("series_id", F.col("n_nationkey").cast("string"))
    return nation.join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).distinct()


@query("q41_dimension_subset", """SELECT c_nationkey::VARCHAR AS series_id, o_orderdate AS ts, count(*)::DOUBLE AS value
FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey IN (SELECT n_nationkey FROM nation JOIN region ON r_regionkey = n_regionkey
WHERE r_name IN ('ASIA', 'EUROPE')) GROUP BY 1, 2""")
def dimension_subset_query(spark, sf_dir):
    return series_subset(_nation_orders(spark, sf_dir), _nations(spark, sf_dir), F.col("r_name").isin("ASIA", "EUROPE"))


@query("q41_group_concat", """SELECT r_name, string_agg(n_nationkey::VARCHAR, ',' ORDER BY n_nationkey::VARCHAR) AS ids
FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY 1""")
def group_concat_query(spark, sf_dir):
    return grouped_ids(_nations(spark, sf_dir), ["r_name"], "series_id", "ids")


@query("q41_last_wins", """SELECT c_nationkey, c_mktsegment, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment
ORDER BY c_acctbal DESC, c_custkey DESC) AS rn FROM customer) WHERE rn = 1""")
def last_wins_query(spark, sf_dir):
    """One customer per nation and segment: the last in order of balance."""
    customers = table(spark, sf_dir, "customer").select("c_nationkey", "c_mktsegment", "c_custkey", "c_acctbal")
    out = last_wins(customers, ["c_nationkey", "c_mktsegment"], [F.col("c_acctbal"), F.col("c_custkey")])
    return out.drop("c_acctbal")


@query("q41_unmatched_ids", """SELECT DISTINCT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')""")
def unmatched_query(spark, sf_dir):
    """Customers that link to no urgent order: the report of failed lookups."""
    orders = table(spark, sf_dir, "orders").where(F.col("o_orderpriority") == "1-URGENT").select(F.col("o_custkey").alias("c_custkey"))
    return unmatched(table(spark, sf_dir, "customer"), orders, ["c_custkey"])


@query("q41_shared_ids", """SELECT id, (row_number() OVER (ORDER BY id))::INT AS place FROM
(SELECT c_nationkey AS id FROM customer INTERSECT SELECT s_nationkey FROM supplier)""")
def shared_ids_query(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("id"))
    shared = customers.intersect(table(spark, sf_dir, "supplier").select("s_nationkey"))
    return place_in_order(shared, ["id"]).withColumn("place", F.col("place").cast("int"))


@query("q41_code_labels", """SELECT event_type, CASE event_type """ + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in EVENT_IDS.items()) +
       """ END AS id, count(*) AS n FROM events GROUP BY 1""")
def code_labels_query(spark, sf_dir):
    counts = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return map_codes(counts, "event_type", EVENT_IDS, "id")
