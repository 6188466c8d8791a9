"""Observation table from raw daily totals and hourly percentage profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.dates import day_start, parse_day_month_year, seconds
from ..operators.select import drop_incomplete, drop_sentinel, last_wins, normalise_id, repair_count, series_subset
from ..operators.stats import complete_groups, pivot_mean, share_missing

# Labels of the 24 hour slots of a profile.
HOUR_SLOTS = [f"{h}H-{(h + 1) % 24}H" for h in range(24)]


def clean_totals(raw: DataFrame) -> DataFrame:
    """(JOUR dd/MM/yyyy, ID_REFA_LDA, NB_VALD, CODE_STIF_ARRET) text -> (day, series_id, total, stop_code)."""
    kept = drop_sentinel(drop_incomplete(raw.select("JOUR", "ID_REFA_LDA", "NB_VALD", "CODE_STIF_ARRET")),
                         "ID_REFA_LDA", "?")
    return kept.select(parse_day_month_year("JOUR").alias("day"), normalise_id("ID_REFA_LDA").alias("series_id"),
                       repair_count("NB_VALD").alias("total"), F.col("CODE_STIF_ARRET").cast("string").alias("stop_code"))


def clean_profiles(raw: DataFrame) -> DataFrame:
    """(TRNC_HORR_60, ID_REFA_LDA, CAT_JOUR, pourc_validations) -> (series_id, category, slot, percent), distinct."""
    kept = drop_incomplete(raw.select("TRNC_HORR_60", "ID_REFA_LDA", "CAT_JOUR", "pourc_validations"))
    kept = drop_sentinel(drop_sentinel(kept, "TRNC_HORR_60", "ND"), "ID_REFA_LDA", "?")
    return kept.select(normalise_id("ID_REFA_LDA").alias("series_id"), F.col("CAT_JOUR").alias("category"),
                       F.col("TRNC_HORR_60").alias("slot"), F.col("pourc_validations").cast("double").alias("percent")
                       ).dropDuplicates()


def slot_hour(slot) -> Column:
    """'23H-0H' -> 23."""
    slot = F.col(slot) if isinstance(slot, str) else slot
    return F.split(slot, "H")[0].cast("int")


def slot_time(slot) -> Column:
    """'23H-0H' -> '23:00:00'."""
    return F.concat(F.lpad(slot_hour(slot).cast("string"), 2, "0"), F.lit(":00:00"))


def profile_table(profiles: DataFrame, n_categories: int = 5) -> DataFrame:
    """(series_id, category, 24 slot columns); mean of repeated cells, 0 where absent; only series that have a
    profile for every day category."""
    wide = pivot_mean(profiles, ["series_id", "category"], "slot", HOUR_SLOTS, ["percent"], fill=0.0, separator="")
    return complete_groups(wide, "series_id", n_categories)


def disaggregate(totals: DataFrame, profiles: DataFrame, day_category: DataFrame) -> DataFrame:
    """Spread daily totals over the hours: total * percent of (series, type of day, hour) / 100.

    ``totals`` is (series_id, day, total), ``profiles`` the output of :func:`profile_table`, ``day_category``
    (day, category). Every series known to both sides gets every day; a day without a total or a profile gives 0
    and is marked ``is_missing``. Profiles travel as one array per (series, category) and hours are exploded last,
    so the joins run on days, not on hours.
    """
    arrays = profiles.select("series_id", "category", F.array(*[F.col(f"`{s}`") for s in HOUR_SLOTS]).alias("percent"))
    days = totals.agg(F.collect_set("day").alias("d")).scalar()
    shared = totals.select("series_id").intersect(profiles.select("series_id"))
    per_day = (shared.withColumn("day", F.explode(days))
               .join(totals.groupBy("series_id", "day").agg(F.sum("total").alias("total")), ["series_id", "day"], "left")
               .join(day_category.select("day", "category"), "day", "left")
               .join(arrays, ["series_id", "category"], "left"))
    missing = F.col("total").isNull() | F.col("percent").isNull()
    nothing = F.array(*[F.lit(0.0)] * len(HOUR_SLOTS))
    hours = per_day.select("series_id", "day", missing.cast("int").alias("is_missing"), "total",
                           F.posexplode(F.coalesce(F.col("percent"), nothing)).alias("hour", "p"))
    value = F.when(F.col("is_missing") == 1, F.lit(0.0)).otherwise(F.col("total") * F.col("p") / 100)
    return hours.select("series_id", "day", (day_start("day") + seconds(F.col("hour") * 3600)).alias("ts"),
                        value.alias("value"), "is_missing")


def missing_share(disaggregated: DataFrame) -> DataFrame:
    """Percent of (series, day) cells without a source value."""
    cells = disaggregated.select("series_id", "day", F.when(F.col("is_missing") == 0, F.lit(1)).alias("v")).distinct()
    return cells.agg(share_missing(F.col("v")).alias("missing_percent"))


def observation_table(raw_totals: DataFrame, raw_profiles: DataFrame, day_category: DataFrame,
                      stations: DataFrame | None = None, condition: Column | None = None) -> DataFrame:
    """The whole job: clean, pivot, disaggregate, and keep the series of the wanted stations.

    ``stations`` (stop_code, attributes...) is linked to series through the stop codes seen in the totals; of several
    series for one code the last in order of the id wins.
    """
    totals = clean_totals(raw_totals)
    out = disaggregate(totals, profile_table(clean_profiles(raw_profiles)), day_category)
    if stations is None:
        return out
    link = last_wins(totals.select("stop_code", "series_id").distinct(), ["stop_code"], [F.col("series_id")])
    return series_subset(out, stations.join(link, "stop_code"), F.lit(True) if condition is None else condition)
