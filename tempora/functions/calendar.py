"""Holiday, school-holiday and day-category logic at day grain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .dates import lookup, weekday_id

# Day categories, their ids and their English labels.
CATEGORY1_ID = {"JOHV": 1, "JOVS": 2, "SAHV": 3, "SAVS": 4, "DIJFP": 5}
CATEGORY1_EN = {"JOHV": "WD-OSH", "JOVS": "WD-H", "SAHV": "S-OSH", "SAVS": "S-H", "DIJFP": "SHEDO"}
CATEGORY2_ID = {"LHV_2": 1, "JMHV_2": 2, "VHV_2": 3, "MHV_2": 4, "JOVS_2": 5, "SAHV_2": 6, "SAVS_2": 7, "DIJFP_2": 8}
CATEGORY2_EN = {"LHV_2": "M-OSH_2", "JMHV_2": "TT-OSH_2", "VHV_2": "F-OSH_2", "MHV_2": "W-OSH_2",
                "JOVS_2": "W-H_2", "SAHV_2": "S-OSH_2", "SAVS_2": "S-H_2", "DIJFP_2": "SPD_2"}


def period_days(periods: DataFrame) -> DataFrame:
    """(start_day, end_day) intervals -> distinct days, so that interval tests become equi-joins."""
    return periods.select(F.explode(F.sequence("start_day", "end_day")).alias("day")).distinct()


def flag_members(df: DataFrame, members: DataFrame, name: str, day: str = "day") -> DataFrame:
    """Add a 0/1 column telling whether ``day`` occurs in ``members(day)``; duplicates do not multiply rows."""
    marked = members.select(F.col("day").alias(day)).distinct().withColumn(name, F.lit(1))
    return df.join(marked, day, "left").withColumn(name, F.coalesce(F.col(name), F.lit(0)))


def extra_days_off(holidays: DataFrame, periods: DataFrame) -> DataFrame:
    """Bridge days: Friday after a Thursday holiday, Monday before a Tuesday one, outside school holidays."""
    wd = weekday_id("day")
    bridge = (F.when(wd == 3, F.date_add("day", 1)).when(wd == 1, F.date_sub("day", 1)))
    candidates = holidays.select(bridge.alias("day")).where(F.col("day").isNotNull()).distinct()
    return candidates.join(period_days(periods), "day", "left_anti")


def _off(day: Column, holiday: Column, extra: Column) -> Column:
    return (weekday_id(day) == 6) | (holiday == 1) | (extra == 1)


def day_category1(day: Column, school: Column, holiday: Column, extra: Column) -> Column:
    saturday = weekday_id(day) == 5
    vacation = school == 1
    return (F.when(_off(day, holiday, extra), "DIJFP")
            .when(vacation & saturday, "SAVS").when(vacation, "JOVS")
            .when(saturday, "SAHV").otherwise("JOHV"))


def day_category2(day: Column, school: Column, holiday: Column, extra: Column) -> Column:
    """Like category 1, with the working days outside school holidays split by weekday."""
    by_weekday = lookup(weekday_id(day), {0: "LHV_2", 1: "JMHV_2", 2: "MHV_2", 3: "JMHV_2", 4: "VHV_2"})
    cat1 = day_category1(day, school, holiday, extra)
    return F.when(cat1 == "JOHV", by_weekday).otherwise(F.concat(cat1, F.lit("_2")))


def day_flags(days: DataFrame, holidays: DataFrame, periods: DataFrame, day: str = "day") -> DataFrame:
    """Add ``school_holiday``, ``extra_day_off``, ``holiday`` (0/1) to a table of days."""
    out = flag_members(days, period_days(periods), "school_holiday", day)
    out = flag_members(out, extra_days_off(holidays, periods), "extra_day_off", day)
    return flag_members(out, holidays, "holiday", day)


def with_categories(flagged: DataFrame, day: str = "day") -> DataFrame:
    """Add both day categories with id and English label to the output of :func:`day_flags`."""
    args = (F.col(day), F.col("school_holiday"), F.col("holiday"), F.col("extra_day_off"))
    return (flagged.withColumn("category1", day_category1(*args)).withColumn("category2", day_category2(*args))
            .withColumn("category1_id", lookup("category1", CATEGORY1_ID))
            .withColumn("category1_en", lookup("category1", CATEGORY1_EN))
            .withColumn("category2_id", lookup("category2", CATEGORY2_ID))
            .withColumn("category2_en", lookup("category2", CATEGORY2_EN)))
