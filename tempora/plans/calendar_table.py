"""Calendar feature table over a time grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import dates as D
from ..functions.calendar import day_flags, with_categories
from ..operators.encode import one_hot
from ..operators.windows import appearance_codes
from ..session import materialize

# Output column names that feature lists refer to.
RENAMED = {"school_holiday": "School_holidays_france_zoneC", "extra_day_off": "Extra_day_off_france",
           "holiday": "Holidays_france", "category1": "Category1", "category1_id": "Day_category1_id",
           "category1_en": "Day_category1_en", "category2": "Category2", "category2_id": "Day_category2_id",
           "category2_en": "Day_category2_en"}


def bare(column: str, value) -> str:
    return str(value)


def calendar_days(days: DataFrame, holidays: DataFrame, periods: DataFrame) -> DataFrame:
    """Day-grain calendar features of ``days(day)``: each is computed once per day, not once per step."""
    flagged = with_categories(day_flags(days, holidays, periods))
    named = flagged.withColumnsRenamed(RENAMED)
    return (named.withColumn("Day_id", D.weekday_id("day"))
            .withColumn("Day_fr", D.day_name("Day_id")).withColumn("Day_en", D.day_name("Day_id", french=False))
            .withColumn("Month_id", F.month("day")).withColumn("Month_en", D.month_name_en("day"))
            .withColumn("24_december", D.is_month_day("day", "12-24"))
            .withColumn("31_december", D.is_month_day("day", "12-31")))


def calendar_table(grid: DataFrame, holidays: DataFrame, periods: DataFrame, indicators: bool = True) -> DataFrame:
    """All calendar features for a grid of steps ``grid(ts)``.

    Indicator columns exist for the days, months, categories and clock times that occur.
    """
    stamped = grid.select("ts").withColumn("day", F.to_date("ts")).withColumn("hour_minute_second", D.time_of_day("ts"))
    per_day = materialize(calendar_days(stamped.select("day").distinct(), holidays, periods), "calendar")
    codes = materialize(appearance_codes(stamped, "hour_minute_second", target="hour_minute_second_numerical"), "clock")
    if indicators:
        per_day = one_hot(per_day, ["Day_en", "Month_en", "Category2", "Category1"], drop_last=False, keep_source=True,
                          name=bare)
        codes = one_hot(codes, ["hour_minute_second_numerical"], drop_last=False, keep_source=True, name=bare)
    return stamped.join(codes, "hour_minute_second").join(per_day, "day").drop("day")
