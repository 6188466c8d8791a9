from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tempora.functions import calendar as C
from tempora.functions import dates as D
from tempora.operators.grid import steps_per_day, time_range
from tempora.operators.select import label_slice
from tempora.operators.windows import appearance_code


def stamps(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "t string").select(F.col("t").cast("timestamp_ntz").alias("ts"))


def ts(text):
    return datetime.fromisoformat(text)


@pytest.mark.parametrize("start, end, step, want", [
    ("2015-01-01 00:00:00", "2015-01-01 01:00:00", 1800, 3),
    ("2015-01-01 00:00:00", "2015-01-01 01:00:00", 1500, 4),
    ("2015-01-01 02:00:00", "2015-01-01 01:00:00", 900, 1),
    ("2015-01-01 01:00:00", "2015-01-01 01:00:00", 900, 1),
])
def test_timestamp_list_overshoots(spark, start, end, step, want):
    df = spark.range(1).select(F.lit(start).cast("timestamp_ntz").alias("a"), F.lit(end).cast("timestamp_ntz").alias("b"))
    got = df.select(D.timestamp_list("a", "b", step).alias("l")).first()["l"]
    assert len(got) == want
    assert got == [ts(start) + timedelta(seconds=step * i) for i in range(want)]
    if ts(start) < ts(end):
        assert got[-1] >= ts(end) > got[-2]


def test_time_range_matches_timestamp_list(spark):
    rows = time_range(spark, 0, 3600, 1500).orderBy("ts").collect()
    assert [r.ts for r in rows] == [ts("1970-01-01 00:00:00") + timedelta(seconds=1500 * i) for i in range(4)]
    assert steps_per_day("00:00:00", "23:45:00", 900) == 96
    assert steps_per_day("00:00:00", "01:00:00", 1500) == 4


def test_epoch_is_independent_of_session_zone(spark):
    df = stamps(spark, "2017-03-26 02:30:00.500000", "1969-12-31 23:59:59.250000")
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            got = df.select(D.epoch_seconds("ts").alias("s"), D.epoch_millis("ts").alias("m"),
                            D.truncate_to("ts", 3600).alias("h")).collect()
            assert [(r.s, r.m) for r in got] == [(1490495400, 1490495400500), (-1, -750)]
            assert [r.h for r in got] == [ts("2017-03-26 02:00:00"), ts("1969-12-31 23:00:00")]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_text_forms_are_independent_of_session_zone(spark):
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        r = stamps(spark, "2017-03-12 02:07:00.5").select(  # this hour does not exist in New York
            D.format_padded("ts").alias("a"), D.time_of_day("ts").alias("b"), D.bucket_id("ts", 15).alias("c"),
            D.format_timestamp("ts").alias("d"), D.bucket_id("ts", 60).alias("e"),
            D.parse_timestamp(F.lit("2017-03-12 02:07:00")).alias("f")).first()
        assert (r.a, r.b, r.c, r.d, r.e) == ("2017-03-12 02:07:00", "02:07:00", "2017-03-12-02-0", "2017-3-12 2:7:0", "2017-03-12-02")
        assert r.f == ts("2017-03-12 02:07:00")
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_local_to_utc_flags_gap_and_overlap(spark):
    df = stamps(spark, "2017-03-26 02:30:00", "2017-10-29 02:30:00", "2017-07-01 12:00:00", "2017-10-29 03:00:00",
                "2017-10-29 01:59:00", "2017-03-26 03:00:00")
    rows = df.select("ts", *[c.alias(n) for n, c in D.local_to_utc("ts").items()]).collect()
    assert [(r.is_gap, r.is_overlap) for r in rows] == [(1, 0), (0, 1), (0, 0), (0, 0), (0, 0), (0, 0)]
    assert [r.utc for r in rows] == [None, None, ts("2017-07-01 10:00:00"), ts("2017-10-29 02:00:00"),
                                     ts("2017-10-28 23:59:00"), ts("2017-03-26 01:00:00")]


@pytest.mark.parametrize("start, end", [("2015", "2017"), ("2015-02", "2015-02-28"), ("2015-01-01 06:00:00", "2015-01-02 00:00:00"),
                                        (None, "2016-12"), ("2016-12-31 23", None), ("2015-01-01 0", "2016")])
def test_label_slice_is_text_order(spark, start, end):
    texts = [(datetime(2014, 12, 30) + timedelta(hours=7 * i)).strftime("%Y-%m-%d %H:%M:%S") for i in range(4000)]
    df = stamps(spark, *texts)
    if start and start.endswith(" 0"):
        with pytest.raises(ValueError):
            label_slice(df, start, end)
        return
    got = sorted(r.ts.strftime("%Y-%m-%d %H:%M:%S") for r in label_slice(df, start, end).collect())
    assert got == [t for t in texts if (start is None or t >= start) and (end is None or t <= end)]


def days_frame(spark, first, n):
    return spark.createDataFrame([(first + timedelta(days=i),) for i in range(n)], "day date")


def test_bridge_days(spark):
    holidays = spark.createDataFrame([(date(2017, 5, 25),), (date(2017, 8, 15),), (date(2017, 8, 15),), (date(2018, 5, 8),),
                                      (date(2017, 5, 1),)], "day date")
    periods = spark.createDataFrame([(date(2017, 7, 8), date(2017, 9, 3))], "start_day date, end_day date")
    got = sorted(r.day for r in C.extra_days_off(holidays, periods).collect())
    assert got == [date(2017, 5, 26), date(2018, 5, 7)]  # the Monday before 15 August 2017 is school holiday


def test_duplicate_holiday_keeps_one_row_per_day(spark):
    days = days_frame(spark, date(2008, 4, 28), 7)
    holidays = spark.createDataFrame([(date(2008, 5, 1),), (date(2008, 5, 1),)], "day date")
    rows = C.flag_members(days, holidays, "holiday").orderBy("day").collect()
    assert [r.holiday for r in rows] == [0, 0, 0, 1, 0, 0, 0]


def test_categories_against_plain_rules(spark):
    first = date(2017, 1, 1)
    days = days_frame(spark, first, 365)
    hol = [date(2017, 1, 1), date(2017, 5, 25), date(2017, 8, 15), date(2017, 12, 25)]
    per = [(date(2017, 2, 4), date(2017, 2, 19)), (date(2017, 7, 8), date(2017, 9, 3))]
    out = C.with_categories(C.day_flags(days, spark.createDataFrame([(h,) for h in hol], "day date"),
                                        spark.createDataFrame(per, "start_day date, end_day date"))).collect()
    assert len(out) == 365
    in_school = lambda d: any(a <= d <= b for a, b in per)
    bridges = {h + timedelta(days=1) for h in hol if h.weekday() == 3} | {h - timedelta(days=1) for h in hol if h.weekday() == 1}
    bridges = {b for b in bridges if not in_school(b)}
    term = {0: "LHV_2", 1: "JMHV_2", 2: "MHV_2", 3: "JMHV_2", 4: "VHV_2"}
    for r in out:
        d = r.day
        off = d.weekday() == 6 or d in hol or d in bridges
        want = "DIJFP" if off else ("SAVS" if d.weekday() == 5 else "JOVS") if in_school(d) else "SAHV" if d.weekday() == 5 else "JOHV"
        assert r.category1 == want
        assert r.category2 == (term[d.weekday()] if want == "JOHV" else want + "_2")
        assert r.category1_id == C.CATEGORY1_ID[want] and r.category2_en == C.CATEGORY2_EN[r.category2]


def test_clock_code_follows_first_appearance(spark):
    df = stamps(spark, "2017-01-01 06:00:00", "2017-01-01 12:00:00", "2017-01-02 00:00:00", "2017-01-02 06:00:00")
    rows = appearance_code(df.withColumn("hms", D.time_of_day("ts")), "hms").collect()
    assert {r.hms: r.code for r in rows} == {"06:00:00": 0, "12:00:00": 1, "00:00:00": 2}


def test_unpadded_text(spark):
    r = stamps(spark, "2017-01-05 00:00:00").select(D.format_timestamp("ts").alias("a"), D.format_timestamp("ts", False).alias("b")).first()
    assert (r.a, r.b) == ("2017-1-5 0:0:0", "2017-1-5")
