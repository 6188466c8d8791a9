"""Date and time expressions on TIMESTAMP_NTZ columns; none depends on the session time zone."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

# Day names by weekday id, Monday = 0.
DAY_NAMES_FR = ["Lundi", "Mardi", "Mercredi", "Jeudi", "Vendredi", "Samedi", "Dimanche"]
DAY_NAMES_EN = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def seconds(n) -> Column:
    """Day-time interval of ``n`` seconds (number or column)."""
    zero = F.lit(0)
    n = F.lit(n) if isinstance(n, (int, float)) else n
    return F.make_dt_interval(zero, zero, zero, n)


def epoch_seconds(ts) -> Column:
    """Whole seconds since 1970-01-01 of a zone-less timestamp."""
    ts = _col(ts)
    return (F.unix_date(F.to_date(ts)).cast("long") * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60
            + F.floor(F.second(ts)).cast("long"))


def epoch_millis(ts) -> Column:
    """Whole milliseconds since 1970-01-01 of a zone-less timestamp."""
    ts = _col(ts)
    milli = F.floor(F.date_part(F.lit("SECOND"), ts) * 1000).cast("long")
    return (F.unix_date(F.to_date(ts)).cast("long") * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60) * 1000 + milli


def from_epoch_seconds(sec) -> Column:
    """Inverse of :func:`epoch_seconds`."""
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + seconds(_col(sec))


def truncate_to(ts, step_seconds: int) -> Column:
    """Start of the ``step_seconds`` bucket holding ``ts``, kept zone-less."""
    sec = epoch_seconds(ts)
    return from_epoch_seconds(sec - F.pmod(sec, F.lit(step_seconds)))


def day_start(day) -> Column:
    """Midnight of a date as TIMESTAMP_NTZ."""
    return _col(day).cast("timestamp_ntz")


def steps_needed(start, end, step_seconds: int) -> Column:
    """Number of steps after ``start`` until the first stamp that is not before ``end``; 0 if start >= end."""
    span = epoch_seconds(end) - epoch_seconds(start)
    return F.greatest(F.lit(0).cast("long"), F.ceil(span / F.lit(step_seconds)).cast("long"))


def timestamp_list(start, end, step_seconds: int) -> Column:
    """Array of stamps from ``start`` by the step, ending at the first one that is not before ``end``.

    The last stamp lies after ``end`` when the step does not divide the span.
    """
    start = _col(start)
    stop = start + seconds(steps_needed(start, end, step_seconds) * F.lit(step_seconds))
    return F.sequence(start, stop, seconds(step_seconds))


def next_timestamp(ts, step_seconds: int) -> Column:
    return _col(ts) + seconds(step_seconds)


def parse_timestamp(text, with_time: bool = True) -> Column:
    text = _col(text)
    fmt = "yyyy-MM-dd HH:mm:ss" if with_time else "yyyy-MM-dd"
    return F.to_timestamp_ntz(text, F.lit(fmt)) if with_time else F.to_date(text, fmt)


def format_timestamp(ts, with_time: bool = True) -> Column:
    """Text without zero padding, e.g. ``2017-1-5 0:0:0``."""
    ts = _col(ts)
    text = lambda *parts: [p.cast("string") for p in parts]
    day = F.concat_ws("-", *text(F.year(ts), F.month(ts), F.dayofmonth(ts)))
    if not with_time:
        return day
    return F.concat_ws(" ", day, F.concat_ws(":", *text(F.hour(ts), F.minute(ts), F.second(ts))))


def format_padded(ts) -> Column:
    """``yyyy-MM-dd HH:mm:ss``; a plain cast, as formatting would pass through the session zone."""
    return F.substring(_col(ts).cast("string"), 1, 19)


def time_of_day(ts) -> Column:
    return F.substring(_col(ts).cast("string"), 12, 8)


def bucket_id(ts, minutes: int) -> Column:
    """``yyyy-MM-dd-HH-k`` with k the bucket inside the hour; ``yyyy-MM-dd-HH`` for 60 minutes."""
    ts = _col(ts)
    label = ts.cast("string")
    hour = F.concat_ws("-", F.substring(label, 1, 10), F.substring(label, 12, 2))
    if minutes == 60:
        return hour
    return F.concat_ws("-", hour, F.floor(F.minute(ts) / minutes).cast("string"))


def is_hour(ts, i: int) -> Column:
    return (F.hour(_col(ts)) == i).cast("int")


def is_quarter(ts, i: int) -> Column:
    return (F.minute(_col(ts)) == 15 * i).cast("int")


def is_half(ts, i: int) -> Column:
    return (F.minute(_col(ts)) == 30 * i).cast("int")


def weekday_id(day) -> Column:
    """Monday = 0 ... Sunday = 6."""
    return F.weekday(_col(day))


def lookup(key, mapping: dict) -> Column:
    """Literal dictionary lookup; NULL for an unknown key."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.element_at(F.create_map(*pairs), _col(key))


def day_name(day_id, french: bool = True) -> Column:
    names = DAY_NAMES_FR if french else DAY_NAMES_EN
    return lookup(day_id, dict(enumerate(names)))


def day_name_en(day) -> Column:
    return F.date_format(_col(day), "EEEE")


def month_name_en(day) -> Column:
    return F.date_format(_col(day), "MMMM")


def is_month_day(day, month_day: str) -> Column:
    return (F.date_format(_col(day), "MM-dd") == month_day).cast("int")


def parse_day_month_year(text) -> Column:
    return F.to_date(_col(text), "dd/MM/yyyy")


def local_to_utc(ts, zone: str = "Europe/Paris") -> dict[str, Column]:
    """Strict local -> UTC: columns ``utc``, ``is_gap``, ``is_overlap``; ``utc`` is NULL where a flag is set.

    A local time that does not exist does not survive the round trip; one that exists twice is reached again one
    hour later. Runs on zone-less values, so the session zone has no part in it.
    """
    ts = _col(ts)
    source, utc = F.lit(zone), F.lit("UTC")
    as_utc = F.convert_timezone(source, utc, ts)
    back = F.convert_timezone(utc, source, as_utc)
    later = F.convert_timezone(utc, source, as_utc + seconds(3600))
    earlier = F.convert_timezone(utc, source, as_utc - seconds(3600))
    gap = back != ts
    overlap = (~gap) & ((later == ts) | (earlier == ts))
    return {"utc": F.when(~gap & ~overlap, as_utc), "is_gap": gap.cast("int"), "is_overlap": overlap.cast("int")}


# Lowest value of each part of a stamp, used to complete a shortened bound.
_FLOOR = "0001-01-01 00:00:00"


def label_between(ts, start: str | None, end: str | None) -> Column:
    """Inclusive slice of ISO labels in text order, given as bounds on the timestamp so that scans can prune.

    Bounds may be shortened (``'2015'``): a shortened lower bound starts at its first instant, a shortened upper
    bound excludes everything that it is a prefix of, because the longer label sorts after it.
    """
    ts = _col(ts)
    cond = F.lit(True)
    for bound in (start, end):
        if bound is not None and not re.match(r"^\d{4}(-\d\d(-\d\d( \d\d(:\d\d(:\d\d)?)?)?)?)?$", bound):
            raise ValueError(f"not a timestamp label: {bound!r}")
    if start is not None:
        cond = ts >= F.lit(start + _FLOOR[len(start):]).cast("timestamp_ntz")
    if end is not None:
        stop = F.lit(end + _FLOOR[len(end):]).cast("timestamp_ntz")
        upper = ts <= stop if len(end) == len(_FLOOR) else ts < stop
        cond = upper if start is None else cond & upper
    return cond
