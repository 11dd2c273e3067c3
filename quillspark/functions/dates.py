"""Dates, and arrays of structs (date, label, type) that hold an item's timeline. The clock is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def timestamp(text: Column) -> Column:
    """ISO text to a timestamp, null where it is none."""
    return text.try_cast("timestamp")


def days_until(day: Column, today: Column) -> Column:
    """Whole days to the end of a day: today is 1, yesterday 0."""
    return F.date_diff(day, today) + 1


def days_since(then: Column, now: Column) -> Column:
    return F.floor(F.timestamp_diff("SECOND", then, now) / 86400).cast("long")


def duration(start: Column, end: Column) -> Column:
    """Seconds between two instants, to a tenth."""
    return F.round(F.timestamp_diff("MICROSECOND", start, end) / 1_000_000, 1)


def trial_days_left(ends: Column, now: Column) -> Column:
    return F.greatest(F.lit(0), F.ceil(F.timestamp_diff("SECOND", now, ends) / 86400).cast("int"))


def expired(ends: Column, now: Column) -> Column:
    """A missing end counts as past."""
    return F.coalesce(now > ends, F.lit(True))


def extended(current: Column, now: Column, days: Column) -> Column:
    """Days added to the later of now and the current end."""
    return F.greatest(now, F.coalesce(current, now)) + F.make_interval(days=days)


def fresh(checked: Column, now: Column, days: int = 7) -> Column:
    return F.coalesce(checked > now - F.make_interval(days=F.lit(days)), F.lit(False))


def month_number(day: Column) -> Column:
    return F.year(day) * 12 + F.month(day)


def snapshot_time(name: Column) -> Column:
    """The instant in a file name: the first YYYYMMDD, with -HHMMSS where it follows; null where that is no date."""
    stamp = F.regexp_extract(name, r"\d{8}(?:-\d{6})?", 0)
    return F.when(F.length(stamp) == 8, F.try_to_timestamp(stamp, F.lit("yyyyMMdd"))).when(F.length(stamp) == 15, F.try_to_timestamp(stamp, F.lit("yyyyMMdd-HHmmss")))


def next_date(dates: Column, today: Column) -> Column:
    """The earliest upcoming entry (yesterday still counts), else the latest past one."""
    ahead = F.filter(dates, lambda d: days_until(d["date"], today) >= 0)
    return F.coalesce(F.array_min(ahead), F.array_max(dates))


def milestones(dates: Column, today: Column) -> Column:
    """Distinct (date, label) in order, with whether each is past."""
    pairs = F.array_distinct(F.transform(F.filter(dates, lambda d: d["date"].isNotNull()), lambda d: F.struct(d["date"].alias("date"), d["label"].alias("label"))))
    return F.transform(F.array_sort(pairs), lambda d: F.struct(d["date"].alias("date"), d["label"].alias("label"), (days_until(d["date"], today) < 0).alias("past")))


def display_milestones(dates: Column, today: Column) -> Column:
    """The entries with a date, each (date, label) once and the first of them, by date; a blank label is Date, a blank type deadline."""
    there = F.filter(dates, lambda d: d["date"].isNotNull())
    keys = F.transform(there, lambda d: F.struct(d["date"].alias("date"), F.coalesce(d["label"], F.lit("")).alias("label")))
    first = F.filter(there, lambda d, i: F.array_position(keys, F.struct(d["date"].alias("date"), F.coalesce(d["label"], F.lit("")).alias("label"))) == i + 1)
    named = lambda v, other: F.coalesce(F.nullif(v, F.lit("")), F.lit(other))
    shown = F.transform(first, lambda d, i: F.struct(d["date"].alias("date"), i.alias("at"), named(d["label"], "Date").alias("label"), named(d["type"], "deadline").alias("type"), (days_until(d["date"], today) < 0).alias("past")))
    return F.array_sort(shown)


def progress(dates: Column, estimated: Column, run_status: Column, today: Column) -> Column:
    """completed where the entry does not run; not_started before the first date or without any; in_progress up to the last;
    then completed, unless the dates were estimates for something that still runs."""
    days = F.filter(F.transform(dates, lambda d: d["date"]), lambda d: d.isNotNull())
    first, last = F.array_min(days), F.array_max(days)
    return (
        F.when(F.coalesce(run_status == "not_running", F.lit(False)), "completed")
        .when(F.coalesce(F.size(days), F.lit(0)) <= 0, "not_started")
        .when(days_until(first, today) > 0, "not_started")
        .when(days_until(last, today) >= 0, "in_progress")
        .when(F.coalesce((run_status == "running") & estimated, F.lit(False)), "not_started")
        .otherwise("completed")
    )


def with_opening(dates: Column, opens: Column) -> Column:
    """The dates and an `opens` entry, unless one is there."""
    entry = F.struct(opens.alias("date"), F.lit("Opens").alias("label"), F.lit("opens").alias("type"))
    return F.when(opens.isNull() | F.exists(dates, lambda d: d["type"] == "opens"), dates).otherwise(F.concat(F.array(entry), dates))
