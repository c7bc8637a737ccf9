"""Time expressions: leading timestamps of lines, windows and schedules."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from logquarry.functions import fixed
from logquarry.functions.text import jvm_pattern

_WINDOW_UNITS = {"m": 60, "h": 3600, "d": 86400}


def window_seconds(window: str | None) -> int | None:
    """``15m``, ``6h``, ``7d`` in seconds; None for no or an unknown window."""
    found = re.fullmatch(r"(\d+)([mhd])", (window or "").strip().lower())
    return int(found[1]) * _WINDOW_UNITS[found[2]] if found else None


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def _iso(line: Column) -> Column:
    return F.regexp_extract(line, fixed.ISO_TIME, 1).try_cast("timestamp")


def _bsd(line: Column, year: Column) -> Column:
    months = F.array(*[F.lit(m) for m in fixed.MONTHS])
    month = F.array_position(months, F.regexp_extract(line, fixed.BSD_TIME, 1))
    text = F.format_string(
        "%04d-%02d-%s %s",
        year,
        month,
        F.lpad(F.regexp_extract(line, fixed.BSD_TIME, 2), 2, "0"),
        F.regexp_extract(line, fixed.BSD_TIME, 3),
    )
    return F.when(line.rlike(fixed.BSD_TIME) & (month > 0), text.try_cast("timestamp"))


def line_timestamp(line: Column, year: Column | int | None = None) -> Column:
    """A leading ISO-8601 time (session zone when it names none) or a BSD time in the given year."""
    if year is None:
        year = F.year(F.current_date())
    elif isinstance(year, int):
        year = F.lit(year)
    return F.coalesce(_iso(line), _bsd(line, year))


def pattern_groups(pattern: str) -> dict[str, int]:
    """Named groups of a pattern with their numbers; none for a malformed one."""
    try:
        return dict(re.compile(pattern).groupindex)
    except re.error:
        return {}


def pattern_timestamp(
    line: Column,
    pattern: str,
    date_group: str = "event_date",
    time_group: str = "event_time",
    time_default: str = "00:00:00",
) -> Column:
    """Date and time groups of a pattern; the fraction is dropped, a missing time takes the default."""
    groups, jvm = pattern_groups(pattern), jvm_pattern(pattern)
    if date_group not in groups or jvm is None:
        return F.lit(None).cast("timestamp")
    day = F.regexp_extract(line, jvm, groups[date_group])
    clock = F.nullif(F.regexp_extract(line, jvm, groups[time_group]), F.lit("")) if time_group in groups else F.lit(None)
    clock = F.substring_index(F.coalesce(clock, F.lit(time_default)), ".", 1)
    text = F.concat_ws(" ", day, clock)
    return F.when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$"), text.try_cast("timestamp"))


def next_run(after: Column, interval_days: Column, hour: Column) -> Column:
    """``interval_days`` later at the full hour, pushed a day when that is not after ``after``."""
    days = F.greatest(interval_days.cast("int"), F.lit(1))
    hours = F.least(F.greatest(hour.cast("int"), F.lit(0)), F.lit(23))
    midnight = F.date_add(after.cast("date"), days).cast("timestamp")
    candidate = midnight + F.make_interval(hours=hours)
    return F.when(candidate <= after, candidate + F.expr("INTERVAL 1 DAY")).otherwise(candidate)
