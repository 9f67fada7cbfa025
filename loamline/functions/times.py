"""Clocks, days and ranges."""

from __future__ import annotations

import re
from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

_UNITS = {"m": "minutes", "h": "hours", "d": "days", "w": "weeks"}


def micros(clock: Column | str) -> Column:
    """Microseconds since 1970 of a zoneless timestamp, whatever the session's zone."""
    clock = F.col(clock) if isinstance(clock, str) else clock
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), clock)


def parse_duration(text: str) -> timedelta:
    """90m, 24h, 7d, 2w."""
    found = re.fullmatch(r"(\d+)([mhdw])", text.strip())
    if not found:
        raise ValueError(f"not a duration: {text!r}")
    return timedelta(**{_UNITS[found[2]]: int(found[1])})


def parse_when(text: str, now: datetime, zone: str = "UTC") -> datetime:
    """An RFC 3339 time, a date (its start in `zone`), or a duration before now; always in UTC."""
    text = text.strip()
    if re.fullmatch(r"\d+[mhdw]", text):
        return now.astimezone(UTC) - parse_duration(text)
    found = datetime.fromisoformat(text.replace("Z", "+00:00"))
    return (found if found.tzinfo else found.replace(tzinfo=ZoneInfo(zone))).astimezone(UTC)


def parse_range(text: str, now: datetime, zone: str = "UTC") -> tuple[datetime, datetime]:
    """today, tomorrow, yesterday, a weekday, week, or a date: local midnight to local midnight, so a day may have 23 or 25 hours."""
    local = now.astimezone(ZoneInfo(zone))
    start = local.replace(hour=0, minute=0, second=0, microsecond=0, tzinfo=None)
    days = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]
    word, length = text.strip().lower(), 1
    if word in ("today", "tomorrow", "yesterday"):
        start += timedelta({"today": 0, "tomorrow": 1, "yesterday": -1}[word])
    elif word in days:
        start += timedelta((days.index(word) - start.weekday()) % 7)
    elif word == "week":
        start, length = start - timedelta(start.weekday()), 7
    else:
        start = datetime.fromisoformat(word)
    return tuple((start + timedelta(n)).replace(tzinfo=ZoneInfo(zone)).astimezone(UTC) for n in (0, length))


def local_day(clock: Column, zone: str | Column) -> Column:
    """The date of a UTC clock in a zone."""
    return F.to_date(F.from_utc_timestamp(clock, zone))


def day_start(day: Column, zone: str | Column) -> Column:
    """The UTC clock of a local midnight."""
    return F.to_utc_timestamp(day.cast("timestamp"), zone)


def looks_all_day(start: Column, end: Column) -> Column:
    """At least 23 hours, and within an hour of whole days."""
    hours = (micros(end) - micros(start)) / F.lit(3.6e9)
    return (hours >= 23) & (F.abs(hours - F.round(hours / 24) * 24) <= 1)


def from_ticks(ticks: Column) -> Column:
    """Microseconds since 1970 of a count of 100 ns since 0001-01-01."""
    return F.floor(ticks / 10).cast("long") - F.lit(62_135_596_800_000_000)


def later(a: Column, b: Column, skew_us: int = 5_000_000) -> Column:
    """1, -1 or 0: which clock is later by more than the skew; 0 where one is unknown."""
    gap = micros(a) - micros(b)
    return F.when(gap > skew_us, 1).when(gap < -skew_us, -1).otherwise(0)
