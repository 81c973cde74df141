"""Scalar expressions whose NULL, rounding and boundary rules affect results.

All of them are plain Catalyst expressions; there is no Python UDF here.
"""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = [
    "all_of",
    "any_of",
    "as_event_time",
    "as_wall_clock",
    "concat_nullsafe",
    "days_hms",
    "fmt_duration",
    "holds",
    "isolation_name",
    "least_or_null",
    "minutes_between",
    "minus_hours",
    "pages_to_mb",
    "percent",
    "plus_seconds",
    "seconds_between",
    "time_of_day",
    "ts",
]

# Isolation level codes.
ISOLATION_LEVELS = {
    0: "Unspecified",
    1: "Read Uncommitted",
    2: "Read Committed",
    3: "Repeatable Read",
    4: "Serializable",
    5: "Snapshot",
}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ts(value: str | datetime | Column) -> Column:
    """A zone-free timestamp; all clock arguments of the library go through it."""
    value = value if isinstance(value, Column) else F.lit(str(value))
    return value.cast("timestamp_ntz")


def as_event_time(c: Column | str) -> Column:
    """A zone-free timestamp as an instant in UTC, which watermarks and windows need."""
    return F.from_utc_timestamp(_col(c).cast("timestamp"), F.current_timezone())


def as_wall_clock(c: Column | str) -> Column:
    """The inverse of :func:`as_event_time`, whatever the zone of the session."""
    return F.to_utc_timestamp(_col(c), F.current_timezone()).cast("timestamp_ntz")


def all_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def holds(condition: Column) -> Column:
    """Three-valued logic to two-valued: unknown counts as not true."""
    return F.coalesce(condition, F.lit(False))


def concat_nullsafe(*parts: Column | str) -> Column:
    """Concatenation in which NULL contributes nothing.  Strings are literals."""
    return F.concat(
        *[
            F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit(""))
            for p in parts
        ]
    )


def _day_number(c: Column) -> Column:
    return F.datediff(c.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")


def minutes_between(start: Column | str, end: Column | str) -> Column:
    """Minute boundaries crossed from start to end (00:59:59 -> 01:00:00 is 1)."""

    def minute(c: Column) -> Column:
        return _day_number(c) * 1440 + F.hour(c) * 60 + F.minute(c)

    return minute(_col(end)) - minute(_col(start))


def seconds_between(start: Column | str, end: Column | str) -> Column:
    """Second boundaries crossed from start to end."""

    def second(c: Column) -> Column:
        return _day_number(c) * 86400 + F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)

    return second(_col(end)) - second(_col(start))


def plus_seconds(c: Column | str, seconds: Column) -> Column:
    return _col(c) + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))


def minus_hours(c: Column | str, hours: int) -> Column:
    return _col(c) - F.make_dt_interval(hours=F.lit(hours))


def time_of_day(c: Column | str) -> Column:
    return F.date_format(_col(c), "HH:mm:ss")


def _two(c: Column) -> Column:
    return F.lpad(c.cast("string"), 2, "0")


def fmt_duration(ms: Column | str) -> Column:
    """``<days>dHH:mm:ss:mmm`` from milliseconds; days and clock share one counter."""
    ms = _col(ms).cast("long")
    seconds = F.floor(ms / 1000)
    return F.concat(
        F.floor(ms / 86_400_000).cast("string"),
        F.lit("d"),
        _two(F.floor(seconds / 3600) % 24),
        F.lit(":"),
        _two(F.floor(seconds / 60) % 60),
        F.lit(":"),
        _two(seconds % 60),
        F.lit(":"),
        F.lpad((ms % 1000).cast("string"), 3, "0"),
    )


def days_hms(seconds: Column | str) -> Column:
    """``[d.]HH:mm:ss``; the day part appears only when it is not zero."""
    s = _col(seconds).cast("long")
    days = F.floor(s / 86_400)
    return F.concat(
        F.when(days > 0, F.concat(days.cast("string"), F.lit("."))).otherwise(""),
        _two(F.floor(s / 3600) % 24),
        F.lit(":"),
        _two(F.floor(s / 60) % 60),
        F.lit(":"),
        _two(s % 60),
    )


def isolation_name(level: Column | str) -> Column:
    level = _col(level)
    out = F.lit(None).cast("string")
    for code, name in ISOLATION_LEVELS.items():
        out = F.when(level == code, name).otherwise(out)
    return out


def pages_to_mb(pages: Column | str, precision: str = "decimal(14,2)") -> Column:
    """8 KB pages to MB, two decimals."""
    return F.round(_col(pages).cast("decimal(20,0)") / F.lit(Decimal(128)), 2).cast(precision)


def percent(part: Column, whole: Column, precision: str = "decimal(9,2)") -> Column:
    """``part / whole * 100`` in decimals; a zero whole counts as one."""
    return (part / F.when(whole == 0, F.lit(1)).otherwise(whole) * 100).cast(precision)


def least_or_null(*cols: Column) -> Column:
    """Minimum that is NULL as soon as one argument is (Spark's ``least`` skips NULLs)."""
    return F.when(all_of(c.isNotNull() for c in cols), F.least(*cols) if len(cols) > 1 else cols[0])
