from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from opslens import functions as fn


def one(spark, column, **values):
    schema = ", ".join(
        f"{k} {'string' if v is None or isinstance(v, str) else 'timestamp_ntz' if isinstance(v, datetime) else 'double' if isinstance(v, float) else 'boolean' if isinstance(v, bool) else 'long'}"
        for k, v in values.items()
    )
    df = spark.createDataFrame([tuple(values.values())], schema or "x int") if values else spark.range(1)
    return df.select(column.alias("r")).first()["r"]


def test_concat_ignores_null(spark):
    assert one(spark, fn.concat_nullsafe("a", F.col("x"), F.col("y")), x=None, y="b") == "ab"


@pytest.mark.parametrize(
    ("start", "end", "minutes"),
    [
        (datetime(2024, 1, 1, 0, 59, 59), datetime(2024, 1, 1, 1, 0, 0), 1),
        (datetime(2024, 1, 1, 0, 0, 0), datetime(2024, 1, 1, 0, 0, 59), 0),
        (datetime(2024, 3, 10, 1, 0, 0), datetime(2024, 3, 10, 4, 0, 0), 180),  # clocks change here
        (datetime(2024, 1, 2), datetime(2024, 1, 1), -1440),
    ],
)
def test_minutes_count_boundaries(spark, start, end, minutes):
    assert one(spark, fn.minutes_between("s", "e"), s=start, e=end) == minutes


def test_seconds_count_boundaries(spark):
    start, end = datetime(2024, 1, 1, 0, 0, 0, 999999), datetime(2024, 1, 1, 0, 0, 1)
    assert one(spark, fn.seconds_between("s", "e"), s=start, e=end) == 1


@pytest.mark.parametrize(
    ("ms", "text"),
    [(0, "0d00:00:00:000"), (90_061_001, "1d01:01:01:001"), (86_399_999, "0d23:59:59:999")],
)
def test_duration(spark, ms, text):
    assert one(spark, fn.fmt_duration("x"), x=ms) == text


@pytest.mark.parametrize(
    ("seconds", "text"), [(0, "00:00:00"), (86_399, "23:59:59"), (93_784, "1.02:03:04")]
)
def test_days_hms(spark, seconds, text):
    assert one(spark, fn.days_hms("x"), x=seconds) == text


@pytest.mark.parametrize(("level", "name"), [(0, "Unspecified"), (5, "Snapshot"), (6, None)])
def test_isolation(spark, level, name):
    assert one(spark, fn.isolation_name("x"), x=level) == name


def test_percent_guards_zero(spark):
    part, whole = (F.col(c).cast("decimal(12,2)") for c in "ab")
    assert one(spark, fn.percent(part, whole), a=5, b=0) == Decimal("500.00")
    assert one(spark, fn.percent(part, whole), a=1, b=3) == Decimal("33.33")


def test_pages_round_half_up(spark):
    assert one(spark, fn.pages_to_mb("x"), x=16) == Decimal("0.13")


def test_least_or_null(spark):
    assert one(spark, fn.least_or_null(F.col("a"), F.col("b")), a=2, b=1) == 1
    assert one(spark, fn.least_or_null(F.col("a"), F.lit(None).cast("long")), a=2) is None


def test_quotename_doubles_brackets(spark):
    assert one(spark, fn.quotename("x"), x="a]b") == "[a]]b]"
    assert one(spark, fn.quote_literal("x"), x="o'k") == "N'o''k'"


def test_name_part_counts_from_the_right(spark):
    assert one(spark, fn.name_part("x", 1), x="db.dbo.t") == "t"
    assert one(spark, fn.name_part("x", 3), x="db.dbo.t") == "db"
    assert one(spark, fn.name_part("x", 4), x="db.dbo.t") is None


def test_safe_name(spark):
    assert one(spark, fn.safe_name("x"), x='a\\/:*?"<>|b ') == "ab"


def test_like_escapes_underscore(spark):
    pattern = fn.escape_like("a_b%")
    assert one(spark, fn.like_ci("x", pattern), x="A_Bc") is True
    assert one(spark, fn.like_ci("x", pattern), x="axbc") is False


@pytest.mark.parametrize(
    ("start", "end", "text"),
    # An open end is one position past the last non-blank character.
    [(0, -1, "select 1 "), (0, 10, "select"), (14, 14, "1"), (14, -1, "1 "), (100, -1, "")],
)
def test_statement_offsets_are_bytes(spark, start, end, text):
    column = fn.extract_statement("t", "s", "e")
    assert one(spark, column, t="select 1  ", s=start, e=end) == text


def test_swapped_guid(spark):
    guid = "11223344-5566-7788-99AA-BBCCDDEEFF00"
    assert one(spark, fn.swapped_guid_hex("x"), x=guid) == "443322116655887799AABBCCDDEEFF00"
    assert one(spark, fn.swapped_guid_hex("x"), x=None) == "?"


def test_event_time_round_trip(spark):
    moment = datetime(2024, 7, 1, 12, 30)
    assert one(spark, fn.as_wall_clock(fn.as_event_time("x")), x=moment) == moment
