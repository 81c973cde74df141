"""Row numbers and running totals that do not depend on one task per group.

A window partitioned by a database puts that database into one task.  Here rows are sorted by range over
all tasks and written once, each range is numbered by itself, and the few per-range totals are carried
forward.  There is one plan, whatever the size of the groups.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opslens.sources.workdir import reliable_checkpoint

POSITION = "__position"
RANGE = "__range"
_RANGE_BITS = 33  # monotonically_increasing_id keeps the partition above this bit


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """``row_number`` per key.  ``order`` has to be total within a key."""
    rows = in_ranges(df, keys, order)
    before = _carry(rows.groupBy(RANGE).agg(F.count(F.lit(1)).alias("rows")), "rows")
    first = F.shiftleft(F.col(RANGE), _RANGE_BITS)
    rows = rows.join(F.broadcast(before), RANGE).withColumn(
        name, F.col(POSITION) - first + F.col("rows_before") + 1
    )
    if keys:
        starts = rows.groupBy(*keys).agg((F.min(name) - 1).alias("__start"))
        rows = _join_keys(rows, starts, keys).withColumn(name, F.col(name) - F.col("__start"))
    return rows.select(*df.columns, name)


def running_sum(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: str, name: str
) -> DataFrame:
    """Running total of an integer or decimal column per key, current row included.

    As in SQL, NULL values add nothing and the total is NULL before a key's first value.
    """
    rows = in_ranges(df, keys, order)
    total, known = F.coalesce(F.sum(value), F.lit(0)), F.count(value)
    before = _carry(rows.groupBy(RANGE).agg(total.alias("total"), known.alias("known")), "total", "known")
    inside = (
        Window.partitionBy(RANGE)
        .orderBy(POSITION)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = rows.select("*", F.sum(value).over(inside).alias(name), F.count(value).over(inside).alias("__known"))
    rows = local.join(F.broadcast(before), RANGE)
    rows = rows.withColumn(name, F.coalesce(name, F.lit(0)) + F.col("total_before")).withColumn(
        "__known", F.col("__known") + F.col("known_before")
    )
    opening = F.struct(
        (F.col(name) - F.coalesce(value, F.lit(0))).alias("total"),
        (F.col("__known") - F.col(value).isNotNull().cast("int")).alias("known"),
    )
    if keys:
        starts = rows.groupBy(*keys).agg(F.min_by(opening, F.col(POSITION)).alias("__start"))
        rows = _join_keys(rows, starts, keys)
        own, count = F.col(name) - F.col("__start.total"), F.col("__known") - F.col("__start.known")
    else:
        own, count = F.col(name), F.col("__known")
    return rows.withColumn(name, F.when(count > 0, own)).select(*df.columns, name)


def in_ranges(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Globally sorted rows with their range and position.

    Checkpointed, because the position is read by several branches and must
    stay the same when a lost task is run again.
    """
    ordered = df.orderBy(*[F.col(k) for k in keys], *order)
    placed = ordered.withColumn(POSITION, F.monotonically_increasing_id())
    return reliable_checkpoint(
        placed.withColumn(RANGE, F.shiftright(F.col(POSITION), _RANGE_BITS))
    )


def _carry(totals: DataFrame, *columns: str) -> DataFrame:
    """Totals of all earlier ranges: one row per sort partition, hence small and bounded."""
    earlier = Window.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(
        RANGE, *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in columns]
    )


def _join_keys(rows: DataFrame, starts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Attach one row per key, treating NULL keys as equal; a hot key splits under AQE."""
    renamed = starts.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], "__start")
    condition = F.lit(True)
    for i, k in enumerate(keys):
        condition = condition & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return rows.join(renamed, condition)
