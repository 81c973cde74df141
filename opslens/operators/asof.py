"""As-of joins: each row with the last row of another table that is not later than it.

Kinds of one server are polled one after the other, so a request and its session rarely carry the same poll time.
Both sides are sorted together by range over all tasks, as in ``ranking``; inside a range the last row of the
right side is carried forward, and over range borders the last one of each range, of which there are few.
There is no join on the key, so a busy key is no heavier than others.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opslens.operators.ranking import POSITION, RANGE, in_ranges
from opslens.sources.schemas import FLEET_KEYS

_RIGHT, _LEFT = 0, 1


def asof_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    time: str,
    columns: Sequence[str],
    right_time: str | None = None,
    within: str | None = None,
    matched_time: str = "as_of_time",
) -> DataFrame:
    """All rows of ``left`` with ``columns`` of the last ``right`` row of the same keys at or before ``time``.

    ``matched_time`` is that row's time; all these are NULL without such a row, or if it is older than
    ``within`` (an interval such as ``10 minutes``).  Of right rows with equal keys and time the one
    with the greatest ``columns`` counts.  Rows whose keys or time are NULL match nothing.
    """
    right_time = right_time or time
    names = [f"__k{i}" for i in range(len(keys))]
    clash = set(left.columns) & {*columns, matched_time}
    if clash:
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    rows = left.select(
        *[F.col(c).alias(n) for c, n in zip(keys, names, strict=True)],
        F.col(time).alias("__time"),
        F.lit(_LEFT).alias("__side"),
        F.struct(*left.columns).alias("__row"),
    )
    found = right.dropna(subset=[*keys, right_time]).groupBy(
        *[F.col(c).alias(n) for c, n in zip(keys, names, strict=True)], F.col(right_time).alias("__time")
    )
    found = found.agg(F.max(F.struct(*columns)).alias("__found")).withColumn("__side", F.lit(_RIGHT))
    both = rows.unionByName(found, allowMissingColumns=True)
    placed = in_ranges(both, names, [F.col("__time"), F.col("__side")])

    seen = F.when(F.col("__side") == _RIGHT, F.struct(*names, "__time", "__found"))
    inside = Window.partitionBy(RANGE).orderBy(POSITION).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = placed.groupBy(RANGE).agg(F.max_by(seen, F.when(F.col("__side") == _RIGHT, F.col(POSITION))).alias("end"))
    earlier = Window.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    # One row per sort partition, hence small and bounded.
    carried = ends.select(RANGE, F.last("end", ignorenulls=True).over(earlier).alias("__carried"))
    near = placed.withColumn("__seen", F.last(seen, ignorenulls=True).over(inside)).where(F.col("__side") == _LEFT)
    near = near.join(F.broadcast(carried), RANGE)
    last = F.coalesce("__seen", "__carried")
    fits = last.isNotNull()
    for n in names:
        fits = fits & F.coalesce(last[n] == F.col(n), F.lit(False))
    if within is not None:
        fits = fits & (last["__time"] >= F.col("__time") - F.expr(f"INTERVAL {within}"))
    # A NULL time sorts before all others, so nothing of its key stands before it.
    return near.select(
        *[F.col(f"__row.{c}").alias(c) for c in left.columns],
        *[F.when(fits, last["__found"][c]).alias(c) for c in columns],
        F.when(fits, last["__time"]).alias(matched_time),
    )


def poll_times(df: DataFrame) -> DataFrame:
    return df.select("server_id", "snapshot_ts").distinct()


def align_polls(
    leading: DataFrame,
    other: DataFrame,
    within: str | None = None,
    leading_polls: DataFrame | None = None,
    other_polls: DataFrame | None = None,
) -> DataFrame:
    """Rows of ``other`` as the polls of ``leading`` saw them, with the fleet columns of those polls.

    Each poll of ``leading`` gets the rows of the server's last poll of ``other`` at or before it, so that both can
    be joined with ``FLEET_KEYS`` as scope.  Whole polls are aligned, not rows: what that poll does not
    hold any more does not come back from an older one.  One poll of ``other`` may serve several.  Polls
    that are known from a manifest can be given, and need no pass over the rows.
    """
    wanted = poll_times(leading) if leading_polls is None else leading_polls.select("server_id", "snapshot_ts").distinct()
    there = poll_times(other) if other_polls is None else other_polls.select("server_id", "snapshot_ts").distinct()
    there = there.withColumn("poll_ts", F.col("snapshot_ts"))
    pairs = asof_join(wanted, there, ["server_id"], "snapshot_ts", ["poll_ts"], within=within).where("poll_ts is not null")
    pairs = pairs.select("server_id", F.col("poll_ts").alias("__poll"), F.col("snapshot_ts").alias("__seen_at"))
    rows = other.withColumnRenamed("snapshot_ts", "__poll").join(pairs, ["server_id", "__poll"])
    rows = rows.drop("snapshot_date", "__poll").withColumnRenamed("__seen_at", "snapshot_ts")
    rows = rows.withColumn("snapshot_date", F.col("snapshot_ts").cast("date"))
    rest = [c for c in other.columns if c not in FLEET_KEYS]
    return rows.select(*FLEET_KEYS, *rest)
