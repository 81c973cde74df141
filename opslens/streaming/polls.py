"""Repeated polls as streams: activity windows, blocked episodes, command pairing, retention."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from opslens.functions import as_event_time, as_wall_clock
from opslens.operators.snapshots import snapshot_retention
from opslens.sources.folders import names
from opslens.sources.parts import PART, commit, listing, part_of, read_parts, versions, write_parts
from opslens.sources.workdir import fresh_path

# Settings a stream is started with: state outside the heap, written as changes and not counted (a count
# reads each key before it is written), and session windows merged inside each task before their rows meet.
_STREAM_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
}


def read_stream(
    spark: SparkSession, path: str, schema: StructType, max_files: int | None = None
) -> DataFrame:
    """Files of a growing table as a stream; the schema is explicit, nothing is inferred."""
    reader = spark.readStream.schema(schema)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def activity_windows(
    activity: DataFrame,
    window: str = "1 day",
    slide: str | None = None,
    delay: str = "1 day",
    keys: Sequence[str] = ("database_name",),
    time: str = "ts",
) -> DataFrame:
    """Requests, waits and blocked requests per tumbling or sliding window.

    Counts combine before the shuffle, so a busy database costs one row per
    task and window.  A sliding window is put together from panes, tumbling windows as long as the slide,
    which have to divide the window: an event is counted once, in its pane, and only finished panes are added
    to the windows that hold them.
    """
    pane = F.window(time, slide or window)
    counted = (
        activity.withColumn(time, as_event_time(time))
        .withWatermark(time, delay)
        .groupBy(pane.alias("w"), *keys)
        .agg(
            F.count(F.lit(1)).alias("requests"),
            F.count_if("is_waiting").alias("waits"),
            F.count_if("is_blocked").alias("blocked"),
        )
    )
    if slide:
        _check_panes(window, slide)
        counts = ("requests", "waits", "blocked")
        counted = counted.groupBy(F.window(F.window_time("w"), window, slide).alias("w"), *keys).agg(
            *[F.sum(c).alias(c) for c in counts]
        )
    return (
        counted.select(
            as_wall_clock("w.start").alias("window_start"),
            as_wall_clock("w.end").alias("window_end"),
            *keys,
            "requests",
            "waits",
            "blocked",
        )
    )


def _check_panes(window: str, slide: str) -> None:
    length, step = _duration(window), _duration(slide)
    if not step or length % step:
        raise ValueError(f"a window of {window} is no whole number of slides of {slide}")


def _duration(text: str) -> timedelta:
    """A duration such as ``1 day 12 hours``, in units of fixed length."""
    words = text.split()
    units = [w.lower().rstrip("s") + "s" for w in words[1::2]]
    if len(words) % 2 or not set(units) <= {"weeks", "days", "hours", "minutes", "seconds", "milliseconds"}:
        raise ValueError(f"not a duration: {text}")
    return sum((timedelta(**{u: int(n)}) for n, u in zip(words[::2], units, strict=True)), timedelta())


def blocked_episodes(
    polls: DataFrame,
    gap: str = "2 hours",
    delay: str = "1 day",
    keys: Sequence[str] = ("session_id",),
    time: str = "ts",
) -> DataFrame:
    """Episodes in which a session was seen blocked; a gap closes an episode."""
    return (
        polls.where("is_blocked")
        .withColumn(time, as_event_time(time))
        .withWatermark(time, delay)
        .groupBy(F.session_window(time, gap).alias("w"), *keys)
        .agg(F.count(F.lit(1)).alias("polls"))
        .select(
            *keys,
            as_wall_clock("w.start").alias("episode_start"),
            as_wall_clock("w.end").alias("episode_end"),
            "polls",
        )
    )


@contextmanager
def _stream_settings(spark: SparkSession) -> Iterator[None]:
    """A query keeps the settings it was started with, so they are put back afterwards."""
    before = {key: spark.conf.get(key, None) for key in _STREAM_SETTINGS}
    for key, value in _STREAM_SETTINGS.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def pair_commands(
    starts: DataFrame,
    finishes: DataFrame,
    timeout: str = "1 hour",
    delay: str = "1 day",
) -> DataFrame:
    """Start events with the finish event that follows within the timeout.

    Starts without one come out flagged once the watermark has passed them.
    """
    s = starts.withColumn("start_time", as_event_time("start_time")).withWatermark(
        "start_time", delay
    )
    f = finishes.select(
        F.col("id").alias("finish_id"), as_event_time("end_time").alias("end_time"), "error_number"
    ).withWatermark("end_time", delay)
    condition = F.expr(
        "id = finish_id AND end_time >= start_time "
        f"AND end_time <= start_time + INTERVAL {timeout}"
    )
    return s.join(f, condition, "leftOuter").select(
        *[as_wall_clock(c).alias(c) if c == "start_time" else c for c in starts.columns],
        as_wall_clock("end_time").alias("end_time"),
        "error_number",
        F.col("finish_id").isNull().alias("is_unfinished"),
    )


def run_to_table(
    stream: DataFrame,
    label: str,
    partition_by: Sequence[str] = (),
    path: str | None = None,
) -> DataFrame:
    """Process everything available into a Parquet table of the shared folder and read it back."""
    spark = stream.sparkSession
    path = path or fresh_path(spark, label)
    writer = (
        stream.writeStream.outputMode("append")
        .format("parquet")
        .option("checkpointLocation", f"{path}-progress")
        .trigger(availableNow=True)
    )
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    with _stream_settings(spark):
        query = writer.start(path)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def retention_on_trigger(
    snapshots: DataFrame,
    files: Callable[[], DataFrame],
    label: str = "retention",
    path: str | None = None,
    *,
    scope: Sequence[str] = (),
    **limits,
) -> DataFrame:
    """Decide retention on every trigger over the newest poll of each server.

    ``snapshots`` are polls: rows with ``snapshot_ts`` and the server columns ``scope``.  Only the rows of
    a server's newest poll count, one per snapshot, and that poll's time is the clock.  State and decisions are
    kept in a part for each server.  A trigger reads and rewrites those of the servers in its batch, both
    under its batch id, so its work follows the batch and a repeated batch replaces itself.
    Returns the decisions of every server's last trigger; none before the first poll.
    """
    spark = snapshots.sparkSession
    path = path or fresh_path(spark, label)
    schema = snapshots.schema
    tables = ["state", "decided"]

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        rows = batch.withColumn(PART, part_of(scope))
        touched = [r[0] for r in rows.select(PART).distinct().collect()]
        if batch_id in versions(session, path) or not touched:
            return
        kept = read_parts(session, path, "state", schema, touched, listing(session, path))
        polls = newest_poll(kept.unionByName(batch), scope)
        write_parts(polls.withColumn(PART, part_of(scope)), path, "state", batch_id)
        current = session.read.schema(schema).parquet(*_written(session, path, "state", batch_id))
        decisions = snapshot_retention(current, files(), F.col("snapshot_ts"), scope=scope, **limits)
        write_parts(decisions.withColumn(PART, part_of(scope)), path, "decided", batch_id)
        commit(session, path, batch_id, tables, touched)

    query = (
        snapshots.writeStream.foreachBatch(on_batch)
        .option("checkpointLocation", f"{path}/progress")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    nothing = snapshot_retention(spark.createDataFrame([], schema), files(), F.col("snapshot_ts"), scope=scope, **limits)
    return read_parts(spark, path, "decided", nothing.schema) if versions(spark, path) else nothing


def _written(spark: SparkSession, path: str, table: str, version: int) -> list[str]:
    folder = f"{path}/{table}/version={version}"
    return [f"{folder}/{n}" for n in names(spark, folder) if n.startswith(f"{PART}=")]


def newest_poll(polls: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Rows of each server's newest poll; a snapshot that the poll repeats counts once."""
    keys = list(scope)
    last = polls.groupBy(*keys).agg(F.max("snapshot_ts").alias("snapshot_ts"))
    newest = polls.join(last, [*keys, "snapshot_ts"], "left_semi")
    return newest.dropDuplicates([*keys, "source_database_id", "database_id"])
