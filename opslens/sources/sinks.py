"""Result-table and command-log sinks."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opslens.functions.expr import ts
from opslens.sources.parts import PART, commit, listing, read_parts, versions, write_parts

EVENT_DAY = "event_date"


def sink_append(
    df: DataFrame, path: str, partition_by: tuple[str, ...] = (), create: bool = False
) -> None:
    """Append rows to a result table, creating it on the first write."""
    writer = df.write.mode("overwrite" if create else "append")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def log_start(plan: DataFrame, path: str, started: str | Column) -> None:
    """Start events of planned commands.  The log is append-only: nothing is updated later."""
    events = plan.select(
        "id",
        "database_name",
        "command_type",
        "command_text",
        F.lit("start").alias("event"),
        ts(started).alias("event_time"),
        F.lit(None).cast("int").alias("error_number"),
        F.lit(None).cast("string").alias("error_message"),
    )
    sink_append(events.withColumn(EVENT_DAY, F.col("event_time").cast("date")), path, (EVENT_DAY,))


def log_finish(results: DataFrame, path: str, finished: str | Column) -> None:
    """Finish events (``id``, ``error_number``, ``error_message``) for earlier start events."""
    events = results.select(
        "id",
        F.lit(None).cast("string").alias("database_name"),
        F.lit(None).cast("string").alias("command_type"),
        F.lit(None).cast("string").alias("command_text"),
        F.lit("finish").alias("event"),
        ts(finished).alias("event_time"),
        F.col("error_number").cast("int").alias("error_number"),
        F.col("error_message").cast("string").alias("error_message"),
    )
    sink_append(events.withColumn(EVENT_DAY, F.col("event_time").cast("date")), path, (EVENT_DAY,))


def pair_log(events: DataFrame) -> DataFrame:
    """One row per command from its start and finish events, in one aggregation."""
    is_start = F.col("event") == "start"
    is_finish = F.col("event") == "finish"
    return events.groupBy("id").agg(
        F.max(F.when(is_start, F.col("database_name"))).alias("database_name"),
        F.max(F.when(is_start, F.col("command_type"))).alias("command_type"),
        F.max(F.when(is_start, F.col("command_text"))).alias("command_text"),
        F.min(F.when(is_start, F.col("event_time"))).alias("start_time"),
        F.max(F.when(is_finish, F.col("event_time"))).alias("end_time"),
        F.max(F.when(is_finish, F.col("error_number"))).alias("error_number"),
        F.max(F.when(is_finish, F.col("error_message"))).alias("error_message"),
    )


EVENTS = """id long, database_name string, command_type string, command_text string, event string,
    event_time timestamp_ntz, error_number int, error_message string"""
PAIRS = """id long, database_name string, command_type string, command_text string, start_time timestamp_ntz,
    end_time timestamp_ntz, error_number int, error_message string"""
_FINISHED, _OPEN = "finished", "open"


def advance_pairs(spark: SparkSession, log: str, path: str, until: date | str) -> None:
    """Bring a table of paired commands up to the events before a date.

    Reads the days of the log that were not read yet and the starts that are still open, and nothing
    else: finished pairs are written once, under the day they finished.  Days before ``until`` have to be
    complete.  A version is named by its date, so that a run that is repeated replaces what it left.
    """
    target = date.fromisoformat(str(until)[:10])
    done = [v for v in versions(spark, path) if v < target.toordinal()]
    if target.toordinal() in versions(spark, path):
        return
    events = spark.read.schema(f"{EVENTS}, {EVENT_DAY} date").parquet(log)
    events = events.where(F.col(EVENT_DAY) < F.lit(target))
    if done:
        events = events.where(F.col(EVENT_DAY) >= F.lit(date.fromordinal(done[-1])))
    schema = spark.createDataFrame([], PAIRS).schema
    open_ = read_parts(spark, path, _OPEN, schema, listed=listing(spark, path, before=target.toordinal()))
    waiting = open_.select(
        "id", "database_name", "command_type", "command_text", F.lit("start").alias("event"),
        F.col("start_time").alias("event_time"), "error_number", "error_message",
    )
    pairs = pair_log(events.drop(EVENT_DAY).unionByName(waiting))
    day = F.date_format("end_time", "yyyyMMdd")
    ended = pairs.where(F.col("end_time").isNotNull()).withColumn(PART, F.concat(F.lit("d"), day))
    write_parts(ended, path, _FINISHED, target.toordinal())
    write_parts(pairs.where(F.col("end_time").isNull()).withColumn(PART, F.lit("all")), path, _OPEN, target.toordinal())
    commit(spark, path, target.toordinal(), [_OPEN, _FINISHED], ["all"])


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Finished pairs and open starts, as of the last ``advance_pairs``."""
    schema, listed = spark.createDataFrame([], PAIRS).schema, listing(spark, path)
    finished = read_parts(spark, path, _FINISHED, schema, listed=listed)
    return finished.unionByName(read_parts(spark, path, _OPEN, schema, listed=listed))
