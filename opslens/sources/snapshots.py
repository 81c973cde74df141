"""Scans over collected snapshot tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opslens.functions.expr import ts
from opslens.sources.manifest import has_manifest, read_newest
from opslens.sources.schemas import SCHEMAS


def scan_all(
    spark: SparkSession,
    kind: str,
    path: str,
    since: date | str | None = None,
    until: date | str | None = None,
    servers: Sequence[str] | None = None,
) -> DataFrame:
    """Every poll of one kind over the whole fleet; date and server prune partitions."""
    df = spark.read.schema(SCHEMAS[kind]).parquet(path).drop("write")
    if since is not None:
        df = df.where(F.col("snapshot_date") >= F.lit(str(since)).cast("date"))
    if until is not None:
        df = df.where(F.col("snapshot_date") <= F.lit(str(until)).cast("date"))
    if servers is not None:
        df = df.where(F.col("server_id").isin(list(servers)))
    return df


def read_snapshot(
    spark: SparkSession,
    kind: str,
    path: str,
    as_of: datetime | str,
    servers: Sequence[str] | None = None,
    since: date | str | None = None,
) -> DataFrame:
    """The last poll of each server, not later than ``as_of``.

    A table written by ``write_polls`` has a manifest, and only the files of those polls are read.  For
    other tables they come from a scan of the key columns up to ``as_of``, which ``since`` shortens; polls before it
    are left out.
    """
    if has_manifest(spark, path):
        return read_newest(spark, kind, path, as_of, servers, since)
    polls = scan_all(spark, kind, path, since=since, until=str(as_of)[:10], servers=servers).where(
        F.col("snapshot_ts") <= ts(as_of)
    )
    last = polls.groupBy("server_id").agg(F.max(F.struct("snapshot_ts", "snapshot_date")).alias("last"))
    last = last.select("server_id", "last.snapshot_ts", "last.snapshot_date")
    return polls.join(last, ["server_id", "snapshot_ts", "snapshot_date"], "left_semi")


def for_each_partition_of(
    df: DataFrame,
    databases: DataFrame,
    fn: Callable[[DataFrame], DataFrame],
    key: str = "database_id",
    database_filter: Column | None = None,
) -> DataFrame:
    """Run one query for every matching database.

    The database is a column of ``df``, so the loop is a semi-join in front of
    one set-based plan; ``fn`` keeps the database columns it wants to report.
    """
    wanted = databases if database_filter is None else databases.where(database_filter)
    return fn(df.join(wanted.select(key), key, "left_semi"))
