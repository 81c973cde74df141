"""Poll tables with a manifest: which file holds which poll, so that the newest polls are read without the history.

Every write is a folder of its own below the table, and adds one manifest row per server, poll and file.  The
newest poll of each server is then looked up in the manifest, and only its files are scanned.  The manifest
grows with the number of polls; so a day can be closed, which writes down the newest poll that each server
had before it.  A lookup then reads that, and the manifest rows from there to the date it asks for.

Rows count from the moment their manifest rows are written; a write that fails before leaves files that nothing
refers to.  A poll may be added in several writes.  Rows that arrive for a day that was closed open it again.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opslens.functions.expr import ts
from opslens.sources.folders import exists, names, remove
from opslens.sources.schemas import FLEET_KEYS, SCHEMAS

_WRITE = "write"
_ENTRIES = "server_id string, snapshot_ts timestamp_ntz, file string, rows long, snapshot_date date"


def manifest_path(path: str) -> str:
    return f"{path.rstrip('/')}.polls"


def write_polls(df: DataFrame, path: str) -> None:
    """Append polls (rows with the fleet columns) to a table, and say in its manifest where they are.

    Rows are dealt by poll and sorted, so that a file holds few polls.  They are hashed, not split by range: a range
    is sampled first, which computes all rows twice.  The date always is that of the poll time.
    """
    spark = df.sparkSession
    path = path.rstrip("/")
    name = f"{_WRITE}={uuid.uuid4().hex}"
    order = ["snapshot_date", "snapshot_ts", "server_id"]
    rows = df.withColumn("snapshot_date", F.col("snapshot_ts").cast("date"))
    rows.repartition(*order).sortWithinPartitions(*order).write.partitionBy("snapshot_date").parquet(f"{path}/{name}")
    file = F.concat(F.lit(f"{name}/"), F.substring_index("_metadata.file_path", f"/{name}/", -1))
    written = spark.read.schema(f"{_schema(df)}, snapshot_date date").parquet(f"{path}/{name}")
    entries = written.groupBy("server_id", "snapshot_ts", "snapshot_date", file.alias("file")).agg(
        F.count(F.lit(1)).alias("rows")
    )
    entries.write.partitionBy("snapshot_date").mode("append").parquet(f"{manifest_path(path)}/entries")
    _open_again(spark, path, name)


def _schema(df: DataFrame) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return f"server_id {kinds['server_id']}, snapshot_ts {kinds['snapshot_ts']}"


def _open_again(spark: SparkSession, path: str, name: str) -> None:
    """Closings that did not know of the dates just written are void."""
    first = min((d.partition("=")[2] for d in names(spark, f"{path}/{name}") if d.startswith("snapshot_date=")), default=None)
    for closing in _closings(spark, path):
        if first is not None and closing > first:
            remove(spark, f"{manifest_path(path)}/closed/before={closing}")


def _closings(spark: SparkSession, path: str) -> list[str]:
    return sorted(n.partition("=")[2] for n in names(spark, f"{manifest_path(path)}/closed") if n.startswith("before="))


def newest_polls(
    spark: SparkSession,
    path: str,
    as_of: datetime | str,
    servers: Sequence[str] | None = None,
    since: date | str | None = None,
) -> DataFrame:
    """``server_id, snapshot_ts, snapshot_date, file`` of each server's last poll not later than ``as_of``.

    Reads the latest closing up to that date, and manifest rows from it on.
    """
    day = str(as_of)[:10]
    closed = max((c for c in _closings(spark, path) if c <= day), default=None)
    known = spark.read.schema(_ENTRIES).parquet(f"{manifest_path(path)}/entries")
    known = known.where((F.col("snapshot_date") <= F.lit(day).cast("date")) & (F.col("snapshot_ts") <= ts(as_of)))
    if closed is not None:
        known = known.where(F.col("snapshot_date") >= F.lit(closed).cast("date"))
        before = spark.read.schema(_ENTRIES).parquet(f"{manifest_path(path)}/closed/before={closed}")
        known = known.unionByName(before)
    if since is not None:
        known = known.where(F.col("snapshot_date") >= F.lit(str(since)).cast("date"))
    if servers is not None:
        known = known.where(F.col("server_id").isin(list(servers)))
    last = known.groupBy("server_id").agg(F.max("snapshot_ts").alias("snapshot_ts"))
    return known.join(last, ["server_id", "snapshot_ts"], "left_semi").select(*FLEET_KEYS, "file", "rows")


def close_polls(spark: SparkSession, path: str, before: date | str) -> None:
    """Write down the newest poll that each server had before a date; later lookups start from there."""
    midnight = datetime.fromisoformat(str(before)[:10])
    last = newest_polls(spark, path, str(midnight - timedelta(microseconds=1)))
    last.write.mode("overwrite").parquet(f"{manifest_path(path)}/closed/before={midnight.date()}")


def read_newest(
    spark: SparkSession,
    kind: str,
    path: str,
    as_of: datetime | str,
    servers: Sequence[str] | None = None,
    since: date | str | None = None,
) -> DataFrame:
    """Rows of the last poll of each server, from the files that hold them and no others.

    The list of those files passes through the driver, as the list of all files of a table does
    whenever Spark reads one.
    """
    path = path.rstrip("/")
    polls = newest_polls(spark, path, as_of, servers, since)
    files = [f"{path}/{r.file}" for r in polls.select("file").distinct().orderBy("file").collect()]
    empty = spark.createDataFrame([], SCHEMAS[kind])
    if not files:
        return empty
    rows = spark.read.schema(SCHEMAS[kind]).option("basePath", path).parquet(*files).drop(_WRITE)
    return rows.join(polls.select(*FLEET_KEYS).distinct(), list(FLEET_KEYS), "left_semi").select(*empty.columns)


def has_manifest(spark: SparkSession, path: str) -> bool:
    return exists(spark, f"{manifest_path(path)}/entries")
