"""The newest polls come from their own files, and from few manifest rows."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from opslens.sources import close_polls, newest_polls, read_snapshot, scan_all, write_polls
from opslens.sources.folders import names
from opslens.sources.manifest import manifest_path

START = datetime(2024, 1, 1)
SCHEMA = "server_id string, snapshot_ts timestamp_ntz, snapshot_date date, log_size_mb double"


def polls(spark, days, servers="abc", hours=(6, 18)):
    rows = [
        (s, START + timedelta(days=d, hours=h), None, float(100 * d + h))
        for d in days
        for h in hours
        for s in servers
        for _ in range(2)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def read_files(df):
    """Files that the scan of a poll table was given."""
    return {f for f in df.inputFiles() if ".polls/" not in f}


@pytest.fixture
def month(spark, tmp_path):
    path = str(tmp_path / "log_space")
    for first in (0, 10, 20):
        write_polls(polls(spark, range(first, first + 10)), path)
    return path


def test_only_the_newest_polls_are_scanned(spark, month):
    newest = read_snapshot(spark, "log_space", month, "2024-01-30 12:00:00")
    assert sorted((r.server_id, r.log_size_mb) for r in newest.collect()) == [(s, 2906.0) for s in "abc" for _ in "12"]
    everything = scan_all(spark, "log_space", month)
    assert sorted(everything.columns) == sorted(newest.columns) and everything.count() == 30 * 2 * 3 * 2
    files = read_files(newest)
    assert all("snapshot_date=2024-01-30" in f for f in files)
    assert len(files) <= 3 < len(read_files(everything))


def test_servers_that_stopped_come_from_older_days(spark, month):
    write_polls(polls(spark, [30], servers="ad"), month)
    newest = read_snapshot(spark, "log_space", month, "2024-02-10 00:00:00")
    got = sorted({(r.server_id, r.log_size_mb) for r in newest.collect()})
    assert got == [("a", 3018.0), ("b", 2918.0), ("c", 2918.0), ("d", 3018.0)]
    only = read_snapshot(spark, "log_space", month, "2024-02-10 00:00:00", servers=["b"], since="2024-01-30")
    assert {r.server_id for r in only.collect()} == {"b"}
    assert read_snapshot(spark, "log_space", month, "2024-02-10 00:00:00", since="2024-02-01").isEmpty()
    assert read_snapshot(spark, "log_space", month, "2023-12-31 00:00:00").isEmpty()


def test_closing_a_day_shortens_the_lookup(spark, month):
    before = newest_polls(spark, month, "2024-01-25 00:00:00").orderBy("server_id", "file").collect()
    close_polls(spark, month, "2024-01-20")
    after = newest_polls(spark, month, "2024-01-25 00:00:00")
    assert after.orderBy("server_id", "file").collect() == before
    plan = after._jdf.queryExecution().optimizedPlan().toString()
    assert ">= 2024-01-20)" in plan
    # Nothing newer than the closing: the answer is the closing itself.
    write = read_snapshot(spark, "log_space", month, "2024-01-20 05:00:00")
    assert {r.log_size_mb for r in write.collect()} == {1818.0}


def test_a_poll_at_midnight_is_not_before_the_day(spark, tmp_path):
    path = str(tmp_path / "p")
    write_polls(polls(spark, range(3), hours=(0, 12)), path)
    close_polls(spark, path, "2024-01-02")
    closed = spark.read.parquet(f"{manifest_path(path)}/closed/before=2024-01-02")
    assert {str(r.snapshot_ts) for r in closed.collect()} == {"2024-01-01 12:00:00"}
    assert {r.log_size_mb for r in read_snapshot(spark, "log_space", path, "2024-01-02 00:00:00").collect()} == {100.0}


def test_late_polls_open_a_closed_day(spark, month):
    close_polls(spark, month, "2024-01-05")
    close_polls(spark, month, "2024-01-20")
    write_polls(polls(spark, [9], servers="late"), month)
    assert names(spark, f"{manifest_path(month)}/closed") == ["before=2024-01-05"]
    newest = read_snapshot(spark, "log_space", month, "2024-01-21 00:00:00")
    assert {"l", "t", "e"} <= {r.server_id for r in newest.collect()}


def test_a_poll_in_two_writes_is_whole(spark, tmp_path):
    path = str(tmp_path / "p")
    for _ in range(2):
        write_polls(polls(spark, [0], hours=(6,), servers="a"), path)
    assert read_snapshot(spark, "log_space", path, "2024-01-02 00:00:00").count() == 4


def test_files_without_a_manifest_row_do_not_count(spark, month):
    stray = polls(spark, [40]).withColumn("snapshot_date", F.col("snapshot_ts").cast("date"))
    stray.write.partitionBy("snapshot_date").parquet(f"{month}/write=failed")
    newest = read_snapshot(spark, "log_space", month, "2024-03-01 00:00:00")
    assert {r.log_size_mb for r in newest.collect()} == {2918.0}


def test_rows_are_computed_once_for_a_write(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    days = polls(spark, range(3))
    write_polls(days.mapInArrow(count, days.schema), str(tmp_path / "p"))
    assert seen.value == days.count()
