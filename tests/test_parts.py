"""State tables in parts: what did not change keeps its files."""

from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from opslens.operators import state
from opslens.operators.snapshots import snapshot_retention
from opslens.sources import parts
from opslens.streaming import activity_windows, read_stream, retention_on_trigger, run_to_table

KEYS, MEASURES = ["database_id", "object_id"], ["pages", "kind"]
SCHEMA = "database_id int, object_id int, pages long, kind string"


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def files(path):
    return {str(f): f.stat().st_mtime_ns for f in Path(path).rglob("part=*/*.parquet")}


@pytest.fixture
def base():
    return [(d, o, 10 * o, "NONE" if o % 2 else None) for d in (1, 2, 3) for o in range(400)]


def test_upsert_rewrites_changed_buckets_only(spark, tmp_path, rows, base):
    path = str(tmp_path / "state")
    first = state.upsert(table(spark, base), path, KEYS, MEASURES, ["database_id"])
    assert len(first) <= 3 * 16 and rows(_read(spark, path)) == sorted(base, key=repr)
    before = files(path)

    poll = [(d, o, p + (o in (7, 8, 9, 11)), k) for d, o, p, k in base if d == 2]
    touched = state.upsert(table(spark, poll), path, KEYS, MEASURES, ["database_id"])
    assert 1 <= len(touched) <= 4 and set(touched) <= set(first)
    after = files(path)
    assert {f: after.get(f) for f in before} == before  # no file is changed, and the new version has few
    assert len(after) - len(before) == len(touched)
    assert rows(_read(spark, path)) == sorted([r for r in base if r[0] != 2] + poll, key=repr)

    assert state.upsert(table(spark, poll), path, KEYS, MEASURES, ["database_id"]) == []
    assert files(path) == after


def _read(spark, path):
    return state.read_state(spark, path, table(spark, []).schema)


@pytest.mark.parametrize("scope", [(), ("database_id",)])
def test_upsert_equals_a_full_merge(spark, tmp_path, rows, base, scope):
    path = str(tmp_path / "state")
    polls = [base, [r for r in base if r[1] % 7], [(1, 5, 50, "PAGE"), (4, 1, None, "NONE")], []]
    expected = table(spark, [])
    for poll in polls:
        now = table(spark, poll)
        state.upsert(now, path, KEYS, MEASURES, scope, groups=4, buckets=3)
        mark = now.select(*scope).distinct() if scope else None
        expected = state.apply_changes(state.merge_state(expected, now, KEYS, MEASURES, mark), KEYS, MEASURES)
        expected = table(spark, [tuple(r) for r in expected.collect()])
        assert rows(_read(spark, path)) == rows(expected)


def test_an_unfinished_version_does_not_count(spark, tmp_path, rows, base):
    path = str(tmp_path / "state")
    state.upsert(table(spark, base), path, KEYS, MEASURES)
    bucket = parts.bucket_of((), KEYS, 64, 16)
    parts.write_parts(table(spark, [(9, 9, 9, "lost")]).withColumn(parts.PART, bucket), path, "rows", 2)
    assert parts.versions(spark, path) == [1] and rows(_read(spark, path)) == sorted(base, key=repr)
    state.upsert(table(spark, base + [(9, 10, 1, "new")]), path, KEYS, MEASURES)
    assert _read(spark, path).where("database_id = 9").count() == 1


def test_retention_leaves_other_servers_alone(spark, tmp_path, rows):
    """Four triggers over three servers; the last ones concern one server each."""
    schema = "server_id string, source_database_id long, database_id long, create_date timestamp_ntz, snapshot_ts timestamp_ntz"
    at = [datetime(2024, 1, 1, 10) + timedelta(hours=h) for h in range(4)]
    polls = [[(s, 1, i, at[0] - timedelta(hours=i), at[0]) for s in "abc" for i in range(5)]]
    polls += [[("a", 1, i, at[0] - timedelta(hours=i), at[1]) for i in range(3)]]
    polls += [[("b", 2, i, at[0] - timedelta(hours=i), at[2]) for i in range(2, 5)]]
    polls += [[("a", 1, 9, at[0], at[0])]]  # an older poll comes late and changes nothing
    source, path = str(tmp_path / "polls"), str(tmp_path / "retention")
    nothing = spark.createDataFrame([], "server_id string, database_id long, file_id int, size_pages long, size_on_disk_bytes long")
    limits = {"max_snapshots": 2, "max_age_hours": 100}
    seen = []
    for poll in polls:
        spark.createDataFrame(poll, schema).coalesce(1).write.mode("append").parquet(source)
        stream = read_stream(spark, source, spark.read.parquet(source).schema, max_files=1)
        decided = retention_on_trigger(stream, lambda: nothing, path=path, scope=["server_id"], **limits)
        seen.append((files(f"{path}/state"), files(f"{path}/decided")))
    for (old_state, old_decided), (new_state, new_decided) in zip(seen, seen[1:], strict=False):
        assert {f: new_state[f] for f in old_state} == old_state
        assert {f: new_decided[f] for f in old_decided} == old_decided
        assert len(new_state) == len(old_state) + 1 and len(new_decided) == len(old_decided) + 1
    newest = [*polls[1], *polls[2], *[r for r in polls[0] if r[0] == "c"]]
    expected = snapshot_retention(
        spark.createDataFrame(newest, schema), nothing, F.col("snapshot_ts"), scope=["server_id"], **limits
    )
    columns = ["server_id", "database_id", "snapshot_order", "action", "reasons"]
    assert rows(decided, *columns) == rows(expected, *columns)


def test_sliding_windows_come_from_panes(spark, tmp_path):
    """An event is counted once; windows add up finished panes."""
    start = datetime(2024, 1, 1)
    table = spark.createDataFrame(
        [("d", start + timedelta(minutes=10 * i), i % 3 == 0, i % 5 == 0) for i in range(600)],
        "database_name string, ts timestamp_ntz, is_waiting boolean, is_blocked boolean",
    )
    path = str(tmp_path / "events")
    for part in range(3):
        table.where(F.floor(F.dayofmonth("ts") / 2) == part).coalesce(1).write.mode("append").parquet(path)
    stream = read_stream(spark, path, table.schema, max_files=1)
    windows = activity_windows(stream, "6 hours", "2 hours", "1 hour")
    plan = windows._jdf.queryExecution().analyzed().toString()  # the sources come last
    assert plan.count("Aggregate") == 2 and "Expand" not in plan[plan.rindex("Aggregate") :]
    got = {(r.window_start, r.requests, r.waits, r.blocked) for r in run_to_table(windows, "panes").collect()}
    rows = [tuple(r) for r in table.collect()]
    mark = max(r[1] for r in rows) - timedelta(hours=1)
    want = set()
    for k in range(-2, 60):
        begin = start + timedelta(hours=2 * k)
        inside = [r for r in rows if begin <= r[1] < begin + timedelta(hours=6)]
        if inside and begin + timedelta(hours=6) <= mark:
            want.add((begin, len(inside), sum(r[2] for r in inside), sum(r[3] for r in inside)))
    assert got == want
    with pytest.raises(ValueError, match="slides"):
        activity_windows(stream, "1 day", "7 hours")
