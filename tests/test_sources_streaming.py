from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql.streaming.readwriter import DataStreamWriter

from opslens.operators.jobs import cmdlog_outcome
from opslens.operators.sessions import sessions_all, who, with_child_tasks
from opslens.plans.inputs import AS_OF, Inputs
from opslens.sources import SCHEMAS, for_each_partition_of, log_finish, log_start, read_snapshot, scan_all, sink_append
from opslens.sources.sinks import advance_pairs, pair_log, read_pairs
from opslens.sources.workdir import work_dir
from opslens.streaming import (
    activity_windows,
    blocked_episodes,
    pair_commands,
    read_stream,
    retention_on_trigger,
    run_to_table,
)


def test_schemas_parse(spark):
    for kind, ddl in SCHEMAS.items():
        assert spark.createDataFrame([], ddl).columns[:3] == ["server_id", "snapshot_ts", "snapshot_date"], kind


def test_last_poll_of_each_server(spark, tmp_path):
    polls = [
        ("a", datetime(2024, 1, 1, 23), 1.0), ("a", datetime(2024, 1, 2, 10), 2.0), ("a", datetime(2024, 1, 2, 12), 3.0),
        ("b", datetime(2024, 1, 2, 9), 4.0), ("b", datetime(2024, 1, 2, 9), 5.0),
    ]
    df = spark.createDataFrame(polls, "server_id string, snapshot_ts timestamp_ntz, log_size_mb double")
    path = str(tmp_path / "log_space")
    sink_append(df.withColumn("snapshot_date", F.col("snapshot_ts").cast("date")), path, ("snapshot_date",))
    last = read_snapshot(spark, "log_space", path, "2024-01-02 11:00:00")
    assert sorted(r["log_size_mb"] for r in last.collect()) == [2.0, 4.0, 5.0]
    midnight = read_snapshot(spark, "log_space", path, "2024-01-02 00:00:30")
    assert [r["log_size_mb"] for r in midnight.collect()] == [1.0]
    next_week = read_snapshot(spark, "log_space", path, "2024-01-09 00:00:00")
    assert sorted(r["log_size_mb"] for r in next_week.collect()) == [3.0, 4.0, 5.0]
    assert read_snapshot(spark, "log_space", path, "2024-01-09 00:00:00", since="2024-01-03").isEmpty()
    plan = scan_all(spark, "log_space", path, since="2024-01-02", servers=["a"])
    assert plan.count() == 2
    assert "PartitionFilters: [isnotnull(snapshot_date" in plan._jdf.queryExecution().executedPlan().toString()


def test_append_sink_adds_rows(spark, tmp_path):
    path = str(tmp_path / "result")
    sink_append(spark.range(2), path, create=True)
    sink_append(spark.range(3), path)
    assert spark.read.parquet(path).count() == 5


def test_command_log_round_trip(spark, tmp_path, rows):
    path = str(tmp_path / "log")
    plan = spark.createDataFrame(
        [(1, "d", "KILL", "KILL 1"), (2, "d", "KILL", "KILL 2")],
        "id long, database_name string, command_type string, command_text string",
    )
    log_start(plan, path, "2024-01-01 00:00:00")
    done = spark.createDataFrame([(1, 0, None)], "id long, error_number int, error_message string")
    log_finish(done, path, "2024-01-01 00:00:05")
    paired = cmdlog_outcome(pair_log(spark.read.parquet(path)))
    assert rows(paired, "id", "command_text", "outcome", "duration") == [
        (1, "KILL 1", "Succeeded", "00:00:05"), (2, "KILL 2", "Not Finished", None),
    ]


def test_pairs_advance_by_new_days_and_open_starts(spark, tmp_path, rows):
    log, path = str(tmp_path / "log"), str(tmp_path / "pairs")
    plan = "id long, database_name string, command_type string, command_text string"
    done = "id long, error_number int, error_message string"

    def start(day, *ids):
        log_start(spark.createDataFrame([(i, "d", "KILL", f"KILL {i}") for i in ids], plan), log, f"2024-01-{day} 10:00:00")

    def finish(day, *ids):
        log_finish(spark.createDataFrame([(i, i % 2, None) for i in ids], done), log, f"2024-01-{day} 11:00:00")

    start("01", 1, 2, 3)
    finish("01", 1)
    advance_pairs(spark, log, path, "2024-01-02")
    start("02", 4)
    finish("02", 2, 4)
    finish("03", 9)  # its start was never logged
    advance_pairs(spark, log, path, "2024-01-03")
    before = {str(f) for f in (tmp_path / "pairs" / "finished").rglob("*.parquet")}
    advance_pairs(spark, log, path, "2024-01-03")  # repeated: nothing to do
    assert {str(f) for f in (tmp_path / "pairs" / "finished").rglob("*.parquet")} == before
    found = rows(read_pairs(spark, path), "id", F.dayofmonth("start_time"), F.dayofmonth("end_time"), "error_number")
    assert found == [(1, 1, 1, 1), (2, 1, 2, 0), (3, 1, None, None), (4, 2, 2, 0)]

    # The next run opens the files of the open starts and of the new days, and no others.
    start("03", 5)
    finish("04", 5, 3)
    advance_pairs(spark, log, path, "2024-01-06")
    read = {str(f) for f in (tmp_path / "pairs" / "finished").rglob("*.parquet")}
    assert before < read and all("part=d20240103" in f or "part=d20240104" in f for f in read - before)
    assert rows(read_pairs(spark, path)) == rows(pair_log(spark.read.parquet(log)))


def test_one_query_over_matching_databases(spark, rows):
    df = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "database_id long, v string")
    databases = spark.createDataFrame([(1, True), (2, False)], "database_id long, is_read_only boolean")
    out = for_each_partition_of(df, databases, lambda d: d.select("v"), database_filter=~F.col("is_read_only"))
    assert rows(out) == [("y",)]


def test_work_dir_comes_from_the_session(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    assert configured is None or work_dir(spark) == configured


def test_idle_sessions_stay(spark, rows):
    sessions = spark.createDataFrame([(1, "a"), (2, "b")], "session_id long, login_name string")
    requests = spark.createDataFrame([(1, 10, 7)], "session_id long, request_id long, blocking_session_id long")
    out = sessions_all(sessions, requests)
    assert rows(out, "session_id", "request_id", "blocking_session_id") == [(1, 10, 7), (2, None, 0)]


def test_child_tasks_and_placeholders(spark, sf_dir):
    t = Inputs(spark, sf_dir)
    plain = who(t.request, t.session, user_processes=None)
    assert plain.count() == t.request.count()
    with pytest.raises(ValueError, match="tasks"):
        who(t.request, t.session, child_tasks=True)
    owner = t.request.select("request_id", "session_id")
    expanded = who(
        t.request, t.session, user_processes=None, child_tasks=True,
        tasks=t.task.join(owner, "request_id"),
        waits=t.wait.join(owner, "request_id").drop("request_id"),
    )
    assert {"task_count", "task_wait_type", "task_wait_resource"} <= set(expanded.columns)
    assert expanded.select("request_id").distinct().count() == plain.count()


def test_every_request_keeps_its_tasks_or_one_empty_row(spark, rows):
    requests = spark.createDataFrame(
        [(1, 10, "a"), (1, 11, "b"), (1, 11, "c"), (1, None, "d"), (None, 10, "e"), (2, 10, "f"), (2, 10, "g")],
        "session_id long, request_id long, command string",
    )
    tasks = spark.createDataFrame(
        [(1, 10, 0), (1, 10, 1), (2, 10, 0), (3, 10, 0), (1, None, 5)], "session_id long, request_id long, exec_context_id int"
    )
    waits = spark.createDataFrame(
        [(1, 1, "LCK", "x"), (2, 0, "PAGELATCH_SH", "5:1:1"), (2, 0, "LCK", "y")],
        "session_id long, exec_context_id int, wait_type string, resource_description string",
    )
    got = with_child_tasks(requests, tasks, waits)
    assert rows(got, "command", "task_count", "exec_context_id", "task_wait_resource") == sorted([
        ("a", 2, 0, None), ("a", 2, 1, "x"), ("b", 0, None, None), ("c", 0, None, None), ("d", 0, None, None),
        ("e", 0, None, None), ("f", 1, 0, "5:1:1(Is PFS Page)"), ("f", 1, 0, "y"), ("g", 1, 0, "5:1:1(Is PFS Page)"),
        ("g", 1, 0, "y"),
    ], key=repr)


# ---------------------------------------------------------------- streams of several files


@pytest.fixture(scope="module")
def events(spark, sf_dir, tmp_path_factory):
    """The events in time order over five files, so that each file is one trigger."""
    path = str(tmp_path_factory.mktemp("events") / "table")
    table = Inputs(spark, sf_dir).activity
    cut = table.select(F.percentile_approx("event_id", [0.2, 0.4, 0.6, 0.8])).first()[0]
    low = -1
    for high in [*cut, 10**12]:
        part = table.where((F.col("event_id") > low) & (F.col("event_id") <= high))
        part.coalesce(1).write.mode("append").parquet(path)
        low = high
    return path


def stream(spark, path):
    return read_stream(spark, path, spark.read.parquet(path).schema, max_files=1)


def test_windows_over_many_triggers(spark, events, rows):
    out = run_to_table(activity_windows(stream(spark, events)), "windows")
    polls = spark.read.parquet(events)
    day = F.date_trunc("day", F.col("ts")).cast("timestamp_ntz")
    mark = polls.agg(F.max("ts") - F.make_dt_interval(F.lit(1))).first()[0]
    twin = polls.groupBy(day.alias("window_start"), "database_name").agg(
        F.count(F.lit(1)).alias("requests"), F.count_if("is_waiting").alias("waits"), F.count_if("is_blocked").alias("blocked")
    )
    twin = twin.where(F.col("window_start") + F.make_dt_interval(F.lit(1)) <= F.lit(mark))
    columns = ["window_start", "database_name", "requests", "waits", "blocked"]
    assert rows(out, *columns) == rows(twin, *columns)


def test_episodes_do_not_depend_on_triggers(spark, events, rows):
    whole = read_stream(spark, events, spark.read.parquet(events).schema)
    many = run_to_table(blocked_episodes(stream(spark, events)), "episodes-many")
    once = run_to_table(blocked_episodes(whole), "episodes-once")
    assert rows(many) == rows(once)
    assert not many.isEmpty()


def test_commands_pair_across_triggers(spark, events, rows):
    starts = stream(spark, events).select(F.col("event_id").alias("id"), F.col("ts").alias("start_time"))
    finishes = (
        stream(spark, events)
        .where("event_id % 5 <> 0")
        .select(
            F.col("event_id").alias("id"),
            (F.col("ts") + F.make_dt_interval(mins=F.lit(10))).alias("end_time"),
            F.lit(0).alias("error_number"),
        )
    )
    out = run_to_table(pair_commands(starts, finishes), "pairs")
    assert out.where("is_unfinished").where("id % 5 <> 0").isEmpty()
    assert out.where("NOT is_unfinished").count() == spark.read.parquet(events).where("event_id % 5 <> 0").count()
    assert not out.where("is_unfinished").isEmpty()


def test_pairing_writes_its_state_without_reading_it_first(spark, events, monkeypatch):
    """For a start and its finish the state reports three reads; with one more for each write it was six."""
    started, start = [], DataStreamWriter.start

    def watched(writer, *args, **kwargs):
        started.append(start(writer, *args, **kwargs))
        return started[-1]

    monkeypatch.setattr(DataStreamWriter, "start", watched)
    whole = read_stream(spark, events, spark.read.parquet(events).schema)
    starts = whole.select(F.col("event_id").alias("id"), F.col("ts").alias("start_time"))
    finishes = starts.select("id", F.col("start_time").alias("end_time"), F.lit(0).alias("error_number"))
    assert run_to_table(pair_commands(starts, finishes), "pairs-asked").count() == spark.read.parquet(events).count()
    state = started[0].recentProgress[0].stateOperators[0]
    assert state.numRowsUpdated == 2 * spark.read.parquet(events).count()
    assert 0 < state.customMetrics["rocksdbGetCount"] <= 2 * state.numRowsUpdated


def test_retention_sees_all_earlier_triggers(spark, sf_dir, tmp_path, rows):
    t = Inputs(spark, sf_dir)
    path = str(tmp_path / "snapshots")
    for part in range(3):
        t.snapshot.where(F.col("database_id") % 3 == part).coalesce(1).write.mode("append").parquet(path)
    from opslens.operators.snapshots import snapshot_retention

    at = F.lit(AS_OF).cast("timestamp_ntz")
    polls = stream(spark, path).withColumn("snapshot_ts", F.explode(F.array(at, at)))
    decided = retention_on_trigger(polls, lambda: t.snapfile, max_snapshots=2)
    expected = snapshot_retention(t.snapshot, t.snapfile, AS_OF, max_snapshots=2)
    columns = ["database_id", "snapshot_order", "reasons"]
    assert rows(decided, *columns) == rows(expected, *columns)


def test_retention_sees_only_the_newest_poll_of_each_server(spark, tmp_path, rows):
    """Two servers, three polls: snapshots gone since, repeated ones, and a server polled less often."""
    schema = "server_id string, source_database_id long, database_id long, create_date timestamp_ntz, snapshot_ts timestamp_ntz"
    old, new = datetime(2024, 1, 1, 10), datetime(2024, 1, 1, 11)
    made = [datetime(2024, 1, 1, h) for h in range(10)]
    polls = [
        [("a", 1, 10, made[0], old), ("a", 1, 11, made[1], old), ("b", 1, 10, made[2], old)],
        [("a", 1, 11, made[1], new), ("a", 1, 12, made[3], new)],
    ]
    path = str(tmp_path / "polls")
    for poll in polls:
        spark.createDataFrame(poll, schema).coalesce(1).write.mode("append").parquet(path)
    files = spark.createDataFrame(
        [], "server_id string, database_id long, file_id int, size_pages long, size_on_disk_bytes long"
    )
    stream = read_stream(spark, path, spark.read.parquet(path).schema, max_files=1)
    decided = retention_on_trigger(stream, lambda: files, scope=["server_id"], max_snapshots=1, max_age_hours=100)
    found = rows(decided, "server_id", "database_id", "snapshot_order", "action")
    assert found == [("a", 11, 2, "DROP"), ("a", 12, 1, "KEEP"), ("b", 10, 1, "KEEP")]


def test_retention_of_an_empty_source(spark, tmp_path):
    path = str(tmp_path / "none")
    schema = "source_database_id long, database_id long, create_date timestamp_ntz, snapshot_ts timestamp_ntz"
    spark.createDataFrame([], schema).write.parquet(path)
    files = spark.createDataFrame([], "database_id long, file_id int, size_pages long, size_on_disk_bytes long")
    stream = read_stream(spark, path, spark.read.parquet(path).schema)
    assert retention_on_trigger(stream, lambda: files).count() == 0
