"""Two servers with two databases each and colliding ids: nothing of one reaches the other."""

from datetime import datetime

from pyspark.sql import functions as F

from opslens.operators import backup, jobs, maintenance, principals, selection, space
from opslens.operators.sessions import resolve_wait_resource, who, with_wait_resource
from opslens.operators.snapshots import snapshot_plan

SERVER = ["server_id"]
BOTH = ["server_id", "database_id"]


def on_servers(df):
    return df.crossJoin(df.sparkSession.createDataFrame([("a",), ("b",)], "server_id string"))


def test_resource_groups(spark):
    requests = on_servers(spark.createDataFrame([(5, 1, 10, 3)], "session_id int, request_id int, total_elapsed_ms long, cpu_ms long"))
    requests = requests.withColumns({
        "blocking_session_id": F.lit(0), "command": F.lit("X"), "status": F.lit("run"), "database_name": F.lit("d"),
        "isolation_level": F.lit(2), "percent_complete": F.lit(0.0), "statement_start_offset": F.lit(0), "statement_end_offset": F.lit(-1),
    })
    sessions = on_servers(spark.createDataFrame(
        [(5, "l", True, "h", "p", 2, 0, 1)],
        "session_id int, login_name string, is_user_process boolean, host_name string, program_name string, "
        "isolation_level int, open_transaction_count int, group_id int",
    ))
    groups = spark.createDataFrame([("a", 1, "ga"), ("b", 1, "gb"), ("c", 1, "gc")], "server_id string, group_id int, name string")
    found = who(requests, sessions, groups=groups, scope=SERVER).select("server_id", "resource_pool").collect()
    assert sorted(map(tuple, found)) == [("a", "ga"), ("b", "gb")]


def test_wait_resources(spark):
    waits = on_servers(spark.createDataFrame(
        [(1, "KEY: 5:7 (x)"), (2, "KEY: 6:7 (x)"), (3, "OBJECT: 6:40:0 "), (4, "PAGE: 5:1:9"), (5, ""), (6, "KEY: 5:-3 (x)")],
        "request_id long, wait_resource string",
    ))
    where = "server_id string, database_id long"
    partitions = spark.createDataFrame(
        [(s, d, 7, 40 if s == "a" else 41, d, d * 100) for s in "ab" for d in (5, 6)] + [("a", 5, -3, 40, 5, 1)],
        f"{where}, hobt_id long, object_id long, index_id long, partition_id long",
    )
    pages = partitions.where("hobt_id = 7").selectExpr(*BOTH, "1 AS file_id", "9 AS page_id", "object_id", "index_id", "partition_id")
    objects = spark.createDataFrame(
        [(s, d, o, f"{s}{d}-{o}") for s in "ab" for d in (5, 6) for o in (40, 41)], f"{where}, object_id long, object_name string"
    )
    indexes = partitions.select(*BOTH, "object_id", "index_id").distinct().withColumn("index_name", F.concat_ws("/", *BOTH))
    out = resolve_wait_resource(
        with_wait_resource(waits), partitions, pages, objects, indexes, ["request_id"], scope=SERVER
    )
    found = {(r.server_id, r.request_id): (r.object_name, r.index_name, r.partition_id) for r in out.collect()}
    assert len(found) == out.count() == 12
    assert found["a", 1] == ("a5-40", "a/5", 500) and found["b", 1] == ("b5-41", "b/5", 500)
    assert found["a", 2] == ("a6-40", "a/6", 600) and found["b", 3] == ("b6-40", None, None)
    assert found["b", 4] == ("b5-41", "b/5", 500) and found["a", 5] == (None, None, None)
    assert found["a", 6] == ("a5-40", "a/5", 1) and found["b", 6] == (None, None, None)


def test_connect_permission(spark, rows):
    users = spark.createDataFrame(
        [(s, d, 5, "u", "S", f"D{d}") for s in "ab" for d in (1, 2)],
        "server_id string, database_id long, principal_id long, name string, type string, database_name string",
    )
    permissions = spark.createDataFrame(
        [("a", 1, 5, "CO", "G"), ("a", 2, 5, "CO", "D"), ("b", 2, 5, "CO", "G")],
        "server_id string, database_id long, grantee_principal_id long, type string, state string",
    )
    found = principals.users_without_connect(users, permissions, scope=BOTH)
    assert rows(found, *BOTH) == [("a", 2), ("b", 1)]


def test_owners(spark, rows):
    databases = on_servers(spark.createDataFrame([(7, "d", "s1"), (8, "e", "s1")], "database_id long, name string, owner_sid string"))
    logins = spark.createDataFrame([("a", "s1", "la"), ("b", "s1", "lb")], "server_id string, sid string, name string")
    found = principals.db_owner_drift(databases, logins, "s0", scope=SERVER)
    assert rows(found, "server_id", "database_id", "owner_name") == [
        ("a", 7, "la"), ("a", 8, "la"), ("b", 7, "lb"), ("b", 8, "lb"),
    ]
    steps = on_servers(spark.createDataFrame([("j", "id", "s1")], "name string, job_id string, owner_sid string"))
    drift = principals.job_owner_drift(steps, logins, scope=SERVER)
    assert rows(drift, "server_id", "owner_name") == [("a", "la"), ("b", "lb")]


def test_role_gap(spark, rows):
    logins = on_servers(spark.createDataFrame([(1, "s1", "l", "S")], "principal_id long, sid string, name string, type string"))
    members = spark.createDataFrame([("a", 1)], "server_id string, member_principal_id long")
    users = spark.createDataFrame(
        [(s, d, 5, "s1", "u", "S") for s in "ab" for d in (1, 2)],
        "server_id string, database_id long, principal_id long, sid string, name string, type string",
    )
    holders = spark.createDataFrame([("a", 1, 5), ("b", 2, 5)], "server_id string, database_id long, member_principal_id long")
    gap = principals.role_gap(logins, members, users, holders, "r", scope=SERVER, database=["database_id"])
    assert rows(gap, *BOTH, "user_name") == [("a", 2, "u")]


def test_snapshot_plan(spark, rows):
    databases = on_servers(spark.createDataFrame([(7, "d", None)], "database_id long, name string, source_database_id long"))
    files = spark.createDataFrame(
        [(s, 7, 1, f"f{s}", "ROWS", f"C:\\{s}.mdf") for s in "ab"],
        "server_id string, database_id long, file_id int, file_name string, type_desc string, physical_name string",
    )
    taken = spark.createDataFrame([("b", "d_Snapshot_20240101")], "server_id string, name string")
    plan = snapshot_plan(databases, files, taken, "2024-01-01 00:00:00", scope=SERVER)
    found = {r.server_id: (r.action, r.file_list) for r in plan.collect()}
    assert found["a"][0] == "CREATE" and "fa" in found["a"][1] and "fb" not in found["a"][1]
    assert found["b"][0] == "SKIP"


def test_backups(spark, rows):
    databases = on_servers(spark.createDataFrame(
        [(7, "d", 70, "FULL", 5, 10, 100)],
        "database_id long, name string, differential_base_lsn long, recovery_model_desc string, last_log_backup_lsn long, "
        "modified_extent_pages long, allocated_extent_pages long",
    ))
    early, late = datetime(2024, 1, 1), datetime(2024, 1, 9)
    history = spark.createDataFrame(
        [("a", 7, "D", early, False, 1, 70, True), ("b", 7, "D", late, False, 1, 70, False)],
        "server_id string, database_id long, type string, backup_start_date timestamp_ntz, is_damaged boolean, "
        "database_backup_lsn long, checkpoint_lsn long, is_snapshot boolean",
    )
    latest = backup.latest_backup(history, databases, scope=SERVER)
    assert rows(latest, "server_id", "latest_backup") == [("a", early), ("b", late)]
    typed = backup.decide_backup_type(databases, "DIFF", history, scope=SERVER)
    assert rows(typed, "server_id", "backup_type") == [("a", "FULL"), ("b", "DIFF")]
    cutoffs = spark.createDataFrame([("b", 7, "FULL", datetime(2024, 2, 1))], "server_id string, database_id long, backup_type string, cleanup_before timestamp_ntz")
    assert rows(backup.expired_files(history, cutoffs, scope=SERVER), "server_id") == [("b",)]
    roles = spark.createDataFrame([("a", 7, "g", "PRIMARY", True)], "server_id string, database_id long, availability_group string, availability_group_role string, is_preferred_replica boolean")
    assert rows(backup.with_roles(databases, roles, scope=SERVER), "server_id", "availability_group") == [("a", "g"), ("b", None)]


def test_selection_and_checks(spark, rows):
    databases = on_servers(spark.createDataFrame([(7, "d")], "database_id long, name string"))
    one = spark.createDataFrame([("a",)], "server_id string")
    states = one.selectExpr("server_id", "7L AS database_id", "1 AS replica_id")
    replicas = one.selectExpr("server_id", "1 AS replica_id", "2 AS group_id", "0 AS secondary_role_allow_connections")
    groups = one.selectExpr("server_id", "2 AS group_id", "'other' AS primary_replica")
    left = selection.exclude_unreadable(databases, states, replicas, groups, F.col("server_id"), scope=SERVER)
    assert rows(left, "server_id") == [("b",)]
    assert selection.duplicate_names(databases, "name", scope=SERVER).isEmpty()
    assert selection.duplicate_names(databases, "name", scope=()).count() == 2
    filegroups = spark.createDataFrame([("a", 7, "ga"), ("b", 7, "gb")], "server_id string, database_id long, filegroup_name string")
    plan = maintenance.check_plan(databases, "CHECKFILEGROUP", filegroups=filegroups, scope=SERVER)
    assert rows(plan, "server_id", "target") == [("a", "ga"), ("b", "gb")]


def test_queue_and_space(spark, rows):
    at = datetime(2024, 1, 1)
    queue = on_servers(spark.createDataFrame([("q", at, None, 5, 1, at)], "database_name string, database_start_time timestamp_ntz, database_end_time timestamp_ntz, session_id int, request_id int, request_start_time timestamp_ntz"))
    requests = spark.createDataFrame([("a", 5, 1, at)], "server_id string, session_id int, request_id int, start_time timestamp_ntz")
    assert rows(jobs.queue_state(queue, requests, scope=SERVER), "server_id", "queue_state") == [("a", "RUNNING"), ("b", "DEAD")]
    volumes = on_servers(spark.createDataFrame(
        [(7, 1, "d", "f1", "ROWS", "c", "Vol", 1000 << 20, 500 << 20, "C:\\f1")],
        "database_id long, file_id long, database_name string, file_name string, type_desc string, "
        "volume_mount_point string, logical_volume_name string, total_bytes long, available_bytes long, physical_name string",
    ))
    sizes = spark.createDataFrame(
        [("a", 7, 1, "g", 1280, 640)], "server_id string, database_id long, file_id long, group_name string, size_pages long, used_pages long"
    )
    listed = space.file_space(sizes, volumes=volumes, scope=SERVER)
    assert [(r.server_id, float(r.total_mb)) for r in listed.orderBy("server_id").collect()] == [("a", 10.0), ("b", 0.0)]
    report = space.space_report(volumes.join(sizes, ["server_id", "database_id", "file_id"]).unionByName(
        volumes.where("server_id = 'b'").selectExpr("*", "'g' AS group_name", "256L AS size_pages", "128L AS used_pages")
    ), scope=SERVER)
    per_database = report.where("detail_type = 2").select("server_id", F.col("total_mb").cast("double"))
    assert rows(per_database) == [("a", 10.0), ("b", 2.0)]


def test_schedules_of_other_kinds_are_reported(spark, rows):
    schedules = spark.createDataFrame(
        [("daily", 4, 1, 1, 0, 0), ("monthly", 16, 1, 1, 0, 0), ("none", None, 1, 1, 0, 0)],
        "job_name string, freq_type int, freq_interval int, freq_subday_type int, freq_subday_interval int, active_start_time int",
    )
    found = rows(jobs.expand_schedule(schedules, "2024-01-01", "2024-01-02"), "job_name", "run_time", "problem")
    assert found == [
        ("daily", datetime(2024, 1, 1), None), ("daily", datetime(2024, 1, 2), None),
        ("monthly", None, "unsupported frequency 16"), ("none", None, "unsupported frequency NULL"),
    ]
