"""Every operator accepts the snapshot tables as the reader delivers them."""

import pytest
from pyspark.sql import functions as F

from opslens.operators import backup, blocking, jobs, maintenance, principals, rowgroups, selection, sessions, snapshots, space, state
from opslens.sources import FLEET_KEYS, SCHEMAS, read_snapshot, sink_append

SCOPE = list(FLEET_KEYS)
DATABASE = [*SCOPE, "database_id"]


@pytest.fixture(scope="module")
def t(spark):
    return {kind: spark.createDataFrame([], ddl) for kind, ddl in SCHEMAS.items()}


def test_sessions(t):
    wide = {"connections": t["connection"], "batches": t["batch_text"], "grants": t["grant"], "groups": t["group"]}
    plain = sessions.who(t["request"], t["session"], jobs=t["job"], tasks=t["task"], **wide, scope=SCOPE)
    full = sessions.who(
        t["request"], t["session"], tasks=t["task"], waits=t["wait"], child_tasks=True, **wide, scope=SCOPE
    )
    assert set(sessions.TASK_COLUMNS) <= set(plain.columns) and set(sessions.TASK_COLUMNS) <= set(full.columns)
    assert dict(plain.dtypes)["exec_context_id"] == "int"
    assert sessions.sessions_all(t["session"], t["request"], t["connection"], scope=SCOPE).columns
    assert sessions.backup_progress(t["request"], t["batch_text"], "2024-01-01 00:00:00", SCOPE).columns
    waiting = sessions.with_wait_resource(t["request"])
    assert "hobt_id" in waiting.columns


def test_space_and_snapshots(t):
    listed = space.file_space(t["file"], volumes=t["file_volume"], scope=SCOPE)
    assert {"total_mb", "disk_free_mb", *SCOPE} <= set(listed.columns)
    whole = t["file_volume"].join(t["file"].select(*DATABASE, "file_id", "size_pages", "used_pages", "group_name"), [*DATABASE, "file_id"])
    assert space.space_report(whole, 3, scope=SCOPE).columns
    assert snapshots.snapshot_plan(t["database"], t["file"], t["database"], "2024-01-01 00:00:00", scope=SCOPE).columns
    assert snapshots.snapshot_sizes(t["file_stats"], SCOPE).columns
    found = snapshots.snapshot_retention(
        t["database"].where(F.col("source_database_id").isNotNull()), t["file_stats"], "2024-01-01 00:00:00", scope=SCOPE
    )
    assert found.count() == 0
    assert rowgroups.rowgroup_rebuild(t["rowgroup"], scope=DATABASE).columns
    keys = [*DATABASE, "object_id", "index_id"]
    assert state.index_inventory(t["index_stats"], keys).columns


def test_backup(t):
    typed = backup.decide_backup_type(t["database"], "LOG", t["backup"], modification_level=50, scope=SCOPE)
    roles = ["availability_group", "availability_group_role", "is_preferred_replica", "log_shipping_role", "mirroring_role"]
    typed = typed.withColumns({c: F.lit(None).cast("boolean" if c.startswith("is_") else "string") for c in roles})
    assert backup.backup_eligible(typed, "2024-01-01 00:00:00", updateability="ALL").columns
    assert backup.latest_backup(t["backup"], t["database"], scope=SCOPE).columns
    assert backup.verify_status(t["backup"], DATABASE).columns


def test_principals_jobs_and_checks(t):
    users = t["principal"]
    assert principals.orphan_users(users, users, SCOPE).columns
    assert principals.wrong_default_schema(users).columns
    assert principals.users_without_connect(users, t["permission"], scope=DATABASE).columns
    assert principals.db_owner_drift(t["database"], users, "s", scope=SCOPE).columns
    assert principals.job_owner_drift(t["job"], users, scope=SCOPE).columns
    gap = principals.role_gap(users, t["role_member"], users, t["role_member"], "r", scope=SCOPE, database=["database_id"])
    assert gap.columns
    assert jobs.cmdlog_outcome(t["command_log"]).columns
    assert jobs.expand_schedule(t["schedule"], "2024-01-01", "2024-01-02").columns
    assert jobs.queue_state(t["queue"], t["request"], scope=SCOPE).columns
    assert maintenance.check_plan(t["database"], "CHECKDB", scope=SCOPE).columns
    assert selection.duplicate_names(t["database"], "name", scope=SCOPE).columns


def test_blocking(t):
    assert blocking.blocking_chains(t["request"], scope=SCOPE).columns


def test_readme_example(spark, tmp_path):
    at = "timestamp_ntz'2024-01-02 10:00:00' AS snapshot_ts, date'2024-01-02' AS snapshot_date"
    for kind, row in {
        "request": "5L AS session_id, 1L AS request_id, 'SELECT' AS command, 'running' AS status, 1000L AS total_elapsed_ms",
        "session": "5L AS session_id, 'l' AS login_name, 'o' AS original_login_name, true AS is_user_process",
    }.items():
        some = spark.sql(f"SELECT 'a' AS server_id, {at}, {row}")
        blank = spark.createDataFrame([], SCHEMAS[kind])
        full = blank.unionByName(some, allowMissingColumns=True).select(blank.columns)
        sink_append(full, str(tmp_path / kind), ("snapshot_date",))
    read = {k: read_snapshot(spark, k, str(tmp_path / k), as_of="2024-01-03 11:00:00") for k in ("request", "session")}
    (found,) = sessions.who(read["request"], read["session"], scope=SCOPE).collect()
    assert (found.session_id, found.login_name, found.task_state) == (5, "o", None)
