from datetime import datetime

import pytest
from pyspark.sql import functions as F

from opslens.operators import jobs, principals, rowgroups, space, state
from opslens.operators.snapshots import snapshot_plan, snapshot_retention
from opslens.plans.inputs import Inputs

KEYS, MEASURES = ["d", "k"], ["v"]


def table(spark, data):
    return spark.createDataFrame(data, "d int, k int, v int")


def test_applying_the_changes_gives_the_new_state(spark, rows):
    old = table(spark, [(1, 1, 10), (1, 2, 20), (1, 3, None), (2, 1, 1)])
    new = table(spark, [(1, 1, 10), (1, 2, 21), (1, 4, 40), (1, 3, None)])
    changes = state.merge_state(old, new, KEYS, MEASURES)
    assert {(r["d"], r["k"]): r["action"] for r in changes.collect()} == {
        (1, 1): "KEEP", (1, 2): "UPDATE", (1, 3): "KEEP", (1, 4): "INSERT", (2, 1): "DELETE",
    }
    assert rows(state.apply_changes(changes, KEYS, MEASURES)) == rows(new)


def test_databases_that_were_not_polled_keep_their_rows(spark, rows):
    old = table(spark, [(1, 1, 10), (2, 1, 1)])
    new = table(spark, [(1, 5, 50)])
    polled = spark.createDataFrame([(1,)], "d int")
    changes = state.merge_state(old, new, KEYS, MEASURES, polled)
    assert rows(state.apply_changes(changes, KEYS, MEASURES)) == [(1, 5, 50), (2, 1, 1)]


def test_budget_lets_the_last_item_finish(spark, rows):
    work = spark.createDataFrame([("a", i, 4) for i in range(5)], "k string, o int, c long")
    kept = state.within_budget(work, "c", 10, ["o"], ["k"])
    assert rows(kept, "o", "spent") == [(0, 4), (1, 8), (2, 12)]


def test_unknown_costs_spend_nothing(spark, rows):
    work = spark.createDataFrame([(1, None), (2, None), (3, 5), (4, 7), (5, 1)], "o int, c long").repartition(4)
    kept = state.within_budget(work, "c", 10, ["o"])
    assert rows(kept, "o", "spent") == [(1, None), (2, None), (3, 5), (4, 12)]


def test_done_rows_and_excluded_databases(spark, rows):
    df = spark.createDataFrame(
        [("D", "NONE", ""), ("D", "PAGE", ""), ("ReportServerTemp", "NONE", "")],
        "database_name string, data_compression string, status string",
    )
    assert rows(state.mark_done(df)) == [("D", "NONE", ""), ("D", "PAGE", "0")]


def test_snapshot_without_files_is_judged_by_rank_and_age(spark):
    snaps = spark.createDataFrame(
        [(1, 10, datetime(2024, 1, 1, 0, 59, 59))],
        "source_database_id long, database_id long, create_date timestamp_ntz",
    )
    files = spark.createDataFrame([], "database_id long, file_id int, size_pages long, size_on_disk_bytes long")
    row = snapshot_retention(snaps, files, "2024-01-01 14:00:00").first()
    assert (row["age_in_hours"], row["reasons"], row["action"]) == (13, ["age_in_hours"], "DROP")
    assert row["space_used_percent"] is None


def test_snapshot_plan_actions(spark):
    databases = spark.createDataFrame(
        [(5, "A", None), (6, "B", None), (7, "A_snap", 5), (1, "master", None)],
        "database_id long, name string, source_database_id long",
    )
    files = spark.createDataFrame(
        [(5, 2, "f2", "ROWS", "C:\\x\\f2.ndf"), (5, 1, "f1", "ROWS", "C:\\x\\f1.mdf"), (5, 3, "l", "LOG", "C:\\l.ldf")],
        "database_id long, file_id int, file_name string, type_desc string, physical_name string",
    )
    existing = spark.createDataFrame([("B_Snapshot_2024010213",)], "name string")
    at = "2024-01-02 13:45:00"
    plan = {r["name"]: r for r in snapshot_plan(databases, files, existing, at, use_hours=True, scope=()).collect()}
    assert {n: r["action"] for n, r in plan.items()} == {"A": "CREATE", "B": "SKIP"}
    assert plan["A"]["file_list"] == (
        "(NAME = N'f1', FILENAME = N'C:\\x\\A_Snapshot_2024010213_f1.ss'),"
        "(NAME = N'f2', FILENAME = N'C:\\x\\A_Snapshot_2024010213_f2.ss')"
    )
    again = snapshot_plan(databases, files, existing, at, use_hours=True, overwrite_existing=True, scope=())
    text = again.where("name = 'B'").first()["command_text"]
    assert text.startswith("DROP DATABASE [B_Snapshot_2024010213]; CREATE DATABASE")


def test_rowgroup_table_filter_and_newest_partition(spark, sf_dir):
    groups = Inputs(spark, sf_dir).rowgroup
    plan = rowgroups.rowgroup_rebuild(groups, " T3 ")
    assert {r["object_name"] for r in plan.collect()} == {"T3"}
    newest = groups.where("object_name = 'T3'").agg(F.max("partition_number")).first()[0]
    assert plan.agg(F.max("partition_number")).first()[0] < newest
    assert rowgroups.rowgroup_rebuild(groups, "", steps=4).count() == 4


def test_unknown_report_type_is_the_flat_list(spark, sf_dir):
    files = Inputs(spark, sf_dir).file
    assert space.space_report(files, 9, scope=()).count() == files.count()
    assert space.space_report(files, None, drive_letters="c", scope=()).count() == files.where("volume_mount_point = 'c'").count()
    ordered = space.space_report(files, 3, scope=()).orderBy(*space.report_order(3)).first()
    assert ordered["drive_letter"] in ("", "C")


def test_outcome_and_errors(spark, rows):
    at = datetime(2024, 1, 1)
    log = spark.createDataFrame(
        [(1, "d", at, datetime(2024, 1, 2, 1, 2, 3), 0), (2, "d", at, at, 50000), (3, "d", at, at, 1222),
         (4, "d", at, at, None), (5, "d", at, None, None)],
        "id long, database_name string, start_time timestamp_ntz, end_time timestamp_ntz, error_number int",
    )
    out = jobs.cmdlog_outcome(log)
    assert rows(out, "id", "outcome") == [
        (1, "Succeeded"), (2, "Failed"), (3, "Failed"), (4, "Not Executed"), (5, "Not Finished"),
    ]
    assert out.where("id = 1").first()["duration"] == "1.01:02:03"
    strict = jobs.error_summary(jobs.error_severity(log)).first()
    assert (strict["failures"], strict["lock_errors"], strict["return_code"]) == (2, 1, 1222)
    lenient = jobs.error_summary(jobs.error_severity(log, lock_severity=10)).first()
    assert (lenient["failures"], lenient["return_code"]) == (1, 50000)


@pytest.mark.parametrize(
    ("schedule", "expected"),
    [
        ((4, 1, 1, 0, 30000), ["06 03:00", "07 03:00", "08 03:00"]),
        ((8, 1, 1, 0, 0), ["07 00:00"]),  # Sunday
        ((8, 126, 1, 0, 10000), ["06 01:00", "08 01:00"]),  # every other day
        ((4, 2, 1, 0, 0), ["06 00:00", "08 00:00"]),
        ((8, 1, 8, 10, 3000), ["07 00:30", "07 10:30", "07 20:30"]),
        ((8, 1, 4, 600, 0), ["07 00:00", "07 10:00", "07 20:00"]),
        ((16, 1, 1, 0, 0), ["unsupported frequency 16"]),
    ],
)
def test_schedule(spark, schedule, expected):
    df = spark.createDataFrame(
        [schedule],
        "freq_type int, freq_interval int, freq_subday_type int, freq_subday_interval int, active_start_time int",
    )
    runs = jobs.expand_schedule(df, "2024-01-06", "2024-01-08").orderBy("run_time").collect()
    assert [r["problem"] or r["run_time"].strftime("%d %H:%M") for r in runs] == expected


def test_schedule_active_dates(spark):
    df = spark.createDataFrame(
        [(4, 1, 1, 0, 0)],
        "freq_type int, freq_interval int, freq_subday_type int, freq_subday_interval int, active_start_time int",
    )
    df = df.withColumn("active_end_date", F.lit("2024-01-06").cast("date"))
    assert jobs.expand_schedule(df, "2024-01-06", "2024-01-08").count() == 1
    assert jobs.expand_schedule(df, "2024-01-07", "2024-01-08").count() == 0


def test_role_gap_without_creating_users(spark):
    logins = spark.createDataFrame(
        [(1, "s1", "a", "S"), (2, "s2", "b", "U"), (3, "s3", "c", "S"), (4, "s4", "d", "G")],
        "principal_id long, sid string, name string, type string",
    )
    users = spark.createDataFrame(
        [(10, "s2", "b", "U"), (11, "s3", "c", "S")], "principal_id long, sid string, name string, type string"
    )
    members = spark.createDataFrame([(1,), (2,), (3,), (4,)], "member_principal_id long")
    holders = spark.createDataFrame([(11,)], "member_principal_id long")
    gap = principals.role_gap(logins, members, users, holders, "r", create_users=False, scope=())
    assert {(r["login_name"], r["create_user_command"], r["add_member_command"]) for r in gap.collect()} == {
        ("a", None, None), ("b", None, "ALTER ROLE [r] ADD MEMBER [b]"),
    }
    filled = principals.role_gap(logins, members, users, holders, "r", scope=()).where("login_name = 'a'").first()
    assert filled["create_user_command"] == "CREATE USER [a] FOR LOGIN [a]"
