import re
from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from opslens.operators import backup as b

AS_OF = "2024-01-02 12:00:00"


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab_-$./\\", max_size=16))
def test_cleaned_templates_are_stable(text):
    directory, name = b.clean_directory(text), b.clean_file_name(text)
    assert b.clean_directory(directory) == directory
    assert b.clean_file_name(name) == name
    assert not re.search(r"__|--|_\$|\$_|-\$|\$-|[_-]\.|^[_$-]|[_$-]$", name)
    flat = directory.replace("{DirectorySeparator}", "/")
    assert not re.search(r"//|/[_$-]|[_$-]/|__|--|^[_$/-]|[_$/-]$", flat)
    for kept in (flat, name):  # nothing but separators ever goes
        assert re.sub(r"[_$./\\-]", "", kept) == re.sub(r"[_$./\\-]", "", text)


@pytest.mark.parametrize(
    ("template", "directory", "name"),
    [
        ("$a__b$_c-", "a_b_c", "a_b_c"),
        ("x\\/$_y", "x{DirectorySeparator}y", "x\\/_y"),
        ("_/a-/_-/b/$", "a{DirectorySeparator}b", "/a-/_-/b/"),
        ("a_-.b", "a_-.b", "a.b"),
        ("a_-b", "a_-b", "a_-b"),
        ("a$b$$c", "a$b$$c", "a$b$$c"),
        ("/$$-.", ".", "/."),
        ("a$_.b", "a_.b", "a.b"),
        ("a$.b", "a$.b", "a$.b"),
    ],
)
def test_cleaning_examples(template, directory, name):
    assert b.clean_directory(template) == directory
    assert b.clean_file_name(template) == name


def named(spark, **overrides):
    values = {
        "name": "Sales", "backup_type": "FULL", "server_name": "SRV", "instance_name": None,
        "cluster_name": None, "availability_group": None, **overrides,
    }
    schema = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema)


def test_names_follow_the_template(spark):
    row = b.backup_names(named(spark), AS_OF, root="B:", number_of_files=4).first()
    assert row["directory_path"] == "B:\\SRV\\Sales\\FULL"
    assert row["file_name"] == "SRV_Sales_FULL_20240102_120000_{FileNumber}.bak"
    row = b.backup_names(named(spark, instance_name="I1", backup_type="LOG"), AS_OF, root="B:", copy_only=True).first()
    assert row["directory_path"] == "B:\\SRV$I1\\Sales\\LOG_COPY_ONLY"
    assert row["file_name"] == "SRV$I1_Sales_LOG_COPY_ONLY_20240102_120000.trn"
    row = b.backup_names(named(spark, availability_group="AG", cluster_name="C"), AS_OF, root="B:").first()
    assert row["file_name"] == "C$AG_Sales_FULL_20240102_120000.bak"


def test_service_and_version_tokens(spark):
    template = "{ServerName}_{ServiceName}_{DatabaseName}_v{MajorVersion}_{MinorVersion}.{FileExtension}"
    df = named(spark).withColumns(
        {"service_name": F.lit(None).cast("string"), "major_version": F.lit(16), "minor_version": F.lit(0)}
    )
    row = b.backup_names(df, AS_OF, root="B:", file_template=template).first()
    assert row["file_name"] == "SRV_Sales_v16_0.bak"
    row = b.backup_names(df.withColumn("service_name", F.lit("SVC")), AS_OF, root="B:", file_template=template).first()
    assert row["file_name"] == "SRV_SVC_Sales_v16_0.bak"
    with pytest.raises(ValueError, match="service_name"):
        b.backup_names(named(spark), AS_OF, root="B:", file_template=template)


def test_long_paths_shorten_the_database_name(spark):
    row = b.backup_names(named(spark, name="x" * 120), AS_OF, root="B:" + "y" * 60).first()
    assert len(row["directory_path"]) + 1 + len(row["file_name"]) == 259
    assert "..." in row["file_name"]
    row = b.backup_names(named(spark, name="x" * 200), AS_OF, root="B:" + "y" * 60).first()
    assert f"SRV_{'x' * 20}..._FULL" in row["file_name"]


@pytest.mark.parametrize(("files", "dirs"), [(4, 2), (12, 3), (1, 1), (64, 8)])
def test_stripes_cover_every_number_once(spark, files, dirs):
    names = [f"d{i}" for i in range(dirs)]
    plan = b.stripe_plan(spark.range(3), files, names, [f"m{i}" for i in range(dirs)])
    for mirror in (True, False):
        rows = plan.where(F.col("is_mirror") == mirror).where("id = 1").orderBy("file_number").collect()
        assert [r["file_number"] for r in rows] == list(range(1, files + 1))
        prefix = "m" if mirror else "d"
        assert [r["directory"] for r in rows] == [f"{prefix}{i * dirs // files}" for i in range(files)]
    widths = {len(r["file_number_text"]) for r in plan.collect()}
    assert widths == ({0} if files == 1 else {1} if files < 10 else {2})


@pytest.mark.parametrize(("files", "dirs"), [(0, 1), (65, 1), (3, 2), (1, 2)])
def test_stripe_arguments(spark, files, dirs):
    with pytest.raises(ValueError, match="number of files"):
        b.stripe_plan(spark.range(1), files, ["d"] * dirs)


DATABASE = (
    "database_id long, name string, recovery_model_desc string, last_log_backup_lsn long, "
    "differential_base_lsn long, modified_extent_pages long, allocated_extent_pages long"
)


def test_type_moves_up(spark):
    data = [
        (1, "ok", "FULL", 5, 50, 1, 100), (2, "simple", "SIMPLE", None, 50, 1, 100),
        (3, "nolog", "FULL", None, 50, 1, 100), (4, "nobase", "FULL", None, None, 1, 100),
        (5, "changed", "FULL", None, 50, 60, 100), (6, "snap", "FULL", None, 70, 1, 100),
        (7, "empty", "FULL", None, 50, 0, 0), (8, "master", "FULL", None, 50, 1, 100),
    ]
    databases = spark.createDataFrame(data, DATABASE)
    backups = spark.createDataFrame(
        [(6, "D", 70, True), (6, "D", 70, False), (3, "D", 51, True)],
        "database_id long, type string, checkpoint_lsn long, is_snapshot boolean",
    )
    out = b.decide_backup_type(databases, "LOG", backups, modification_level=50, scope=())
    assert {r["name"]: r["backup_type"] for r in out.collect()} == {
        "ok": "LOG", "simple": "LOG", "nolog": "DIFF", "nobase": "FULL", "changed": "FULL",
        "snap": "FULL", "empty": "DIFF", "master": "LOG",
    }
    same = b.decide_backup_type(databases, "DIFF", change_backup_type=False, scope=())
    assert {r["backup_type"] for r in same.collect()} == {"DIFF"}
    with pytest.raises(ValueError, match="type"):
        b.decide_backup_type(databases, "WEEKLY", scope=())


def test_unknown_rule_does_not_pass(spark):
    columns = {
        "state_desc": "ONLINE", "user_access_desc": "MULTI_USER", "is_accessible": True,
        "is_in_standby": None, "backup_type": "FULL", "recovery_model_desc": "FULL",
        "last_log_backup_lsn": 1, "differential_base_lsn": 1, "name": "n", "availability_group": None,
        "availability_group_role": None, "is_preferred_replica": None, "log_shipping_role": None,
        "is_read_only": False, "log_since_backup_mb": 1, "last_log_backup_time": datetime(2024, 1, 1),
    }
    schema = """state_desc string, user_access_desc string, is_accessible boolean, is_in_standby boolean,
      backup_type string, recovery_model_desc string, last_log_backup_lsn long, differential_base_lsn long,
      name string, availability_group string, availability_group_role string, is_preferred_replica boolean,
      log_shipping_role string, is_read_only boolean, log_since_backup_mb long, last_log_backup_time timestamp_ntz"""

    def judge(**overrides):
        df = spark.createDataFrame([tuple({**columns, **overrides}.values())], schema)
        return b.backup_eligible(df, AS_OF, min_log_size_mb=10, min_seconds_since_log=60).first()

    assert judge()["failed_rules"] == ["standby"]
    assert judge(is_in_standby=False)["eligible"]
    log = {"is_in_standby": False, "backup_type": "LOG"}
    assert judge(**log)["eligible"]  # the last log backup is long ago
    recent = datetime(2024, 1, 2, 11, 59, 30)
    assert judge(**log, last_log_backup_time=recent)["failed_rules"] == ["log_throttle"]
    assert judge(**log, last_log_backup_time=recent, log_since_backup_mb=None)["eligible"]
    group = {**log, "availability_group": "AG"}
    assert judge(**group)["failed_rules"] == ["group_log_not_preferred"]
    assert judge(**group, is_preferred_replica=True)["eligible"]


def test_cleanup_needs_every_date(spark):
    data = [
        (1, "LOG", datetime(2024, 1, 1), 0, True), (2, "LOG", None, 0, True),
        (3, "FULL", None, 0, True), (4, "LOG", datetime(2024, 1, 1), 1, True),
        (5, "LOG", datetime(2024, 1, 2, 11), 0, None),
    ]
    df = spark.createDataFrame(
        data, "database_id long, backup_type string, latest_backup timestamp_ntz, backup_output int, verify_ok boolean"
    )
    after = b.cleanup_cutoff(df, "LOG", AS_OF, cleanup_hours=24)
    assert {r["database_id"]: r["cleanup_before"] for r in after.collect()} == {
        1: datetime(2024, 1, 1), 2: None, 3: None, 4: None, 5: None,
    }
    before = b.cleanup_cutoff(df, "LOG", AS_OF, cleanup_hours=24, mode="BEFORE_BACKUP")
    cutoffs = {r["database_id"]: r["cleanup_before"] for r in before.collect()}
    assert cutoffs[4] == datetime(2024, 1, 1)
    assert cutoffs[5] == datetime(2024, 1, 1, 12)
    assert all(r["mirror_cleanup_before"] is None for r in before.collect())
