"""Backup planning and integrity checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslens.operators.backup import (
    backup_commands,
    backup_eligible,
    backup_names,
    cleanup_cutoff,
    decide_backup_type,
    expired_files,
    latest_backup,
    stripe_plan,
    unsafe_names,
    verify_status,
    with_roles,
)
from opslens.operators.maintenance import check_eligible, check_plan, order_by_last_check
from opslens.plans.inputs import AS_OF, Inputs
from opslens.plans.registry import query

_BASES = """bases AS (SELECT database_id, checkpoint_lsn, bool_or(is_snapshot) AS base_is_snapshot FROM v_backup
    WHERE type = 'D' GROUP BY 1, 2)"""
_TYPED = f"""{_BASES}, step1 AS (SELECT *, CASE WHEN recovery_model_desc IN ('FULL', 'BULK_LOGGED') AND last_log_backup_lsn IS NULL
      AND name <> 'master' THEN 'DIFF' ELSE 'LOG' END AS t1 FROM v_database),
  step2 AS (SELECT *, CASE WHEN t1 = 'DIFF' AND (name = 'master' OR differential_base_lsn IS NULL
      OR modified_extent_pages * 100 >= 50 * allocated_extent_pages) THEN 'FULL' ELSE t1 END AS t2 FROM step1),
  typed AS (SELECT s.*, CASE WHEN t2 = 'DIFF' AND b.base_is_snapshot THEN 'FULL' ELSE t2 END AS backup_type
    FROM step2 s LEFT JOIN bases b ON b.database_id = s.database_id AND b.checkpoint_lsn = s.differential_base_lsn)"""


def _typed(t: Inputs, databases: DataFrame | None = None) -> DataFrame:
    databases = t.database if databases is None else databases
    return decide_backup_type(databases, "LOG", t.backup, modification_level=50, scope=t.scope)


@query(
    "q_backup_type",
    f"WITH {_TYPED} SELECT database_id, name, recovery_model_desc, backup_type FROM typed",
    fleet=True,
)
def q_backup_type(t: Inputs) -> DataFrame:
    return _typed(t).select(*t.scope, "database_id", "name", "recovery_model_desc", "backup_type")


@query(
    "q_backup_eligible",
    f"""WITH {_TYPED}, failed AS (SELECT database_id, name, backup_type, concat_ws(',',
      CASE WHEN state_desc <> 'ONLINE' THEN 'online' END,
      CASE WHEN user_access_desc = 'SINGLE_USER' AND NOT is_accessible THEN 'single_user' END,
      CASE WHEN is_in_standby THEN 'standby' END,
      CASE WHEN backup_type = 'LOG' AND recovery_model_desc = 'SIMPLE' THEN 'log_simple_model' END,
      CASE WHEN backup_type = 'LOG' AND recovery_model_desc IN ('FULL', 'BULK_LOGGED') AND last_log_backup_lsn IS NULL THEN 'log_no_base' END,
      CASE WHEN backup_type = 'DIFF' AND differential_base_lsn IS NULL THEN 'diff_no_base' END,
      CASE WHEN availability_group IS NOT NULL AND backup_type = 'FULL' AND availability_group_role IS DISTINCT FROM 'PRIMARY'
        THEN 'group_full_not_primary' END,
      CASE WHEN availability_group IS NOT NULL AND backup_type = 'DIFF' AND availability_group_role IS DISTINCT FROM 'PRIMARY'
        THEN 'group_diff_not_primary' END,
      CASE WHEN availability_group IS NOT NULL AND backup_type = 'LOG' AND is_preferred_replica IS DISTINCT FROM true
        THEN 'group_log_not_preferred' END,
      CASE WHEN log_shipping_role = 'PRIMARY' AND backup_type = 'LOG' THEN 'log_shipping_primary' END,
      CASE WHEN is_read_only THEN 'read_only' END,
      CASE WHEN backup_type = 'LOG' AND log_since_backup_mb < 3000
        AND date_diff('second', last_log_backup_time, TIMESTAMP '{AS_OF}') < 3600 THEN 'log_throttle' END) AS failed_rules
      FROM typed)
    SELECT database_id, name, backup_type, failed_rules = '' AS eligible, failed_rules FROM failed""",
    fleet=True,
)
def q_backup_eligible(t: Inputs) -> DataFrame:
    databases = t.database
    roles = ["availability_group", "availability_group_role", "is_preferred_replica"]
    with_role = with_roles(
        databases.drop(*roles, "log_shipping_role"),
        databases.where(F.col("availability_group").isNotNull()).select(*t.scope, "database_id", *roles),
        None,
        databases.where(F.col("log_shipping_role") == "PRIMARY"),
        databases.where(F.col("log_shipping_role") == "SECONDARY"),
        scope=t.scope,
    )
    judged = backup_eligible(
        _typed(t, with_role),
        AS_OF,
        updateability="READ_WRITE",
        min_log_size_mb=3000,
        min_seconds_since_log=3600,
    )
    return judged.select(
        *t.scope, "database_id", "name", "backup_type", "eligible",
        F.array_join("failed_rules", ",").alias("failed_rules"),
    )


_LATEST = """SELECT b.database_id, max(b.backup_start_date) AS latest_backup FROM v_backup b
  JOIN v_database d ON d.database_id = b.database_id
  WHERE NOT b.is_damaged AND (b.type IN ('D', 'I') OR b.database_backup_lsn < d.differential_base_lsn) GROUP BY 1"""


@query("q_latest_backup", _LATEST, fleet=True)
def q_latest_backup(t: Inputs) -> DataFrame:
    return latest_backup(t.backup, t.database, scope=t.scope)


_CUTOFF = f"""{_TYPED}, latest AS ({_LATEST}),
  verified AS (SELECT database_id, count(*) AS backup_sets,
      count(*) FILTER (WHERE verify_output <> 0 OR verify_output IS NULL) AS failed_sets FROM v_backup GROUP BY 1),
  cutoffs AS (SELECT t.database_id, t.backup_type,
      CASE WHEN t.backup_type = 'LOG' AND v.failed_sets <= 1 AND l.latest_backup IS NOT NULL
        THEN least(TIMESTAMP '{AS_OF}' - INTERVAL '24' HOUR, l.latest_backup) END AS cleanup_before,
      CASE WHEN t.backup_type = 'LOG' AND v.failed_sets <= 1 AND l.latest_backup IS NOT NULL
        THEN least(TIMESTAMP '{AS_OF}' - INTERVAL '48' HOUR, l.latest_backup) END AS mirror_cleanup_before
    FROM typed t LEFT JOIN latest l ON l.database_id = t.database_id LEFT JOIN verified v ON v.database_id = t.database_id)"""


def _cutoffs(t: Inputs) -> DataFrame:
    # Up to one failed set is tolerated here, so that both outcomes occur in the test data.
    key = [*t.scope, "database_id"]
    status = verify_status(t.backup, key).withColumn("verify_ok", F.col("failed_sets") <= 1)
    databases = (
        _typed(t)
        .join(latest_backup(t.backup, t.database, scope=t.scope), key, "left")
        .join(status.select(*key, "verify_ok"), key, "left")
        .withColumn("backup_output", F.lit(0))
    )
    return cleanup_cutoff(databases, "LOG", AS_OF, cleanup_hours=24, mirror_cleanup_hours=48)


@query("q_cleanup_cutoff", f"WITH {_CUTOFF} SELECT * FROM cutoffs", fleet=True)
def q_cleanup_cutoff(t: Inputs) -> DataFrame:
    return _cutoffs(t).select(
        *t.scope, "database_id", "backup_type", "cleanup_before", "mirror_cleanup_before"
    )


@query(
    "q_expired_files",
    f"""WITH {_CUTOFF} SELECT b.database_id, b.database_backup_lsn, b.backup_start_date, c.cleanup_before
    FROM v_backup b JOIN cutoffs c ON c.database_id = b.database_id
    WHERE b.type = 'L' AND b.backup_start_date < c.cleanup_before""",
    fleet=True,
)
def q_expired_files(t: Inputs) -> DataFrame:
    return expired_files(t.backup, _cutoffs(t), scope=t.scope).select(
        *t.scope, "database_id", "database_backup_lsn", "backup_start_date", "cleanup_before"
    )


@query(
    "q_verify_status",
    """SELECT database_id, count(*) AS backup_sets,
      count(*) FILTER (WHERE verify_output <> 0 OR verify_output IS NULL) AS failed_sets,
      count(*) FILTER (WHERE verify_output <> 0 OR verify_output IS NULL) = 0 AS verify_ok
    FROM v_backup GROUP BY 1""",
)
def q_verify_status(t: Inputs) -> DataFrame:
    return verify_status(t.backup)


_HOST = """CASE WHEN availability_group IS NOT NULL THEN concat('CLU$', availability_group)
  ELSE concat(server_name, CASE WHEN instance_name IS NULL THEN '' ELSE concat('$', instance_name) END) END"""


@query(
    "q_backup_names",
    f"""WITH {_TYPED}, named AS (SELECT database_id, name, backup_type, {_HOST} AS host,
      concat('B:', chr(92), {_HOST}, chr(92), name, chr(92), backup_type) AS directory_path FROM typed)
    SELECT database_id, directory_path, concat(host, '_', name, '_', backup_type, '_20010801_000000_{{FileNumber}}.',
      CASE backup_type WHEN 'LOG' THEN 'trn' ELSE 'bak' END) AS file_name FROM named""",
)
def q_backup_names(t: Inputs) -> DataFrame:
    return backup_names(_typed(t), AS_OF, root="B:", number_of_files=4).select(
        "database_id", "directory_path", "file_name"
    )


_TOKENS = (
    "{ServerName}${InstanceName}_{ServiceName}_{DatabaseName}_{BackupType}_v{MajorVersion}_{MinorVersion}_"
    "{FileNumber}.{FileExtension}"
)


@query(
    "q_backup_name_tokens",
    f"""WITH {_TYPED}, named AS (SELECT database_id, name, backup_type, {_HOST} AS host,
      CASE WHEN database_id % 3 = 0 THEN '' ELSE concat('_SVC', database_id % 4) END AS service,
      compatibility_level // 10 AS major, compatibility_level % 7 AS minor FROM typed)
    SELECT database_id, concat(host, service, '_', name, '_', backup_type, '_v', major, '_', minor, '.',
      CASE backup_type WHEN 'LOG' THEN 'trn' ELSE 'bak' END) AS file_name FROM named""",
)
def q_backup_name_tokens(t: Inputs) -> DataFrame:
    typed = _typed(t).withColumns(
        {
            "service_name": F.expr("CASE WHEN database_id % 3 = 0 THEN NULL ELSE concat('SVC', database_id % 4) END"),
            "major_version": F.expr("compatibility_level DIV 10"),
            "minor_version": F.expr("compatibility_level % 7"),
        }
    )
    group_template = _TOKENS.replace("{ServerName}${InstanceName}", "{ClusterName}${AvailabilityGroupName}")
    named = backup_names(typed, AS_OF, root="B:", file_template=_TOKENS, group_file_template=group_template)
    return named.select("database_id", "file_name")


def _disks(root: str) -> str:
    disks = []
    for n in range(1, 5):
        disks.append(
            f"concat('DISK = N''', '{root}{1 if n <= 2 else 2}:', chr(92), host, chr(92), name, chr(92), backup_type, chr(92), "
            f"host, '_', name, '_', backup_type, '_20010801_000000_{n}.', CASE backup_type WHEN 'LOG' THEN 'trn' ELSE 'bak' END, '''')"
        )
    return f"concat_ws(', ', {', '.join(disks)})"


@query(
    "q_backup_commands",
    f"""WITH {_TYPED}, named AS (SELECT database_id, name, backup_type, {_HOST} AS host FROM typed)
    SELECT database_id, CASE backup_type WHEN 'LOG' THEN 'BACKUP_LOG' ELSE 'BACKUP_DATABASE' END AS command_type,
      concat('BACKUP ', CASE backup_type WHEN 'LOG' THEN 'LOG' ELSE 'DATABASE' END, ' [', name, '] TO ', {_disks('P')},
        ' MIRROR TO ', {_disks('M')}, ' WITH CHECKSUM, COMPRESSION', CASE backup_type WHEN 'DIFF' THEN ', DIFFERENTIAL' ELSE '' END,
        ', FORMAT, BUFFERCOUNT = 50') AS command_text,
      concat('RESTORE VERIFYONLY FROM ', {_disks('P')}, ' WITH CHECKSUM') AS verify_command,
      concat('RESTORE VERIFYONLY FROM ', {_disks('M')}, ' WITH CHECKSUM') AS mirror_verify_command
    FROM named""",
)
def q_backup_commands(t: Inputs) -> DataFrame:
    named = backup_names(_typed(t), AS_OF, root="P1:", number_of_files=4)
    commands = backup_commands(
        named, 4, ["P1:", "P2:"], ["M1:", "M2:"], checksum=True, compress=True, buffer_count=50
    )
    return commands.select(
        "database_id", "command_type", "command_text", "verify_command", "mirror_verify_command"
    )


@query(
    "q_stripe_plan",
    """SELECT database_id, CAST(n AS BIGINT) AS file_number, is_mirror,
      concat(CASE WHEN is_mirror THEN 'M' ELSE 'P' END, CASE WHEN n <= 2 THEN '1' ELSE '2' END) AS directory,
      CAST(n AS VARCHAR) AS file_number_text
    FROM v_database, range(1, 5) r(n), (VALUES (true), (false)) m(is_mirror)""",
)
def q_stripe_plan(t: Inputs) -> DataFrame:
    return stripe_plan(t.database, 4, ["P1", "P2"], ["M1", "M2"]).select(
        "database_id", "file_number", "is_mirror", "directory", "file_number_text"
    )


# ---------------------------------------------------------------- integrity checks

_CHECKABLE = """checkable AS (SELECT * FROM v_database WHERE state_desc = 'ONLINE'
    AND NOT (user_access_desc = 'SINGLE_USER' AND NOT is_accessible)
    AND (availability_group_role = 'PRIMARY' OR availability_group_role IS NULL))"""
_GROUPS = "groups AS (SELECT DISTINCT database_id, group_name FROM v_file WHERE group_name IS NOT NULL)"
_TABLES = "tables AS (SELECT DISTINCT database_id, object_name FROM v_index_cur)"


@query(
    "q_check_plan",
    f"""WITH {_CHECKABLE}, {_GROUPS}, {_TABLES}
    SELECT database_id, name, 'DBCC_CHECKDB' AS command_type, name AS target,
      concat('SET LOCK_TIMEOUT 5000; DBCC CHECKDB ([', name, ']) WITH NO_INFOMSGS, ALL_ERRORMSGS, PHYSICAL_ONLY, MAXDOP = 2') AS command_text
    FROM checkable
    UNION ALL SELECT c.database_id, name, 'DBCC_CHECKFILEGROUP', group_name,
      concat('USE [', name, ']; DBCC CHECKFILEGROUP ([', group_name, '], NOINDEX) WITH NO_INFOMSGS, ALL_ERRORMSGS')
    FROM checkable c JOIN groups g ON g.database_id = c.database_id
    UNION ALL SELECT database_id, name, 'DBCC_CHECKCATALOG', name, concat('DBCC CHECKCATALOG ([', name, ']) WITH NO_INFOMSGS') FROM checkable
    UNION ALL SELECT database_id, name, 'DBCC_CHECKALLOC', name,
      concat('DBCC CHECKALLOC ([', name, ']) WITH NO_INFOMSGS, ALL_ERRORMSGS, TABLOCK') FROM checkable
    UNION ALL SELECT c.database_id, name, 'DBCC_CHECKTABLE', concat('[dbo].[', object_name, ']'),
      concat('USE [', name, ']; DBCC CHECKTABLE (''[dbo].[', object_name, ']'') WITH NO_INFOMSGS, ALL_ERRORMSGS, DATA_PURITY, TABLOCK')
    FROM checkable c JOIN tables g ON g.database_id = c.database_id""",
    fleet=True,
)
def q_check_plan(t: Inputs) -> DataFrame:
    databases = check_eligible(t.database, replicas="PRIMARY")
    filegroups = (
        t.file.where(F.col("group_name").isNotNull())
        .select(*t.scope, "database_id", F.col("group_name").alias("filegroup_name"))
        .distinct()
    )
    objects = t.index_cur.select(*t.scope, "database_id", "schema_name", "object_name").distinct()
    plans = [
        check_plan(databases, "CHECKDB", physical_only=True, max_dop=2, lock_timeout=5, scope=t.scope),
        check_plan(databases, "CHECKFILEGROUP,CHECKCATALOG", filegroups=filegroups, no_index=True, scope=t.scope),
        check_plan(databases, "CHECKALLOC,CHECKTABLE", objects=objects, tab_lock=True, scope=t.scope),
    ]
    return plans[0].unionByName(plans[1]).unionByName(plans[2])


@query(
    "q_last_check_order",
    """WITH dbs AS (SELECT DISTINCT database_id, database_name AS name FROM v_file),
      runs AS (SELECT database_name AS name, max(start_time) AS last_command_time FROM v_command_log
        WHERE command_type = 'DBCC_CHECKDB' AND error_number = 0 GROUP BY 1)
    SELECT database_id, d.name, last_command_time,
      row_number() OVER (ORDER BY last_command_time NULLS FIRST, d.name) AS order_no
    FROM dbs d LEFT JOIN runs r ON r.name = d.name""",
)
def q_last_check_order(t: Inputs) -> DataFrame:
    databases = t.file.select("database_id", F.col("database_name").alias("name")).distinct()
    return order_by_last_check(databases, t.command_log).select(
        "database_id", "name", "last_command_time", "order_no"
    )


_ODD_NAME = """CASE database_id % 5 WHEN 0 THEN concat('?*', chr(92), '/:') WHEN 1 THEN concat('<', name, '>') WHEN 2 THEN '| "'
  ELSE name END"""


@query(
    "q_unsafe_names",
    f"""SELECT database_id, name, concat('name has no file-system form: ', name) AS reason
    FROM (SELECT database_id, {_ODD_NAME} AS name FROM v_database) d WHERE database_id % 5 IN (0, 2)""",
)
def q_unsafe_names(t: Inputs) -> DataFrame:
    return unsafe_names(t.database.select("database_id", F.expr(_ODD_NAME).alias("name")))
