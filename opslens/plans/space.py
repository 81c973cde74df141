"""Space, snapshots and row groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslens.operators.rowgroups import rowgroup_rebuild
from opslens.operators.snapshots import snapshot_plan, snapshot_retention
from opslens.operators.space import (
    file_space,
    log_space,
    resize_advice,
    shrink_steps,
    space_by_database,
    space_report,
    volume_summary,
)
from opslens.plans.inputs import AS_OF, Inputs
from opslens.plans.registry import query

DRIVES, DATABASES = "CDE", "DB1"

# MB figures as integer hundredths, so that every rounding below is exact:
# pages / 128 * 100 = pages * 25 / 32, rounded half up.
_FILES = """SELECT upper(volume_mount_point) AS drive_letter, logical_volume_name, database_id, database_name,
    file_id, file_name, type_desc, coalesce(group_name, '(log)') AS group_name, total_bytes, available_bytes,
    (size_pages * 50 + 32) // 64 AS total_c, (used_pages * 50 + 32) // 64 AS used_c,
    ((size_pages - used_pages) * 50 + 32) // 64 AS free_c, physical_name
  FROM v_file"""
_WANTED = """WHERE instr('CDE', upper(volume_mount_point)) > 0
    AND (instr('db1', lower(database_name)) > 0 OR lower(database_name) LIKE '%db1%')"""
_SPACE = f"({_FILES} {_WANTED})"


def _mb(cents: str) -> str:
    return f"CAST({cents} AS BIGINT) / 100.0"


def _disk(expr: str, unit: str = "1048576.0") -> str:
    return f"ROUND(({expr}) / {unit}, 2)"


def _ratio(part: str, whole: str) -> str:
    """Percent with two decimals, half up, from integer hundredths; zero counts as one MB."""
    w = f"(CASE WHEN {whole} = 0 THEN 100 ELSE {whole} END)"
    return f"CAST((CAST({part} AS BIGINT) * 20000 + {w}) // (2 * {w}) AS BIGINT) / 100.0"


_DISK_COLUMNS = f"""{_disk('total_bytes')} AS disk_total_mb, {_disk('total_bytes - available_bytes')} AS disk_used_mb,
  ROUND((total_bytes - available_bytes - 1) / total_bytes * 100, 2) AS disk_used_perc,
  {_disk('available_bytes')} AS disk_free_mb"""


@query(
    "q_space_file",
    f"""SELECT drive_letter, database_name, file_id, file_name, group_name, {_DISK_COLUMNS},
      {_mb('total_c')} AS total_mb, {_mb('used_c')} AS used_mb, {_mb('free_c')} AS free_mb,
      {_ratio('used_c', 'total_c')} AS used_perc, physical_name FROM {_SPACE} f""",
)
def q_space_file(t: Inputs) -> DataFrame:
    return file_space(t.file, DRIVES, DATABASES).select(
        "drive_letter", "database_name", "file_id", "file_name", "group_name", "disk_total_mb",
        "disk_used_mb", "disk_used_perc", "disk_free_mb", "total_mb", "used_mb", "free_mb",
        "used_perc", "physical_name",
    )


@query(
    "q_space_volumes",
    f"""SELECT database_id % 2 AS server_id, drive_letter, database_name, file_id, file_name,
      CASE WHEN file_id % 5 = 0 THEN '(log)' ELSE group_name END AS group_name, {_DISK_COLUMNS},
      CASE WHEN file_id % 5 = 0 THEN 0.0 ELSE {_mb('total_c')} END AS total_mb,
      CASE WHEN file_id % 5 = 0 THEN 0.0 ELSE {_mb('used_c')} END AS used_mb
    FROM ({_FILES}) f""",
)
def q_space_volumes(t: Inputs) -> DataFrame:
    """Volumes list every file of two servers; the sizes of some databases' files could not be read."""
    files = t.file.withColumn("server_id", F.col("database_id") % 2)
    sizes = files.where("file_id % 5 <> 0").select(
        "server_id", "database_id", "file_id", "size_pages", "used_pages", "group_name"
    )
    volumes = files.drop("size_pages", "used_pages", "group_name")
    return file_space(sizes, volumes=volumes, scope=["server_id"]).select(
        "server_id", "drive_letter", "database_name", "file_id", "file_name", "group_name", "disk_total_mb",
        "disk_used_mb", "disk_used_perc", "disk_free_mb", "total_mb", "used_mb",
    )


@query(
    "q_space_database",
    f"""SELECT drive_letter, logical_volume_name, database_name, max({_disk('total_bytes')}) AS disk_total_mb,
      max({_disk('total_bytes - available_bytes')}) AS disk_used_mb,
      ROUND((sum(total_bytes) - sum(available_bytes) - 1) / sum(total_bytes) * 100, 2) AS disk_used_perc,
      max({_disk('available_bytes')}) AS disk_free_mb,
      {_mb('sum(total_c)')} AS total_mb, {_mb('sum(used_c)')} AS used_mb, {_mb('sum(free_c)')} AS free_mb
    FROM ({_FILES}) f GROUP BY 1, 2, 3""",
)
def q_space_database(t: Inputs) -> DataFrame:
    return space_by_database(file_space(t.file))


def _report_oracle(kind: int) -> str:
    drive, flat = kind == 2, "'' AS group_name, '' AS file_type, '' AS file_name, '' AS shrink_command, '' AS expand_command"
    one = "CASE WHEN total_c = 0 THEN 100 ELSE total_c END"
    database_key = "database_name, drive_letter" if drive else "database_name"
    level3 = (
        f"""CAST(max(ROUND(total_bytes / 10485.76, 0)) AS BIGINT) AS t_c,
          CAST(max(ROUND((total_bytes - available_bytes) / 10485.76, 0)) AS BIGINT) AS u_c,
          CAST(max(ROUND(available_bytes / 10485.76, 0)) AS BIGINT) AS f_c,
          max(ROUND((total_bytes - available_bytes - 1) / total_bytes * 100, 2)) AS used_perc"""
        if drive
        else f"sum(total_c) AS t_c, sum(used_c) AS u_c, sum(free_c) AS f_c, {_ratio('sum(used_c)', f'sum({one})')} AS used_perc"
    )
    return f"""SELECT CAST({kind} AS BIGINT) AS report_type, CAST(detail_type AS BIGINT) AS detail_type, label, drive_letter, database_name,
      {_mb('t_c')} AS total_mb, {_mb('u_c')} AS used_mb, {_mb('f_c')} AS free_mb, used_perc,
      group_name, file_type, file_name, shrink_command, expand_command,
      format('{{:,}}', CAST((t_c + 50) // 100 AS BIGINT)) AS total_text, format('{{:,}}', CAST(u_c // 100 AS BIGINT)) AS used_text,
      format('{{:,}}', CAST((f_c + 50) // 100 AS BIGINT)) AS free_text
    FROM (
      SELECT 1 AS detail_type, concat('        --> ', file_name) AS label, drive_letter, database_name,
        total_c AS t_c, used_c AS u_c, free_c AS f_c, {_ratio('used_c', 'total_c')} AS used_perc,
        group_name, type_desc AS file_type, file_name, {_SHRINK} AS shrink_command, {_EXPAND} AS expand_command
      FROM ({_FILES}) d
      UNION ALL
      SELECT 2, concat('{'   --> ' if drive else ''}', database_name), {'drive_letter' if drive else "''"}, database_name,
        sum(total_c), sum(used_c), sum(free_c), {_ratio('sum(used_c)', f'sum({one})')}, {flat}
      FROM ({_FILES}) d GROUP BY {database_key}
      UNION ALL
      SELECT 3, concat('{'' if drive else '   --> '}', drive_letter, ': ', vol), drive_letter, {"''" if drive else 'database_name'},
        t_c, u_c, f_c, used_perc, {flat}
      FROM (SELECT drive_letter, CASE WHEN length(logical_volume_name) > 0 THEN concat('(', logical_volume_name, ')') END AS vol,
          {'' if drive else 'database_name,'} {level3}
        FROM ({_FILES}) d GROUP BY drive_letter, logical_volume_name{'' if drive else ', database_name'}) g
    ) r"""


_SHRINK = """concat('USE [', database_name, ']; DBCC SHRINKFILE (N''', file_name, ''', ',
  (used_c + 50) // 100 + 2000, ')')"""
_EXPAND = """concat('ALTER DATABASE [', database_name, '] MODIFY FILE (NAME = N''', file_name, ''', SIZE = ',
  (total_c * 15 + 1024000 - 1) // 1024000, 'GB, FILEGROWTH = 1GB)')"""


@query("q_space_rollup", f"{_report_oracle(2)} UNION ALL {_report_oracle(3)}", fleet=True)
def q_space_rollup(t: Inputs) -> DataFrame:
    files = t.file
    both = None
    for kind in (2, 3):
        report = space_report(files, kind, scope=t.scope).withColumn("report_type", F.lit(kind))
        both = report if both is None else both.unionByName(report)
    return both.drop("physical_name", "used_perc_text")


def _gb(cents: str) -> str:
    """Hundredths of MB summed to GB with two decimals, half up."""
    return f"(CAST({cents} AS BIGINT) * 2 + 1024) // 2048 / 100.0"


@query(
    "q_space_volume",
    f"""SELECT *, ROUND(disk_used_gb - db_files_total_gb, 2) AS disk_used_non_db_gb,
      ROUND((disk_used_gb - db_files_free_gb) / disk_total_gb * 100, 2) AS disk_used_from_db_files_perc
    FROM (SELECT drive_letter, logical_volume_name, max({_disk('total_bytes', '1073741824.0')}) AS disk_total_gb,
        max({_disk('total_bytes - available_bytes', '1073741824.0')}) AS disk_used_gb,
        max({_disk('available_bytes', '1073741824.0')}) AS disk_free_gb,
        {_gb('sum(total_c)')} AS db_files_total_gb, {_gb('sum(used_c)')} AS db_files_used_gb,
        {_gb('sum(free_c)')} AS db_files_free_gb,
        max(ROUND((total_bytes - available_bytes - 1) / total_bytes * 100, 2)) AS disk_used_perc
      FROM ({_FILES}) f GROUP BY 1, 2) v""",
)
def q_space_volume(t: Inputs) -> DataFrame:
    return volume_summary(file_space(t.file))


@query(
    "q_space_advice",
    f"""SELECT file_id, (used_c + 50) // 100 + 2000 AS shrink_target_mb,
      (total_c * 15 + 1024000 - 1) // 1024000 AS expand_target_gb,
      {_SHRINK} AS shrink_command, {_EXPAND} AS expand_command FROM ({_FILES}) f""",
)
def q_space_advice(t: Inputs) -> DataFrame:
    return resize_advice(file_space(t.file)).select(
        "file_id", "shrink_target_mb", "expand_target_gb", "shrink_command", "expand_command"
    )


_LOGS = """SELECT concat(database_name, '_', file_id) AS database_name, size_pages / 128.0 AS log_size_mb,
  CASE WHEN size_pages = 0 THEN 0.0 ELSE CAST(used_pages AS DOUBLE) / size_pages * 100 END AS log_used_percent
FROM v_file WHERE type_desc = 'LOG'"""


@query(
    "q_log_space",
    f"""SELECT database_name, ROUND(log_size_mb, 2) AS log_size_mb, ROUND(log_used_percent, 2) AS log_used_percent,
      CAST(0 AS BIGINT) AS status, ROUND((1.0 - log_used_percent / 100.0) * log_size_mb, 2) AS log_free_mb
    FROM ({_LOGS}) l""",
)
def q_log_space(t: Inputs) -> DataFrame:
    used = F.when(F.col("size_pages") == 0, 0.0).otherwise(
        F.col("used_pages").cast("double") / F.col("size_pages") * 100
    )
    logs = t.file.where(F.col("type_desc") == "LOG").select(
        F.concat("database_name", F.lit("_"), "file_id").alias("database_name"),
        (F.col("size_pages").cast("double") / 128).alias("log_size_mb"),
        used.alias("log_used_percent"),
        F.lit(0).alias("status"),
    )
    return log_space(logs).orderBy(F.col("log_free_mb").desc())


@query(
    "q_shrink_steps",
    f"""SELECT database_id, file_id, file_name, {_mb('total_c')} AS reserved_mb, {_mb('free_c')} AS free_mb,
      total_c // 100 - 1024 AS next_size_mb, 'SHRINK_FILE' AS action,
      concat('USE [', database_name, ']; DBCC SHRINKFILE (N''', file_name, ''', ', total_c // 100 - 1024, ')') AS command_text
    FROM ({_FILES}) f WHERE type_desc = 'ROWS' AND free_c > 1024000""",
)
def q_shrink_steps(t: Inputs) -> DataFrame:
    return shrink_steps(t.file).select(
        "database_id", "file_id", "file_name", "reserved_mb", "free_mb", "next_size_mb", "action",
        "command_text",
    )


# ---------------------------------------------------------------- snapshots


@query(
    "q_snapshot_plan",
    f"""WITH candidates AS (
      SELECT database_id, name, concat(name, '_Snapshot_20010801') AS new_name FROM v_database
      WHERE source_database_id IS NULL AND database_id > 4 AND name ILIKE 'NATION_1%'),
    existing AS (SELECT concat(name, '_Snapshot_20010801') AS new_name FROM v_database WHERE is_read_only),
    clauses AS (SELECT c.database_id, string_agg(concat('(NAME = N''', file_name, ''', FILENAME = N''D:', chr(92), 'data', chr(92),
        new_name, '_', file_name, '.ss'')'), ',' ORDER BY file_name, file_id) AS file_list
      FROM candidates c JOIN v_file f ON f.database_id = c.database_id WHERE type_desc = 'ROWS' GROUP BY 1)
    SELECT c.database_id, c.name, c.new_name, CASE WHEN e.new_name IS NULL THEN 'CREATE' ELSE 'SKIP' END AS action,
      coalesce(file_list, '') AS file_list,
      CASE WHEN e.new_name IS NULL THEN concat('CREATE DATABASE [', c.new_name, '] ON ', coalesce(file_list, ''),
        ' AS SNAPSHOT OF [', c.name, ']') END AS command_text
    FROM candidates c LEFT JOIN clauses k ON k.database_id = c.database_id LEFT JOIN existing e ON e.new_name = c.new_name""",
    fleet=True,
)
def q_snapshot_plan(t: Inputs) -> DataFrame:
    databases = t.database
    existing = databases.where("is_read_only").select(
        *t.scope, F.concat("name", F.lit("_Snapshot_20010801")).alias("name")
    )
    return snapshot_plan(databases, t.file, existing, AS_OF, database_like="NATION_1%", scope=t.scope)


RETENTION_LIMITS = {
    "max_snapshots": 3,
    "max_age_hours": 50_000,
    "max_size_on_disk_mb": 150,
    "max_space_used_percent": 100.0,
}

RETENTION_COLUMNS = [
    "source_database_id", "database_id", "snapshot_order", "age_in_hours", "size_mb",
    "size_on_disk_mb", "space_used_percent", "drop_snapshot", "reasons",
]

RETENTION_ORACLE = f"""
WITH per_file AS (SELECT database_id, file_id, sum(size_pages) * 8 // 1024 AS mb,
    sum(size_on_disk_bytes) // 1024 // 1024 AS disk FROM v_snapfile GROUP BY 1, 2),
  sizes AS (SELECT database_id, CAST(sum(mb) AS BIGINT) AS size_mb, CAST(sum(disk) AS BIGINT) AS size_on_disk_mb
    FROM per_file GROUP BY 1),
  ranked AS (SELECT s.*, row_number() OVER (PARTITION BY source_database_id ORDER BY create_date DESC, database_id DESC) AS snapshot_order,
      date_diff('minute', create_date, TIMESTAMP '{AS_OF}') // 60 AS age_in_hours, size_mb, size_on_disk_mb
    FROM v_snapshot s LEFT JOIN sizes USING (database_id)),
  judged AS (SELECT *, (size_on_disk_mb * 20000 + size_mb) // nullif(2 * size_mb, 0) / 100.0 AS space_used_percent FROM ranked)
SELECT source_database_id, database_id, snapshot_order, age_in_hours, size_mb, size_on_disk_mb, space_used_percent,
  coalesce(snapshot_order > 3, false) OR coalesce(age_in_hours > 50000, false) OR coalesce(size_on_disk_mb > 150, false)
    OR coalesce(space_used_percent > 100, false) AS drop_snapshot,
  concat_ws(',', CASE WHEN snapshot_order > 3 THEN 'snapshot_order' END, CASE WHEN age_in_hours > 50000 THEN 'age_in_hours' END,
    CASE WHEN size_on_disk_mb > 150 THEN 'size_on_disk_mb' END, CASE WHEN space_used_percent > 100 THEN 'space_used_percent' END) AS reasons
FROM judged
"""


@query("q_snapshot_retention", RETENTION_ORACLE)
def q_snapshot_retention(t: Inputs) -> DataFrame:
    plan = snapshot_retention(t.snapshot, t.snapfile, AS_OF, **RETENTION_LIMITS)
    return plan.withColumn("reasons", F.array_join("reasons", ",")).select(*RETENTION_COLUMNS)


# ---------------------------------------------------------------- row groups

_ROWGROUPS = """WITH parts AS (
    SELECT object_id, object_name, index_name, is_partitioned, partition_number,
      min(created_time) FILTER (WHERE bad) AS oldest_created, count(*) FILTER (WHERE bad) AS bad_rowgroups,
      CAST(coalesce(sum(deleted_rows) FILTER (WHERE bad), 0) AS BIGINT) AS deleted_rows
    FROM (SELECT *, coalesce(state_desc <> 'COMPRESSED', false) OR coalesce(transition_desc <> 'INDEX_BUILD', false)
        OR deleted_rows > 0 AS bad FROM v_rowgroup) r GROUP BY 1, 2, 3, 4, 5),
  newest AS (SELECT object_id, max(partition_number) AS top FROM v_rowgroup GROUP BY 1)
SELECT p.object_id, CAST(p.partition_number AS BIGINT) AS partition_number, oldest_created, bad_rowgroups, deleted_rows,
  concat('ALTER INDEX [', index_name, '] ON [dbo].[', object_name, '] REBUILD',
    CASE WHEN is_partitioned THEN concat(' PARTITION = ', partition_number) ELSE '' END) AS command_text
FROM parts p JOIN newest n ON n.object_id = p.object_id WHERE bad_rowgroups > 0 AND partition_number < top"""

_ROWGROUP_COLUMNS = [
    "object_id", "partition_number", "oldest_created", "bad_rowgroups", "deleted_rows",
    "command_text",
]


@query("q_rowgroup_rebuild", _ROWGROUPS)
def q_rowgroup_rebuild(t: Inputs) -> DataFrame:
    return rowgroup_rebuild(t.rowgroup).select(*_ROWGROUP_COLUMNS)


@query("q_rowgroup_topn", f"{_ROWGROUPS} ORDER BY oldest_created, 1, 2 LIMIT 10")
def q_rowgroup_topn(t: Inputs) -> DataFrame:
    return rowgroup_rebuild(t.rowgroup, steps=10).select(*_ROWGROUP_COLUMNS)
