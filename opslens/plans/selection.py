"""Selection lists, database filters and orderings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslens.functions import safe_name
from opslens.operators.patterns import select_by_list
from opslens.operators.selection import (
    command_for_each,
    duplicate_names,
    exclude_unreadable,
    outside_selection,
    filter_databases,
    order_databases,
    select_by_group,
    select_by_spec,
    spec_missing,
    suspect,
)
from opslens.plans.inputs import Inputs
from opslens.plans.registry import query

DATABASE_SPEC = "NATION_1%, USER_DATABASES, -NATION_1_1%"


_SELECTED = """SELECT *, CASE WHEN name ILIKE 'NATION$_1%' ESCAPE '$' THEN 1 ELSE 2 END AS start_position FROM v_database
  WHERE (name ILIKE 'NATION$_1%' ESCAPE '$' OR database_type = 'U') AND NOT name ILIKE 'NATION$_1$_1%' ESCAPE '$'"""


def _selected(t: Inputs) -> DataFrame:
    chosen = select_by_spec(t.database, DATABASE_SPEC, type_column="database_type")
    return chosen.where("selected")


@query(
    "q_select_databases",
    f"SELECT database_id, name, CAST(start_position AS BIGINT) AS start_position FROM ({_SELECTED}) s",
)
def q_select_databases(t: Inputs) -> DataFrame:
    return _selected(t).select("database_id", "name", "start_position")


_LISTS = """WITH items AS (SELECT server_id, position, trim(item) AS text FROM v_list_item),
  parsed AS (SELECT server_id, position, NOT starts_with(text, '-') AS include, ltrim(text, '-') AS body FROM items),
  patterns AS (SELECT server_id, position, include, body = 'SYSTEM_DATABASES' AS is_system,
    CASE WHEN body = 'SYSTEM_DATABASES' THEN '%' ELSE replace(trim(body, '[]'), '_', '$_') END AS pattern FROM parsed),
  matched AS (SELECT d.database_id, min(CASE WHEN include THEN position END) AS start_position, bool_or(NOT include) AS gone
    FROM v_database d JOIN patterns p ON p.server_id = d.database_id % 5 AND d.name ILIKE p.pattern ESCAPE '$'
      AND (NOT is_system OR d.database_type = 'S') GROUP BY d.database_id)"""


@query(
    "q_select_by_server",
    f"""{_LISTS} SELECT d.database_id % 5 AS server_id, d.database_id, d.name, m.start_position
    FROM v_database d JOIN matched m ON m.database_id = d.database_id WHERE m.start_position IS NOT NULL AND NOT m.gone""",
)
def q_select_by_server(t: Inputs) -> DataFrame:
    """A selection list for every server, from a table of items."""
    databases = t.database.withColumn("server_id", F.col("database_id") % 5)
    chosen = select_by_list(databases, t.list_item, scope=["server_id"], type_column="database_type").where("selected")
    return chosen.select("server_id", "database_id", "name", "start_position")


@query(
    "q_select_groups",
    """SELECT database_id, name, concat('AG_', n_regionkey) AS group_name,
      CAST(CASE WHEN n_regionkey = 2 THEN 1 ELSE 2 END AS BIGINT) AS start_position
    FROM v_database WHERE n_regionkey <> 3""",
)
def q_select_groups(t: Inputs) -> DataFrame:
    databases = t.database
    group = F.concat(F.lit("AG_"), F.col("n_regionkey").cast("string"))
    memberships = databases.select("database_id", group.alias("group_name"))
    groups = t.table("region").select(
        F.concat(F.lit("AG_"), F.col("r_regionkey").cast("string")).alias("group_name")
    )
    spec = "AG_2,ALL_AVAILABILITY_GROUPS,-AG_3"
    return select_by_group(databases.select("database_id", "name"), memberships, groups, spec).select(
        "database_id", "name", "group_name", "start_position"
    )


@query(
    "q_select_indexes",
    """SELECT database_name, object_name, index_name, CAST(partition_number AS BIGINT) AS partition_number,
      CAST(CASE WHEN database_name ILIKE 'DB1%' AND object_name ILIKE 'T12%' THEN 1 ELSE 2 END AS BIGINT) AS start_position
    FROM v_index_cur WHERE ((database_name ILIKE 'DB1%' AND object_name ILIKE 'T12%')
      OR (lower(database_name) = 'db2' AND index_name ILIKE 'IX$_3%' ESCAPE '$')) AND NOT index_name ILIKE '%5'""",
)
def q_select_indexes(t: Inputs) -> DataFrame:
    names = ("database_name", "schema_name", "object_name", "index_name")
    chosen = select_by_spec(
        t.index_cur, "DB1%.dbo.T12%,DB2.dbo.%.IX_3%,-%.%.%.%5", names, optional_last=True
    )
    return chosen.where("selected").select(
        "database_name", "object_name", "index_name", "partition_number", "start_position"
    )


@query(
    "q_select_objects",
    """SELECT database_name, file_group, CAST(1 AS BIGINT) AS start_position, object_name
    FROM (SELECT DISTINCT database_name, object_name, concat('FG', object_id % 4) AS file_group FROM v_index_cur) o
    WHERE object_name ILIKE 'T1%' AND lower(database_name) <> 'db7' AND lower(file_group) <> 'fg3'""",
)
def q_select_objects(t: Inputs) -> DataFrame:
    group = F.concat(F.lit("FG"), (F.col("object_id") % 4).cast("string"))
    objects = t.index_cur.select(
        "database_name", "schema_name", "object_name", group.alias("file_group")
    ).distinct()
    by_name = select_by_spec(
        objects, "%.[dbo].T1%,-DB7.%.%", ("database_name", "schema_name", "object_name")
    ).where("selected")
    by_group = select_by_spec(
        by_name.drop("selected", "start_position"),
        "ALL_FILEGROUPS,-%.FG3",
        ("database_name", "file_group"),
    ).where("selected")
    return by_group.select("database_name", "file_group", "start_position", "object_name")


@query(
    "q_spec_missing",
    """SELECT item FROM (VALUES ('NATION_3_3'), ('NATION_99_1'), ('nowhere')) w(item)
    WHERE lower(item) NOT IN (SELECT lower(name) FROM v_database)""",
)
def q_spec_missing(t: Inputs) -> DataFrame:
    return spec_missing("NATION_3_3,NATION_99_1,-nowhere,NATION_1%", t.database, "name")


@query(
    "q_db_filter",
    """SELECT database_id, name, recovery_model_desc, CAST(compatibility_level AS BIGINT) AS compatibility_level
    FROM v_database WHERE database_id NOT IN (1, 2, 3, 4) AND name ILIKE '%NATION_1%' AND recovery_model_desc = 'FULL'
      AND state_desc = 'ONLINE' AND NOT is_read_only AND name NOT IN ('NATION_1_6', 'NATION_10_12')""",
)
def q_db_filter(t: Inputs) -> DataFrame:
    return filter_databases(
        t.database,
        user_only=True,
        name_pattern="%NATION_1%",
        exclude_list="NATION_1_6, NATION_10_12",
        recovery_model_desc="FULL",
        state_desc="ONLINE",
        is_read_only=False,
    ).select("database_id", "name", "recovery_model_desc", "compatibility_level")


@query(
    "q_foreach_command",
    """SELECT database_id, name, concat('USE [', name, ']; EXEC sys.sp_helpdb ''[', name, ']''') AS command_text
    FROM v_database WHERE database_id NOT IN (1, 2, 3, 4) AND NOT is_read_only""",
)
def q_foreach_command(t: Inputs) -> DataFrame:
    databases = filter_databases(t.database, user_only=True, is_read_only=False)
    return command_for_each(databases, "USE [?]; EXEC sys.sp_helpdb '?'").select(
        "database_id", "name", "command_text"
    )


@query(
    "q_db_replica_anti",
    """SELECT database_id, name FROM v_database
    WHERE NOT (availability_group IS NOT NULL AND n_nationkey % 3 = 0 AND n_regionkey = 1)""",
    fleet=True,
)
def q_db_replica_anti(t: Inputs) -> DataFrame:
    databases = t.database
    states = databases.where(F.col("availability_group").isNotNull()).select(
        *t.scope, "database_id", F.col("n_nationkey").alias("replica_id")
    )
    replicas = t.table("nation").select(
        F.col("n_nationkey").alias("replica_id"),
        F.col("n_regionkey").alias("group_id"),
        F.when(F.col("n_nationkey") % 3 == 0, 0).otherwise(1).alias("secondary_role_allow_connections"),
    )
    groups = t.table("region").select(
        F.col("r_regionkey").alias("group_id"),
        F.when(F.col("r_regionkey") == 1, "SRV_B").otherwise("SRV_A").alias("primary_replica"),
    )
    replicas, groups = t.each(replicas), t.each(groups)
    return exclude_unreadable(databases, states, replicas, groups, "SRV_A", scope=t.scope).select(
        *t.scope, "database_id", "name"
    )


@query(
    "q_suspect",
    "SELECT database_id, name, state_desc FROM v_database WHERE state_desc = 'OFFLINE'",
)
def q_suspect(t: Inputs) -> DataFrame:
    return suspect(t.database, "OFFLINE").select("database_id", "name", "state_desc")


@query(
    "q_db_order",
    f"""SELECT database_id, 'list' AS order_mode, row_number() OVER (ORDER BY start_position, name) AS order_no FROM ({_SELECTED}) a
    UNION ALL SELECT database_id, 'log size', row_number() OVER (ORDER BY log_since_backup_mb DESC NULLS LAST, name) FROM ({_SELECTED}) b
    UNION ALL SELECT database_id, 'size', row_number() OVER (ORDER BY database_size NULLS FIRST, name)
      FROM ({_SELECTED}) c LEFT JOIN (SELECT database_id AS id, sum(size_pages) AS database_size FROM v_file
        WHERE type_desc = 'ROWS' GROUP BY 1) f ON f.id = c.database_id""",
)
def q_db_order(t: Inputs) -> DataFrame:
    chosen = _selected(t)
    sizes = (
        t.file.where(F.col("type_desc") == "ROWS")
        .groupBy("database_id")
        .agg(F.sum("size_pages").alias("database_size"))
    )

    def ordered(df: DataFrame, mode: str | None, label: str) -> DataFrame:
        return order_databases(df, mode).select(
            "database_id", F.lit(label).alias("order_mode"), "order_no"
        )

    return (
        ordered(chosen, None, "list")
        .unionByName(ordered(chosen, "LOG_SIZE_SINCE_LAST_LOG_BACKUP_DESC", "log size"))
        .unionByName(
            ordered(chosen.join(sizes, "database_id", "left"), "DATABASE_SIZE_ASC", "size")
        )
    )


@query(
    "q_dup_names",
    """SELECT file_id, file_name, same_name FROM v_file JOIN (SELECT upper(file_name) AS k, count(*) AS same_name FROM v_file
      GROUP BY 1 HAVING count(*) > 1) d ON d.k = upper(file_name)""",
    fleet=True,
)
def q_dup_names(t: Inputs) -> DataFrame:
    files = t.file.withColumn("fs_name", safe_name("file_name"))
    return duplicate_names(files, "fs_name", scope=t.scope).select(*t.scope, "file_id", "file_name", "same_name")


@query(
    "q_outside_selection",
    """SELECT DISTINCT name FROM v_database WHERE database_type = 'U' AND name NOT IN
      (SELECT name FROM v_database WHERE state_desc = 'ONLINE')""",
)
def q_outside_selection(t: Inputs) -> DataFrame:
    databases = t.database
    selected = databases.withColumn("selected", F.col("state_desc") == "ONLINE")
    return outside_selection(databases.where("database_type = 'U'"), selected)
