"""Users, logins, owners, roles."""

from __future__ import annotations

from hashlib import md5

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslens.operators.principals import (
    ag_job_steps,
    db_owner_drift,
    job_owner_drift,
    orphan_users,
    role_gap,
    users_without_connect,
    wrong_default_schema,
    wrong_domain,
)
from opslens.operators.selection import require_nonempty
from opslens.plans.inputs import Inputs
from opslens.plans.registry import query
from opslens.sources import for_each_partition_of

SYSTEM_SID = md5(b"0").hexdigest()
SYSTEM_OWNER = "Customer#000000000"


@query(
    "q_orphan_users",
    """SELECT principal_id, u.name, concat('USE [', database_name, ']; DROP USER [', u.name, ']') AS command_text
    FROM v_dbuser u WHERE u.type = 'G' AND NOT EXISTS (SELECT 1 FROM v_login l WHERE l.sid = u.sid)""",
)
def q_orphan_users(t: Inputs) -> DataFrame:
    return orphan_users(t.dbuser, t.login).select("principal_id", "name", "command_text")


_SCHEMA_ORACLE = """SELECT database_name, name, default_schema_name,
  concat('USE [', database_name, ']; ALTER USER [', name, '] WITH DEFAULT_SCHEMA=[dbo]') AS command_text
FROM v_dbuser u WHERE name <> 'guest' AND default_schema_name <> 'dbo'"""
_SCHEMA_COLUMNS = ["database_name", "name", "default_schema_name", "command_text"]


@query("q_wrong_schema", _SCHEMA_ORACLE)
def q_wrong_schema(t: Inputs) -> DataFrame:
    return wrong_default_schema(t.dbuser).select(*_SCHEMA_COLUMNS)


@query(
    "q_foreach_union",
    f"""{_SCHEMA_ORACLE} AND EXISTS (SELECT 1 FROM v_database d WHERE d.database_id = u.database_id
      AND d.database_id > 4 AND NOT d.is_read_only)""",
)
def q_foreach_union(t: Inputs) -> DataFrame:
    writable = (F.col("database_id") > 4) & ~F.col("is_read_only")
    found = for_each_partition_of(
        t.dbuser, t.database, wrong_default_schema, database_filter=writable
    )
    return found.select(*_SCHEMA_COLUMNS)


@query(
    "q_wrong_domain",
    """SELECT principal_id, name, type, split_part(name, chr(92), 1) AS domain FROM v_login
    WHERE contains(name, chr(92)) AND type IN ('U', 'G') AND split_part(name, chr(92), 1) NOT IN ('BUILDING', 'MACHINERY')""",
)
def q_wrong_domain(t: Inputs) -> DataFrame:
    return wrong_domain(t.login, ["BUILDING", "MACHINERY"]).select(
        "principal_id", "name", "type", "domain"
    )


@query(
    "q_no_connect",
    """SELECT u.principal_id, u.name, u.type, p.state AS connect_state, false AS has_db_access,
      concat('USE [', database_name, ']; GRANT CONNECT TO [', u.name, ']') AS command_text
    FROM v_dbuser u LEFT JOIN v_permission p ON p.grantee_principal_id = u.principal_id AND p.type = 'CO'
    WHERE u.type IN ('U', 'S', 'G', 'C', 'K', 'E', 'X') AND u.principal_id > 4
      AND (p.state NOT IN ('G', 'W') OR p.state IS NULL)""",
    fleet=True,
)
def q_no_connect(t: Inputs) -> DataFrame:
    return users_without_connect(t.dbuser, t.permission, scope=t.scope).select(
        *t.scope, "principal_id", "name", "type", "connect_state", "has_db_access", "command_text"
    )


@query(
    "q_db_owner",
    f"""SELECT d.database_id, d.name, l.name AS owner_name,
      concat('ALTER AUTHORIZATION ON DATABASE::[', d.name, '] TO [sa]') AS command_text
    FROM v_database d LEFT JOIN v_login l ON l.sid = d.owner_sid
    WHERE d.database_id > 4 AND d.owner_sid <> '{SYSTEM_SID}'""",
    fleet=True,
)
def q_db_owner(t: Inputs) -> DataFrame:
    return db_owner_drift(t.database, t.login, SYSTEM_SID, scope=t.scope).select(
        *t.scope, "database_id", "name", "owner_name", "command_text"
    )


@query(
    "q_job_owner",
    f"""SELECT j.name, j.job_id, l.name AS owner_name,
      concat('EXEC dbo.sp_update_job @job_id = ''', j.job_id, ''', @owner_login_name = ''{SYSTEM_OWNER}''') AS command_text
    FROM v_job j JOIN v_login l ON l.sid = j.owner_sid WHERE l.name <> '{SYSTEM_OWNER}'""",
    fleet=True,
)
def q_job_owner(t: Inputs) -> DataFrame:
    return job_owner_drift(t.job, t.login, SYSTEM_OWNER, scope=t.scope).select(
        *t.scope, "name", "job_id", "owner_name", "command_text"
    )


@query(
    "q_role_gap",
    """WITH m AS (SELECT sid, name FROM v_login WHERE type IN ('S', 'U') AND in_server_role AND name ILIKE '%customer%'),
      u AS (SELECT sid, name, in_db_role FROM v_dbuser WHERE type IN ('S', 'U'))
    SELECT m.name AS login_name, u.name AS user_name,
      CASE WHEN u.name IS NULL THEN concat('CREATE USER [', m.name, '] FOR LOGIN [', m.name, ']') END AS create_user_command,
      concat('ALTER ROLE [db_monitor] ADD MEMBER [', coalesce(u.name, m.name), ']') AS add_member_command
    FROM m LEFT JOIN u ON u.sid = m.sid WHERE u.name IS NULL OR NOT u.in_db_role""",
    fleet=True,
)
def q_role_gap(t: Inputs) -> DataFrame:
    logins, users = t.login, t.dbuser
    return role_gap(
        logins,
        logins.where("in_server_role").select(*t.scope, F.col("principal_id").alias("member_principal_id")),
        users,
        users.where("in_db_role").select(*t.scope, F.col("principal_id").alias("member_principal_id")),
        "db_monitor",
        login_like="%customer%",
        scope=t.scope,
    )


@query(
    "q_role_gap_all",
    """WITH m AS (SELECT principal_id % 3 AS server_id, sid, name FROM v_login WHERE type IN ('S', 'U') AND in_server_role),
      u AS (SELECT principal_id * 2 % 3 AS server_id, principal_id % 40 AS database_id, sid, name, type, in_db_role FROM v_dbuser),
      d AS (SELECT DISTINCT server_id, database_id FROM u)
    SELECT d.server_id, d.database_id, m.name AS login_name, u.name AS user_name,
      CASE WHEN u.name IS NULL THEN concat('CREATE USER [', m.name, '] FOR LOGIN [', m.name, ']') END AS create_user_command,
      concat('ALTER ROLE [db_monitor] ADD MEMBER [', coalesce(u.name, m.name), ']') AS add_member_command
    FROM d JOIN m ON m.server_id = d.server_id LEFT JOIN u
      ON u.server_id = d.server_id AND u.database_id = d.database_id AND u.sid = m.sid AND u.type IN ('S', 'U')
    WHERE u.name IS NULL OR NOT u.in_db_role""",
)
def q_role_gap_all(t: Inputs) -> DataFrame:
    """The gap in every database of three servers."""
    logins = t.login.withColumn("server_id", F.col("principal_id") % 3)
    users = t.dbuser.withColumns(
        {"server_id": F.col("principal_id") * 2 % 3, "database_id": F.col("principal_id") % 40}
    )
    member = F.col("principal_id").alias("member_principal_id")
    holders = logins.where("in_server_role")
    require_nonempty(holders, "nobody has the server role")
    return role_gap(
        logins,
        holders.select("server_id", member),
        users,
        users.where("in_db_role").select("server_id", "database_id", member),
        "db_monitor",
        scope=["server_id"],
        database=["database_id"],
    )


@query(
    "q_ag_job_steps",
    """SELECT job_name, CAST(step_id AS BIGINT) AS step_id, database_name,
      concat('IF sys.fn_hadr_is_primary_replica(DB_NAME()) = 1', chr(10), 'BEGIN', chr(10), command, chr(10), 'END') AS new_command
    FROM v_job_step WHERE subsystem = 'TSQL' AND command NOT ILIKE '%fn_hadr_is_primary_replica%'
      AND database_name IN (SELECT n_name FROM nation WHERE n_regionkey = 1)""",
)
def q_ag_job_steps(t: Inputs) -> DataFrame:
    replicated = t.table("nation").where(F.col("n_regionkey") == 1)
    return ag_job_steps(
        t.job_step, replicated.select(F.col("n_name").alias("database_name"))
    ).select("job_name", "step_id", "database_name", "new_command")
