"""Activity, statements, memory, waits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslens.functions import extract_statement, fmt_duration, isolation_name
from opslens.operators.sessions import (
    backup_progress,
    classify_page,
    executer,
    resolve_agent_job,
    resolve_wait_resource,
    sessions_all,
    who,
    with_batch_text,
    with_child_tasks,
    with_memory,
    with_wait_resource,
)
from opslens.plans.inputs import AS_OF, Inputs
from opslens.plans.registry import query


def _two(expr: str) -> str:
    return f"lpad(CAST({expr} AS VARCHAR), 2, '0')"


def _duration(ms: str) -> str:
    return (
        f"concat({ms} // 86400000, 'd', {_two(f'({ms} // 3600000) % 24')}, ':', "
        f"{_two(f'({ms} // 60000) % 60')}, ':', {_two(f'({ms} // 1000) % 60')}, ':', "
        f"lpad(CAST({ms} % 1000 AS VARCHAR), 3, '0'))"
    )


def _isolation(c: str) -> str:
    return (
        f"CASE {c} WHEN 0 THEN 'Unspecified' WHEN 1 THEN 'Read Uncommitted' WHEN 2 THEN 'Read Committed' "
        "WHEN 3 THEN 'Repeatable Read' WHEN 4 THEN 'Serializable' WHEN 5 THEN 'Snapshot' END"
    )


_EXECUTER = """CASE
  WHEN s.program_name ILIKE 'SQLAgent - TSQL JobStep%'
    THEN concat(j.name, '; ', replace(substring(s.program_name, 67, 20), ')', ''))
  WHEN s.program_name ILIKE 'Microsoft SQL Server Management Studio%' THEN concat(s.host_name, ' - SSMS')
  WHEN s.program_name ILIKE 'SQL Monitor%' THEN 'SQL Monitor'
  WHEN s.program_name ILIKE 'DatabaseMail%' THEN 'Db Mail'
  WHEN s.program_name ILIKE 'Microsoft SQL Server' THEN concat(s.host_name, ' - SS')
  ELSE s.program_name END"""

_JOB_JOIN = """LEFT JOIN v_job j ON s.program_name ILIKE 'SQLAgent - TSQL JobStep%'
  AND substring(s.program_name, 32, 32) = upper(md5(CAST(j.job_number AS VARCHAR)))"""


def _statement(r: str = "r", b: str = "b") -> str:
    stop = (
        f"CASE WHEN {r}.statement_end_offset = -1 THEN length(rtrim({b}.text)) * 2 "
        f"ELSE {r}.statement_end_offset END"
    )
    return (
        f"substring({b}.text, {r}.statement_start_offset // 2 + 1, "
        f"greatest((({stop}) - {r}.statement_start_offset) // 2 + 1, 0))"
    )


_WHO_COLUMNS = [
    "request_id", "session_id", "login_name", "executer", "command", "status", "database_name",
    "blocking_session_id", "executing_statement", "batch_hash", "elapsed_text", "cpu_text",
    "percent_complete_text", "command_isolation", "session_isolation", "session_open_transactions",
    "client_net_address", "net_transport", "auth_scheme", "host_name",
]

_WHO_ORACLE = f"""
SELECT r.request_id, r.session_id, s.login_name, {_EXECUTER} AS executer, r.command, r.status,
  r.database_name, r.blocking_session_id, {_statement()} AS executing_statement,
  md5(b.text) AS batch_hash, {_duration('r.total_elapsed_ms')} AS elapsed_text,
  {_duration('r.cpu_ms')} AS cpu_text,
  concat(CAST(CAST(ROUND(r.percent_complete, 2) AS DECIMAL(15, 2)) AS VARCHAR), '%') AS percent_complete_text,
  {_isolation('r.isolation_level')} AS command_isolation, {_isolation('s.isolation_level')} AS session_isolation,
  CAST(s.open_transaction_count AS BIGINT) AS session_open_transactions,
  c.client_net_address, c.net_transport, c.auth_scheme, s.host_name
FROM v_request r
LEFT JOIN v_connection c ON c.session_id = r.session_id
LEFT JOIN v_session s ON s.session_id = r.session_id
LEFT JOIN v_batch b ON b.sql_handle = r.sql_handle
{_JOB_JOIN}
"""


def _who(t: Inputs, **options) -> DataFrame:
    report = who(
        t.request, t.session, connections=t.connection, batches=t.batch, jobs=t.job, **options
    )
    return report.withColumn("batch_hash", F.md5("batch_text")).select(*_WHO_COLUMNS)


@query("q_who", _WHO_ORACLE + "WHERE r.session_id <> 1 AND s.is_user_process")
def q_who(t: Inputs) -> DataFrame:
    return _who(t, exclude_sessions=(1,))


@query(
    "q_who_filtered",
    _WHO_ORACLE
    + """WHERE s.is_user_process AND s.login_name ILIKE '%0001%' AND r.blocking_session_id > 0
  AND r.command ILIKE '%back%'""",
)
def q_who_filtered(t: Inputs) -> DataFrame:
    return _who(t, login="0001", is_blocked=True, command="back")


@query(
    "q_who_sorted",
    _WHO_ORACLE + "WHERE r.total_elapsed_ms > 400000000 AND r.command = 'SELECT'",
)
def q_who_sorted(t: Inputs) -> DataFrame:
    return _who(
        t,
        user_processes=None,
        where="total_elapsed_ms > 400000000 AND command = 'SELECT'",
        order_by="total_elapsed_ms DESC, request_id",
    )


@query(
    "q_who_memory",
    """SELECT r.request_id, r.session_id, r.command, g.requested_memory_kb / 1024.0 AS requested_memory_mb,
      g.granted_memory_kb / 1024.0 AS granted_memory_mb
    FROM v_request r LEFT JOIN v_grant g ON g.session_id = r.session_id AND g.request_id = r.request_id""",
)
def q_who_memory(t: Inputs) -> DataFrame:
    return with_memory(t.request, t.grant).select(
        "request_id", "session_id", "command", "requested_memory_mb", "granted_memory_mb"
    )


_PAGE = "TRY_CAST(string_split(resource_description, ':')[3] AS BIGINT)"
_CLASSIFIED = f"""SELECT *, CASE WHEN p = 1 OR p % 8088 = 0 THEN 'Is PFS Page'
    WHEN p = 2 OR p % 511232 = 0 THEN 'Is GAM Page'
    WHEN p = 3 OR (p - 1) % 511232 = 0 THEN 'Is SGAM Page' END AS page_class
  FROM (SELECT *, CASE WHEN wait_type ILIKE 'PAGE%LATCH_%' THEN {_PAGE} END AS p FROM v_wait) w"""


@query(
    "q_who_tasks",
    f"""WITH classified AS ({_CLASSIFIED}),
    counts AS (SELECT request_id, count(*) AS n FROM v_task GROUP BY request_id)
    SELECT r.request_id, r.session_id, r.command, coalesce(n, 0) AS task_count,
      CAST(k.exec_context_id AS BIGINT) AS exec_context_id, k.task_state, w.wait_type AS task_wait_type,
      concat(w.resource_description, CASE WHEN page_class IS NOT NULL THEN concat('(', page_class, ')') ELSE '' END)
        AS task_wait_resource
    FROM v_request r LEFT JOIN counts USING (request_id) LEFT JOIN v_task k USING (request_id)
    LEFT JOIN classified w ON w.request_id = r.request_id AND w.exec_context_id = k.exec_context_id""",
)
def q_who_tasks(t: Inputs) -> DataFrame:
    requests = t.request.select("request_id", "session_id", "command")
    out = with_child_tasks(
        requests, t.task, t.wait, ["request_id"], ["request_id", "exec_context_id"]
    )
    return out.select(
        "request_id", "session_id", "command", "task_count", "exec_context_id", "task_state", "task_wait_type",
        F.coalesce("task_wait_resource", F.lit("")).alias("task_wait_resource"),
    )


@query(
    "q_wait_page_class",
    f"""SELECT request_id, CAST(exec_context_id AS BIGINT) AS exec_context_id, wait_type, p AS page_id, page_class
    FROM ({_CLASSIFIED}) c""",
)
def q_wait_page_class(t: Inputs) -> DataFrame:
    return classify_page(t.wait).select(
        "request_id", "exec_context_id", "wait_type", "page_id", "page_class"
    )


_PARSED = """SELECT request_id, exec_context_id, kind,
    CASE WHEN kind IS NOT NULL THEN TRY_CAST(f[1] AS BIGINT) END AS wait_database_id,
    CASE WHEN kind = 'KEY' THEN TRY_CAST(trim(f[2]) AS BIGINT) END AS hobt_id,
    CASE WHEN kind = 'OBJECT' THEN TRY_CAST(f[2] AS BIGINT) END AS wait_object_id,
    CASE WHEN kind IN ('PAGE', 'RID') THEN TRY_CAST(f[2] AS BIGINT) END AS file_id,
    CASE WHEN kind IN ('PAGE', 'RID') THEN TRY_CAST(f[3] AS BIGINT) END AS page_id,
    CASE WHEN kind = 'RID' THEN TRY_CAST(f[4] AS BIGINT) END AS row_id
  FROM (SELECT request_id, exec_context_id,
      CASE WHEN wait_resource LIKE '%: %' THEN split_part(wait_resource, ': ', 1) END AS kind,
      string_split(split_part(split_part(wait_resource, ': ', 2), '(', 1), ':') AS f FROM v_wait) x"""


@query(
    "q_wait_resource",
    f"""SELECT request_id, CAST(exec_context_id AS BIGINT) AS exec_context_id, kind AS resource_kind,
      wait_database_id, hobt_id, wait_object_id, file_id, page_id, row_id FROM ({_PARSED}) p""",
)
def q_wait_resource(t: Inputs) -> DataFrame:
    return with_wait_resource(t.wait).select(
        "request_id", "exec_context_id", "resource_kind", "wait_database_id", "hobt_id",
        "wait_object_id", "file_id", "page_id", "row_id",
    )


@query(
    "q_who_full",
    """SELECT r.session_id % 3 AS server_id, r.request_id, r.session_id, g.name AS resource_pool,
      m.requested_memory_kb / 1024.0 AS requested_memory_mb, m.granted_memory_kb / 1024.0 AS granted_memory_mb,
      CAST(NULL AS VARCHAR) AS task_state, CAST(NULL AS BIGINT) AS exec_context_id
    FROM v_request r JOIN v_session s ON s.session_id = r.session_id AND s.is_user_process
    LEFT JOIN v_group g ON g.group_id = r.session_id % 9 AND g.server_id = r.session_id % 3
    LEFT JOIN v_grant m ON m.session_id = r.session_id AND m.request_id = r.request_id""",
)
def q_who_full(t: Inputs) -> DataFrame:
    """Groups and grants of three servers that number their groups alike."""
    server = F.col("session_id") % 3
    report = who(
        t.request.withColumn("server_id", server),
        t.session.withColumn("server_id", server).withColumn("group_id", F.col("session_id") % 9),
        grants=t.grant.withColumn("server_id", server),
        groups=t.group,
        scope=["server_id"],
    )
    return report.select(
        "server_id", "request_id", "session_id", "resource_pool",
        F.col("requested_memory_mb").cast("double").alias("requested_memory_mb"),
        F.col("granted_memory_mb").cast("double").alias("granted_memory_mb"),
        "task_state", "exec_context_id",
    )


_WIDE = [
    "server_id", "request_id", "session_id", "login_name", "executer", "host_name", "command", "status", "database_name",
    "blocking_session_id", "elapsed_text", "cpu_text", "wait_type", "wait_text", "last_wait_type", "wait_resource",
    "percent_complete_text", "command_isolation", "session_isolation", "memory_usage", "login_time", "reads", "writes",
    "logical_reads", "start_time", "resource_pool", "client_net_address", "net_transport", "auth_scheme", "query_cost",
    "request_time", "grant_time", "task_count", "exec_context_id", "task_state", "context_switches_count",
    "scheduler_id", "pending_io_count", "pending_io_byte_count", "pending_io_byte_average", "task_wait_type",
    "task_wait_resource", "task_blocking_session_id",
]
_WIDE_MEMORY = ["requested", "granted", "required", "used", "max_used", "ideal"]


@query(
    "q_who_wide",
    f"""WITH counts AS (SELECT server_id, session_id, request_id, count(*) AS n FROM v_wide_task GROUP BY 1, 2, 3),
    waits AS (SELECT *, CASE WHEN wait_type LIKE 'PAGE%' THEN CAST(split_part(resource_description, ':', 3) AS BIGINT) END AS p
      FROM v_wide_wait),
    classified AS (SELECT *, CASE WHEN p = 1 OR p % 8088 = 0 THEN '(Is PFS Page)' WHEN p = 2 OR p % 511232 = 0 THEN '(Is GAM Page)'
      WHEN p = 3 OR (p - 1) % 511232 = 0 THEN '(Is SGAM Page)' ELSE '' END AS page_class FROM waits)
    SELECT r.server_id, r.request_id, r.session_id, coalesce(s.original_login_name, s.login_name) AS login_name,
      s.program_name AS executer, s.host_name, r.command, r.status, r.database_name, r.blocking_session_id,
      {_duration('r.total_elapsed_ms')} AS elapsed_text, {_duration('r.cpu_ms')} AS cpu_text, r.wait_type,
      {_duration('r.wait_time')} AS wait_text, r.last_wait_type, r.wait_resource,
      concat(CAST(CAST(ROUND(r.percent_complete, 2) AS DECIMAL(15, 2)) AS VARCHAR), '%') AS percent_complete_text,
      {_isolation('r.isolation_level')} AS command_isolation, {_isolation('s.isolation_level')} AS session_isolation,
      CAST(s.memory_usage AS BIGINT) AS memory_usage, s.login_time, r.reads, r.writes, r.logical_reads, r.start_time,
      g.name AS resource_pool, s.client_net_address, s.net_transport, s.auth_scheme, m.query_cost, m.request_time, m.grant_time,
      coalesce(n, 0) AS task_count, CAST(k.exec_context_id AS BIGINT) AS exec_context_id, k.task_state,
      CAST(k.context_switches_count AS BIGINT) AS context_switches_count, CAST(k.scheduler_id AS BIGINT) AS scheduler_id,
      CAST(k.pending_io_count AS BIGINT) AS pending_io_count, k.pending_io_byte_count,
      CAST(k.pending_io_byte_average AS BIGINT) AS pending_io_byte_average, w.wait_type AS task_wait_type,
      concat(w.resource_description, w.page_class) AS task_wait_resource, w.blocking_session_id AS task_blocking_session_id,
      {", ".join(f"m.{c}_memory_kb / 1024.0 AS {c}_memory_mb" for c in _WIDE_MEMORY)}
    FROM v_wide_request r JOIN v_wide_session s ON s.server_id = r.server_id AND s.session_id = r.session_id AND s.is_user_process
    LEFT JOIN v_group g ON g.server_id = r.server_id AND g.group_id = s.group_id
    LEFT JOIN v_wide_grant m ON m.server_id = r.server_id AND m.session_id = r.session_id AND m.request_id = r.request_id
    LEFT JOIN counts c ON c.server_id = r.server_id AND c.session_id = r.session_id AND c.request_id = r.request_id
    LEFT JOIN v_wide_task k ON k.server_id = r.server_id AND k.session_id = r.session_id AND k.request_id = r.request_id
    LEFT JOIN classified w ON w.server_id = k.server_id AND w.session_id = k.session_id AND w.exec_context_id = k.exec_context_id""",
)
def q_who_wide(t: Inputs) -> DataFrame:
    """The whole width of the report, a row per task, over three servers that number their sessions alike."""
    sessions = t.wide_session
    report = who(
        t.wide_request, sessions, connections=sessions, grants=t.wide_grant, groups=t.group, tasks=t.wide_task,
        waits=t.wide_wait, child_tasks=True, scope=["server_id"],
    )
    resource = F.when(F.col("task_wait_type").isNull(), "").otherwise(F.col("task_wait_resource"))
    report = report.withColumn("task_wait_resource", resource)
    memory = [F.col(f"{c}_memory_mb").cast("double").alias(f"{c}_memory_mb") for c in _WIDE_MEMORY]
    return report.select(*_WIDE, *memory)


@query(
    "q_wait_object",
    f"""SELECT w.request_id, CAST(w.exec_context_id AS BIGINT) AS exec_context_id, w.kind AS resource_kind,
      w.wait_database_id, coalesce(w.wait_object_id, p.object_id) AS object_id, n.object_name,
      CAST(p.index_id AS BIGINT) AS index_id,
      CASE WHEN p.index_id IS NOT NULL THEN concat('IX_', p.database_id, '_', p.object_id, '_', p.index_id) END AS index_name,
      p.partition_id
    FROM ({_PARSED}) w LEFT JOIN v_partition p
      ON p.hobt_id = coalesce(w.hobt_id, w.page_id) AND p.database_id = w.wait_database_id
    LEFT JOIN v_wait_name n ON n.object_id = coalesce(w.wait_object_id, p.object_id) AND n.database_id = w.wait_database_id""",
    fleet=True,
)
def q_wait_object(t: Inputs) -> DataFrame:
    partitions = t.partition
    pages = partitions.withColumn("page_id", F.col("hobt_id")).withColumn("file_id", F.lit(1))
    indexes = (
        partitions.select(*t.scope, "database_id", "object_id", "index_id")
        .distinct()
        .withColumn("index_name", F.concat_ws("_", F.lit("IX"), "database_id", "object_id", "index_id"))
    )
    resolved = resolve_wait_resource(
        with_wait_resource(t.wait), partitions, pages, t.wait_name, indexes,
        ["request_id", "exec_context_id"], scope=t.scope,
    )
    return resolved.select(
        *t.scope, "request_id", "exec_context_id", "resource_kind", "wait_database_id", "object_id",
        "object_name", "index_id", "index_name", "partition_id",
    )


@query(
    "q_sessions_all",
    """SELECT s.session_id, s.login_name, s.status, r.request_id, r.command, r.status AS request_status,
      coalesce(r.blocking_session_id, 0) AS blocking_session_id, c.client_net_address
    FROM v_session s LEFT JOIN v_request r ON r.session_id = s.session_id
    LEFT JOIN v_connection c ON c.session_id = s.session_id""",
)
def q_sessions_all(t: Inputs) -> DataFrame:
    sessions = t.session.drop("blocking_session_id")
    return sessions_all(sessions, t.request, t.connection).select(
        "session_id", "login_name", "status", "request_id", "command", "request_status",
        "blocking_session_id", "client_net_address",
    )


@query(
    "q_executer",
    f"SELECT s.session_id, s.host_name, {_EXECUTER} AS executer FROM v_session s {_JOB_JOIN}",
)
def q_executer(t: Inputs) -> DataFrame:
    return resolve_agent_job(t.session, t.job).select(
        "session_id", "host_name", executer().alias("executer")
    )


@query(
    "q_statement",
    f"""SELECT r.request_id, {_statement()} AS executing_statement, length(b.text) AS batch_chars
    FROM v_request r LEFT JOIN v_batch b ON b.sql_handle = r.sql_handle""",
)
def q_statement(t: Inputs) -> DataFrame:
    return with_batch_text(t.request, t.batch).select(
        "request_id",
        extract_statement("batch_text", "statement_start_offset", "statement_end_offset").alias(
            "executing_statement"
        ),
        F.length("batch_text").alias("batch_chars"),
    )


@query(
    "q_durations",
    f"""SELECT request_id, {_duration('total_elapsed_ms')} AS elapsed_text, {_duration('cpu_ms')} AS cpu_text
    FROM v_request""",
)
def q_durations(t: Inputs) -> DataFrame:
    return t.request.select(
        "request_id",
        fmt_duration("total_elapsed_ms").alias("elapsed_text"),
        fmt_duration("cpu_ms").alias("cpu_text"),
    )


@query(
    "q_isolation_mix",
    f"""SELECT {_isolation('isolation_level')} AS isolation, count(*) AS requests,
      CAST(sum(cpu_ms) AS BIGINT) AS cpu_ms, max(total_elapsed_ms) AS max_elapsed_ms
    FROM v_request GROUP BY 1""",
)
def q_isolation_mix(t: Inputs) -> DataFrame:
    return t.request.groupBy(isolation_name("isolation_level").alias("isolation")).agg(
        F.count(F.lit(1)).alias("requests"),
        F.sum("cpu_ms").alias("cpu_ms"),
        F.max("total_elapsed_ms").alias("max_elapsed_ms"),
    )


@query(
    "q_backup_progress",
    f"""SELECT r.request_id, r.session_id, r.command, md5(b.text) AS batch_hash, r.start_time, r.percent_complete,
      strftime(TIMESTAMP '{AS_OF}' + INTERVAL '1' SECOND * CAST(r.estimated_completion_ms // 1000 AS INT), '%H:%M:%S')
        AS estimated_completion_time
    FROM v_request r JOIN v_batch b ON b.sql_handle = r.sql_handle
    WHERE r.command LIKE 'BACKUP%' OR r.command LIKE 'RESTORE%'""",
)
def q_backup_progress(t: Inputs) -> DataFrame:
    return backup_progress(t.request, t.batch, AS_OF).select(
        "request_id", "session_id", "command", F.md5("batch_text").alias("batch_hash"),
        "start_time", "percent_complete", "estimated_completion_time",
    )
