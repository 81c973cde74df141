"""Who is running what: requests, statements, memory, waits and tasks."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslens.functions import (
    any_of,
    concat_nullsafe,
    extract_statement,
    fmt_duration,
    isolation_name,
    like_ci,
    plus_seconds,
    swapped_guid_hex,
    time_of_day,
    ts,
)
from opslens.operators.joins import left_join_hot, lookup
from opslens.operators.selection import (
    commands_like,
    contains_filters,
    eq_filters,
    exclude_ids,
    order_expr,
    tristate,
    where_expr,
)

# Program-name prefixes and the labels shown for them.
AGENT_STEP = "SQLAgent - TSQL JobStep%"
AGENT_JOB_AT, AGENT_JOB_SIZE = 32, 32
AGENT_STEP_AT, AGENT_STEP_SIZE = 67, 20
STUDIO = "Microsoft SQL Server Management Studio%"
MONITOR = "SQL Monitor%"
MAIL = "DatabaseMail%"
SERVER = "Microsoft SQL Server"

MEMORY_COLUMNS = (
    "requested_memory_kb",
    "granted_memory_kb",
    "required_memory_kb",
    "used_memory_kb",
    "max_used_memory_kb",
    "ideal_memory_kb",
)


def _or_null(df: DataFrame, column: str, kind: str) -> Column:
    return F.col(column) if column in df.columns else F.lit(None).cast(kind).alias(column)


# ---------------------------------------------------------------- executer


def resolve_agent_job(sessions: DataFrame, jobs: DataFrame) -> DataFrame:
    """Attach ``job_name`` through the job id printed inside the agent's program name.

    The id is byte-swapped on the job side once, so this is a plain equi-join.
    """
    printed = F.upper(F.substring("program_name", AGENT_JOB_AT, AGENT_JOB_SIZE))
    agent_key = F.when(like_ci("program_name", AGENT_STEP), printed)
    # Sessions of other programs cannot match: give each its own key instead of one NULL.
    key = F.coalesce(agent_key, F.concat(F.lit("-"), F.xxhash64("session_id").cast("string")))
    named = jobs.select(
        swapped_guid_hex("job_id").alias("__job"), F.col("name").alias("job_name")
    )
    return sessions.join(named, key == F.col("__job"), "left").drop("__job")


def executer(program: str = "program_name", host: str = "host_name", job: str = "job_name") -> Column:
    """What is behind a session: agent job step, tool, mail, server, or the program itself."""
    step = F.replace(
        F.substring(program, AGENT_STEP_AT, AGENT_STEP_SIZE), F.lit(")"), F.lit("")
    )
    return (
        F.when(like_ci(program, AGENT_STEP), concat_nullsafe(F.col(job), "; ", step))
        .when(like_ci(program, STUDIO), concat_nullsafe(F.col(host), " - SSMS"))
        .when(like_ci(program, MONITOR), "SQL Monitor")
        .when(like_ci(program, MAIL), "Db Mail")
        .when(F.lower(program) == SERVER.lower(), concat_nullsafe(F.col(host), " - SS"))
        .otherwise(F.col(program))
    )


# ---------------------------------------------------------------- request parts


def with_batch_text(
    requests: DataFrame, batches: DataFrame, how: str = "left", scope: Sequence[str] = ()
) -> DataFrame:
    """Batch text by handle; ``how="inner"`` drops requests without text."""
    texts = batches.select(*scope, "sql_handle", F.col("text").alias("batch_text"))
    return requests.join(texts, [*scope, "sql_handle"], how)


def with_memory(requests: DataFrame, grants: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Memory-grant figures in MB; requests without a grant keep NULLs."""
    present = [c for c in MEMORY_COLUMNS if c in grants.columns]
    other = [c for c in ("query_cost", "request_time", "grant_time") if c in grants.columns]
    mb = grants.select(
        *scope,
        "session_id",
        "request_id",
        *[(F.col(c) / 1024.0).alias(c.replace("_kb", "_mb")) for c in present],
        *other,
    )
    return requests.join(mb, [*scope, "session_id", "request_id"], "left")


def classify_page(waits: DataFrame) -> DataFrame:
    """Page id and allocation-page class of page latch waits; the first matching class wins."""
    page = F.col("page_id")
    kind = (
        F.when((page == 1) | (page % 8088 == 0), "Is PFS Page")
        .when((page == 2) | (page % 511232 == 0), "Is GAM Page")
        .when((page == 3) | ((page - 1) % 511232 == 0), "Is SGAM Page")
    )
    third = F.try_element_at(F.split("resource_description", ":"), F.lit(3)).try_cast("long")
    suffix = F.when(
        F.col("page_class").isNotNull(), F.concat(F.lit("("), F.col("page_class"), F.lit(")"))
    ).otherwise("")
    return (
        waits.withColumn("page_id", F.when(like_ci("wait_type", "PAGE%LATCH_%"), third))
        .withColumn("page_class", kind)
        .withColumn("wait_resource_text", F.concat(F.col("resource_description"), suffix))
    )


def task_count(tasks: DataFrame, keys: Sequence[str]) -> DataFrame:
    return tasks.groupBy(*keys).agg(F.count(F.lit(1)).alias("task_count"))


# Columns that a task adds to a request.
TASK_COLUMNS = {
    "exec_context_id": "int",
    "task_state": "string",
    "task_wait_type": "string",
    "task_wait_resource": "string",
    "task_blocking_session_id": "long",
}


def with_child_tasks(
    requests: DataFrame,
    tasks: DataFrame,
    waits: DataFrame | None = None,
    keys: Sequence[str] = ("session_id", "request_id"),
    wait_keys: Sequence[str] = ("session_id", "exec_context_id"),
) -> DataFrame:
    """One row per task of a request, with the wait of that task.

    Waits and counts meet the narrow tasks, and a request without a task gets one empty row among them.  Then the
    requests, with all their columns, are joined once, in an inner join whose hot keys can be split on both sides.
    """
    keys, wait_keys = list(keys), list(wait_keys)
    columns = [
        F.col(c).alias(f"task_{c}" if c in requests.columns else c)
        for c in tasks.columns
        if c not in keys
    ]
    counts = task_count(tasks, keys)
    expanded = tasks.select(*keys, *columns)
    if waits is not None:
        classified = classify_page(waits).select(
            *wait_keys,
            F.col("wait_type").alias("task_wait_type"),
            F.col("wait_resource_text").alias("task_wait_resource"),
            _or_null(waits, "blocking_session_id", "long").alias("task_blocking_session_id"),
        )
        expanded = expanded.join(classified, wait_keys, "left")  # no task is hot
    expanded = expanded.join(counts, keys)
    idle = requests.select(*keys).distinct().join(counts, keys, "left_anti")
    none = F.lit(0).cast("long").alias("task_count")
    expanded = expanded.unionByName(idle.select("*", none), allowMissingColumns=True)
    unnamed = requests.where(any_of(F.col(k).isNull() for k in keys)).withColumn("task_count", none)
    return requests.join(expanded, keys).unionByName(unnamed, allowMissingColumns=True)


# ---------------------------------------------------------------- activity report


def who(
    requests: DataFrame,
    sessions: DataFrame,
    *,
    connections: DataFrame | None = None,
    batches: DataFrame | None = None,
    jobs: DataFrame | None = None,
    grants: DataFrame | None = None,
    groups: DataFrame | None = None,
    tasks: DataFrame | None = None,
    waits: DataFrame | None = None,
    child_tasks: bool = False,
    user_processes: bool | None = True,
    login: str | None = None,
    command: str | None = None,
    is_blocked: bool | None = None,
    status: str | None = None,
    session_id: int | None = None,
    database: str | None = None,
    host: str | None = None,
    executer_name: str | None = None,
    exclude_sessions: Sequence[int] = (),
    where: str | None = None,
    order_by: str | None = None,
    scope: Sequence[str] = (),
) -> DataFrame:
    """One row per request, or per task of a request with ``child_tasks``.

    Filters on request and session columns are applied before the wide joins.  The login is the original
    one where the sessions have it.  Without ``child_tasks`` the columns of a task are NULL.
    """
    scope = list(scope)
    by_session = [*scope, "session_id"]
    requests = exclude_ids(requests, "session_id", exclude_sessions) if exclude_sessions else requests
    requests = tristate(requests, "blocking_session_id", is_blocked)
    requests = contains_filters(
        requests, {"command": command, "status": status, "database_name": database}
    )
    requests = eq_filters(requests, {"session_id": session_id})

    s = sessions if jobs is None else resolve_agent_job(sessions, jobs)
    if "original_login_name" in s.columns:
        s = s.withColumn("login_name", F.coalesce("original_login_name", "login_name"))
    s = s if "job_name" in s.columns else s.withColumn("job_name", F.lit(None).cast("string"))
    s = s.withColumn("executer", executer())
    session_filters = {"login_name": login, "host_name": host, "executer": executer_name}
    restricted = user_processes is not None or any(v is not None for v in session_filters.values())
    s = contains_filters(tristate(s, "is_user_process", user_processes), session_filters)
    s = s.select(
        *by_session, "login_name", "executer", "is_user_process", "host_name", "program_name",
        F.col("isolation_level").alias("session_isolation_level"),
        F.col("open_transaction_count").alias("session_open_transactions"),
        _or_null(s, "memory_usage", "int"),
        _or_null(s, "login_time", "timestamp_ntz"),
        _or_null(s, "group_id", "int"),
    )

    # Sessions and connections have one row per session, so they meet first and the requests,
    # where a busy session repeats, are joined only once.  A filter on session columns is
    # never true for a request without a session row.
    if connections is not None:
        c = connections.select(
            *by_session, "client_net_address", "net_transport", "auth_scheme",
            _or_null(connections, "connect_time", "timestamp_ntz"),
        )
        s = s.join(c, by_session, "left" if restricted else "full")
    out = requests.join(s, by_session, "inner" if restricted else "left")
    if grants is not None:
        out = with_memory(out, grants, scope)
    if groups is not None:
        pools = groups.select(*scope, "group_id", F.col("name").alias("resource_pool"))
        out = out.join(pools, [*scope, "group_id"], "left")

    by_request = [*scope, "session_id", "request_id"]
    if child_tasks:
        if tasks is None:
            raise ValueError("child_tasks needs the tasks table")
        out = with_child_tasks(out, tasks, waits, by_request, [*by_session, "exec_context_id"])
    if not child_tasks:
        out = out.withColumns({c: F.lit(None).cast(t) for c, t in TASK_COLUMNS.items() if c not in out.columns})
    if tasks is not None and not child_tasks:
        out = out.join(task_count(tasks, by_request), by_request, "left").withColumn(
            "task_count", F.coalesce("task_count", F.lit(0))
        )
    if batches is not None:  # last, so that no text goes through another join
        out = with_batch_text(out, batches, "left", scope).withColumn(
            "executing_statement",
            extract_statement("batch_text", "statement_start_offset", "statement_end_offset"),
        )

    out = (
        out.withColumn("elapsed_text", fmt_duration("total_elapsed_ms"))
        .withColumn("cpu_text", fmt_duration("cpu_ms"))
        .withColumn(
            "percent_complete_text",
            concat_nullsafe(F.round("percent_complete", 2).cast("decimal(15,2)"), "%"),
        )
        .withColumn("command_isolation", isolation_name("isolation_level"))
        .withColumn("session_isolation", isolation_name("session_isolation_level"))
    )
    if "wait_time" in out.columns:
        out = out.withColumn("wait_text", fmt_duration("wait_time"))
    return order_expr(where_expr(out, where, out.columns), order_by, out.columns)


def sessions_all(
    sessions: DataFrame,
    requests: DataFrame,
    connections: DataFrame | None = None,
    scope: Sequence[str] = (),
) -> DataFrame:
    """Session-driven view: idle sessions stay, with no request columns and blocker 0."""
    by_session = [*scope, "session_id"]
    shared = [c for c in requests.columns if c in sessions.columns and c not in by_session]
    if connections is not None:
        sessions = sessions.join(connections, by_session, "left")
    out = left_join_hot(
        sessions,
        requests.select(
            *[F.col(c).alias(f"request_{c}") if c in shared else F.col(c) for c in requests.columns]
        ),
        by_session,
        null_keys=False,
    )
    blocker = "blocking_session_id"
    return out.withColumn(blocker, F.coalesce(F.col(blocker), F.lit(0).cast("long")))


# ---------------------------------------------------------------- wait resources


def with_wait_resource(df: DataFrame, column: str = "wait_resource") -> DataFrame:
    """Columns for ``KEY: db:hobt (hash)``, ``OBJECT: db:obj:..``, ``PAGE: db:file:page`` and
    ``RID: db:file:page:row``; other texts give NULLs.

    The text is split once; everything else reads the parts.
    """
    kinds = ("KEY", "OBJECT", "PAGE", "RID")
    parts = F.col("__parts")
    kind = F.col("resource_kind")

    def number(n: int, *of: str) -> Column:
        value = F.try_element_at(parts, F.lit(n + 1)).try_cast("long")
        return F.when(kind.isin(*of), value)

    first = F.try_element_at(parts, F.lit(1))
    return (
        df.withColumn("__parts", F.split(F.upper(F.col(column)), "[: ()]+"))
        .withColumn("resource_kind", F.when(first.isin(*kinds), first))
        .select(
            *df.columns,
            "resource_kind",
            number(1, *kinds).alias("wait_database_id"),
            number(2, "KEY").alias("hobt_id"),
            number(2, "OBJECT").alias("wait_object_id"),
            number(2, "PAGE", "RID").alias("file_id"),
            number(3, "PAGE", "RID").alias("page_id"),
            number(4, "RID").alias("row_id"),
        )
    )


def resolve_wait_resource(
    waits: DataFrame,
    partitions: DataFrame,
    pages: DataFrame,
    objects: DataFrame,
    indexes: DataFrame,
    row_id: Sequence[str],
    *,
    scope: Sequence[str],
) -> DataFrame:
    """From a parsed wait resource to object, index and partition.

    ``partitions`` are keyed by ``scope``, database_id and hobt_id; ``pages`` (which only a collector can
    deliver) by file_id and page_id instead; ``objects`` and ``indexes`` by object_id and index_id.  Names
    are resolved among these tables, which become one map, so the waits are joined once.  A wait without a
    key has a kind that the map lacks.  Forms nobody knows resolve to NULL.
    """
    database = [*scope, "database_id"]
    columns = ["object_id", "index_id", "partition_id", "object_name", "index_name"]
    none = F.lit(None).cast("long")

    def entries(table: DataFrame, kind: str, key: str, file: Column) -> DataFrame:
        return table.select(
            *database, F.lit(kind).alias("__kind"), F.col(key).cast("long").alias("__key"),
            file.cast("long").alias("__file"), *columns,
        )

    names = objects.select(*database, "object_id", "object_name")
    indexes = indexes.select(*database, "object_id", "index_id", "index_name")

    def named(table: DataFrame) -> DataFrame:
        table = table.join(names, [*database, "object_id"], "left")
        return table.join(indexes, [*database, "object_id", "index_id"], "left")

    whole = names.select("*", none.alias("index_id"), none.alias("partition_id"), F.lit(None).cast("string").alias("index_name"))
    known = (
        entries(named(partitions), "hobt", "hobt_id", F.lit(0))
        .unionByName(entries(named(pages), "page", "page_id", F.col("file_id")))
        .unionByName(entries(whole, "object", "object_id", F.lit(0)))
    )
    kind = (
        F.when(F.col("hobt_id").isNotNull(), "hobt")
        .when(F.col("page_id").isNotNull(), "page")
        .when(F.col("wait_object_id").isNotNull(), "object")
    )
    # Waits without a key are spread over the tasks by their row.
    key = F.coalesce("hobt_id", "page_id", "wait_object_id", F.xxhash64(*row_id))
    pairs = [(F.col(c), c) for c in scope] + [
        (F.col("wait_database_id"), "database_id"),
        (F.coalesce(kind, F.lit("none")), "__kind"),
        (key, "__key"),
        (F.when(kind == "page", F.col("file_id")).otherwise(F.lit(0)), "__file"),
    ]
    out = lookup(waits, known, pairs, columns)
    return out.withColumn("object_id", F.coalesce("wait_object_id", "object_id"))


# ---------------------------------------------------------------- backup progress


def backup_progress(
    requests: DataFrame, batches: DataFrame, as_of: datetime | str, scope: Sequence[str] = ()
) -> DataFrame:
    """Running backups and restores with the clock time they should end at."""
    running = requests.where(commands_like("command", ("BACKUP", "RESTORE")))
    end = plus_seconds(ts(as_of), F.floor(F.col("estimated_completion_ms") / 1000))
    return with_batch_text(running, batches, "inner", scope).withColumn(
        "estimated_completion_time", time_of_day(end)
    )
