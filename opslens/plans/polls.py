"""Polls of all kinds read back by their manifest, and kinds that were polled at different instants."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslens.operators.asof import align_polls, asof_join
from opslens.operators.sessions import who
from opslens.plans.inputs import Inputs
from opslens.plans.registry import query
from opslens.sources import FLEET_KEYS, SCHEMAS, read_snapshot, write_polls
from opslens.sources.workdir import fresh_path

#: Kind, view, its number that spreads the rows over servers and polls, and what is summed after reading back.
KINDS = [
    ("session", "v_session", "session_id", "isolation_level"),
    ("request", "v_request", "request_id", "total_elapsed_ms"),
    ("task", "v_task", "request_id", "exec_context_id"),
    ("wait", "v_wait", "request_id", "length(resource_description)"),
    ("grant", "v_grant", "request_id", "granted_memory_kb"),
    ("group", "v_group", "group_id", "length(name)"),
    ("file", "v_file", "file_id", "used_pages"),
    ("file_volume", "v_file", "database_id", "total_bytes"),
    ("rowgroup", "v_rowgroup", "object_id", "deleted_rows"),
    ("index_stats", "v_index_now", "object_id", "page_count"),
    ("index_catalog", "v_index", "object_id", "index_type"),
    ("backup", "v_backup", "database_id", "checkpoint_lsn"),
    ("principal", "v_login", "principal_id", "length(name)"),
    ("job_step", "v_job_step", "step_id", "length(command)"),
    ("schedule", "v_schedule", "active_start_time", "freq_interval"),
]
_KINDS_AS_OF = "2024-01-02 12:30:00"
_SERVER = "concat('S', {0} % 5)"
_POLL = "CAST('2024-01-01 00:00:00' AS {1}) + INTERVAL '1' HOUR * CAST({0} % 5 * 3 + {0} * 7 % 41 AS INT)"


def _newest(kind: str, view: str, number: str, measure: str) -> str:
    server, poll = _SERVER.format(number), _POLL.format(number, "TIMESTAMP")
    return f"""SELECT '{kind}' AS kind, server AS server_id, poll AS snapshot_ts, count(*) AS n_rows, CAST(sum({measure}) AS DOUBLE) AS total
      FROM (SELECT *, max(poll) OVER (PARTITION BY server) AS newest
        FROM (SELECT *, {server} AS server, {poll} AS poll FROM {view}) a
        WHERE poll <= TIMESTAMP '{_KINDS_AS_OF}') b
      WHERE poll = newest GROUP BY server, poll"""


@query("q_newest_kinds", " UNION ALL ".join(_newest(*k) for k in KINDS))
def q_newest_kinds(t: Inputs) -> DataFrame:
    """Polls of every kind written as a collector would, and what the newest ones hold."""

    def read_back(kind: str, view: str, number: str, measure: str) -> DataFrame:
        rows = getattr(t, view.removeprefix("v_")).withColumns(
            {"server_id": F.expr(_SERVER.format(number)), "snapshot_ts": F.expr(_POLL.format(number, "TIMESTAMP_NTZ"))}
        )
        wanted = t.spark.createDataFrame([], SCHEMAS[kind]).schema
        path = fresh_path(t.spark, kind)
        write_polls(rows.select(*[F.col(f.name).cast(f.dataType) for f in wanted if f.name in rows.columns]), path)
        newest = read_snapshot(t.spark, kind, path, _KINDS_AS_OF)
        return newest.groupBy(F.lit(kind).alias("kind"), "server_id", "snapshot_ts").agg(
            F.count(F.lit(1)).alias("n_rows"), F.sum(F.expr(measure)).cast("double").alias("total")
        )

    with ThreadPoolExecutor(4) as several:  # the tables have nothing to do with each other
        return reduce(DataFrame.unionByName, several.map(lambda k: read_back(*k), KINDS))


@query(
    "q_asof_view",
    """WITH views AS (SELECT user_id, ts AS as_of_time, max(event_id) AS view_id FROM events WHERE event_type = 'view'
        GROUP BY user_id, ts),
      others AS (SELECT event_id, user_id, ts FROM events WHERE event_type <> 'view')
    SELECT o.event_id, o.user_id, o.ts, CASE WHEN as_of_time >= ts - INTERVAL '6' HOUR THEN view_id END AS view_id,
      CASE WHEN as_of_time >= ts - INTERVAL '6' HOUR THEN as_of_time END AS as_of_time
    FROM others o ASOF LEFT JOIN views v ON o.user_id = v.user_id AND o.ts >= v.as_of_time""",
)
def q_asof_view(t: Inputs) -> DataFrame:
    """Every event with the user's last view in the six hours before it."""
    events = t.table("events").select("event_id", "user_id", "ts", "event_type")
    views = events.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("view_id"))
    others = events.where("event_type <> 'view'").drop("event_type")
    return asof_join(others, views, ["user_id"], "ts", ["view_id"], within="6 hours")


@query(
    "q_who_shifted",
    """WITH wanted AS (SELECT DISTINCT server_id, snapshot_ts FROM v_request_poll),
      there AS (SELECT DISTINCT server_id, snapshot_ts AS poll_ts FROM v_session_poll),
      pairs AS (SELECT l.server_id, l.snapshot_ts, o.poll_ts FROM wanted l ASOF JOIN there o
        ON o.server_id = l.server_id AND l.snapshot_ts >= o.poll_ts WHERE poll_ts >= snapshot_ts - INTERVAL '90' MINUTE)
    SELECT r.server_id, r.snapshot_ts, r.request_id, r.session_id, r.command, r.database_name, s.login_name,
      CAST(s.open_transaction_count AS BIGINT) AS session_open_transactions
    FROM v_request_poll r LEFT JOIN pairs p ON p.server_id = r.server_id AND p.snapshot_ts = r.snapshot_ts
    LEFT JOIN v_session_poll s ON s.server_id = r.server_id AND s.snapshot_ts = p.poll_ts AND s.session_id = r.session_id""",
)
def q_who_shifted(t: Inputs) -> DataFrame:
    """The activity report over requests and sessions whose polls never have the same time."""
    date = F.col("snapshot_ts").cast("date").alias("snapshot_date")
    null = [F.lit(None).cast(kind).alias(c) for c, kind in _UNUSED_REQUEST.items()]
    requests = t.request_poll.select("*", date, *null)
    null = [F.lit(None).cast(kind).alias(c) for c, kind in _UNUSED_SESSION.items()]
    sessions = t.session_poll.select("*", date, *null)
    seen = align_polls(requests, sessions, within="90 minutes")
    report = who(requests, seen, user_processes=None, scope=FLEET_KEYS)
    return report.select(
        "server_id", "snapshot_ts", "request_id", "session_id", "command", "database_name", "login_name",
        "session_open_transactions",
    )


_UNUSED_REQUEST = {
    "blocking_session_id": "long", "status": "string", "total_elapsed_ms": "long", "cpu_ms": "long",
    "percent_complete": "double", "isolation_level": "int",
}
_UNUSED_SESSION = {
    "program_name": "string", "host_name": "string", "is_user_process": "boolean", "isolation_level": "int",
}
