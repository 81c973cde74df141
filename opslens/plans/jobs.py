"""Command log, jobs, schedules, queue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslens.operators.jobs import (
    cmdlog_outcome,
    error_severity,
    error_summary,
    expand_schedule,
    expired_log,
    job_catalog,
    queue_state,
    queue_sync,
)
from opslens.operators.selection import order_databases, select_by_spec
from opslens.plans.inputs import EVENTS_AS_OF, Inputs
from opslens.plans.registry import query
from opslens.sources import close_polls, log_finish, log_start, read_snapshot, write_polls
from opslens.sources.sinks import advance_pairs, pair_log, read_pairs
from opslens.sources.workdir import fresh_path

EVENTS_MIDDLE = "2024-01-16"


@query(
    "q_cmdlog_outcome",
    """SELECT id, database_name, command_type,
      CASE WHEN end_time IS NULL THEN 'Not Finished' WHEN error_number IS NULL THEN 'Not Executed'
        WHEN error_number = 0 THEN 'Succeeded' ELSE 'Failed' END AS outcome,
      CASE WHEN s >= 86400 THEN concat(s // 86400, '.') ELSE '' END || lpad(CAST((s // 3600) % 24 AS VARCHAR), 2, '0') || ':'
        || lpad(CAST((s // 60) % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS duration
    FROM (SELECT *, date_diff('second', start_time, end_time) AS s FROM v_command_log) l""",
)
def q_cmdlog_outcome(t: Inputs) -> DataFrame:
    return cmdlog_outcome(t.command_log).select(
        "id",
        "database_name",
        "command_type",
        "outcome",
        F.when(F.col("end_time").isNotNull(), F.col("duration")).alias("duration"),
    )


@query(
    "q_cmdlog_errors",
    """SELECT database_name, count(*) AS commands, count(*) FILTER (WHERE error_number = 50000) AS failures,
      count(*) FILTER (WHERE error_number IN (1205, 1222)) AS lock_errors,
      CAST(coalesce(max_by(error_number, id) FILTER (WHERE error_number = 50000), 0) AS BIGINT) AS return_code
    FROM v_command_log GROUP BY 1""",
)
def q_cmdlog_errors(t: Inputs) -> DataFrame:
    return error_summary(error_severity(t.command_log, lock_severity=10))


@query(
    "q_cmdlog_cleanup",
    f"""SELECT id, database_name, start_time FROM v_command_log
    WHERE start_time < TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL '10' DAY""",
)
def q_cmdlog_cleanup(t: Inputs) -> DataFrame:
    return expired_log(t.command_log, EVENTS_AS_OF, days=10).select(
        "id", "database_name", "start_time"
    )


@query(
    "q_job_catalog",
    "SELECT server_id, platform, job_name, subsystem FROM v_server JOIN v_job_offer USING (platform)",
)
def q_job_catalog(t: Inputs) -> DataFrame:
    return job_catalog(t.server, t.job_offer).select("server_id", "platform", "job_name", "subsystem")


@query(
    "q_schedule_runs",
    """WITH days AS (SELECT CAST(d AS DATE) AS run_date FROM range(DATE '2024-01-01', DATE '2024-02-01', INTERVAL 1 DAY) r(d)),
      s AS (SELECT *, CAST((active_start_time // 10000) * 3600 AS BIGINT) AS begin_second FROM v_schedule),
      due AS (SELECT * FROM s JOIN days ON freq_type = 4 OR (freq_interval & (1 << dayofweek(run_date))) <> 0)
    SELECT job_name, run_date + to_seconds(t) AS run_time FROM (
      SELECT job_name, CAST(run_date AS TIMESTAMP) AS run_date, unnest(CASE freq_subday_type WHEN 1 THEN [begin_second]
        WHEN 4 THEN range(begin_second, CAST(86400 AS BIGINT), CAST(freq_subday_interval * 60 AS BIGINT))
        ELSE range(begin_second, CAST(86400 AS BIGINT), CAST(freq_subday_interval * 3600 AS BIGINT)) END) AS t FROM due) x""",
)
def q_schedule_runs(t: Inputs) -> DataFrame:
    return expand_schedule(t.schedule, "2024-01-01", "2024-01-31").select("job_name", "run_time")


@query(
    "q_queue_state",
    """SELECT q.database_name, q.database_order, CASE WHEN q.database_start_time IS NULL THEN 'PENDING'
      WHEN q.database_end_time IS NOT NULL THEN 'DONE' WHEN r.request_id IS NOT NULL THEN 'RUNNING' ELSE 'DEAD' END AS queue_state
    FROM v_queue q LEFT JOIN v_request r ON r.session_id = q.session_id AND r.request_id = q.request_id
      AND r.start_time = q.request_start_time""",
    fleet=True,
)
def q_queue_state(t: Inputs) -> DataFrame:
    states = queue_state(t.queue, t.request, scope=t.scope)
    return states.select(*t.scope, "database_name", "database_order", "queue_state")


@query(
    "q_queue_sync",
    """WITH q AS (SELECT name, database_id % 100 + 1 AS old_order FROM v_database WHERE state_desc = 'ONLINE'),
      s AS (SELECT name, row_number() OVER (ORDER BY name) AS new_order FROM v_database WHERE database_type = 'U')
    SELECT coalesce(q.name, s.name) AS name, CASE WHEN q.name IS NULL THEN 'ADD' WHEN s.name IS NULL THEN 'REMOVE'
      WHEN old_order <> new_order THEN 'REORDER' ELSE 'KEEP' END AS action, old_order, new_order
    FROM q FULL JOIN s ON q.name = s.name""",
)
def q_queue_sync(t: Inputs) -> DataFrame:
    databases = t.database
    queue = databases.where(F.col("state_desc") == "ONLINE").select(
        "name", (F.col("database_id") % 100 + 1).alias("database_order")
    )
    chosen = select_by_spec(databases, "USER_DATABASES", type_column="database_type").where("selected")
    return queue_sync(queue, order_databases(chosen, "DATABASE_NAME_ASC"))


_PAIRED = """SELECT id, database_name, command_type, concat(command_type, ' ', database_name) AS command_text, start_time, end_time,
      CAST(CASE WHEN end_time IS NOT NULL THEN error_number END AS BIGINT) AS error_number FROM v_command_log"""


@query("q_cmdlog_roundtrip", _PAIRED)
def q_cmdlog_roundtrip(t: Inputs) -> DataFrame:
    """Start and finish events appended to a log, read back and paired."""
    return pair_log(t.spark.read.parquet(_written_log(t))).drop("error_message")


@query("q_cmdlog_advance", _PAIRED)
def q_cmdlog_advance(t: Inputs) -> DataFrame:
    """The same pairs from a table that is brought up to date three times, from new days and open starts."""
    log, path = _written_log(t), fresh_path(t.spark, "command-pairs")
    for until in ("2024-01-10", EVENTS_MIDDLE, "2024-04-01"):
        advance_pairs(t.spark, log, path, until)
    return read_pairs(t.spark, path).drop("error_message")


def _written_log(t: Inputs) -> str:
    log, path = t.command_log, fresh_path(t.spark, "command-log")
    text = F.concat_ws(" ", "command_type", "database_name")
    log_start(log.withColumn("command_text", text), path, F.col("start_time"))
    finished = log.where(F.col("end_time").isNotNull()).withColumn("error_message", F.lit(None).cast("string"))
    log_finish(finished, path, F.col("end_time"))
    return path


@query(
    "q_snapshot_scan",
    f"""SELECT server_id, snapshot_ts, database_name, log_size_mb, log_used_percent, CAST(status AS BIGINT) AS status
    FROM v_poll p WHERE snapshot_ts = (SELECT max(q.snapshot_ts) FROM v_poll q
      WHERE q.server_id = p.server_id AND q.snapshot_ts <= TIMESTAMP '{EVENTS_AS_OF}')""",
)
def q_snapshot_scan(t: Inputs) -> DataFrame:
    """Polls of thirty days written with their manifest, the first half closed; the last one of each server read back."""
    path = fresh_path(t.spark, "polls")
    middle = F.lit(EVENTS_MIDDLE).cast("date")
    write_polls(t.poll.where(F.col("snapshot_date") < middle), path)
    write_polls(t.poll.where(F.col("snapshot_date") >= middle), path)
    close_polls(t.spark, path, EVENTS_MIDDLE)
    return read_snapshot(t.spark, "log_space", path, EVENTS_AS_OF).drop("snapshot_date")
