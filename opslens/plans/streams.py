"""Streaming runs over everything available, compared with their batch twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslens.plans.inputs import AS_OF, Inputs
from opslens.plans.registry import query
from opslens.plans.space import RETENTION_COLUMNS, RETENTION_LIMITS, RETENTION_ORACLE
from opslens.streaming import (
    activity_windows,
    blocked_episodes,
    pair_commands,
    read_stream,
    retention_on_trigger,
    run_to_table,
)


def _stream(t: Inputs, table: str) -> DataFrame:
    """A test table as a stream.  The pattern lets one file or a folder of files pass."""
    return read_stream(t.spark, f"{t.path(table)[:-1]}[t]", t.table(table).schema)


def _activity(t: Inputs) -> DataFrame:
    return _stream(t, "events").select(
        "ts",
        F.col("user_id").alias("session_id"),
        F.concat(F.lit("DB"), F.col("user_id") % 25).alias("database_name"),
        (F.col("event_type") == "error").alias("is_waiting"),
        F.col("event_type").isin("click", "view").alias("is_blocked"),
    )


# Append mode keeps windows back until the watermark has passed their end.
_MARK = "(SELECT max(ts) - INTERVAL '1' DAY FROM v_activity)"


@query(
    "q_stream_activity",
    f"""SELECT window_start, window_start + INTERVAL '1' DAY AS window_end, database_name, count(*) AS requests,
      count(*) FILTER (WHERE is_waiting) AS waits, count(*) FILTER (WHERE is_blocked) AS blocked
    FROM (SELECT *, date_trunc('hour', ts) - INTERVAL '1' HOUR * CAST(h AS INT) AS window_start
      FROM v_activity, range(0, 24) r(h)) w
    WHERE window_start + INTERVAL '1' DAY <= {_MARK} GROUP BY 1, 2, 3""",
)
def q_stream_activity(t: Inputs) -> DataFrame:
    return run_to_table(activity_windows(_activity(t), "1 day", "1 hour"), "activity")


@query(
    "q_stream_activity_daily",
    f"""SELECT date_trunc('day', ts) AS window_start, date_trunc('day', ts) + INTERVAL '1' DAY AS window_end, database_name,
      count(*) AS requests, count(*) FILTER (WHERE is_waiting) AS waits, count(*) FILTER (WHERE is_blocked) AS blocked
    FROM v_activity WHERE date_trunc('day', ts) + INTERVAL '1' DAY <= {_MARK} GROUP BY 1, 2, 3""",
)
def q_stream_activity_daily(t: Inputs) -> DataFrame:
    return run_to_table(activity_windows(_activity(t), "1 day"), "activity-daily")


@query(
    "q_stream_blocked",
    """WITH polls AS (SELECT session_id, ts, lag(ts) OVER (PARTITION BY session_id ORDER BY ts, event_id) AS before
        FROM v_activity WHERE is_blocked),
      islands AS (SELECT *, sum(CASE WHEN before IS NULL OR ts >= before + INTERVAL '2' HOUR THEN 1 ELSE 0 END)
        OVER (PARTITION BY session_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS island FROM polls),
      episodes AS (SELECT session_id, min(ts) AS episode_start, max(ts) + INTERVAL '2' HOUR AS episode_end, count(*) AS polls
        FROM islands GROUP BY session_id, island)
    SELECT * FROM episodes WHERE episode_end <= (SELECT max(ts) - INTERVAL '1' DAY FROM v_activity WHERE is_blocked)""",
)
def q_stream_blocked(t: Inputs) -> DataFrame:
    return run_to_table(blocked_episodes(_activity(t)), "blocked")


@query(
    "q_stream_cmdlog",
    """WITH paired AS (SELECT s.id, s.database_name, s.command_type, s.start_time, f.end_time, f.error_number
        FROM v_command_log s LEFT JOIN v_command_log f ON f.id = s.id AND f.end_time IS NOT NULL
          AND f.end_time >= s.start_time AND f.end_time <= s.start_time + INTERVAL '1' HOUR),
      mark AS (SELECT least((SELECT max(start_time) FROM v_command_log), (SELECT max(end_time) FROM v_command_log))
        - INTERVAL '1' DAY AS w)
    SELECT id, database_name, command_type, start_time, end_time, CAST(error_number AS BIGINT) AS error_number,
      end_time IS NULL AS is_unfinished
    FROM paired, mark WHERE end_time IS NOT NULL OR start_time + INTERVAL '1' HOUR < w""",
)
def q_stream_cmdlog(t: Inputs) -> DataFrame:
    log = t.sql_stream("v_command_log", _stream(t, "events"))
    starts = log.select("id", "database_name", "command_type", "start_time")
    finishes = t.sql_stream("v_command_log", _stream(t, "events")).where(
        F.col("end_time").isNotNull()
    )
    return run_to_table(pair_commands(starts, finishes), "commands")


@query("q_stream_retention", RETENTION_ORACLE)
def q_stream_retention(t: Inputs) -> DataFrame:
    snapshots = _stream(t, "orders").select(
        F.col("o_custkey").alias("source_database_id"),
        F.col("o_orderkey").alias("database_id"),
        F.col("o_orderdate").alias("create_date"),
    )
    # Every snapshot is polled twice; only the newest poll counts.
    at = F.lit(AS_OF).cast("timestamp_ntz")
    polls = snapshots.select("*", F.explode(F.array(at - F.expr("INTERVAL 1 DAY"), at)).alias("snapshot_ts"))
    decisions = retention_on_trigger(polls, lambda: t.snapfile, **RETENTION_LIMITS)
    return decisions.withColumn("reasons", F.array_join("reasons", ",")).select(*RETENTION_COLUMNS)
