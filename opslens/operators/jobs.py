"""Command log, job catalogue, schedules and the shared work queue."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslens.functions import days_hms, holds, seconds_between, ts

# Lock errors, severities, retention and schedule codes.
LOCK_ERRORS = (1205, 1222)
SEVERITY = 16
KEEP_DAYS = 30
DAILY, WEEKLY = 4, 8
ONCE, EVERY_MINUTES, EVERY_HOURS = 1, 4, 8
END_OF_DAY = 235959


# ---------------------------------------------------------------- command log


def cmdlog_outcome(log: DataFrame) -> DataFrame:
    """Outcome and duration of each logged command."""
    seconds = seconds_between("start_time", "end_time")
    outcome = (
        F.when(F.col("end_time").isNull(), "Not Finished")
        .when(F.col("error_number").isNull(), "Not Executed")
        .when(F.col("error_number") == 0, "Succeeded")
        .otherwise("Failed")
    )
    return log.withColumn("outcome", outcome).withColumn("duration", days_hms(seconds))


def error_severity(log: DataFrame, lock_severity: int = SEVERITY) -> DataFrame:
    """Severity per failed command; lock errors below 16 are reported but do not count."""
    if lock_severity not in (10, SEVERITY):
        raise ValueError(f"lock severity not supported: {lock_severity!r}")
    error = F.col("error_number")
    failed = holds(error != 0)
    lock = holds(error.isin(*LOCK_ERRORS))
    severity = F.when(lock, F.lit(lock_severity)).otherwise(F.lit(SEVERITY))
    return (
        log.withColumn("is_lock_error", failed & lock)
        .withColumn("severity", F.when(failed, severity))
        .withColumn("counts_as_failure", failed & ~(lock & F.lit(lock_severity == 10)))
    )


def error_summary(triaged: DataFrame, keys: Sequence[str] = ("database_name",)) -> DataFrame:
    """Failures per key, and the return code: the error of the last counting failure."""
    counted = F.when(F.col("counts_as_failure"), F.col("id"))
    return triaged.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("commands"),
        F.count_if("counts_as_failure").alias("failures"),
        F.count_if("is_lock_error").alias("lock_errors"),
        F.coalesce(F.max_by("error_number", counted), F.lit(0)).alias("return_code"),
    )


def expired_log(
    log: DataFrame, as_of: datetime | str, days: int = KEEP_DAYS, column: str = "start_time"
) -> DataFrame:
    """Rows older than the retention.  The cut-off is a constant, so the scan can skip files."""
    cutoff = ts(as_of) - F.make_dt_interval(days=F.lit(days))
    return log.where(F.col(column) < cutoff)


# ---------------------------------------------------------------- job catalogue


def job_catalog(servers: DataFrame, catalogue: DataFrame, platform: str = "platform") -> DataFrame:
    """The jobs each server should have.

    ``catalogue`` has one row per job and platform on which it is installed: job_name, subsystem, and a
    column named as ``platform``.  Servers of a platform without jobs give no rows.
    """
    return servers.join(catalogue.select("job_name", "subsystem", platform).distinct(), platform)


# ---------------------------------------------------------------- schedules


def _clock_seconds(hhmmss: Column) -> Column:
    return (
        F.floor(hhmmss / 10000) * 3600 + (F.floor(hhmmss / 100) % 100) * 60 + hhmmss % 100
    ).cast("int")


def expand_schedule(
    schedules: DataFrame, first: date | str, last: date | str
) -> DataFrame:
    """Run times of daily and weekly schedules between two dates, both included.

    A schedule of another kind gives one row without a run time and with a ``problem``.  At most one row per
    minute and day comes out of a schedule, whatever its settings.
    """
    start_day, end_day = F.lit(str(first)).cast("date"), F.lit(str(last)).cast("date")
    s = schedules
    for column, default, kind in (
        ("active_start_date", str(first), "date"),
        ("active_end_date", str(last), "date"),
        ("active_end_time", END_OF_DAY, "int"),
    ):
        if column not in s.columns:
            s = s.withColumn(column, F.lit(default).cast(kind))
    lower = F.greatest(start_day, F.coalesce("active_start_date", start_day))
    upper = F.least(end_day, F.coalesce("active_end_date", end_day))
    days = F.when(lower <= upper, F.sequence(lower, upper))

    # Sunday is bit 0 of a weekly mask.
    bit = F.expr("shiftleft(1, dayofweek(run_date) - 1)")
    weekly = F.col("freq_interval").cast("int").bitwiseAND(bit) != 0
    # A daily schedule with interval n runs every n-th day of its active period.
    offset = F.datediff("run_date", F.coalesce("active_start_date", start_day))
    daily = offset % F.greatest(F.col("freq_interval"), F.lit(1)) == 0
    runs_today = F.when(F.col("freq_type") == DAILY, daily).when(
        F.col("freq_type") == WEEKLY, weekly
    )

    begin = _clock_seconds(F.col("active_start_time"))
    end = _clock_seconds(F.coalesce("active_end_time", F.lit(END_OF_DAY)))
    unit = F.when(F.col("freq_subday_type") == EVERY_MINUTES, 60).when(
        F.col("freq_subday_type") == EVERY_HOURS, 3600
    )
    step = (unit * F.greatest(F.col("freq_subday_interval"), F.lit(1))).cast("int")
    times = F.when(F.col("freq_subday_type") == ONCE, F.array(begin)).when(
        begin <= end, F.sequence(begin, end, step)
    )
    known = F.col("freq_type").isin(DAILY, WEEKLY)
    problem = F.concat(F.lit("unsupported frequency "), F.coalesce(F.col("freq_type").cast("string"), F.lit("NULL")))
    others = s.where(~holds(known)).select(
        "*",
        F.lit(None).cast("date").alias("run_date"),
        F.lit(None).cast("int").alias("run_second"),
        F.lit(None).cast("timestamp_ntz").alias("run_time"),
        problem.alias("problem"),
    )
    runs = (
        s.where(known).withColumn("run_date", F.explode(days))
        .where(holds(runs_today))
        .withColumn("run_second", F.explode(times))
        .withColumn(
            "run_time",
            F.col("run_date").cast("timestamp_ntz")
            + F.make_dt_interval(secs=F.col("run_second").cast("decimal(18,6)")),
        )
        .withColumn("problem", F.lit(None).cast("string"))
    )
    return runs.unionByName(others)


# ---------------------------------------------------------------- queue


def queue_state(queue: DataFrame, requests: DataFrame, *, scope: Sequence[str]) -> DataFrame:
    """DONE, RUNNING, PENDING, or DEAD when the claiming request no longer exists.

    ``scope`` names the columns of the claiming server.
    """
    alive = requests.select(
        *scope,
        "session_id",
        "request_id",
        F.col("start_time").alias("request_start_time"),
        F.lit(True).alias("__alive"),
    ).distinct()
    state = (
        F.when(F.col("database_start_time").isNull(), "PENDING")
        .when(F.col("database_end_time").isNotNull(), "DONE")
        .when(holds(F.col("__alive")), "RUNNING")
        .otherwise("DEAD")
    )
    return (
        queue.join(alive, [*scope, "session_id", "request_id", "request_start_time"], "left")
        .withColumn("queue_state", state)
        .drop("__alive")
    )


def queue_sync(queue: DataFrame, selected: DataFrame, keys: Sequence[str] = ("name",)) -> DataFrame:
    """Reconcile a queue with the selection: ADD, REMOVE, REORDER or KEEP."""
    old = queue.select(*keys, F.col("database_order").alias("old_order"), F.lit(True).alias("__q"))
    new = selected.select(*keys, F.col("order_no").alias("new_order"), F.lit(True).alias("__s"))
    moved = ~F.col("old_order").eqNullSafe(F.col("new_order"))
    action = (
        F.when(F.col("__q").isNull(), "ADD")
        .when(F.col("__s").isNull(), "REMOVE")
        .when(moved, "REORDER")
        .otherwise("KEEP")
    )
    return old.join(new, list(keys), "full").select(
        *keys, action.alias("action"), "old_order", "new_order"
    )
