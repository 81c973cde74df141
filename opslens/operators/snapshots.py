"""Database snapshots: which to create and which have expired."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslens.functions import (
    concat_nullsafe,
    holds,
    like_ci,
    minutes_between,
    quote_literal,
    quotename,
    ts,
)
from opslens.operators.ranking import numbered

MAX_SNAPSHOTS = 1
MAX_AGE_HOURS = 12
MAX_SIZE_ON_DISK_MB = 10_240
MAX_SPACE_USED_PERCENT = 1.00

FIRST_USER_DATABASE_ID = 5


def snapshot_plan(
    databases: DataFrame,
    files: DataFrame,
    existing_names: DataFrame,
    as_of: datetime | str,
    *,
    use_hours: bool = False,
    use_minutes: bool = False,
    overwrite_existing: bool = False,
    database_like: str = "%",
    scope: Sequence[str],
) -> DataFrame:
    """Snapshots to create, with action CREATE, DROP_CREATE or SKIP; ``scope`` names the server columns.

    The file clauses of one database become one string.  A database holds at
    most 32,767 files, so that group is bounded by the server, not by the data.
    """
    pattern = "yyyyMMdd" + ("HH" if use_hours or use_minutes else "") + ("mm" if use_minutes else "")
    suffix = F.date_format(ts(as_of), pattern)
    candidates = databases.where(
        F.col("source_database_id").isNull()
        & (F.col("database_id") >= FIRST_USER_DATABASE_ID)
        & like_ci("name", database_like)
    ).select(
        *scope, "database_id", "name", concat_nullsafe(F.col("name"), "_Snapshot_", suffix).alias("new_name")
    )

    leaf = F.substring_index("physical_name", "\\", -1)
    directory = F.substring(
        F.col("physical_name"), F.lit(1), F.length("physical_name") - F.length(leaf)
    )
    data_files = files.where(F.col("type_desc") == "ROWS").select(
        *scope, "database_id", "file_id", "file_name", directory.alias("directory")
    )
    clause = F.concat(
        F.lit("(NAME = "),
        quote_literal("file_name"),
        F.lit(", FILENAME = "),
        quote_literal(
            concat_nullsafe(F.col("directory"), F.col("new_name"), "_", F.col("file_name"), ".ss")
        ),
        F.lit(")"),
    )
    plan = (
        candidates.join(data_files, [*scope, "database_id"], "left")
        .groupBy(*scope, "database_id", "name", "new_name")
        .agg(
            F.array_join(
                F.transform(
                    F.array_sort(
                        F.collect_list(
                            F.when(
                                F.col("file_name").isNotNull(),
                                F.struct("file_name", "file_id", clause.alias("clause")),
                            )
                        )
                    ),
                    lambda f: f["clause"],
                ),
                ",",
            ).alias("file_list")
        )
    )

    taken = existing_names.select(*scope, F.col("name").alias("new_name"), F.lit(True).alias("exists"))
    exists = holds(F.col("exists"))
    when_taken = "DROP_CREATE" if overwrite_existing else "SKIP"
    create = concat_nullsafe(
        "CREATE DATABASE ", quotename("new_name"), " ON ", F.col("file_list"),
        " AS SNAPSHOT OF ", quotename("name"),
    )
    drop = concat_nullsafe("DROP DATABASE ", quotename("new_name"), "; ")
    return (
        plan.join(taken.distinct(), [*scope, "new_name"], "left")
        .withColumn("action", F.when(exists, when_taken).otherwise("CREATE"))
        .withColumn(
            "command_text",
            F.when(F.col("action") == "CREATE", create).when(
                F.col("action") == "DROP_CREATE", F.concat(drop, create)
            ),
        )
        .select(*scope, "database_id", "name", "new_name", "action", "file_list", "command_text")
    )


def snapshot_sizes(files: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Reserved and on-disk MB per snapshot; each file is truncated to whole MB first."""
    per_file = files.groupBy(*scope, "database_id", "file_id").agg(
        F.floor(F.sum("size_pages") * 8 / 1024).alias("size_mb"),
        F.floor(F.floor(F.sum("size_on_disk_bytes") / 1024) / 1024).alias("size_on_disk_mb"),
    )
    return per_file.groupBy(*scope, "database_id").agg(
        F.sum("size_mb").alias("size_mb"), F.sum("size_on_disk_mb").alias("size_on_disk_mb")
    )


def snapshot_retention(
    snapshots: DataFrame,
    files: DataFrame,
    as_of: datetime | str | Column,
    *,
    max_snapshots: int = MAX_SNAPSHOTS,
    max_age_hours: int = MAX_AGE_HOURS,
    max_size_on_disk_mb: int = MAX_SIZE_ON_DISK_MB,
    max_space_used_percent: float = MAX_SPACE_USED_PERCENT,
    scope: Sequence[str] = (),
) -> DataFrame:
    """Decide for every snapshot whether it is dropped, and why.

    ``as_of`` is a time, or the column of ``snapshots`` that holds each row's time.

    The rank is taken on the narrow snapshot rows before the file sums join in.
    """
    ranked = numbered(
        snapshots,
        [*scope, "source_database_id"],
        [F.col("create_date").desc(), F.col("database_id").desc()],
        "snapshot_order",
    )
    now = as_of if isinstance(as_of, Column) else ts(as_of)
    age = F.floor(minutes_between(F.col("create_date"), now) / 60)
    used = F.round(
        F.col("size_on_disk_mb").cast("decimal(20,0)")
        * 100
        / F.nullif(F.col("size_mb"), F.lit(0)).cast("decimal(20,0)"),
        2,
    ).cast("decimal(9,2)")
    rules = {
        "snapshot_order": F.col("snapshot_order") > max_snapshots,
        "age_in_hours": F.col("age_in_hours") > max_age_hours,
        "size_on_disk_mb": F.col("size_on_disk_mb") > max_size_on_disk_mb,
        "space_used_percent": F.col("space_used_percent") > F.lit(str(max_space_used_percent)).cast("decimal(9,2)"),
    }
    return (
        ranked.join(snapshot_sizes(files, scope), [*scope, "database_id"], "left")
        .withColumn("age_in_hours", age)
        .withColumn("space_used_percent", used)
        .withColumn(
            "reasons", F.array_compact(F.array(*[F.when(rule, F.lit(n)) for n, rule in rules.items()]))
        )
        .withColumn("drop_snapshot", F.size("reasons") > 0)
        .withColumn("action", F.when(F.col("drop_snapshot"), "DROP").otherwise("KEEP"))
    )
