"""Row groups of column-store partitions that need a rebuild."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslens.functions import concat_nullsafe, holds, quotename
from opslens.operators.selection import match_or_all


def rowgroup_rebuild(
    rowgroups: DataFrame,
    table_name: str | None = None,
    steps: int | None = None,
    scope: Sequence[str] = (),
) -> DataFrame:
    """Partitions with unfinished or partly deleted row groups, oldest first.

    The newest partition of an object is never rebuilt.  Row groups collapse to
    partitions in one map-side-combined aggregation; the newest partition is
    then found on that much smaller result.
    """
    bad = (
        holds(F.col("state_desc") != "COMPRESSED")
        | holds(F.col("transition_desc") != "INDEX_BUILD")
        | holds(F.col("deleted_rows") > 0)
    )
    keys = [*scope, "object_id", "object_name", "schema_name", "index_name", "is_partitioned"]
    partitions = (
        rowgroups.where(match_or_all("object_name", table_name))
        .groupBy(*keys, "partition_number")
        .agg(
            F.min(F.when(bad, F.col("created_time"))).alias("oldest_created"),
            F.count_if(bad).alias("bad_rowgroups"),
            F.sum(F.when(bad, F.col("deleted_rows")).otherwise(0)).alias("deleted_rows"),
        )
    )
    newest = partitions.groupBy(*scope, "object_id").agg(
        F.max("partition_number").alias("max_partition_number")
    )
    clause = F.when(
        F.col("is_partitioned"), concat_nullsafe(" PARTITION = ", F.col("partition_number"))
    )
    plan = (
        partitions.where(F.col("bad_rowgroups") > 0)
        .join(newest, [*scope, "object_id"])
        .where(F.col("partition_number") < F.col("max_partition_number"))
        .withColumn(
            "command_text",
            concat_nullsafe(
                "ALTER INDEX ", quotename("index_name"), " ON ", quotename("schema_name"), ".",
                quotename("object_name"), " REBUILD", clause,
            ),
        )
        .drop("max_partition_number")
    )
    if steps is None:
        return plan
    return plan.orderBy("oldest_created", "object_id", "partition_number").limit(steps)
