"""State tables kept across polls: upsert, work lists, budgets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from opslens.functions import any_of, concat_nullsafe, holds, quotename
from opslens.operators.ranking import numbered, running_sum
from opslens.sources.parts import (
    PART,
    bucket_of,
    commit,
    group_of,
    listing,
    read_parts,
    versions,
    write_parts,
)


def merge_state(
    previous: DataFrame,
    current: DataFrame,
    keys: Sequence[str],
    measures: Sequence[str],
    scope: DataFrame | None = None,
) -> DataFrame:
    """Change log of an upsert: INSERT, UPDATE, DELETE or KEEP for every key.

    Parquet tables have no MERGE, so the upsert is one full outer join.  Rows
    of ``previous`` outside ``scope`` (the databases that were polled this time)
    are kept even when ``current`` does not hold them.
    """
    old = previous.select(
        *keys, *[F.col(m).alias(f"old_{m}") for m in measures], F.lit(True).alias("__old")
    )
    new = current.select(
        *keys, *[F.col(m).alias(f"new_{m}") for m in measures], F.lit(True).alias("__new")
    )
    polled = F.lit(True)
    joined = old.join(new, list(keys), "full")
    if scope is not None:
        mark = scope.distinct().withColumn("__polled", F.lit(True))
        joined = joined.join(mark, scope.columns, "left")
        polled = holds(F.col("__polled"))
    changed = any_of(holds(F.col(f"old_{m}") != F.col(f"new_{m}")) for m in measures)
    action = (
        F.when(F.col("__old").isNull(), "INSERT")
        .when(F.col("__new").isNull() & polled, "DELETE")
        .when(F.col("__new").isNull(), "KEEP")
        .when(changed, "UPDATE")
        .otherwise("KEEP")
    )
    return joined.select(
        *keys,
        action.alias("action"),
        *[f"old_{m}" for m in measures],
        *[f"new_{m}" for m in measures],
    )


def apply_changes(changes: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """The new state table that a change log describes."""
    take_new = F.col("action").isin("INSERT", "UPDATE")
    return changes.where(F.col("action") != "DELETE").select(
        *keys,
        *[
            F.when(take_new, F.col(f"new_{m}")).otherwise(F.col(f"old_{m}")).alias(m)
            for m in measures
        ],
    )


def upsert(
    current: DataFrame,
    path: str,
    keys: Sequence[str],
    measures: Sequence[str],
    scope: Sequence[str] = (),
    groups: int = 64,
    buckets: int = 16,
) -> list[str]:
    """Bring a state table up to date with a poll, and rewrite only the buckets in which something changed.

    ``scope`` names the key columns that tell what was polled (the database): rows of other databases stay, and
    their buckets are not even read.  Returns the buckets that were rewritten.  The first look compares keys
    and measures only to find these; only they are read again and written.
    """
    spark = current.sparkSession
    rows = current.select(*keys, *measures)
    schema = rows.schema
    bucket = bucket_of(scope, keys, groups, buckets)
    listed = listing(spark, path)
    there = sorted({p for t, p in listed if t == "rows"})
    if scope:
        polled = {r[0] for r in rows.select(group_of(scope, groups)).distinct().collect()}
        there = [p for p in there if p.partition("-")[0] in polled]
    marks = rows.select(*scope).distinct() if scope else None
    known = read_parts(spark, path, "rows", schema, there, listed)
    changes = merge_state(known, rows, keys, measures, marks)
    changed = changes.where("action <> 'KEEP'").select(bucket.alias(PART)).distinct()
    touched = sorted(r[0] for r in changed.collect())
    if not touched:
        return []
    old = read_parts(spark, path, "rows", schema, touched, listed)
    new = rows.where(bucket.isin(touched))
    after = apply_changes(merge_state(old, new, keys, measures, marks), keys, measures)
    version = max(versions(spark, path), default=0) + 1
    write_parts(after.withColumn(PART, bucket), path, "rows", version)
    commit(spark, path, version, ["rows"], touched)
    return touched


def read_state(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The newest version of a table that ``upsert`` keeps."""
    return read_parts(spark, path, "rows", schema)


def index_inventory(index_stats: DataFrame, index_keys: Sequence[str]) -> DataFrame:
    """Uncompressed index partitions with the page and partition totals of their index.

    One row per partition comes in, and an index has at most 15,000 partitions,
    so a window over an index is bounded.
    """
    index = Window.partitionBy(*index_keys)
    return (
        index_stats.withColumn("partition_count", F.count(F.lit(1)).over(index))
        .withColumn("index_page_count", F.sum("page_count").over(index))
        .where(F.col("data_compression") == "NONE")
    )


def mark_done(
    worklist: DataFrame, done: str = "0", excluded_prefix: str | None = "ReportServer"
) -> DataFrame:
    """Compressed rows count as done; excluded databases leave the list."""
    if excluded_prefix is not None:
        worklist = worklist.where(
            ~F.lower("database_name").startswith(excluded_prefix.lower())
        )
    return worklist.withColumn(
        "status", F.when(F.col("data_compression") != "NONE", done).otherwise(F.col("status"))
    )


def compression_worklist(
    worklist: DataFrame,
    order_keys: Sequence[str],
    scope: Sequence[str] = (),
    done: str = "0",
) -> DataFrame:
    """What is still to be compressed, by status and then size."""
    todo = worklist.where((F.col("data_compression") == "NONE") & (F.col("status") != done))
    todo = todo.withColumn("size_mb", F.floor(F.col("page_count") * 8 / 1024)).withColumn(
        "command_text",
        concat_nullsafe(
            "ALTER INDEX ", quotename("index_name"), " ON ", quotename("database_name"), ".",
            quotename("schema_name"), ".", quotename("object_name"),
            " REBUILD WITH (ONLINE = ON, DATA_COMPRESSION = PAGE)",
        ),
    )
    order = [F.col(c) for c in ("status", "page_count", *order_keys)]
    return numbered(todo, scope, order, "order_no")


def cumulative(
    df: DataFrame,
    size: str,
    order: Sequence[str],
    keys: Sequence[str] = (),
    name: str = "cumulative",
) -> DataFrame:
    return running_sum(df, keys, [F.col(c) for c in order], size, name)


def within_budget(
    df: DataFrame,
    cost: str,
    budget: int,
    order: Sequence[str],
    keys: Sequence[str] = (),
) -> DataFrame:
    """Ordered work that starts before the budget of its key is spent.

    A run with a time limit starts an item while time is left and lets it
    finish; with estimated costs that is: the cost spent before it is below the budget.
    An unknown cost counts as nothing.
    """
    spent = cumulative(df, cost, order, keys, "spent")
    before = F.coalesce("spent", F.lit(0)) - F.coalesce(F.col(cost), F.lit(0))
    return spent.where(before < budget)
