"""Index state, fragmentation, actions, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslens.operators.maintenance import (
    choose_action,
    choose_stats_update,
    column_stats,
    extended_info,
    frag_group,
    fragmentation,
    index_catalog,
    index_command,
    index_comment,
    index_order,
    index_stats_catalog,
    is_old_engine,
    is_partition,
    stats_command,
    stats_mode,
    with_partition_count,
)
from opslens.operators.selection import select_by_spec
from opslens.operators.state import (
    compression_worklist,
    cumulative,
    index_inventory,
    mark_done,
    merge_state,
    read_state,
    upsert,
    within_budget,
)
from opslens.plans.inputs import Inputs
from opslens.plans.registry import query
from opslens.sources.workdir import fresh_path

KEYS = ["database_id", "object_id", "partition_number"]
MEASURES = ["row_cnt", "page_count", "data_compression"]
INDEX_KEYS = ["database_id", "object_id"]
BUDGET_PAGES = 100_000


@query(
    "q_merge_state",
    """SELECT coalesce(p.database_id, c.database_id) AS database_id, coalesce(p.object_id, c.object_id) AS object_id,
      CAST(coalesce(p.partition_number, c.partition_number) AS BIGINT) AS partition_number,
      CASE WHEN p.object_id IS NULL THEN 'INSERT' WHEN c.object_id IS NULL THEN 'DELETE'
        WHEN p.row_cnt <> c.row_cnt OR p.page_count <> c.page_count OR p.data_compression <> c.data_compression
        THEN 'UPDATE' ELSE 'KEEP' END AS action,
      p.row_cnt AS old_row_cnt, p.page_count AS old_page_count, p.data_compression AS old_data_compression,
      c.row_cnt AS new_row_cnt, c.page_count AS new_page_count, c.data_compression AS new_data_compression
    FROM v_index_prev p FULL JOIN v_index_now c ON p.database_id = c.database_id AND p.object_id = c.object_id
      AND p.partition_number = c.partition_number""",
)
def q_merge_state(t: Inputs) -> DataFrame:
    return merge_state(t.index_prev, t.index_now, KEYS, MEASURES)


@query(
    "q_merge_apply",
    """SELECT database_id, object_id, CAST(partition_number AS BIGINT) AS partition_number, row_cnt, page_count,
      data_compression FROM v_index_now""",
)
def q_merge_apply(t: Inputs) -> DataFrame:
    """A state table written from one poll and brought up to date with the next, bucket by bucket."""
    path = fresh_path(t.spark, "index-state")
    upsert(t.index_prev, path, KEYS, MEASURES)
    upsert(t.index_now, path, KEYS, MEASURES)
    return read_state(t.spark, path, t.index_now.select(*KEYS, *MEASURES).schema)


@query(
    "q_index_inventory",
    """WITH whole AS (SELECT database_id, object_id, count(*) AS partition_count, CAST(sum(page_count) AS BIGINT) AS index_page_count
      FROM v_index_cur GROUP BY 1, 2)
    SELECT c.database_id, c.object_id, CAST(c.partition_number AS BIGINT) AS partition_number, c.row_cnt, c.page_count,
      w.partition_count, w.index_page_count
    FROM v_index_cur c JOIN whole w ON w.database_id = c.database_id AND w.object_id = c.object_id
    WHERE c.data_compression = 'NONE'""",
)
def q_index_inventory(t: Inputs) -> DataFrame:
    return index_inventory(t.index_cur, INDEX_KEYS).select(
        *KEYS, "row_cnt", "page_count", "partition_count", "index_page_count"
    )


_STATUS = "CASE WHEN object_id % 9 = 0 THEN '1205' WHEN object_id % 8 = 0 THEN '0' ELSE '' END"


@query(
    "q_compress_worklist",
    f"""SELECT database_id, object_id, CAST(partition_number AS BIGINT) AS partition_number, status, page_count,
      page_count * 8 // 1024 AS size_mb,
      row_number() OVER (PARTITION BY database_id ORDER BY status, page_count, object_id, partition_number) AS order_no,
      concat('ALTER INDEX [', index_name, '] ON [', database_name, '].[dbo].[', object_name,
        '] REBUILD WITH (ONLINE = ON, DATA_COMPRESSION = PAGE)') AS command_text
    FROM (SELECT *, {_STATUS} AS status FROM v_index_cur) s WHERE data_compression = 'NONE' AND status <> '0'""",
)
def q_compress_worklist(t: Inputs) -> DataFrame:
    state = mark_done(t.index_cur.withColumn("status", F.expr(_STATUS)))
    plan = compression_worklist(state, ["object_id", "partition_number"], ["database_id"])
    return plan.select(*KEYS, "status", "page_count", "size_mb", "order_no", "command_text")


_RUNNING = """sum(page_count) OVER (PARTITION BY database_id ORDER BY page_count NULLS FIRST, object_id, partition_number
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""


@query(
    "q_index_cumulative",
    f"""SELECT database_id, object_id, CAST(partition_number AS BIGINT) AS partition_number, page_count,
      CAST({_RUNNING} AS BIGINT) AS total_pages FROM v_index_cur""",
)
def q_index_cumulative(t: Inputs) -> DataFrame:
    rows = t.index_cur.select(*KEYS, "page_count")
    order = ["page_count", "object_id", "partition_number"]
    return cumulative(rows, "page_count", order, ["database_id"], "total_pages")


@query(
    "q_index_budget",
    f"""SELECT database_id, object_id, CAST(partition_number AS BIGINT) AS partition_number, page_count, spent
    FROM (SELECT *, CAST({_RUNNING} AS BIGINT) AS spent FROM v_index_cost) c
    WHERE coalesce(spent, 0) - coalesce(page_count, 0) < {BUDGET_PAGES}""",
)
def q_index_budget(t: Inputs) -> DataFrame:
    rows = t.index_cost
    order = ["page_count", "object_id", "partition_number"]
    return within_budget(rows, "page_count", BUDGET_PAGES, order, ["database_id"])


@query(
    "q_fragmentation",
    """SELECT database_id, object_id, CAST(partition_number AS BIGINT) AS partition_number, frag_pct, page_count,
      CASE WHEN frag_pct >= 30 THEN 'High' WHEN frag_pct >= 5 THEN 'Medium' ELSE 'Low' END AS frag_group,
      concat('{"page_count":', page_count, ',"fragmentation":', CAST(CAST(frag_pct AS DECIMAL(9, 2)) AS VARCHAR), '}') AS extended_info
    FROM (SELECT database_id, object_id, partition_number, max(avg_fragmentation_in_percent) AS frag_pct,
        CAST(sum(page_count) AS BIGINT) AS page_count FROM v_index_page
      WHERE alloc_unit_type_desc = 'IN_ROW_DATA' AND index_level = 0 GROUP BY 1, 2, 3) f""",
)
def q_fragmentation(t: Inputs) -> DataFrame:
    measured = fragmentation(t.index_page, KEYS)
    return measured.withColumn("frag_group", frag_group()).withColumn(
        "extended_info", F.to_json(extended_info())
    )


def _with_partitions(t: Inputs) -> DataFrame:
    return with_partition_count(t.index_cur, INDEX_KEYS).withColumn("is_partition", is_partition())


_PARTS = """parts AS (SELECT database_id, object_id, count(*) AS partition_count FROM v_index_cur GROUP BY 1, 2)"""
_DECIDED = f"""{_PARTS}, flags AS (
    SELECT c.*, p.partition_count, p.partition_count <> 1 AS is_partition,
      CASE WHEN on_read_only_group THEN NULL WHEN frag_pct >= 30 THEN 'High' WHEN frag_pct >= 5 THEN 'Medium' ELSE 'Low' END AS frag_group,
      NOT on_read_only_group AND NOT is_memory_optimized AND index_type <= 5 AS can_offline,
      NOT on_read_only_group AND NOT is_memory_optimized AND index_type <= 5 AND (allow_page_locks OR index_type = 5) AS can_reorganize,
      NOT on_read_only_group AND NOT is_memory_optimized AND NOT is_column_store AND (index_type = 2
        OR (index_type = 1 AND NOT is_image_text AND NOT (is_new_lob AND is_file_stream))) AS can_online
    FROM v_index_cur c JOIN parts p ON p.database_id = c.database_id AND p.object_id = c.object_id),
  decided AS (
    SELECT *, CASE WHEN resumable THEN 'INDEX_REBUILD_ONLINE' WHEN page_count < 1000 THEN NULL
      WHEN frag_group = 'Medium' AND can_reorganize THEN 'INDEX_REORGANIZE'
      WHEN frag_group IN ('Medium', 'High') AND can_online THEN 'INDEX_REBUILD_ONLINE'
      WHEN frag_group IN ('Medium', 'High') AND can_offline THEN 'INDEX_REBUILD_OFFLINE' END AS index_action
    FROM flags)"""

_OPTIONS = """concat_ws(', ',
    CASE WHEN index_action LIKE '%REBUILD%' AND index_type <= 4 AND NOT resumable THEN 'SORT_IN_TEMPDB = OFF' END,
    CASE WHEN index_action = 'INDEX_REBUILD_ONLINE' AND NOT resumable THEN 'ONLINE = ON'
         WHEN index_action = 'INDEX_REBUILD_OFFLINE' AND NOT resumable THEN 'ONLINE = OFF' END,
    CASE WHEN index_action = 'INDEX_REBUILD_ONLINE' AND NOT allow_page_locks THEN 'MAXDOP = 1'
         WHEN index_action LIKE '%REBUILD%' THEN 'MAXDOP = 4' END,
    CASE WHEN index_action LIKE '%REBUILD%' AND NOT is_partition AND index_type <= 4 AND NOT resumable THEN 'FILLFACTOR = 90' END,
    CASE WHEN index_action = 'INDEX_REBUILD_ONLINE' AND NOT resumable THEN
      CASE WHEN index_type IN (1, 2) AND NOT is_computed AND NOT is_timestamp THEN 'RESUMABLE = ON' ELSE 'RESUMABLE = OFF' END END,
    CASE WHEN index_action = 'INDEX_REORGANIZE' THEN 'LOB_COMPACTION = ON' END)"""


def _yes(c: str) -> str:
    return f"CASE WHEN {c} THEN 'Yes' ELSE 'No' END"


@query(
    "q_index_action",
    f"""WITH {_DECIDED}
    SELECT database_id, object_id, CAST(partition_number AS BIGINT) AS partition_number, is_partition, frag_group, index_action,
      concat('ALTER INDEX [', index_name, '] ON [', database_name, '].[dbo].[', object_name, ']',
        CASE WHEN resumable THEN ' RESUME' WHEN index_action = 'INDEX_REORGANIZE' THEN ' REORGANIZE' ELSE ' REBUILD' END,
        CASE WHEN is_partition AND NOT resumable THEN concat(' PARTITION = ', partition_number) ELSE '' END,
        CASE WHEN {_OPTIONS} <> '' THEN concat(' WITH (', {_OPTIONS}, ')') ELSE '' END) AS command_text,
      concat('IndexType: ', CASE index_type WHEN 1 THEN 'Clustered' WHEN 2 THEN 'NonClustered' WHEN 3 THEN 'XML' WHEN 4 THEN 'Spatial'
          WHEN 5 THEN 'Clustered Columnstore' WHEN 6 THEN 'NonClustered Columnstore' ELSE 'NonClustered Hash' END,
        ', ImageText: ', {_yes('is_image_text')}, ', NewLOB: ', {_yes('is_new_lob')}, ', FileStream: ', {_yes('is_file_stream')},
        ', ColumnStore: ', {_yes('is_column_store')}, ', AllowPageLocks: ', {_yes('allow_page_locks')}, ', PageCount: ', page_count,
        ', Fragmentation: ', CAST(CAST(frag_pct AS DECIMAL(9, 2)) AS VARCHAR)) AS comment
    FROM decided WHERE index_action IS NOT NULL""",
)
def q_index_action(t: Inputs) -> DataFrame:
    decided = choose_action(_with_partitions(t)).where(F.col("index_action").isNotNull())
    return decided.select(
        *KEYS, "is_partition", "frag_group", "index_action",
        index_command(max_dop=4, fill_factor=90, resumable=True).alias("command_text"),
        index_comment().alias("comment"),
    )


@query(
    "q_stats_update",
    f"""WITH {_DECIDED}
    SELECT database_id, object_id, CAST(partition_number AS BIGINT) AS partition_number, row_cnt, modification_counter,
      concat('UPDATE STATISTICS [', database_name, '].[dbo].[', object_name, '] [', index_name, '] WITH ',
        CASE WHEN is_incremental THEN 'RESAMPLE' ELSE 'SAMPLE 20 PERCENT' END,
        CASE WHEN no_recompute THEN ', NORECOMPUTE' ELSE '' END,
        CASE WHEN is_incremental THEN concat(' ON PARTITIONS(', partition_number, ')') ELSE '' END) AS command_text
    FROM decided WHERE index_type IN (1, 2, 3, 4, 7)
      AND (modification_counter * 100 >= 50 * row_cnt OR (modification_counter > 0 AND modification_counter >= sqrt(row_cnt * 1000.0)))
      AND CASE WHEN is_partition THEN partition_number = partition_count OR is_incremental
        ELSE coalesce(index_action NOT LIKE '%REBUILD%', true) END""",
)
def q_stats_update(t: Inputs) -> DataFrame:
    rows = choose_action(_with_partitions(t)).select(
        "*",
        F.lit(1).alias("index_id"),
        F.lit(1).alias("stats_id"),
        F.col("index_name").alias("stats_name"),
    )
    chosen = choose_stats_update(rows, "ALL", modification_level=50, partition_level=True)
    mode = stats_mode(sample=20, partition_level=True)
    return chosen.where("update_statistics").select(
        *KEYS, "row_cnt", "modification_counter",
        stats_command(mode, partition_level=True).alias("command_text"),
    )


_OLD = "is_memory_optimized AND NOT (12 + object_id % 2 >= 13 OR object_id % 5 IN (0, 3))"


@query(
    "q_stats_update_old",
    f"""WITH {_DECIDED}
    SELECT database_id, object_id, CAST(partition_number AS BIGINT) AS partition_number, is_memory_optimized,
      concat('UPDATE STATISTICS [', database_name, '].[dbo].[', object_name, '] [', index_name, '] WITH ',
        CASE WHEN {_OLD} THEN 'RESAMPLE' ELSE 'SAMPLE 20 PERCENT' END,
        CASE WHEN no_recompute THEN ', NORECOMPUTE' ELSE '' END) AS command_text
    FROM decided WHERE index_type IN (1, 2, 3, 4, 7)
      AND (modification_counter * 100 >= 50 * row_cnt OR (modification_counter > 0 AND modification_counter >= sqrt(row_cnt * 1000.0))
        OR ({_OLD}))
      AND CASE WHEN is_partition THEN partition_number = partition_count
        ELSE coalesce(index_action NOT LIKE '%REBUILD%', true) END""",
)
def q_stats_update_old(t: Inputs) -> DataFrame:
    """Servers of two versions and several editions; memory-optimized tables of the old ones have rules of their own."""
    rows = choose_action(_with_partitions(t)).select(
        "*",
        F.lit(1).alias("index_id"),
        F.lit(1).alias("stats_id"),
        F.col("index_name").alias("stats_name"),
        (12 + F.col("object_id") % 2).alias("version"),
        F.when(F.col("object_id") % 5 == 0, 5).when(F.col("object_id") % 5 == 3, 8).otherwise(2).alias("engine_edition"),
    )
    old = is_old_engine()
    chosen = choose_stats_update(rows, "ALL", modification_level=50, old_engine=old)
    return chosen.where("update_statistics").select(
        *KEYS, "is_memory_optimized", stats_command(stats_mode(sample=20, old_engine=old)).alias("command_text")
    )


# ---------------------------------------------------------------- catalogue

_CATALOG_COLUMNS = [
    "object_id", "object_name", "object_type", "is_memory_optimized", "index_id", "index_name",
    "index_type", "is_image_text", "is_new_lob", "is_file_stream", "is_column_store", "is_computed",
    "is_timestamp", "on_read_only_group", "resumable", "stats_id", "stats_name", "no_recompute",
    "partition_number", "partition_count",
]

_LARGE = "(c.type_name = 'xml' OR ((c.type_name IN ('varchar', 'nvarchar', 'varbinary') OR c.is_assembly_type) AND c.max_length = -1))"
_ON_OBJECT = "FROM v_column c WHERE c.object_id = i.object_id"
_ON_INDEX = """FROM v_index_column x JOIN v_column c ON c.object_id = x.object_id AND c.column_id = x.column_id
      WHERE x.object_id = i.object_id AND x.index_id = i.index_id"""

_CATALOG = f"""WITH shown AS (SELECT * FROM v_object WHERE object_type IN ('U', 'V') AND NOT is_ms_shipped),
  counts AS (SELECT object_id, index_id, count(DISTINCT partition_number) AS partition_count FROM v_index_part GROUP BY 1, 2),
  read_only AS (SELECT object_id, index_id, partition_number FROM v_index_part WHERE is_read_only),
  paused AS (SELECT p.object_id, p.index_id, p.partition_number FROM v_index_part p JOIN v_index i
    ON i.object_id = p.object_id AND i.index_id = p.index_id WHERE i.is_paused),
  catalog AS (
    SELECT o.object_id, o.object_name, o.object_type, o.is_memory_optimized, i.index_id, i.index_name,
      CAST(i.index_type AS BIGINT) AS index_type,
      i.index_type = 1 AND EXISTS (SELECT 1 {_ON_OBJECT} AND c.type_name IN ('image', 'text', 'ntext')) AS is_image_text,
      (i.index_type = 1 AND EXISTS (SELECT 1 {_ON_OBJECT} AND {_LARGE}))
        OR (i.index_type = 2 AND EXISTS (SELECT 1 {_ON_INDEX} AND {_LARGE})) AS is_new_lob,
      i.index_type = 1 AND EXISTS (SELECT 1 {_ON_OBJECT} AND c.is_filestream) AS is_file_stream,
      EXISTS (SELECT 1 FROM v_index z WHERE z.object_id = i.object_id AND z.index_type IN (5, 6)) AS is_column_store,
      EXISTS (SELECT 1 {_ON_INDEX} AND (x.key_ordinal > 0 OR x.partition_ordinal > 0) AND c.is_computed) AS is_computed,
      EXISTS (SELECT 1 {_ON_INDEX} AND c.type_name = 'timestamp') AS is_timestamp,
      EXISTS (SELECT 1 FROM read_only r WHERE r.object_id = i.object_id AND r.index_id = i.index_id
        AND r.partition_number = p.partition_number) AS on_read_only_group,
      EXISTS (SELECT 1 FROM paused r WHERE r.object_id = i.object_id AND r.index_id = i.index_id
        AND r.partition_number = p.partition_number) AS resumable,
      s.stats_id, s.stats_name, s.no_recompute, CAST(p.partition_number AS BIGINT) AS partition_number, k.partition_count
    FROM v_index i JOIN shown o ON o.object_id = i.object_id
    LEFT JOIN v_stat s ON s.object_id = i.object_id AND s.stats_id = i.index_id
    LEFT JOIN v_index_part p ON p.object_id = i.object_id AND p.index_id = i.index_id
    LEFT JOIN counts k ON k.object_id = i.object_id AND k.index_id = i.index_id
    WHERE i.index_type BETWEEN 1 AND 7 AND NOT i.is_disabled AND NOT i.is_hypothetical
    UNION
    SELECT o.object_id, o.object_name, o.object_type, o.is_memory_optimized, NULL, NULL, NULL, NULL, NULL, NULL, NULL,
      NULL, NULL, NULL, NULL, s.stats_id, s.stats_name, s.no_recompute, NULL, NULL
    FROM v_stat s JOIN shown o ON o.object_id = s.object_id
    WHERE NOT EXISTS (SELECT 1 FROM v_index i WHERE i.object_id = s.object_id AND i.index_id = s.stats_id))"""


def _catalog(t: Inputs) -> DataFrame:
    indexes, objects, stats, partitions = t.index, t.object, t.stat, t.index_part
    read_only = partitions.where("is_read_only")
    paused = partitions.join(indexes.where("is_paused"), ["object_id", "index_id"], "left_semi")
    rows = index_catalog(
        indexes, objects, stats, partitions, t.column, t.index_column, read_only, paused
    )
    return index_stats_catalog(rows, column_stats(stats, objects, indexes))


@query("q_index_stats_catalog", f"{_CATALOG} SELECT * FROM catalog")
def q_index_stats_catalog(t: Inputs) -> DataFrame:
    return _catalog(t).select(*_CATALOG_COLUMNS)


@query(
    "q_index_order",
    f"""{_CATALOG} SELECT object_id, index_id, stats_id, partition_number,
      CAST(CASE WHEN coalesce(index_name, stats_name) LIKE '%7' THEN 1 ELSE 2 END AS BIGINT) AS start_position,
      row_number() OVER (ORDER BY coalesce(resumable, false) DESC,
        CASE WHEN coalesce(index_name, stats_name) LIKE '%7' THEN 1 ELSE 2 END, object_name,
        CASE WHEN index_type IS NULL THEN 1 ELSE 0 END, index_type NULLS FIRST, index_name NULLS FIRST,
        stats_name NULLS FIRST, partition_number NULLS FIRST) AS order_no
    FROM catalog""",
)
def q_index_order(t: Inputs) -> DataFrame:
    named = _catalog(t).withColumn("work_name", F.coalesce("index_name", "stats_name"))
    listed = select_by_spec(named, "%7,%", ("work_name",)).where("selected")
    return index_order(listed, scope=()).select(
        "object_id", "index_id", "stats_id", "partition_number", "start_position", "order_no"
    )
