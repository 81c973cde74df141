"""Integrity checks, index and statistics maintenance."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opslens.functions import concat_nullsafe, holds, quotename
from opslens.operators.ranking import numbered
from opslens.operators.selection import order_databases, parse_list

# Check commands, actions, limits and type codes.
CHECK_COMMANDS = ("CHECKDB", "CHECKFILEGROUP", "CHECKALLOC", "CHECKTABLE", "CHECKCATALOG")
REORGANIZE = "INDEX_REORGANIZE"
REBUILD_ONLINE = "INDEX_REBUILD_ONLINE"
REBUILD_OFFLINE = "INDEX_REBUILD_OFFLINE"
ACTIONS = (REBUILD_ONLINE, REBUILD_OFFLINE, REORGANIZE)
FRAGMENTATION_LOW = None
FRAGMENTATION_MEDIUM = "INDEX_REORGANIZE,INDEX_REBUILD_ONLINE,INDEX_REBUILD_OFFLINE"
FRAGMENTATION_HIGH = "INDEX_REBUILD_ONLINE,INDEX_REBUILD_OFFLINE"
LEVEL1, LEVEL2 = 5, 30
MIN_PAGES = 1000
INDEX_TYPES = {
    1: "Clustered",
    2: "NonClustered",
    3: "XML",
    4: "Spatial",
    5: "Clustered Columnstore",
    6: "NonClustered Columnstore",
    7: "NonClustered Hash",
}
ROW_STORE_TYPES = (1, 2, 3, 4)
REBUILDABLE_TYPES = (1, 2, 3, 4, 5)
STATISTICS_TYPES = (1, 2, 3, 4, 7)
COLUMN_STORE_TYPES = (5, 6)
ONLINE_EDITIONS = (3, 5, 8)
IMAGE_TEXT_TYPES = ("image", "text", "ntext")
MAX_LENGTH_TYPES = ("varchar", "nvarchar", "varbinary")
USER_OBJECT_TYPES = ("U", "V")


# ---------------------------------------------------------------- integrity checks


def check_eligible(
    databases: DataFrame,
    *,
    replicas: str = "ALL",
    updateability: str = "ALL",
    enterprise: bool = True,
) -> DataFrame:
    """Databases that may be checked here: online, accessible, right replica, right updateability."""
    if replicas not in ("ALL", "PRIMARY", "SECONDARY", "PREFERRED_BACKUP_REPLICA"):
        raise ValueError(f"replicas not supported: {replicas!r}")
    if updateability not in ("ALL", "READ_ONLY", "READ_WRITE"):
        raise ValueError(f"updateability not supported: {updateability!r}")
    role = F.col("availability_group_role")
    wanted_role = {
        "ALL": F.lit(True),
        "PRIMARY": role == "PRIMARY",
        "SECONDARY": role == "SECONDARY",
        "PREFERRED_BACKUP_REPLICA": F.col("is_preferred_replica"),
    }[replicas]
    return databases.where(
        (F.col("state_desc") == "ONLINE")
        & ~((F.col("user_access_desc") == "SINGLE_USER") & ~F.col("is_accessible"))
        & ((role == "PRIMARY") | role.isNull() | F.lit(enterprise))
        & (wanted_role | role.isNull())
        & ~(F.col("is_read_only") & F.lit(updateability == "READ_WRITE"))
        & ~(~F.col("is_read_only") & F.lit(updateability == "READ_ONLY"))
    )


def check_plan(
    databases: DataFrame,
    check_commands: str = "CHECKDB",
    *,
    filegroups: DataFrame | None = None,
    objects: DataFrame | None = None,
    physical_only: bool = False,
    no_index: bool = False,
    extended_logical_checks: bool = False,
    tab_lock: bool = False,
    max_dop: int | None = None,
    lock_timeout: int | None = None,
    scope: Sequence[str],
) -> DataFrame:
    """Check commands for every eligible database and its selected filegroups and objects.

    ``scope`` names the server columns.
    """
    database = [*scope, "database_id"]
    commands = parse_list(check_commands, CHECK_COMMANDS)
    if "CHECKDB" in commands and len(commands) > 1:
        covered = {"CHECKFILEGROUP", "CHECKALLOC", "CHECKTABLE", "CHECKCATALOG"}
        if covered & set(commands):
            raise ValueError("CHECKDB already covers the other check commands")
    if "CHECKFILEGROUP" in commands and {"CHECKALLOC", "CHECKTABLE"} & set(commands):
        raise ValueError("CHECKFILEGROUP already covers CHECKALLOC and CHECKTABLE")
    if physical_only and extended_logical_checks:
        raise ValueError("extended logical checks need more than a physical check")

    timeout = "" if lock_timeout is None else f"SET LOCK_TIMEOUT {lock_timeout * 1000}; "
    inner = ", NOINDEX" if no_index else ""
    locks = ", TABLOCK" if tab_lock else ""
    dop = "" if max_dop is None else f", MAXDOP = {max_dop}"
    physical = ", PHYSICAL_ONLY" if physical_only else ""
    extended = ", EXTENDED_LOGICAL_CHECKS" if extended_logical_checks else ""
    quiet = ") WITH NO_INFOMSGS, ALL_ERRORMSGS"
    purity = physical or ", DATA_PURITY"
    use = concat_nullsafe("USE ", quotename("name"), "; ")

    def branch(df: DataFrame, command: str, target: Column, text: Column) -> DataFrame:
        return df.select(
            *database,
            "name",
            F.lit(f"DBCC_{command}").alias("command_type"),
            target.alias("target"),
            concat_nullsafe(timeout, text).alias("command_text"),
        )

    branches = []
    for command in commands:
        if command == "CHECKFILEGROUP":
            if filegroups is None:
                raise ValueError("CHECKFILEGROUP needs the filegroups table")
            rows = databases.join(filegroups.select(*database, "filegroup_name"), database)
            target = F.col("filegroup_name")
            text = concat_nullsafe(
                use, f"DBCC {command} (", quotename("filegroup_name"),
                f"{inner}{quiet}{physical}{locks}{dop}",
            )
        elif command == "CHECKTABLE":
            if objects is None:
                raise ValueError("CHECKTABLE needs the objects table")
            rows = databases.join(
                objects.select(*database, "schema_name", "object_name"), database
            )
            target = F.concat(quotename("schema_name"), F.lit("."), quotename("object_name"))
            text = concat_nullsafe(
                use, f"DBCC {command} ('", target,
                f"'{inner}{quiet}{purity}{extended}{locks}{dop}",
            )
        else:
            rows, target = databases, F.col("name")
            tail = {
                "CHECKDB": f"{inner}{quiet}{purity}{extended}{locks}{dop}",
                "CHECKALLOC": f"{quiet}{locks}",
                "CHECKCATALOG": ") WITH NO_INFOMSGS",
            }[command]
            text = concat_nullsafe(f"DBCC {command} (", quotename("name"), tail)
        branches.append(branch(rows, command, target, text))
    plan = branches[0]
    for other in branches[1:]:
        plan = plan.unionByName(other)
    return plan


def last_successful(
    command_log: DataFrame, command_type: str = "DBCC_CHECKDB", scope: Sequence[str] = ()
) -> DataFrame:
    """Start of the last successful run per database."""
    return (
        command_log.where((F.col("command_type") == command_type) & (F.col("error_number") == 0))
        .groupBy(*scope, F.col("database_name").alias("name"))
        .agg(F.max("start_time").alias("last_command_time"))
    )


def order_by_last_check(
    databases: DataFrame,
    command_log: DataFrame,
    descending: bool = False,
    scope: Sequence[str] = (),
) -> DataFrame:
    """Databases by last successful check; the never-checked come first when ascending."""
    runs = last_successful(command_log, scope=scope)
    mode = f"REPLICA_LAST_GOOD_CHECK_{'DESC' if descending else 'ASC'}"
    return order_databases(databases.join(runs, [*scope, "name"], "left"), mode, scope)


# ---------------------------------------------------------------- catalogue


def index_catalog(
    indexes: DataFrame,
    objects: DataFrame,
    stats: DataFrame,
    partitions: DataFrame | None,
    columns: DataFrame,
    index_columns: DataFrame,
    read_only_targets: DataFrame,
    paused: DataFrame,
    *,
    include_shipped: bool = False,
    scope: Sequence[str] = (),
) -> DataFrame:
    """Index rows (one per partition) with the flags the maintenance decisions need.

    Flags are existence tests.  Each is one grouped boolean per object or per
    index, so a wide object never multiplies rows.
    """
    scope = list(scope)
    by_object = [*scope, "object_id"]
    by_index = [*scope, "object_id", "index_id"]

    large = F.col("type_name").isin("xml") | (
        (F.col("type_name").isin(*MAX_LENGTH_TYPES) | F.col("is_assembly_type"))
        & (F.col("max_length") == -1)
    )
    column_flags = columns.groupBy(*by_object).agg(
        F.bool_or(F.col("type_name").isin(*IMAGE_TEXT_TYPES)).alias("o_image_text"),
        F.bool_or(large).alias("o_large"),
        F.bool_or("is_filestream").alias("o_filestream"),
    )
    is_key = (F.col("key_ordinal") > 0) | (F.col("partition_ordinal") > 0)
    index_flags = (
        index_columns.join(columns, [*by_object, "column_id"])
        .groupBy(*by_index)
        .agg(
            F.bool_or(large).alias("i_large"),
            F.bool_or(is_key & F.col("is_computed")).alias("i_computed"),
            F.bool_or(F.col("type_name") == "timestamp").alias("i_timestamp"),
        )
    )
    column_store = indexes.groupBy(*by_object).agg(
        F.bool_or(F.col("index_type").isin(*COLUMN_STORE_TYPES)).alias("is_column_store")
    )
    shown = objects.where(
        F.col("object_type").isin(*USER_OBJECT_TYPES)
        & (F.lit(include_shipped) | ~F.col("is_ms_shipped"))
    ).select(*by_object, "schema_name", "object_name", "object_type", "is_memory_optimized")
    active = indexes.where(
        F.col("index_type").isin(*INDEX_TYPES) & ~F.col("is_disabled") & ~F.col("is_hypothetical")
    )
    index_stats = stats.select(
        *scope, "object_id", F.col("stats_id").alias("index_id"), "stats_id", "stats_name",
        "no_recompute", "is_incremental",
    )

    out = (
        active.join(shown, by_object)
        .join(column_store, by_object, "left")
        .join(column_flags, by_object, "left")
        .join(index_flags, by_index, "left")
        .join(index_stats, by_index, "left")
    )
    if partitions is None:
        out = out.withColumn("partition_number", F.lit(None).cast("int")).withColumn(
            "partition_count", F.lit(None).cast("long")
        )
    else:
        counts = partitions.groupBy(*by_index).agg(
            F.countDistinct("partition_number").alias("partition_count")
        )
        out = out.join(partitions.select(*by_index, "partition_number"), by_index, "left").join(
            counts, by_index, "left"
        )
    on_partition = [*by_index, "partition_number"]
    read_only = read_only_targets.select(*on_partition).distinct()
    resume = paused.select(*on_partition).distinct()
    out = out.join(
        read_only.withColumn("on_read_only_group", F.lit(True)), on_partition, "left"
    ).join(resume.withColumn("resumable", F.lit(True)), on_partition, "left")

    clustered, nonclustered = F.col("index_type") == 1, F.col("index_type") == 2
    return out.select(
        *scope, "object_id", "schema_name", "object_name", "object_type", "is_memory_optimized",
        "index_id", "index_name", "index_type", "allow_page_locks",
        holds(clustered & F.col("o_image_text")).alias("is_image_text"),
        holds((clustered & F.col("o_large")) | (nonclustered & F.col("i_large"))).alias("is_new_lob"),
        holds(clustered & F.col("o_filestream")).alias("is_file_stream"),
        holds(F.col("is_column_store")).alias("is_column_store"),
        holds(F.col("i_computed")).alias("is_computed"),
        holds(F.col("i_timestamp")).alias("is_timestamp"),
        holds(F.col("on_read_only_group")).alias("on_read_only_group"),
        holds(F.col("resumable")).alias("resumable"),
        "stats_id", "stats_name", "no_recompute", "is_incremental",
        "partition_number", "partition_count",
    )


def column_stats(
    stats: DataFrame,
    objects: DataFrame,
    indexes: DataFrame,
    *,
    include_shipped: bool = False,
    scope: Sequence[str] = (),
) -> DataFrame:
    """Statistics that belong to no index."""
    scope = list(scope)
    by_object = [*scope, "object_id"]
    shown = objects.where(
        F.col("object_type").isin(*USER_OBJECT_TYPES)
        & (F.lit(include_shipped) | ~F.col("is_ms_shipped"))
    ).select(*by_object, "schema_name", "object_name", "object_type", "is_memory_optimized")
    index_ids = indexes.select(*by_object, F.col("index_id").alias("stats_id"))
    return stats.join(index_ids, [*by_object, "stats_id"], "left_anti").join(shown, by_object)


def index_stats_catalog(index_rows: DataFrame, stats_rows: DataFrame) -> DataFrame:
    """Index rows and column-statistics rows as one work list without repeats."""
    return index_rows.unionByName(stats_rows, allowMissingColumns=True).distinct()


def index_order(
    work: DataFrame,
    scope: Sequence[str] = ("database_id",),
) -> DataFrame:
    """Work order: resumable first, list position, names, indexes before statistics, partition."""
    first = F.when(holds(F.col("resumable")), 0).otherwise(1)
    is_statistics = F.when(F.col("index_type").isNull(), 1).otherwise(0)
    order = [
        first,
        F.col("start_position").asc_nulls_first(),
        F.col("schema_name"),
        F.col("object_name"),
        is_statistics,
        F.col("index_type").asc_nulls_first(),
        F.col("index_name").asc_nulls_first(),
        F.col("stats_name").asc_nulls_first(),
        F.col("partition_number").asc_nulls_first(),
    ]
    return numbered(work, scope, order, "order_no")


# ---------------------------------------------------------------- index actions


def is_partition(number: str = "partition_number", count: str = "partition_count") -> Column:
    return F.when(F.col(number).isNull() | (F.col(count) == 1), False).otherwise(True)


def with_partition_count(index_partitions: DataFrame, index_keys: Sequence[str]) -> DataFrame:
    """Number of partitions on each partition row; an index has at most 15,000 of them."""
    return index_partitions.withColumn(
        "partition_count", F.count(F.lit(1)).over(Window.partitionBy(*index_keys))
    )


def fragmentation(physical: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Worst fragmentation and page total per index partition, in-row leaf level only."""
    return (
        physical.where(
            (F.col("alloc_unit_type_desc") == "IN_ROW_DATA") & (F.col("index_level") == 0)
        )
        .groupBy(*keys)
        .agg(
            F.max("avg_fragmentation_in_percent").alias("frag_pct"),
            F.sum("page_count").alias("page_count"),
        )
    )


def frag_group(
    column: str = "frag_pct", level1: float = LEVEL1, level2: float = LEVEL2
) -> Column:
    c = F.col(column)
    return F.when(c >= level2, "High").when(c >= level1, "Medium").when(c < level1, "Low")


def extended_info(page_count: str = "page_count", frag: str = "frag_pct") -> Column:
    """Structured comment of an index action; NULL when nothing was measured."""
    info = F.struct(
        F.col(page_count).cast("long").alias("page_count"),
        F.col(frag).cast("decimal(9,2)").alias("fragmentation"),
    )
    return F.when(F.col(page_count).isNotNull() | F.col(frag).isNotNull(), info)


def index_comment() -> Column:
    """Readable comment of an index action."""

    def yes_no(column: str) -> Column:
        c = F.col(column)
        return F.when(c, "Yes").when(~c, "No").otherwise("N/A")

    kind = F.lit("N/A")
    for code, name in INDEX_TYPES.items():
        kind = F.when(F.col("index_type") == code, name).otherwise(kind)
    return concat_nullsafe(
        "IndexType: ", kind,
        ", ImageText: ", yes_no("is_image_text"),
        ", NewLOB: ", yes_no("is_new_lob"),
        ", FileStream: ", yes_no("is_file_stream"),
        ", ColumnStore: ", yes_no("is_column_store"),
        ", AllowPageLocks: ", yes_no("allow_page_locks"),
        ", PageCount: ", F.coalesce(F.col("page_count").cast("string"), F.lit("N/A")),
        ", Fragmentation: ",
        F.coalesce(F.col("frag_pct").cast("decimal(9,2)").cast("string"), F.lit("N/A")),
    )


def preferences(
    low: str | None = FRAGMENTATION_LOW,
    medium: str | None = FRAGMENTATION_MEDIUM,
    high: str | None = FRAGMENTATION_HIGH,
) -> dict[str, list[str]]:
    """Preferred actions per fragmentation group, first choice first."""
    return {
        "Low": parse_list(low, ACTIONS),
        "Medium": parse_list(medium, ACTIONS),
        "High": parse_list(high, ACTIONS),
    }


def uniform_actions(preferred: Mapping[str, Sequence[str]]) -> bool:
    """All groups prefer the same actions in the same order, so fragmentation is irrelevant."""
    low, medium, high = preferred["Low"], preferred["Medium"], preferred["High"]
    return list(low) == list(medium) == list(high)


def allowed_actions(edition: int = 3) -> Column:
    """Array of the actions an index can take at all."""
    row_store = F.col("index_type").isin(*REBUILDABLE_TYPES)
    plain = holds(~F.col("on_read_only_group")) & ~holds(F.col("is_memory_optimized"))
    reorganize = plain & row_store & (holds(F.col("allow_page_locks")) | (F.col("index_type") == 5))
    offline = plain & row_store
    clustered = (
        (F.col("index_type") == 1)
        & holds(~F.col("is_image_text"))
        & (holds(~F.col("is_new_lob")) | holds(~F.col("is_file_stream")))
    )
    online = (
        plain
        & (clustered | (F.col("index_type") == 2))
        & holds(~F.col("is_column_store"))
        & F.lit(edition in ONLINE_EDITIONS)
    )
    return F.array_compact(
        F.array(
            F.when(reorganize, F.lit(REORGANIZE)),
            F.when(offline, F.lit(REBUILD_OFFLINE)),
            F.when(online, F.lit(REBUILD_ONLINE)),
        )
    )


def choose_action(
    indexes: DataFrame,
    preferred: Mapping[str, Sequence[str]] | None = None,
    *,
    min_pages: int = MIN_PAGES,
    max_pages: int | None = None,
    level1: float = LEVEL1,
    level2: float = LEVEL2,
    edition: int = 3,
) -> DataFrame:
    """Add fragmentation group, allowed actions and the chosen action (NULL for none)."""
    preferred = preferences() if preferred is None else preferred
    group = F.when(holds(~F.col("on_read_only_group")), frag_group("frag_pct", level1, level2))
    out = indexes.withColumn("frag_group", group).withColumn(
        "allowed_actions", allowed_actions(edition)
    )

    def first_allowed(actions: Sequence[str]) -> Column:
        choice = F.lit(None).cast("string")
        for action in reversed(list(actions)):
            allowed = F.array_contains("allowed_actions", action)
            choice = F.when(allowed, F.lit(action)).otherwise(choice)
        return choice

    if uniform_actions(preferred):
        wanted = first_allowed(preferred["Low"])
    else:
        wanted = F.lit(None).cast("string")
        for name, actions in preferred.items():
            wanted = F.when(F.col("frag_group") == name, first_allowed(actions)).otherwise(wanted)
    in_window = F.lit(True) if min_pages == 0 else F.col("page_count") >= min_pages
    if max_pages is not None:
        in_window = in_window & (F.col("page_count") <= max_pages)
    resumable = holds(F.col("resumable"))
    return out.withColumn(
        "index_action",
        F.when(resumable, F.lit(REBUILD_ONLINE)).when(holds(in_window), wanted),
    )


def _table(database: str = "database_name") -> Column:
    return F.concat_ws(".", quotename(database), quotename("schema_name"), quotename("object_name"))


def index_command(
    *,
    sort_in_tempdb: bool = False,
    max_dop: int | None = None,
    fill_factor: int | None = None,
    pad_index: bool = False,
    lob_compaction: bool = True,
    resumable: bool = False,
    max_duration_minutes: int | None = None,
    wait_minutes: int | None = None,
    abort_after_wait: str = "NONE",
    lock_timeout: int | None = None,
) -> Column:
    """Text of the chosen index action with its ordered option list."""
    action = F.col("index_action")
    rebuild = action.isin(REBUILD_ONLINE, REBUILD_OFFLINE)
    online = action == REBUILD_ONLINE
    fresh = ~holds(F.col("resumable"))
    row_store = F.col("index_type").isin(*ROW_STORE_TYPES)
    whole = ~F.col("is_partition")
    can_resume = (
        F.lit(resumable)
        & F.col("index_type").isin(1, 2)
        & ~holds(F.col("is_computed"))
        & ~holds(F.col("is_timestamp"))
    )
    # An online rebuild without page locks must run on one thread.
    dop = F.when(online & holds(~F.col("allow_page_locks")), F.lit(1)).otherwise(
        F.lit(max_dop).cast("int")
    )
    low_priority = (
        f" (WAIT_AT_LOW_PRIORITY (MAX_DURATION = {wait_minutes}, ABORT_AFTER_WAIT = {abort_after_wait.upper()}))"
        if wait_minutes is not None
        else ""
    )

    def option(condition: Column, text: Column | str) -> Column:
        return F.when(holds(condition), F.lit(text) if isinstance(text, str) else text)

    options = [
        option(
            rebuild & row_store & fresh, f"SORT_IN_TEMPDB = {'ON' if sort_in_tempdb else 'OFF'}"
        ),
        option(online & fresh, f"ONLINE = ON{low_priority}"),
        option((action == REBUILD_OFFLINE) & fresh, "ONLINE = OFF"),
        option(rebuild & dop.isNotNull(), concat_nullsafe("MAXDOP = ", dop)),
        option(
            rebuild & F.lit(fill_factor is not None) & whole & row_store & fresh,
            f"FILLFACTOR = {fill_factor}",
        ),
        option(rebuild & F.lit(pad_index) & whole & row_store & fresh, "PAD_INDEX = ON"),
        option(
            online & fresh,
            F.when(can_resume, F.lit("RESUMABLE = ON")).otherwise(F.lit("RESUMABLE = OFF")),
        ),
        option(
            online & fresh & can_resume & F.lit(max_duration_minutes is not None),
            f"MAX_DURATION = {max_duration_minutes}",
        ),
        option(action == REORGANIZE, f"LOB_COMPACTION = {'ON' if lob_compaction else 'OFF'}"),
    ]
    clause = F.concat_ws(", ", *options)
    timeout = "" if lock_timeout is None else f"SET LOCK_TIMEOUT {lock_timeout * 1000}; "
    verb = (
        F.when(~fresh, " RESUME").when(rebuild, " REBUILD").when(action == REORGANIZE, " REORGANIZE")
    )
    part = F.when(
        F.col("is_partition") & fresh, concat_nullsafe(" PARTITION = ", F.col("partition_number"))
    )
    text = concat_nullsafe(
        f"{timeout}ALTER INDEX ", quotename("index_name"), " ON ", _table(), verb, part,
        F.when(clause != "", F.concat(F.lit(" WITH ("), clause, F.lit(")"))),
    )
    return F.when(action.isNotNull(), text)


# ---------------------------------------------------------------- statistics


# The version from which memory-optimized tables keep their statistics up to date and take samples,
# and the engine editions that do so whatever their version.
SAMPLED_MEMORY_VERSION = 13
CLOUD_EDITIONS = (5, 8)


def is_old_engine(version: str = "version", engine_edition: str = "engine_edition") -> Column:
    """Whether memory-optimized tables need their statistics updated always, and only FULLSCAN or RESAMPLE works."""
    return ~(holds(F.col(version) >= SAMPLED_MEMORY_VERSION) | holds(F.col(engine_edition).isin(*CLOUD_EDITIONS)))


def choose_stats_update(
    rows: DataFrame,
    update: str | None = "ALL",
    *,
    only_modified: bool = False,
    modification_level: int | None = None,
    partition_level: bool = False,
    old_engine: Column | None = None,
) -> DataFrame:
    """Add ``update_statistics``.  With ``old_engine`` (see ``is_old_engine``) also is_memory_optimized is looked at.

    Columns: stats_id, index_id, index_type, index_action, is_partition,
    partition_number, partition_count, is_incremental, row_cnt, modification_counter.
    """
    if update not in (None, "ALL", "INDEX", "COLUMNS"):
        raise ValueError(f"statistics scope not supported: {update!r}")
    if only_modified and modification_level is not None:
        raise ValueError("give either only_modified or a modification level")
    has_index, typed = F.col("index_id").isNotNull(), F.col("index_type").isin(*STATISTICS_TYPES)
    scope = {
        None: F.lit(False),
        "ALL": typed | ~has_index,
        "INDEX": has_index & typed,
        "COLUMNS": ~has_index,
    }[update]
    changed = F.col("modification_counter")
    due = F.lit(True)
    if only_modified:
        due = changed > 0
    if modification_level is not None:
        rate = (
            changed.cast("decimal(20,0)")
            / F.nullif(F.col("row_cnt"), F.lit(0)).cast("decimal(20,0)")
            * 100
        )
        due = holds(rate >= modification_level) | (
            (changed > 0) & (changed >= F.sqrt(F.col("row_cnt") * 1000.0))
        )
    if old_engine is not None:
        due = holds(due) | (holds(F.col("is_memory_optimized")) & old_engine)
    rebuilt = F.col("index_action").isin(REBUILD_ONLINE, REBUILD_OFFLINE)
    uncovered = ~F.col("is_partition") & ~holds(rebuilt)
    last = F.col("partition_number") == F.col("partition_count")
    incremental = F.lit(partition_level) & holds(F.col("is_incremental"))
    place = uncovered | (F.col("is_partition") & (holds(last) | incremental))
    return rows.withColumn(
        "update_statistics",
        F.col("stats_id").isNotNull() & holds(scope) & holds(due) & holds(place),
    )


def stats_mode(
    sample: int | None = None,
    resample: bool = False,
    partition_level: bool = False,
    old_engine: Column | None = None,
) -> Column:
    """FULLSCAN, SAMPLE n PERCENT, RESAMPLE, or NULL for the server default.

    Incremental statistics of a partition only support RESAMPLE, memory-optimized tables of an old engine
    only that and FULLSCAN.
    """
    parts = []
    if sample is not None:
        parts.append("FULLSCAN" if sample == 100 else f"SAMPLE {sample} PERCENT")
    if resample:
        parts.append("RESAMPLE")
    plain = F.lit(", ".join(parts) or None).cast("string")
    if old_engine is not None and sample != 100:
        plain = F.when(holds(F.col("is_memory_optimized")) & old_engine, F.lit("RESAMPLE")).otherwise(plain)
    incremental = F.lit(partition_level) & holds(F.col("is_incremental"))
    return F.when(incremental, F.lit("RESAMPLE")).otherwise(plain)


def stats_command(
    mode: Column,
    *,
    max_dop: int | None = None,
    partition_level: bool = False,
    lock_timeout: int | None = None,
) -> Column:
    timeout = "" if lock_timeout is None else f"SET LOCK_TIMEOUT {lock_timeout * 1000}; "
    options = F.concat_ws(
        ", ",
        F.lit(None if max_dop is None else f"MAXDOP = {max_dop}").cast("string"),
        mode,
        F.when(holds(F.col("no_recompute")), F.lit("NORECOMPUTE")),
    )
    on_partition = F.when(
        F.lit(partition_level) & holds(F.col("is_incremental")) & F.col("partition_number").isNotNull(),
        concat_nullsafe(" ON PARTITIONS(", F.col("partition_number"), ")"),
    )
    text = concat_nullsafe(
        f"{timeout}UPDATE STATISTICS ", _table(), " ", quotename("stats_name"),
        F.when(options != "", F.concat(F.lit(" WITH "), options)), on_partition,
    )
    return F.when(F.col("update_statistics"), text)
