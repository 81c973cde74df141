"""Where disk space goes: files, databases, volumes, logs."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslens.functions import concat_nullsafe, pages_to_mb, percent, quote_literal, quotename
from opslens.operators.selection import in_chars, name_in_list_or_like

MB = "decimal(14,2)"
TOTAL_MB = "decimal(24,2)"
BYTES_PER_MB = Decimal(1048576)
BYTES_PER_GB = Decimal(1073741824)

SHRINK_SLACK_MB = 2000
EXPAND_FACTOR = Decimal("1.5")
SHRINK_TRIGGER_MB = 10_240
SHRINK_STEP_MB = 1024

_MEASURES = ("total_mb", "used_mb", "free_mb")


def file_space(
    files: DataFrame,
    drive_letters: str | None = None,
    databases: str | None = None,
    volumes: DataFrame | None = None,
    scope: Sequence[str] = (),
) -> DataFrame:
    """Size, used and free MB of each file with the figures of its volume.

    ``volumes`` lists every file of the server with its name and volume.  With it, ``files`` need only
    hold the sizes; files whose database could not be read stay, with sizes of 0.
    """
    if volumes is not None:
        key = [*scope, "database_id", "file_id"]
        sizes = files.select(*key, "size_pages", "used_pages", *[c for c in ("group_name",) if c in files.columns])
        listed = [c for c in volumes.columns if c not in sizes.columns or c in key]
        files = volumes.select(*listed).join(sizes, key, "left")
        files = files.fillna(0, ["size_pages", "used_pages"])
    drive = F.upper(F.left(F.col("volume_mount_point"), F.lit(1)))
    wanted = in_chars(drive, drive_letters) & name_in_list_or_like("database_name", databases)
    total, used = pages_to_mb("size_pages"), pages_to_mb("used_pages")
    disk_total = F.col("total_bytes").cast("decimal(20,0)")
    disk_free = F.col("available_bytes").cast("decimal(20,0)")
    return files.where(wanted).select(
        *scope,
        drive.alias("drive_letter"),
        "logical_volume_name",
        "database_id",
        "database_name",
        "file_id",
        "file_name",
        "type_desc",
        F.coalesce("group_name", F.lit("(log)")).alias("group_name"),
        (disk_total / BYTES_PER_MB).cast(MB).alias("disk_total_mb"),
        ((disk_total - disk_free) / BYTES_PER_MB).cast(MB).alias("disk_used_mb"),
        (disk_free / BYTES_PER_MB).cast(MB).alias("disk_free_mb"),
        ((disk_total - disk_free - 1) / disk_total * 100)
        .cast("decimal(5,2)")
        .alias("disk_used_perc"),
        F.coalesce(total, F.lit(0).cast(MB)).alias("total_mb"),
        F.coalesce(used, F.lit(0).cast(MB)).alias("used_mb"),
        F.coalesce(pages_to_mb(F.col("size_pages") - F.col("used_pages")), F.lit(0).cast(MB)).alias(
            "free_mb"
        ),
        disk_total.alias("disk_bytes_total"),
        disk_free.alias("disk_bytes_free"),
        "physical_name",
    ).withColumn("used_perc", percent(F.col("used_mb"), F.col("total_mb")))


def _sums() -> list[Column]:
    return [F.sum(m).cast(TOTAL_MB).alias(m) for m in _MEASURES]


def _used_perc(used: Column, total_or_one: Column) -> Column:
    return (used / total_or_one * 100).cast("decimal(12,2)")


def space_by_database(space: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Drive x database totals.  Volume figures are maxima, file figures are sums."""
    total, free = F.sum("disk_bytes_total"), F.sum("disk_bytes_free")
    return space.groupBy(*scope, "drive_letter", "logical_volume_name", "database_name").agg(
        F.max("disk_total_mb").alias("disk_total_mb"),
        F.max("disk_used_mb").alias("disk_used_mb"),
        ((total - free - 1) / total * 100).cast("decimal(5,2)").alias("disk_used_perc"),
        F.max("disk_free_mb").alias("disk_free_mb"),
        *_sums(),
    )


def resize_advice(space: DataFrame) -> DataFrame:
    """Shrink and expand targets per file, with the commands that would apply them."""
    shrink_mb = F.round("used_mb", 0).cast("long") + SHRINK_SLACK_MB
    expand_gb = F.ceil(F.col("total_mb") * EXPAND_FACTOR / 1024).cast("long")
    return (
        space.withColumn("shrink_target_mb", shrink_mb)
        .withColumn("expand_target_gb", expand_gb)
        .withColumn(
            "shrink_command",
            concat_nullsafe(
                "USE ", quotename("database_name"), "; DBCC SHRINKFILE (",
                quote_literal("file_name"), ", ", F.col("shrink_target_mb"), ")",
            ),
        )
        .withColumn(
            "expand_command",
            concat_nullsafe(
                "ALTER DATABASE ", quotename("database_name"), " MODIFY FILE (NAME = ",
                quote_literal("file_name"), ", SIZE = ", F.col("expand_target_gb"),
                "GB, FILEGROWTH = 1GB)",
            ),
        )
    )


def space_report(
    files: DataFrame,
    report_type: int | None = 2,
    drive_letters: str | None = None,
    databases: str | None = None,
    *,
    scope: Sequence[str],
) -> DataFrame:
    """Layered report per ``scope`` (the server columns).  Type 2 nests drive > database > file, type 3 database > drive > file.

    An unknown type falls back to type 1, the flat file list.  The levels use
    different measures (drive totals of type 2 are maxima of the volume, the
    rest are sums).  Each file is expanded into its row of every level and all levels are grouped at
    once, so the files are read and shuffled once; the rows of the upper levels combine before that.
    """
    space = file_space(files, drive_letters, databases, scope=scope)
    if report_type not in (2, 3):
        return resize_advice(space)
    by_drive = report_type == 2
    levels = _levels(space, by_drive, scope)

    kind, file = F.col("level.detail_type"), F.col("level.file")
    is_file, is_database, is_drive = (kind == k for k in (1, 2, 3))
    name, drive = F.col("level.database_name"), F.col("level.drive_letter")
    volume = F.col("level.logical_volume_name")
    volume = F.when(F.length(volume) > 0, concat_nullsafe("(", volume, ")"))
    label = (
        F.when(is_file, concat_nullsafe("        --> ", file["file_name"]))
        .when(is_database, concat_nullsafe("   --> " if by_drive else "", name))
        .otherwise(concat_nullsafe("" if by_drive else "   --> ", drive, ": ", volume))
    )

    def measure(m: str) -> Column:
        upper = F.col(m)
        if by_drive:
            upper = F.when(is_drive, F.col(f"disk_{m}")).otherwise(upper)
        return F.when(is_file, file[m]).otherwise(upper).cast(TOTAL_MB).alias(m)

    whole = _used_perc(F.col("used_mb"), F.col("whole"))
    if by_drive:
        whole = F.when(is_drive, F.col("disk_used_perc").cast("decimal(12,2)")).otherwise(whole)
    used_perc = F.when(is_file, file["used_perc"].cast("decimal(12,2)")).otherwise(whole).alias("used_perc")
    # A row of the flat list that occurs twice is shown twice.
    repeats = F.explode(F.sequence(F.lit(1), F.when(is_file, F.col("files").cast("int")).otherwise(1)))
    report = levels.select(
        *scope,
        kind.alias("detail_type"),
        label.alias("label"),
        F.when(is_database & F.lit(not by_drive), "").otherwise(drive).alias("drive_letter"),
        F.when(is_drive & F.lit(by_drive), "").otherwise(name).alias("database_name"),
        *[measure(m) for m in _MEASURES],
        used_perc,
        *[
            F.when(is_file, file[c]).otherwise("").alias(a)
            for c, a in (("group_name", "group_name"), ("type_desc", "file_type"), ("file_name", "file_name"))
        ],
        repeats.alias("__repeat"),
        F.when(is_file, file["physical_name"]).otherwise("").alias("physical_name"),
    ).drop("__repeat")
    commands = ("shrink_command", "expand_command")
    report = resize_advice(report).drop("shrink_target_mb", "expand_target_gb")
    report = report.withColumns({c: F.when(F.col("detail_type") == 1, F.col(c)).otherwise("") for c in commands})
    return (
        report.withColumn("total_text", F.format_number(F.round("total_mb", 0), 0))
        .withColumn("used_text", F.format_number(F.floor("used_mb"), 0))
        .withColumn("free_text", F.format_number(F.round("free_mb", 0), 0))
        .withColumn("used_perc_text", concat_nullsafe(F.col("used_perc"), "%"))
    )


def _levels(space: DataFrame, by_drive: bool, scope: Sequence[str]) -> DataFrame:
    """Files, databases and drives with their totals, from one grouping over the key of each level."""
    file_columns = ("database_id", "file_id", "file_name", "type_desc", "group_name", "physical_name", *_MEASURES, "used_perc")
    file = F.struct(*file_columns)
    none = F.lit(None)

    def level(detail_type: int, database: bool, drive: bool, volume: bool) -> Column:
        return F.struct(
            F.lit(detail_type).alias("detail_type"),
            (F.col("database_name") if database else none.cast("string")).alias("database_name"),
            (F.col("drive_letter") if drive else none.cast("string")).alias("drive_letter"),
            (F.col("logical_volume_name") if volume else none.cast("string")).alias("logical_volume_name"),
            F.when(F.lit(detail_type == 1), file).alias("file"),
        )

    keys = F.array(level(1, True, True, False), level(2, True, by_drive, False), level(3, not by_drive, True, True))
    # A file of size zero counts as one MB in the denominator, as in the single-file ratio.
    one = F.when(F.col("total_mb") == 0, F.lit(1)).otherwise(F.col("total_mb"))
    expanded = space.withColumn("total_or_one", one).withColumn("level", F.explode(keys))
    return expanded.groupBy(*scope, "level").agg(
        *_sums(),
        F.sum("total_or_one").alias("whole"),
        F.max("disk_used_perc").alias("disk_used_perc"),
        F.count(F.lit(1)).alias("files"),
        *[F.max(f"disk_{m}").alias(f"disk_{m}") for m in _MEASURES],
    )


def report_order(report_type: int = 2) -> list[str]:
    """Columns that sort a layered report for display."""
    levels = ["drive_letter", "database_name"] if report_type == 2 else ["database_name", "drive_letter"]
    return [*levels, "file_name"]


def volume_summary(space: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """One row per volume in GB, with the share the databases hold."""
    gb = "decimal(14,2)"

    def to_gb(mb_sum: Column) -> Column:
        return (mb_sum / 1024).cast("decimal(20,2)")

    total, free = F.col("disk_bytes_total"), F.col("disk_bytes_free")
    used_gb = F.max(((total - free) / BYTES_PER_GB).cast(gb))
    total_gb = F.max((total / BYTES_PER_GB).cast(gb))
    return space.groupBy(*scope, "drive_letter", "logical_volume_name").agg(
        total_gb.alias("disk_total_gb"),
        used_gb.alias("disk_used_gb"),
        F.max((free / BYTES_PER_GB).cast(gb)).alias("disk_free_gb"),
        (used_gb - to_gb(F.sum("total_mb"))).alias("disk_used_non_db_gb"),
        to_gb(F.sum("total_mb")).alias("db_files_total_gb"),
        to_gb(F.sum("used_mb")).alias("db_files_used_gb"),
        to_gb(F.sum("free_mb")).alias("db_files_free_gb"),
        F.max("disk_used_perc").alias("disk_used_perc"),
        ((used_gb - to_gb(F.sum("free_mb"))) / total_gb * 100)
        .cast("decimal(14,2)")
        .alias("disk_used_from_db_files_perc"),
    )


def log_space(logs: DataFrame) -> DataFrame:
    """Log files with the MB that are free in them; sort by ``log_free_mb`` descending."""
    free = (1.0 - F.col("log_used_percent") / 100.0) * F.col("log_size_mb")
    return logs.select(
        "database_name",
        F.round("log_size_mb", 2).alias("log_size_mb"),
        F.round("log_used_percent", 2).alias("log_used_percent"),
        "status",
        F.round(free, 2).alias("log_free_mb"),
    )


def shrink_steps(
    files: DataFrame, trigger_mb: int = SHRINK_TRIGGER_MB, step_mb: int = SHRINK_STEP_MB
) -> DataFrame:
    """Data files with more free space than the trigger, and their next smaller size."""
    next_size = F.floor("reserved_mb").cast("long") - step_mb
    return (
        files.where(F.col("type_desc") == "ROWS")
        .select(
            "database_id",
            "database_name",
            "file_id",
            "file_name",
            pages_to_mb("size_pages").alias("reserved_mb"),
            pages_to_mb("used_pages").alias("used_mb"),
            pages_to_mb(F.col("size_pages") - F.col("used_pages")).alias("free_mb"),
        )
        .where(F.col("free_mb") > trigger_mb)
        .withColumn("next_size_mb", next_size)
        .withColumn("action", F.lit("SHRINK_FILE"))
        .withColumn("reason", concat_nullsafe("free_mb > ", F.lit(trigger_mb)))
        .withColumn(
            "command_text",
            concat_nullsafe(
                "USE ", quotename("database_name"), "; DBCC SHRINKFILE (",
                quote_literal("file_name"), ", ", F.col("next_size_mb"), ")",
            ),
        )
    )
