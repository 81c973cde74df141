"""Backup planning: type, eligibility, names, stripes, cleanup."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from datetime import datetime
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslens.functions import (
    all_of,
    concat_nullsafe,
    holds,
    least_or_null,
    minus_hours,
    quote_literal,
    quotename,
    safe_name,
    seconds_between,
    ts,
)
from opslens.functions.names import ILLEGAL_FILE_CHARS

# Backup types, templates, extensions and limits.
FULL, DIFF, LOG = "FULL", "DIFF", "LOG"
BACKUP_TYPES = (FULL, DIFF, LOG)
LOGGED_MODELS = ("FULL", "BULK_LOGGED")
DIRECTORY_TEMPLATE = (
    "{ServerName}${InstanceName}{DirectorySeparator}{DatabaseName}{DirectorySeparator}"
    "{BackupType}_{Partial}_{CopyOnly}"
)
GROUP_DIRECTORY_TEMPLATE = (
    "{ClusterName}${AvailabilityGroupName}{DirectorySeparator}{DatabaseName}{DirectorySeparator}"
    "{BackupType}_{Partial}_{CopyOnly}"
)
FILE_TEMPLATE = (
    "{ServerName}${InstanceName}_{DatabaseName}_{BackupType}_{Partial}_{CopyOnly}_"
    "{Year}{Month}{Day}_{Hour}{Minute}{Second}_{FileNumber}.{FileExtension}"
)
GROUP_FILE_TEMPLATE = (
    "{ClusterName}${AvailabilityGroupName}_{DatabaseName}_{BackupType}_{Partial}_{CopyOnly}_"
    "{Year}{Month}{Day}_{Hour}{Minute}{Second}_{FileNumber}.{FileExtension}"
)
EXTENSIONS = {FULL: "bak", DIFF: "bak", LOG: "trn"}
MAX_PATH = 259
MIN_KEPT_NAME = 20
MAX_FILES = 64
DATE_TOKENS = {
    "Year": "%Y",
    "Month": "%m",
    "Day": "%d",
    "Hour": "%H",
    "Minute": "%M",
    "Second": "%S",
}
SERVER_TOKENS = {
    "ServiceName": "service_name",
    "MajorVersion": "major_version",
    "MinorVersion": "minor_version",
}


# ---------------------------------------------------------------- roles and type


def with_roles(
    databases: DataFrame,
    replica_roles: DataFrame | None = None,
    mirroring: DataFrame | None = None,
    shipping_primaries: DataFrame | None = None,
    shipping_secondaries: DataFrame | None = None,
    *,
    scope: Sequence[str],
) -> DataFrame:
    """Attach availability-group, mirroring and log-shipping roles; no row means no role.

    ``scope`` names the server columns of all tables.
    """
    out, database, named = databases, [*scope, "database_id"], [*scope, "name"]
    if replica_roles is not None:
        out = out.join(
            replica_roles.select(
                *database,
                "availability_group",
                "availability_group_role",
                "is_preferred_replica",
            ),
            database,
            "left",
        )
    if mirroring is not None:
        roles = mirroring.select(*database, F.upper("mirroring_role").alias("mirroring_role"))
        out = out.join(roles, database, "left")
    if shipping_primaries is not None and shipping_secondaries is not None:
        p = shipping_primaries.select(*named, F.lit(True).alias("__p")).distinct()
        s = shipping_secondaries.select(*named, F.lit(True).alias("__s")).distinct()
        role = F.when(F.col("__p"), "PRIMARY").when(F.col("__s"), "SECONDARY")
        out = (
            out.join(p, named, "left")
            .join(s, named, "left")
            .withColumn("log_shipping_role", role)
            .drop("__p", "__s")
        )
    return out


def decide_backup_type(
    databases: DataFrame,
    requested: str,
    backups: DataFrame | None = None,
    *,
    change_backup_type: bool = True,
    modification_level: int | None = None,
    scope: Sequence[str],
) -> DataFrame:
    """Requested type, moved LOG -> DIFF -> FULL where the wanted kind is not possible.

    ``backups`` tells whether the differential base is a snapshot backup; ``scope`` names the server columns.
    """
    if requested not in BACKUP_TYPES:
        raise ValueError(f"backup type not supported: {requested!r}")
    wanted = F.lit(requested)
    if not change_backup_type:
        return databases.withColumn("backup_type", wanted)

    not_master = F.col("name") != "master"
    no_log_base = F.col("recovery_model_desc").isin(*LOGGED_MODELS) & F.col(
        "last_log_backup_lsn"
    ).isNull()
    first = F.when((wanted == LOG) & no_log_base & not_master, DIFF).otherwise(wanted)

    modified = (
        F.col("modified_extent_pages").cast("decimal(20,0)")
        / F.nullif(F.col("allocated_extent_pages"), F.lit(0)).cast("decimal(20,0)")
        * 100
    )
    no_diff = ~not_master | F.col("differential_base_lsn").isNull()
    if modification_level is not None:
        no_diff = no_diff | (modified >= modification_level)
    out = databases.withColumn("__first", first).withColumn(
        "__second",
        F.when((F.col("__first") == DIFF) & holds(no_diff), FULL).otherwise(F.col("__first")),
    )
    if backups is None:
        return out.withColumn("backup_type", F.col("__second")).drop("__first", "__second")

    bases = (
        backups.where(F.col("type") == "D")
        .groupBy(*scope, "database_id", F.col("checkpoint_lsn").alias("differential_base_lsn"))
        .agg(F.bool_or("is_snapshot").alias("base_is_snapshot"))
    )
    final = F.when((F.col("__second") == DIFF) & holds(F.col("base_is_snapshot")), FULL)
    return (
        out.join(bases, [*scope, "database_id", "differential_base_lsn"], "left")
        .withColumn("backup_type", final.otherwise(F.col("__second")))
        .drop("__first", "__second")
    )


# ---------------------------------------------------------------- eligibility


def eligibility_rules(
    as_of: datetime | str,
    *,
    copy_only: bool = False,
    override_preference: bool = False,
    updateability: str = "ALL",
    min_log_size_mb: int | None = None,
    min_seconds_since_log: int | None = None,
) -> dict[str, Column]:
    """One named boolean per rule; true passes.

    A rule that is unknown (NULL) does not pass, as in a conjunction of
    conditions evaluated by the server.
    """
    if updateability not in ("ALL", "READ_ONLY", "READ_WRITE"):
        raise ValueError(f"updateability not supported: {updateability!r}")
    kind = F.col("backup_type")
    full, diff, log = kind == FULL, kind == DIFF, kind == LOG
    in_group = F.col("availability_group").isNotNull()
    role = F.col("availability_group_role")
    not_primary = (role != "PRIMARY") | role.isNull()
    preferred = F.col("is_preferred_replica")
    not_preferred = ~preferred | preferred.isNull()
    copy, plain = F.lit(copy_only), F.lit(not copy_only)
    obey = F.lit(not override_preference)

    rules = {
        "online": F.col("state_desc") == "ONLINE",
        "single_user": ~(
            (F.col("user_access_desc") == "SINGLE_USER") & ~F.col("is_accessible")
        ),
        "standby": ~F.col("is_in_standby"),
        "log_simple_model": ~(log & (F.col("recovery_model_desc") == "SIMPLE")),
        "log_no_base": ~(
            log
            & F.col("recovery_model_desc").isin(*LOGGED_MODELS)
            & F.col("last_log_backup_lsn").isNull()
        ),
        "diff_no_base": ~(diff & F.col("differential_base_lsn").isNull()),
        "master_full_only": ~(kind.isin(DIFF, LOG) & (F.col("name") == "master")),
        "group_full_not_primary": ~(in_group & full & plain & not_primary),
        "group_full_not_preferred": ~(in_group & full & copy & not_preferred & obey),
        "group_diff_not_primary": ~(in_group & diff & not_primary),
        "group_log_not_preferred": ~(in_group & log & plain & not_preferred & obey),
        "group_log_not_primary": ~(in_group & log & copy & not_primary),
        "log_shipping_primary": ~(
            (F.col("log_shipping_role") == "PRIMARY") & F.col("log_shipping_role").isNotNull() & log
        ),
        "read_only": ~(F.col("is_read_only") & F.lit(updateability == "READ_WRITE")),
        "read_write": ~(~F.col("is_read_only") & F.lit(updateability == "READ_ONLY")),
    }
    if min_log_size_mb is None or min_seconds_since_log is None:
        rules["log_throttle"] = F.lit(True)
    else:
        size, last = F.col("log_since_backup_mb"), F.col("last_log_backup_time")
        due = (
            holds(size >= min_log_size_mb)
            | size.isNull()
            | holds(seconds_between(last, ts(as_of)) >= min_seconds_since_log)
            | last.isNull()
        )
        rules["log_throttle"] = ~(log & ~due)
    return rules


def backup_eligible(databases: DataFrame, as_of: datetime | str, **options) -> DataFrame:
    """Add ``eligible`` and the array of rules that did not pass."""
    rules = eligibility_rules(as_of, **options)
    failed = F.array_compact(F.array(*[F.when(~holds(r), F.lit(n)) for n, r in rules.items()]))
    return databases.withColumn("failed_rules", failed).withColumn(
        "eligible", F.size("failed_rules") == 0
    )


# ---------------------------------------------------------------- history and cleanup


def latest_backup(backups: DataFrame, databases: DataFrame, *, scope: Sequence[str]) -> DataFrame:
    """Start of the newest undamaged backup a log chain can rest on, per database."""
    database = [*scope, "database_id"]
    bases = databases.select(*database, "differential_base_lsn")
    usable = F.col("type").isin("D", "I") | (
        F.col("database_backup_lsn") < F.col("differential_base_lsn")
    )
    return (
        backups.where(~F.col("is_damaged"))
        .join(bases, database)
        .where(usable)
        .groupBy(*database)
        .agg(F.max("backup_start_date").alias("latest_backup"))
    )


def cleanup_cutoff(
    databases: DataFrame,
    requested: str,
    as_of: datetime | str,
    *,
    cleanup_hours: int | None,
    mirror_cleanup_hours: int | None = None,
    mode: str = "AFTER_BACKUP",
    verify: bool = True,
) -> DataFrame:
    """Files older than the cut-off may go.  NULL means no cleanup.

    The cut-off is the minimum of now, now minus the retention, and for log
    backups the latest usable backup; when one of them is unknown nothing is
    cleaned.  Nothing is cleaned either when the backup type was changed, or in
    after-backup mode when backup or verification failed.
    """
    if mode not in ("BEFORE_BACKUP", "AFTER_BACKUP"):
        raise ValueError(f"cleanup mode not supported: {mode!r}")
    now = ts(as_of)
    allowed = F.col("backup_type") == requested
    if mode == "AFTER_BACKUP":
        allowed = allowed & (F.col("backup_output") == 0)
        if verify:
            allowed = allowed & F.col("verify_ok")

    def cutoff(hours: int | None) -> Column:
        if hours is None:
            return F.lit(None).cast("timestamp_ntz")
        plain = least_or_null(now, minus_hours(now, hours))
        with_log = least_or_null(now, minus_hours(now, hours), F.col("latest_backup"))
        chosen = F.when(F.col("backup_type") == LOG, with_log).otherwise(plain)
        return F.when(holds(allowed), chosen)

    return databases.withColumn("cleanup_before", cutoff(cleanup_hours)).withColumn(
        "mirror_cleanup_before", cutoff(mirror_cleanup_hours)
    )


def expired_files(files: DataFrame, cutoffs: DataFrame, *, scope: Sequence[str]) -> DataFrame:
    """Backup files of the cleaned type that are older than the cut-off of their database."""
    limits = cutoffs.where(F.col("cleanup_before").isNotNull()).select(
        *scope, "database_id", "cleanup_before", F.left("backup_type", F.lit(1)).alias("type_letter")
    )
    # History stores a full backup as D, a differential as I, a log as L.
    letter = F.when(F.col("type") == "D", "F").when(F.col("type") == "I", "D").otherwise("L")
    return (
        files.withColumn("type_letter", letter)
        .join(limits, [*scope, "database_id", "type_letter"])
        .where(F.col("backup_start_date") < F.col("cleanup_before"))
        .drop("type_letter")
    )


def verify_status(sets: DataFrame, keys: Sequence[str] = ("database_id",)) -> DataFrame:
    """Per key: how many backup sets failed verification, and whether all passed."""
    bad = (F.col("verify_output") != 0) | F.col("verify_output").isNull()
    return (
        sets.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("backup_sets"), F.count_if(bad).alias("failed_sets"))
        .withColumn("verify_ok", F.col("failed_sets") == 0)
    )


# ---------------------------------------------------------------- names

_TOKEN = re.compile(r"\{(\w+)\}")
_SEPARATOR = "{DirectorySeparator}"

# Runs of separators: in a directory, and in a file name (with the dot that may follow).
_DIRECTORY_RUN = re.compile(r"(?:[_$\\/-]|\{DirectorySeparator\})+")
_FILE_RUN = re.compile(r"([_$-]+)(\.?)")
_REPEATED_MARK = re.compile(r"_{2,}|-{2,}")


def _strongest(run: str) -> str:
    """What a run between two parts becomes: a path separator wins over marks, marks over dollars.

    Equal marks beside each other count once; a run of dollars alone is text.
    """
    if _SEPARATOR in run or "/" in run or "\\" in run:
        return _SEPARATOR
    marks = run.replace("$", "")
    return _REPEATED_MARK.sub(lambda m: m[0][0], marks) or run


def clean_directory(template: str) -> str:
    """A directory template without the separators that empty tokens leave behind."""

    def joint(m: re.Match[str]) -> str:
        at_an_end = m.start() == 0 or m.end() == len(template)
        return "" if at_an_end else _strongest(m[0])

    return _DIRECTORY_RUN.sub(joint, template)


def clean_file_name(template: str) -> str:
    """The same for a file-name template; marks before a dot go, too."""

    def joint(m: re.Match[str]) -> str:
        if m.start() == 0 or m.end(1) == len(template):
            return m[2]
        run = _strongest(m[1])
        return m[2] if m[2] and "$" not in run else run + m[2]

    return _FILE_RUN.sub(joint, template)


def render_template(
    template: str,
    clean: Callable[[str], str],
    constants: Mapping[str, str],
    columns: Mapping[str, Column],
    optional: Sequence[str] = (),
) -> Column:
    """Text of a template per row.

    Which tokens are empty decides how a template is cleaned, and only the
    ``optional`` ones can be.  So each combination is cleaned once here, and a
    row merely picks one and concatenates its values.  Unknown tokens stay.
    """
    present = [t for t in optional if "{" + t + "}" in template]
    for token, value in constants.items():
        if value == "":
            template = template.replace("{" + token + "}", "")

    def fill(text: str) -> Column:
        parts, end = [], 0
        for match in _TOKEN.finditer(text):
            token = match[1]
            value = constants.get(token, match[0])
            parts.append(F.lit(text[end : match.start()]))
            parts.append(columns[token] if token in columns else F.lit(value))
            end = match.end()
        return F.concat(*parts, F.lit(text[end:]))

    out = fill(clean(template))
    for size in range(1, len(present) + 1):
        for missing in combinations(present, size):
            text = template
            for token in missing:
                text = text.replace("{" + token + "}", "")
            empty = all_of(F.coalesce(columns[t], F.lit("")) == "" for t in missing)
            out = F.when(empty, fill(clean(text))).otherwise(out)
    return out


def fit_database_name(file_name: Column, directory: Column, name: Column, number_size: int) -> Column:
    """Put the database name into a file name so that the path keeps within its limit."""
    fixed = F.length(F.replace(file_name, F.lit("{FileNumber}"), F.lit("0" * number_size)))
    length = F.length(directory) + 1 + fixed - len("{DatabaseName}") + F.length(name)
    kept = F.greatest(F.length(name) + MAX_PATH - length - 3, F.lit(MIN_KEPT_NAME))
    short = F.concat(F.substring(name, F.lit(1), kept), F.lit("..."))
    return F.replace(
        file_name, F.lit("{DatabaseName}"), F.when(length > MAX_PATH, short).otherwise(name)
    )


def backup_names(
    databases: DataFrame,
    clock: datetime | str,
    *,
    root: str,
    number_of_files: int = 1,
    copy_only: bool = False,
    read_write_groups: bool = False,
    separator: str = "\\",
    directory_template: str = DIRECTORY_TEMPLATE,
    group_directory_template: str = GROUP_DIRECTORY_TEMPLATE,
    file_template: str = FILE_TEMPLATE,
    group_file_template: str = GROUP_FILE_TEMPLATE,
    description: str = "",
) -> DataFrame:
    """Folder, directory and file name per database (columns server_name, instance_name,
    cluster_name, availability_group, name, backup_type); ``{FileNumber}`` stays.

    ``{ServiceName}``, ``{MajorVersion}`` and ``{MinorVersion}`` come from the columns service_name,
    major_version and minor_version; a template that uses one needs its column.

    With several directories pass the longest as ``root``: it decides the path length.
    """
    at = clock if isinstance(clock, datetime) else datetime.fromisoformat(clock)
    constants = {token: at.strftime(pattern) for token, pattern in DATE_TOKENS.items()}
    constants |= {
        "Millisecond": f"{at.microsecond // 1000:03d}",
        "Partial": "PARTIAL" if read_write_groups else "",
        "CopyOnly": "COPY_ONLY" if copy_only else "",
        "Description": description.translate(str.maketrans("", "", ILLEGAL_FILE_CHARS)).strip(),
        "DirectorySeparator": separator,
        "NumberOfFiles": "" if number_of_files == 1 else str(number_of_files),
    }
    fs_name = safe_name("name")
    extension = F.lit(None).cast("string")
    for kind, text in EXTENSIONS.items():
        extension = F.when(F.col("backup_type") == kind, text).otherwise(extension)
    columns = {
        "ServerName": F.col("server_name"),
        "InstanceName": F.col("instance_name"),
        "ClusterName": F.col("cluster_name"),
        "AvailabilityGroupName": F.col("availability_group"),
        "BackupType": F.col("backup_type"),
        "FileExtension": extension,
    }
    templates = directory_template + group_directory_template + file_template + group_file_template
    for token, column in SERVER_TOKENS.items():
        if "{" + token + "}" in templates:
            if column not in databases.columns:
                raise ValueError(f"the token {token} needs the column {column}")
            columns[token] = F.coalesce(F.col(column).cast("string"), F.lit(""))
    optional = ("InstanceName", "ClusterName", "AvailabilityGroupName", *SERVER_TOKENS)
    in_group = F.col("availability_group").isNotNull()

    def folder(template: str) -> Column:
        values = {**columns, "DatabaseName": fs_name}
        return render_template(template, clean_directory, constants, values, optional)

    def file_name(template: str) -> Column:
        values = {**constants, "FileNumber": ""} if number_of_files == 1 else constants
        return render_template(template, clean_file_name, values, columns, optional)

    digits = _number_size(number_of_files)
    return (
        databases.withColumn(
            "folder",
            F.when(in_group, folder(group_directory_template)).otherwise(folder(directory_template)),
        )
        .withColumn("directory_path", F.concat(F.lit(root + separator), F.col("folder")))
        .withColumn(
            "file_name",
            F.when(in_group, file_name(group_file_template)).otherwise(file_name(file_template)),
        )
        .withColumn(
            "file_name",
            fit_database_name(F.col("file_name"), F.col("directory_path"), fs_name, digits),
        )
    )


# ---------------------------------------------------------------- stripes


def _number_size(number_of_files: int) -> int:
    return 0 if number_of_files == 1 else 1 if number_of_files <= 9 else 2


def _check_stripes(
    number_of_files: int, directories: Sequence[str], mirror_directories: Sequence[str]
) -> None:
    for dirs in (directories, mirror_directories):
        if dirs and (number_of_files < len(dirs) or number_of_files % len(dirs)):
            raise ValueError("the number of files must be a multiple of the directories")
    if not 1 <= number_of_files <= MAX_FILES or not directories:
        raise ValueError("the number of files must be 1 to 64, with at least one directory")
    if mirror_directories and len(mirror_directories) != len(directories):
        raise ValueError("mirror and primary need the same number of directories")


def stripe_plan(
    databases: DataFrame,
    number_of_files: int,
    directories: Sequence[str],
    mirror_directories: Sequence[str] = (),
) -> DataFrame:
    """Files of one backup spread over directories in equal blocks, primary and mirror.

    Which directory holds a file is arithmetic on the file number, so there is
    no range join.  Every database yields at most 2 x 64 rows.
    """
    _check_stripes(number_of_files, directories, mirror_directories)
    per_directory = number_of_files // len(directories)
    digits = _number_size(number_of_files)
    files = databases.withColumn(
        "file_number", F.explode(F.sequence(F.lit(1), F.lit(number_of_files)))
    ).withColumn(
        "is_mirror",
        F.explode(F.array(*[F.lit(m) for m in ([False, True] if mirror_directories else [False])])),
    )
    slot = F.ceil(F.col("file_number") / per_directory).cast("int")

    def pick(dirs: Sequence[str]) -> Column:
        return F.element_at(F.array(*[F.lit(d) for d in dirs]), slot)

    directory = pick(directories)
    if mirror_directories:
        directory = F.when(F.col("is_mirror"), pick(mirror_directories)).otherwise(directory)
    number = F.lit("") if digits == 0 else F.lpad(F.col("file_number").cast("string"), digits, "0")
    return files.withColumn("directory", directory).withColumn("file_number_text", number)


def backup_commands(
    named: DataFrame,
    number_of_files: int,
    directories: Sequence[str],
    mirror_directories: Sequence[str] = (),
    *,
    checksum: bool = False,
    compress: bool = False,
    copy_only: bool = False,
    read_write_groups: bool = False,
    no_recovery: bool = False,
    init: bool = False,
    block_size: int | None = None,
    buffer_count: int | None = None,
    max_transfer_size: int | None = None,
    description: str | None = None,
    separator: str = "\\",
) -> DataFrame:
    """Backup and verify commands of databases that :func:`backup_names` has named.

    The files of a command are an array built in the row (at most 64), so
    nothing is exploded or grouped.
    """
    _check_stripes(number_of_files, directories, mirror_directories)
    digits = _number_size(number_of_files)
    per_directory = number_of_files // len(directories)

    def targets(dirs: Sequence[str]) -> Column:
        if not dirs:
            return F.lit(None).cast("string")
        paths = [
            F.concat(
                F.lit(f"{dirs[(n - 1) // per_directory]}{separator}"),
                F.col("folder"),
                F.lit(separator),
                F.replace(
                    F.col("file_name"),
                    F.lit("{FileNumber}"),
                    F.lit(str(n).zfill(digits) if digits else ""),
                ),
            )
            for n in range(1, number_of_files + 1)
        ]
        disks = F.transform(
            F.array_sort(F.array(*paths)), lambda p: F.concat(F.lit("DISK = "), quote_literal(p))
        )
        return F.array_join(disks, ", ")

    log, diff = F.col("backup_type") == LOG, F.col("backup_type") == DIFF
    sums = "CHECKSUM" if checksum else "NO_CHECKSUM"
    can_compress = F.lit(compress)
    if "is_encrypted" in named.columns:
        can_compress = can_compress & ~holds(F.col("is_encrypted"))
    sizes = {
        "BLOCKSIZE": block_size,
        "BUFFERCOUNT": buffer_count,
        "MAXTRANSFERSIZE": max_transfer_size,
    }
    options = [
        F.lit(sums),
        F.when(can_compress, "COMPRESSION").otherwise("NO_COMPRESSION"),
        F.when(diff, "DIFFERENTIAL"),
        F.when(F.lit(bool(mirror_directories)), "FORMAT"),
        F.when(F.lit(copy_only), "COPY_ONLY"),
        F.when(log & F.lit(no_recovery), "NORECOVERY"),
        F.when(F.lit(init), "INIT"),
        *[F.lit(f"{word} = {size}") for word, size in sizes.items() if size is not None],
    ]
    if description is not None:
        options.append(F.concat(F.lit("DESCRIPTION = "), quote_literal(F.lit(description))))
    partial = F.when(
        F.lit(read_write_groups) & (F.col("name") != "master"), " READ_WRITE_FILEGROUPS"
    )
    mirror = F.concat(F.lit(" MIRROR TO "), F.col("mirror_files"))

    def verify(files: str) -> Column:
        return F.concat(F.lit("RESTORE VERIFYONLY FROM "), F.col(files), F.lit(f" WITH {sums}"))

    return (
        named.withColumn("primary_files", targets(directories))
        .withColumn("mirror_files", targets(mirror_directories))
        .withColumn("command_type", F.when(log, "BACKUP_LOG").otherwise("BACKUP_DATABASE"))
        .withColumn(
            "command_text",
            concat_nullsafe(
                F.when(log, "BACKUP LOG ").otherwise("BACKUP DATABASE "), quotename("name"), partial,
                " TO ", F.col("primary_files"), mirror, " WITH ", F.concat_ws(", ", *options),
            ),
        )
        .withColumn("verify_command", verify("primary_files"))
        .withColumn("mirror_verify_command", verify("mirror_files"))
        .drop("primary_files", "mirror_files")
    )


def unsafe_names(databases: DataFrame) -> DataFrame:
    """Databases of whose name nothing is left once illegal characters are stripped."""
    return databases.where(safe_name("name") == "").withColumn(
        "reason", concat_nullsafe("name has no file-system form: ", F.col("name"))
    )
