"""Filters, selection lists and database ordering."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslens.functions import all_of, any_of, contains_ci, escape_like, holds, like_ci, quotename
from opslens.operators.ranking import numbered

# ---------------------------------------------------------------- optional filters


def contains_filters(df: DataFrame, filters: Mapping[str, str | None]) -> DataFrame:
    """Case-insensitive substring filters; ``None`` leaves the column unfiltered."""
    return df.where(all_of(contains_ci(c, v) for c, v in filters.items() if v is not None))


def eq_filters(df: DataFrame, filters: Mapping[str, Any]) -> DataFrame:
    return df.where(all_of(F.col(c) == v for c, v in filters.items() if v is not None))


def like_filters(df: DataFrame, filters: Mapping[str, str | None]) -> DataFrame:
    """Anchored LIKE filters; the caller supplies the wildcards."""
    return df.where(all_of(like_ci(c, v) for c, v in filters.items() if v is not None))


def tristate(df: DataFrame, column: str, flag: bool | None) -> DataFrame:
    """Flag columns: true, false, or ``None`` for all rows.  Numbers count as value > 0."""
    if flag is None:
        return df
    c = F.col(column)
    if dict(df.dtypes)[column] == "boolean":
        return df.where(c == F.lit(flag))
    return df.where(c > 0 if flag else c == 0)


def exclude_ids(df: DataFrame, column: str, ids: Iterable[int]) -> DataFrame:
    return df.where(~F.col(column).isin(list(ids)))


def where_expr(df: DataFrame, predicate: str | None, allowed: Sequence[str]) -> DataFrame:
    """A caller-written predicate over an allow-list of columns."""
    if not predicate:
        return df
    _check_words(predicate, allowed)
    return df.where(F.expr(predicate))


def order_expr(df: DataFrame, ordering: str | None, allowed: Sequence[str]) -> DataFrame:
    """A caller-written ordering such as ``"elapsed_ms DESC, session_id"``."""
    if not ordering:
        return df
    keys = []
    for item in parse_list(ordering):
        column, _, direction = item.partition(" ")
        direction = direction.strip().upper() or "ASC"
        if column not in allowed or direction not in ("ASC", "DESC"):
            raise ValueError(f"ordering item not supported: {item!r}")
        keys.append(F.col(column).desc() if direction == "DESC" else F.col(column).asc())
    return df.orderBy(*keys)


# Words a caller-written predicate may use besides allowed columns.
_PREDICATE_WORDS = {
    "and", "or", "not", "is", "null", "in", "like", "between", "true", "false",
}


def _check_words(predicate: str, allowed: Sequence[str]) -> None:
    outside_quotes = re.sub(r"'[^']*'", "", predicate)
    for word in re.findall(r"[A-Za-z_][A-Za-z_0-9]*", outside_quotes):
        if word not in allowed and word.lower() not in _PREDICATE_WORDS:
            raise ValueError(f"predicate word not supported: {word!r}")


def match_or_all(column: str, value: str | None) -> Column:
    """True everywhere for a blank value, equality otherwise."""
    if value is None or not value.strip():
        return F.lit(True)
    return F.col(column) == value.strip()


def in_chars(column: Column, chars: str | None) -> Column:
    """Membership of a one-letter column in a string of letters; NULL passes."""
    if not chars:
        return F.lit(True)
    return F.coalesce(F.instr(F.lower(F.lit(chars)), F.lower(column)) > 0, F.lit(True))


def name_in_list_or_like(column: str, text: str | None) -> Column:
    """The name occurs in the text, or the text occurs in the name; NULL name passes."""
    if not text:
        return F.lit(True)
    name = F.lower(F.col(column))
    listed = F.instr(F.lit(text.lower()), name) > 0
    return F.coalesce(listed, F.lit(True)) | holds(contains_ci(column, text))


def commands_like(column: str, prefixes: Sequence[str]) -> Column:
    return any_of(F.upper(F.col(column)).startswith(p.upper()) for p in prefixes)


def require_nonempty(df: DataFrame, message: str) -> None:
    """Stop at the API edge when a required row (for example a role) is absent."""
    if df.limit(1).isEmpty():
        raise LookupError(message)


def suspect(databases: DataFrame, state: str = "SUSPECT") -> DataFrame:
    return databases.where(F.col("state_desc") == state)


# ---------------------------------------------------------------- database attributes

SYSTEM_DATABASE_IDS = (1, 2, 3, 4)


def filter_databases(
    databases: DataFrame,
    *,
    system_only: bool = False,
    user_only: bool = False,
    name_pattern: str | None = None,
    database_list: str | None = None,
    exclude_list: str | None = None,
    recovery_model_desc: str | None = None,
    compatibility_level: int | None = None,
    state_desc: str | None = None,
    is_read_only: bool | None = None,
    is_auto_close_on: bool | None = None,
    is_auto_shrink_on: bool | None = None,
    is_broker_enabled: bool | None = None,
) -> DataFrame:
    """Databases by attribute; every argument left out is no filter."""
    is_system = F.col("database_id").isin(*SYSTEM_DATABASE_IDS)
    conditions = []
    if system_only:
        conditions.append(is_system)
    if user_only:
        conditions.append(~is_system)
    if exclude_list:
        conditions.append(~F.lower("name").isin([n.lower() for n in parse_list(exclude_list)]))
    if name_pattern not in (None, "%"):
        conditions.append(like_ci("name", name_pattern))
    if database_list:
        conditions.append(F.lower("name").isin([n.lower() for n in parse_list(database_list)]))
    attributes = {
        "recovery_model_desc": recovery_model_desc,
        "compatibility_level": compatibility_level,
        "state_desc": state_desc,
        "is_read_only": is_read_only,
        "is_auto_close_on": is_auto_close_on,
        "is_auto_shrink_on": is_auto_shrink_on,
        "is_broker_enabled": is_broker_enabled,
    }
    return eq_filters(databases.where(all_of(conditions)), attributes)


def exclude_unreadable(
    databases: DataFrame,
    database_replicas: DataFrame,
    replicas: DataFrame,
    groups: DataFrame,
    server_name: str | Column,
    *,
    scope: Sequence[str],
) -> DataFrame:
    """Drop secondaries that accept no connection while another server is primary.

    ``scope`` names the server columns of all four tables; over several servers ``server_name`` is the
    column of ``groups`` that holds the polled server's name.
    """
    scope = list(scope)
    closed = replicas.where(F.col("secondary_role_allow_connections") == 0)
    elsewhere = groups.where(F.col("primary_replica") != server_name)
    unreadable = (
        database_replicas.join(closed.select(*scope, "replica_id", "group_id"), [*scope, "replica_id"])
        .join(elsewhere.select(*scope, "group_id"), [*scope, "group_id"])
        .select(*scope, "database_id")
    )
    return databases.join(unreadable, [*scope, "database_id"], "left_anti")


def command_for_each(
    databases: DataFrame,
    template: str,
    replace_char: str = "?",
    suppress_quotename: bool = False,
) -> DataFrame:
    """One command per database from a template in which ``?`` stands for the database.

    Names are quoted unless suppressed; a template that quotes by itself does
    not end up with doubled brackets.
    """
    name = F.col("name") if suppress_quotename else quotename("name")
    text = F.replace(F.lit(template), F.lit(replace_char), name)
    if not suppress_quotename:
        text = F.replace(F.replace(text, F.lit("[["), F.lit("[")), F.lit("]]"), F.lit("]"))
    return databases.withColumn("command_text", text)


# ---------------------------------------------------------------- selection lists


@dataclass(frozen=True)
class SpecItem:
    position: int
    include: bool
    parts: tuple[str, ...]
    database_type: str | None = None
    availability_group: bool | None = None

    @property
    def has_wildcard(self) -> bool:
        return any("%" in p for p in self.parts)


# Keywords of selection lists.
DATABASE_KEYWORDS: dict[str, dict[str, Any]] = {
    "ALL_DATABASES": {},
    "SYSTEM_DATABASES": {"database_type": "S"},
    "USER_DATABASES": {"database_type": "U"},
    "AVAILABILITY_GROUP_DATABASES": {"availability_group": True},
}
ALL_KEYWORDS = {
    "ALL_AVAILABILITY_GROUPS",
    "ALL_FILEGROUPS",
    "ALL_OBJECTS",
    "ALL_INDEXES",
}


def parse_list(spec: str | None, allowed: Sequence[str] | None = None) -> list[str]:
    """Comma list without wildcards; unknown or repeated items are an argument error."""
    if spec is None:
        return []
    items = [i.strip() for i in re.sub(r"[\r\n]", "", spec).split(",")]
    if any(not i for i in items):
        raise ValueError(f"empty item in list: {spec!r}")
    if allowed is not None and (set(items) - set(allowed) or len(set(items)) < len(items)):
        raise ValueError(f"list not supported: {spec!r}")
    return items


def parse_spec(spec: str, parts: int = 1, optional_last: bool = False) -> list[SpecItem]:
    """Selection list: ``-`` excludes, ``%`` matches anything, ``[name]`` is literal."""
    return [
        _parse_item(text, position, parts, optional_last)
        for position, text in enumerate(parse_list(spec), start=1)
    ]


def _parse_item(text: str, position: int, parts: int, optional_last: bool) -> SpecItem:
    include = not text.startswith("-")
    body = text if include else text[1:]
    if parts == 1 and body.upper() in DATABASE_KEYWORDS:
        return SpecItem(position, include, ("%",), **DATABASE_KEYWORDS[body.upper()])
    if body.upper() in ALL_KEYWORDS:
        return SpecItem(position, include, ("%",) * parts)
    names = [body] if parts == 1 else re.findall(r"\[(?:[^\]]|\]\])*\]|[^.]+", body)
    if optional_last and len(names) == parts - 1:
        names.append("%")
    names = [
        n[1:-1].replace("]]", "]") if n.startswith("[") and n.endswith("]") else n for n in names
    ]
    if len(names) != parts or not all(names):
        raise ValueError(f"selection item not supported: {text!r}")
    return SpecItem(position, include, tuple(names))


def select_by_spec(
    df: DataFrame,
    spec: str | Sequence[SpecItem] | None,
    name_columns: Sequence[str] = ("name",),
    *,
    optional_last: bool = False,
    type_column: str | None = None,
    group_flag_column: str | None = None,
) -> DataFrame:
    """Add ``selected`` and ``start_position``; an exclusion always wins.

    The list is a parameter, so it becomes one boolean expression per item over
    the scanned rows: no join, no shuffle, whatever the size of ``df``.
    ``spec=None`` selects everything.
    """
    if spec is None:
        return df.select("*", F.lit(True).alias("selected"), F.lit(None).cast("int").alias("start_position"))
    items = parse_spec(spec, len(name_columns), optional_last) if isinstance(spec, str) else spec

    def matches(item: SpecItem) -> Column:
        tests = [_name_test(c, p) for c, p in zip(name_columns, item.parts, strict=True)]
        if item.database_type is not None:
            if type_column is None:
                raise ValueError("a database type column is required for this selection")
            tests.append(F.col(type_column) == item.database_type)
        if item.availability_group is not None:
            if group_flag_column is None:
                raise ValueError("a group flag column is required for this selection")
            tests.append(F.col(group_flag_column) == item.availability_group)
        return holds(all_of(tests))

    included = any_of(matches(i) for i in items if i.include)
    excluded = any_of(matches(i) for i in items if not i.include)
    position = F.lit(None).cast("int")
    for item in sorted(items, key=lambda i: -i.position):
        if item.include:
            position = F.when(matches(item), item.position).otherwise(position)
    return df.select(
        "*", (included & ~excluded).alias("selected"), position.alias("start_position")
    )


def _name_test(column: str, pattern: str) -> Column:
    if "%" not in pattern:
        return F.lower(F.col(column)) == pattern.lower()
    return like_ci(column, escape_like(pattern))


def select_by_group(
    databases: DataFrame, memberships: DataFrame, groups: DataFrame, spec: str
) -> DataFrame:
    """Databases selected through their availability group."""
    chosen = select_by_spec(groups, spec, ("group_name",)).where("selected")
    members = memberships.join(chosen.select("group_name", "start_position"), "group_name")
    return databases.join(members, "database_id")


def spec_missing(
    spec: str | Sequence[SpecItem], names: DataFrame, column: str, part: int = 0, parts: int = 1
) -> DataFrame:
    """Items that name something exactly, yet nothing has that name.

    The big side is cut to the named rows by a pushed-down IN before the anti-join.
    """
    items = parse_spec(spec, parts) if isinstance(spec, str) else list(spec)
    exact = sorted({i.parts[part] for i in items if "%" not in i.parts[part]})
    spark = names.sparkSession
    wanted = spark.createDataFrame([(n,) for n in exact], "item string")
    present = names.where(F.lower(column).isin([n.lower() for n in exact])).select(
        F.lower(column).alias("present")
    )
    return wanted.join(present.distinct(), F.lower("item") == F.col("present"), "left_anti")


def outside_selection(chosen: DataFrame, selected: DataFrame, column: str = "name") -> DataFrame:
    """Names a sub-list selects although the main selection does not."""
    main = selected.where(F.col("selected") & F.col(column).isNotNull()).select(column)
    return chosen.select(column).distinct().join(main, column, "left_anti")


def duplicate_names(
    df: DataFrame, column: str, selected: Column | None = None, *, scope: Sequence[str]
) -> DataFrame:
    """Rows whose name, ignoring case, is shared within ``scope``; only groups holding a selected row count."""
    key = F.upper(F.col(column))
    chosen = F.lit(True) if selected is None else holds(selected)
    shared = (
        df.where((F.col(column) != "") & F.col(column).isNotNull())
        .groupBy(*[F.col(c).alias(f"__s{i}") for i, c in enumerate(scope)], key.alias("__name"))
        .agg(F.count(F.lit(1)).alias("same_name"), F.bool_or(chosen).alias("__any"))
        .where((F.col("same_name") > 1) & F.col("__any"))
    )
    same = key == F.col("__name")
    for i, c in enumerate(scope):
        same = same & F.col(c).eqNullSafe(F.col(f"__s{i}"))
    return df.join(shared.drop("__any"), same).drop("__name", *[f"__s{i}" for i in range(len(scope))])


# ---------------------------------------------------------------- ordering

# Ordering modes.
ORDER_MODES = {
    None: "start_position",
    "DATABASE_NAME": "name",
    "DATABASE_SIZE": "database_size",
    "LOG_SIZE_SINCE_LAST_LOG_BACKUP": "log_since_backup_mb",
    "DATABASE_LAST_GOOD_CHECK": "last_good_check",
    "REPLICA_LAST_GOOD_CHECK": "last_command_time",
}


def order_databases(
    databases: DataFrame,
    mode: str | None = None,
    scope: Sequence[str] = (),
) -> DataFrame:
    """Add ``order_no`` per scope (for example per server); NULLs come first ascending."""
    base, direction = mode, "ASC"
    if mode is not None:
        base, _, direction = mode.rpartition("_")
    if base not in ORDER_MODES or direction not in ("ASC", "DESC"):
        raise ValueError(f"order mode not supported: {mode!r}")
    column = F.col(ORDER_MODES[base])
    key = column.asc_nulls_first() if direction == "ASC" else column.desc_nulls_last()
    return numbered(databases, scope, [key, F.col("name"), F.col("database_id")], "order_no")
