"""Selection lists that come as a table, one list per server, matched through a pattern index.

As a parameter a list becomes an expression over the scan (``select_by_spec``).  Thousands of lists cannot, and
joining names with patterns by LIKE compares each with each.  Here every pattern is filed under the one literal
that a matching name must hold: the whole name, else what stands before the first ``%``, else what
stands behind the last, else the first three characters of its longest inner piece.  A pattern that a list
repeats is filed once.  A name looks up its own literals by equality, and LIKE only sees the pairs that share
one and differ in the rest.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslens.functions import holds
from opslens.operators.selection import DATABASE_KEYWORDS

_GRAM = 3


def parse_items(items: DataFrame, item: str = "item") -> DataFrame:
    """Adds ``include, pattern, wanted_type, wanted_group`` by the rules of selection lists.

    ``-`` excludes, ``[name]`` is literal but for ``%``, keywords stand for all databases of a kind.  An empty item
    matches nothing.
    """
    text = F.trim(F.regexp_replace(item, r"[\r\n]", ""))
    include = ~text.startswith("-")
    body = F.when(include, text).otherwise(F.substring(text, F.lit(2), F.length(text)))
    bracketed = body.startswith("[") & body.endswith("]") & (F.length(body) > 1)
    inner = F.replace(F.substring(body, F.lit(2), F.length(body) - 2), F.lit("]]"), F.lit("]"))
    keyword = F.upper(body)
    pattern = F.when(keyword.isin(*DATABASE_KEYWORDS), "%").when(bracketed, inner).otherwise(body)
    kinds = {k: v["database_type"] for k, v in DATABASE_KEYWORDS.items() if "database_type" in v}
    groups = [k for k, v in DATABASE_KEYWORDS.items() if v.get("availability_group")]
    wanted_type = F.lit(None).cast("string")
    for k, v in kinds.items():
        wanted_type = F.when(keyword == k, v).otherwise(wanted_type)
    return items.select(
        "*",
        include.alias("include"),
        F.lower(pattern).alias("pattern"),
        wanted_type.alias("wanted_type"),
        F.when(keyword.isin(*groups), True).alias("wanted_group"),
    )


def distinct_patterns(parsed: DataFrame, scope: Sequence[str], position: str = "position") -> DataFrame:
    """One row per pattern of a list, with its first ``__position``: later copies change no verdict.

    Copies meet every name that shares their literal, so their pairs would grow with the square of the input.
    """
    return parsed.groupBy(*scope, "include", "pattern", "wanted_type", "wanted_group").agg(
        F.min(position).alias("__position")
    )


def _pattern_key() -> tuple[Column, Column, Column]:
    """Kind and literal that a pattern is filed under, and whether they are all of it.

    The kind tells the literal's length where that varies.
    """
    pieces = F.split("pattern", "%")
    first, last = F.element_at(pieces, 1), F.element_at(pieces, -1)
    longest = F.array_max(F.transform(pieces, lambda p: F.struct(F.length(p).alias("size"), p.alias("piece"))))
    gram = F.substring(longest["piece"], 1, _GRAM)
    kind = (
        F.when(F.size(pieces) == 1, "whole")
        .when(first != "", F.concat(F.lit("first"), F.length(first)))
        .when(last != "", F.concat(F.lit("last"), F.length(last)))
        .when(longest["size"] >= _GRAM, "gram")
        .otherwise("any")
    )
    literal = (
        F.when(F.size(pieces) == 1, F.col("pattern"))
        .when(first != "", first)
        .when(last != "", last)
        .when(longest["size"] >= _GRAM, gram)
        .otherwise("")
    )
    # name, first%, %last, %
    is_all = (F.size(pieces) == 1) | ((F.size(pieces) == 2) & ((first == "") | (last == "")))
    return kind, literal, is_all


def _name_keys(name: Column, kinds: Sequence[str]) -> Column:
    """All (kind, literal) pairs under which a pattern for this name may be filed."""

    def pair(kind: str, literal: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), literal.alias("literal"))

    fixed = []
    for kind in kinds:
        if kind == "whole":
            fixed.append(pair(kind, name))
        elif kind == "any":
            fixed.append(pair(kind, F.lit("")))
        elif kind.startswith("first"):
            fixed.append(pair(kind, F.left(name, F.lit(int(kind[5:])))))
        elif kind.startswith("last"):
            fixed.append(pair(kind, F.right(name, F.lit(int(kind[4:])))))
    keys = F.array(*fixed) if fixed else F.array(pair("any", F.lit("")))
    if "gram" in kinds:
        places = F.sequence(F.lit(1), F.greatest(F.length(name) - (_GRAM - 1), F.lit(1)))
        grams = F.array_distinct(F.transform(places, lambda i: pair("gram", F.substring(name, i, F.lit(_GRAM)))))
        keys = F.concat(keys, grams)
    return keys


def select_by_list(
    df: DataFrame,
    items: DataFrame,
    name: str = "name",
    *,
    scope: Sequence[str],
    position: str = "position",
    item: str = "item",
    type_column: str | None = None,
    group_flag_column: str | None = None,
) -> DataFrame:
    """Add ``selected`` and ``start_position`` by the list of each row's ``scope``; an exclusion always wins.

    ``items`` has the scope columns, a position and an item.  A scope without a list selects nothing.  The
    lengths of literals that occur are collected, at most two for each length that a name can have.
    """
    scope = list(scope)
    parsed = parse_items(items, item).where("pattern <> ''")
    kind, literal, is_all = _pattern_key()
    filed = distinct_patterns(parsed, scope, position).select(
        "*", kind.alias("kind"), literal.alias("literal"), is_all.alias("is_all")
    )
    kinds = sorted(r.kind for r in filed.select("kind").distinct().collect())
    own = F.col(type_column) if type_column else F.lit(None).cast("string")
    flag = F.col(group_flag_column) if group_flag_column else F.lit(None).cast("boolean")
    names = df.select(*scope, F.col(name).alias("__name"), own.alias("__type"), flag.alias("__flag")).distinct()
    names = names.where(F.col("__name").isNotNull())  # matches no pattern, not even %
    low = F.lower("__name")
    asked = names.select("*", F.explode(_name_keys(low, kinds)).alias("key")).select(
        *names.columns, F.col("key.kind").alias("kind"), F.col("key.literal").alias("literal")
    )
    like = F.expr(r"lower(__name) LIKE replace(replace(pattern, '\\', '\\\\'), '_', '\\_')")
    fits = (F.col("is_all") | like) & holds(F.col("wanted_type").isNull() | (F.col("__type") == F.col("wanted_type")))
    fits = fits & holds(F.col("wanted_group").isNull() | F.col("__flag"))
    matched = asked.join(filed, [*scope, "kind", "literal"]).where(fits)
    verdict = matched.groupBy(*names.columns).agg(
        F.min(F.when(F.col("include"), F.col("__position"))).alias("start_position"),
        F.bool_or(~F.col("include")).alias("__excluded"),
    )
    renamed = verdict.select(*[F.col(c).alias(f"__v{i}") for i, c in enumerate(names.columns)], "start_position", "__excluded")
    same = F.lit(True)
    for i, c in enumerate([*[F.col(s) for s in scope], F.col(name), own, flag]):
        same = same & c.eqNullSafe(F.col(f"__v{i}"))
    selected = F.col("start_position").isNotNull() & ~holds(F.col("__excluded"))
    return df.join(renamed, same, "left").select(*df.columns, selected.alias("selected"), "start_position")
