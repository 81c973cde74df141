"""Join helpers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslens.functions import all_of


def lookup(
    df: DataFrame,
    table: DataFrame,
    keys: Sequence[tuple[Column, str]],
    columns: Sequence[str],
) -> DataFrame:
    """Left equi-join on computed keys; brings ``columns`` of ``table`` and no key columns."""
    renamed = table.select(
        *[F.col(name).alias(f"__l{i}") for i, (_, name) in enumerate(keys)], *columns
    )
    condition = F.lit(True)
    for i, (expr, _) in enumerate(keys):
        condition = condition & (expr == F.col(f"__l{i}"))
    return df.join(renamed, condition, "left").drop(*[f"__l{i}" for i in range(len(keys))])


def left_join_hot(
    left: DataFrame, right: DataFrame, keys: Sequence[str], null_keys: bool = True
) -> DataFrame:
    """Left join for a right side in which one key may hold a large part of the rows.

    Adaptive execution cannot split the right side of an outer join, but it can
    split both sides of an inner one.  So matches come from an inner join, and
    the rest from an anti-join against the distinct keys, which combine before
    they are shuffled.  Both read the same filtered left side, so its shuffle is
    made once and reused.  Pass ``null_keys=False`` when no left key can be NULL.
    """
    keys = list(keys)
    complete = all_of(F.col(k).isNotNull() for k in keys)
    keyed = left.where(complete)
    matched = keyed.join(right, keys)
    rest = keyed.join(right.select(*keys).distinct(), keys, "left_anti")
    out = matched.unionByName(rest, allowMissingColumns=True)
    if null_keys:
        out = out.unionByName(left.where(~complete), allowMissingColumns=True)
    return out
