"""Names every query, its Spark plan and its independent SQL."""

from __future__ import annotations

import importlib
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, DecimalType, IntegerType, ShortType

from opslens.plans.inputs import VIEWS, Fleet, Inputs, on_two_servers, oracle_view
from opslens.session import tune

Build = Callable[[Inputs], DataFrame]

_PLANS: dict[str, Build] = {}
_ORACLES: dict[str, str] = {}
_MODULES = (
    "sessions",
    "blocking",
    "space",
    "indexes",
    "principals",
    "selection",
    "backup",
    "jobs",
    "streams",
    "polls",
)


def query(name: str, oracle: str | None = None, fleet: bool = False) -> Callable[[Build], Build]:
    """Register a plan and its SQL.  With ``fleet`` both run over two servers, the SQL on each by itself."""

    def register(build: Build) -> Build:
        _PLANS[name] = (lambda t: build(Fleet(t.spark, t.sf_dir))) if fleet else build
        if oracle is not None:
            _ORACLES[name] = _with_views(on_two_servers(oracle) if fleet else oracle)
        return build

    return register


def plain(df: DataFrame) -> DataFrame:
    """Widen result columns so that both engines return the same Python values."""
    columns = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, DecimalType):
            c = c.cast("double")
        elif isinstance(field.dataType, ByteType | ShortType | IntegerType):
            c = c.cast("long")
        columns.append(c.alias(field.name))
    return df.select(*columns)


def _with_views(sql: str) -> str:
    names = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    body = sql.strip()
    views = ", ".join(oracle_view(n) for n in names)
    match = re.match(r"WITH\s+(RECURSIVE\s+)?", body, re.IGNORECASE)
    if not views:
        return body
    if match:
        return f"WITH {match[1] or ''}{views}, {body[match.end():]}"
    return f"WITH {views} {body}"


def _load() -> None:
    for module in _MODULES:
        importlib.import_module(f"opslens.plans.{module}")


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()

    def bind(build: Build) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: plain(build(Inputs(tune(spark), sf_dir)))

    return {name: bind(build) for name, build in _PLANS.items()}


def oracles() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
