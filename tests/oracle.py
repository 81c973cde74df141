"""Run queries against their SQL oracles in DuckDB."""

from __future__ import annotations

import datetime
import math
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

DUCK_TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP",
    "date": "DATE",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return connection


def _value(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def differences(df, connection, sql: str) -> list[str]:
    """Empty when rows, column names and column types agree."""
    cursor = connection.execute(sql)
    duck_types = {d[0]: str(d[1]) for d in cursor.description}
    duck_rows = cursor.fetchall()
    problems = []
    if sorted(df.columns) != sorted(duck_types):
        return [f"columns {sorted(df.columns)} != {sorted(duck_types)}"]
    for name, kind in df.dtypes:
        if DUCK_TYPES.get(kind) != duck_types[name]:
            problems.append(f"type of {name}: {kind} != {duck_types[name]}")
    names = sorted(df.columns)
    at = [list(duck_types).index(n) for n in names]
    ours = Counter(tuple(_value(r[n]) for n in names) for r in df.collect())
    theirs = Counter(tuple(_value(r[i]) for i in at) for r in duck_rows)
    if ours != theirs:
        more, less = ours - theirs, theirs - ours
        problems.append(
            f"{names}\n rows {sum(ours.values())} != {sum(theirs.values())}; "
            f"only spark {sum(more.values())}: {list(more)[:2]}\n only sql {list(less)[:2]}"
        )
    return problems
