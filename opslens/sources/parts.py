"""State tables in parts, of which a new version rewrites only those that change.

Files are written once and never changed: ``<path>/<table>/version=<n>/part=<p>``.  A version lists for every
part of every table the version that wrote it, so an untouched part keeps its files.  A version counts from
the moment its list is complete; a run that is repeated before that replaces what it left.  Lists have one
row per part, as many as there are folders, and pass through the driver like any list of files.

Names of parts consist of letters, digits and ``-``; ``part_of`` makes them from key columns.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from opslens.sources.folders import exists, names

PART = "part"
_LIST = "table string, part string, version long"
Listing = dict[tuple[str, str], int]


def part_of(keys: Sequence[str]) -> Column:
    """A part for each value of the keys."""
    if not keys:
        return F.lit("all")
    return F.concat_ws("-", *[F.coalesce(F.concat(F.lit("x"), F.hex(F.col(k).cast("string"))), F.lit("null")) for k in keys])


def bucket_of(scope: Sequence[str], keys: Sequence[str], groups: int, buckets: int) -> Column:
    """Hashed parts: some ``groups`` over the scope, and each of them in ``buckets`` over the keys.

    A change in one database touches one group; a large database is spread over all its buckets.
    """
    inner = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("string")
    if not scope:
        return F.concat(F.lit("b"), inner)
    return F.concat(group_of(scope, groups), F.lit("-b"), inner)


def group_of(scope: Sequence[str], groups: int) -> Column:
    return F.concat(F.lit("g"), F.pmod(F.xxhash64(*scope), F.lit(groups)).cast("string"))


def versions(spark: SparkSession, path: str) -> list[int]:
    """Complete versions, oldest first."""
    found = [int(n.partition("=")[2]) for n in names(spark, f"{path}/versions") if n.startswith("version=")]
    return sorted(v for v in found if exists(spark, f"{path}/versions/version={v}/_SUCCESS"))


def listing(spark: SparkSession, path: str, before: int | None = None) -> Listing:
    """Which version wrote each (table, part), as of the newest version (below ``before``)."""
    known = [v for v in versions(spark, path) if before is None or v < before]
    if not known:
        return {}
    rows = spark.read.schema(_LIST).parquet(f"{path}/versions/version={known[-1]}").collect()
    return {(r.table, r.part): r.version for r in rows}


def read_parts(
    spark: SparkSession,
    path: str,
    table: str,
    schema: StructType,
    parts: Iterable[str] | None = None,
    listed: Listing | None = None,
) -> DataFrame:
    """Rows of some or all parts of a table; the scan opens no other part."""
    listed = listing(spark, path) if listed is None else listed
    wanted = None if parts is None else set(parts)
    folders = [
        f"{path}/{table}/version={v}/{PART}={p}"
        for (t, p), v in sorted(listed.items())
        if t == table and (wanted is None or p in wanted)
    ]
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*folders)


def write_parts(df: DataFrame, path: str, table: str, version: int) -> None:
    """New content of the parts that ``df`` (with a ``part`` column) holds.

    Rows of a part come together before they are written, so that a part has one file, or a few if it is large.
    """
    dealt = df.hint("rebalance", PART)
    dealt.write.partitionBy(PART).mode("overwrite").parquet(f"{path}/{table}/version={version}")


def commit(spark: SparkSession, path: str, version: int, tables: Sequence[str], touched: Iterable[str]) -> None:
    """Make a version count.  Parts that were touched and hold no rows any more are gone."""
    gone = {(t, p) for t in tables for p in touched}
    listed = {k: v for k, v in listing(spark, path, before=version).items() if k not in gone}
    for t in tables:
        written = names(spark, f"{path}/{t}/version={version}")
        listed |= {(t, n.partition("=")[2]): version for n in written if n.startswith(f"{PART}=")}
    rows = [(t, p, v) for (t, p), v in sorted(listed.items())]
    target = f"{path}/versions/version={version}"
    spark.createDataFrame(rows, _LIST).coalesce(1).write.mode("overwrite").parquet(target)
