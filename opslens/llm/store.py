"""Tables in the shared folder: written once, read by every later step, safe against lost executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opslens.session import tune
from opslens.sources.workdir import fresh_path

#: Rows and bytes that Spark hands to a Python worker at once.
BATCH_ROWS = 1000
BATCH_BYTES = "8m"
#: Rows of a key-sorted shuffle that one task should hold.
ROWS_PER_TASK = 200_000


def prepared(spark: SparkSession) -> SparkSession:
    """Adaptive skew handling and small Arrow batches: texts may be very long."""
    tune(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    _ship(spark)
    return spark


def _ship(spark: SparkSession) -> None:
    """Send the package to the Python workers, unless their search path has it."""
    root = Path(__file__).resolve().parents[2]
    context = spark.sparkContext
    if str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(context, "_opslens_sent", False):
        return
    packed = Path(tempfile.mkdtemp(prefix="opslens-")) / "opslens.zip"
    with zipfile.ZipFile(packed, "w") as archive:
        for source in sorted((root / "opslens").rglob("*.py")):
            archive.write(source, source.relative_to(root))
    context.addPyFile(str(packed))
    context._opslens_sent = True


def saved(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read again; cuts the lineage, also for an empty table."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(column: str, modulus: int):
    """Rows kept from training: crc32 of the id as text, divisible by ``modulus``; never for null."""
    remainder = F.crc32(F.col(column).cast("string").cast("binary")) % modulus
    return F.coalesce(remainder == 0, F.lit(False))


def row_ids() -> Iterator[int]:
    """Numbers that are unique over all tasks of a stage."""
    start = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
    while True:
        yield start
        start += 1


def batch(columns: dict[str, object], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            c if isinstance(c, pa.Array) else pa.array(c, type=f.type)
            for c, f in zip((columns[n] for n in schema.names), schema, strict=True)
        ],
        schema=schema,
    )


def set_aside(docs: DataFrame, used: list[str]) -> tuple[DataFrame, list[str], list[Column]]:
    """``docs`` with all its columns under names of our own, beside the ``used`` ones.

    Also returns those names, and the expressions that give the columns back.  So nothing that an
    operator adds can clash with a column of the input.
    """
    names = [f"__in{i}" for i in range(len(docs.columns))]
    pairs = list(zip(docs.columns, names, strict=True))
    own = [F.col(f"`{c}`").alias(n) for c, n in pairs]
    return docs.select(*own, *used), names, [F.col(n).alias(c) for c, n in pairs]


def raw_hash() -> Column:
    """Tells texts apart, also those that differ only in case, and null from empty."""
    return F.xxhash64(F.coalesce("text", F.lit("")), F.col("text").isNull())


def rows_kept(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Rows of ``docs`` that ``verdicts`` (doc_id, raw, kept) keep, in all their columns.

    Rows meet their verdict by id and ``raw_hash``.  Rows that share both are repeats of one row.  Where
    some of them are kept and others not, one stays; these are few and joined apart, so that the texts
    of the others are shuffled once.
    """
    kept = saved(
        verdicts.groupBy(F.col("doc_id").alias("__id"), F.col("raw").alias("__raw"))
        .agg(F.count_if("kept").alias("stay"), F.count(F.lit(1)).alias("n"))
        .where("stay > 0"),
        "kept",
    )
    apart, _, back = set_aside(docs, ["doc_id", "text"])
    keyed = apart.withColumn("__key", raw_hash())

    def met(part: DataFrame) -> DataFrame:
        some = saved(part.select("__id", "__raw"), "kept")
        return keyed.join(some, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__raw")))

    repeats = met(kept.where("stay < n")).dropDuplicates(["doc_id", "__key"])
    return met(kept.where("stay = n")).unionByName(repeats).select(*back)
