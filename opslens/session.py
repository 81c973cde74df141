"""Runtime settings the operators count on.  All are plain Spark SQL options."""

from __future__ import annotations

from pyspark.sql import SparkSession

TARGET_PARTITION_BYTES = 128 * 1024 * 1024

_ADAPTIVE = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Merged partitions are measured compressed: 64 MB of short keys are millions of groups, over 1 GB in one
    # task's hash table.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot join key even when the grouping behind the join then needs its own shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def tune(spark: SparkSession, shuffle_bytes: int | None = None) -> SparkSession:
    """Turn on adaptive skew handling; size shuffles when their volume is known.

    Adaptive execution merges small shuffle partitions but never splits them
    for a plain aggregation, so the starting number has to suit the data.
    """
    for key, value in _ADAPTIVE.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    if shuffle_bytes is not None:
        wanted = max(1, -(-shuffle_bytes // TARGET_PARTITION_BYTES))
        spark.conf.set("spark.sql.shuffle.partitions", str(wanted))
    return spark
