"""As-of joins against a plain search."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from opslens.operators.asof import align_polls, asof_join

START = datetime(2024, 1, 1)


def brute(left, right, within=None):
    for i, k, t in left:
        fits = [(u, v) for j, u, v in right if None not in (k, t, j, u) and j == k and u <= t]
        best = max(fits, key=lambda f: (f[0], f[1] is not None, f[1] or 0), default=(None, None))
        if within is not None and best[0] is not None and best[0] < t - within:
            best = (None, None)
        yield i, k, t, best[1], best[0]


@pytest.mark.parametrize("hours", [None, 2])
@pytest.mark.parametrize("parts", [1, 16])
def test_against_search(spark, rows, hours, parts):
    draw = random.Random(parts)

    def time():
        return None if draw.random() < 0.05 else START + timedelta(minutes=draw.randrange(0, 3000, 30))

    key = lambda: draw.choice(["hot"] * 6 + ["a", "b", "c", None])
    left = [(i, key(), time()) for i in range(300)]
    right = [(key(), time(), draw.choice([None, *range(9)])) for _ in range(200)]
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = asof_join(
            spark.createDataFrame(left, "id long, k string, t timestamp_ntz"),
            spark.createDataFrame(right, "k string, u timestamp_ntz, v int"),
            ["k"], "t", ["v"], right_time="u", within=None if hours is None else f"{hours} hours",
        )
        assert rows(got) == sorted(brute(left, right, None if hours is None else timedelta(hours=hours)), key=repr)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_last_value_crosses_ranges(spark):
    """One right row before many left rows, which fill all ranges."""
    left = spark.range(5000).select(F.lit("k").alias("k"), F.col("id").alias("t"))
    right = spark.createDataFrame([("k", -1, "first"), ("j", 6000, "other")], "k string, t long, v string")
    got = asof_join(left, right, ["k"], "t", ["v"])
    assert got.where("v = 'first' and as_of_time = -1").count() == 5000


def test_sides_may_be_empty_and_names_may_not_clash(spark):
    left = spark.createDataFrame([(1, 5)], "k int, t int")
    right = spark.createDataFrame([], "k int, t int, v int")
    assert [tuple(r) for r in asof_join(left, right, ["k"], "t", ["v"]).collect()] == [(1, 5, None, None)]
    assert asof_join(left.limit(0), right, ["k"], "t", ["v"]).collect() == []
    with pytest.raises(ValueError, match="both sides"):
        asof_join(left.withColumn("v", F.lit(1)), right, ["k"], "t", ["v"])


def test_whole_polls_are_aligned(spark, rows):
    """A session that the newest poll does not hold is gone, although an older poll had it."""
    schema = "server_id string, snapshot_ts timestamp_ntz, snapshot_date date, session_id int"
    at = lambda m: START + timedelta(minutes=m)
    sessions = spark.createDataFrame(
        [("s", at(0), START.date(), 1), ("s", at(0), START.date(), 2), ("s", at(10), START.date(), 1), ("z", at(0), START.date(), 9)],
        schema,
    )
    requests = spark.createDataFrame([("s", at(m), START.date(), 1) for m in (1, 9, 10, 11, 60)] + [("t", at(5), START.date(), 1)], schema)
    got = align_polls(requests, sessions, within="30 minutes").select("server_id", "snapshot_ts", "session_id")
    want = [("s", at(m), i) for m, i in ((1, 1), (1, 2), (9, 1), (9, 2), (10, 1), (11, 1))]
    assert rows(got) == sorted(want, key=repr)
