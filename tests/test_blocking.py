import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from opslens.operators import blocking
from opslens.operators.blocking import (
    blocking_chains,
    blocking_report,
    unblock_plan,
    unblock_rounds,
)

SCHEMA = "session_id long, blocking_session_id long"


def frame(spark, blockers):
    return spark.createDataFrame(sorted(blockers.items()), SCHEMA)


def brute_force(blockers):
    chains = {}
    for session in blockers:
        path, at = [session], session
        while blockers.get(at) and blockers[at] not in path:
            at = blockers[at]
            path.append(at)
        if at in blockers and not blockers[at]:
            chains[session] = " <-- ".join(map(str, reversed(path)))
    return chains


def as_dict(chains):
    return {r["session_id"]: r["blocking_chain"] for r in chains.collect()}


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.dictionaries(st.integers(1, 12), st.integers(0, 13), min_size=1, max_size=12))
def test_chains_match_brute_force(spark, blockers):
    """Random graphs: forests, cycles, self-blocks, and blockers that do not exist."""
    chains = blocking_chains(frame(spark, blockers))
    assert as_dict(chains) == brute_force(blockers)
    assert all(r["level"] == r["blocking_chain"].count("<--") for r in chains.collect())


def test_deep_chain(spark):
    blockers = {i: i - 1 for i in range(1, 301)}
    chains = as_dict(blocking_chains(frame(spark, blockers)))
    assert chains[300].count("<--") == 299
    assert chains == brute_force(blockers)


@pytest.mark.parametrize("depth", [63, 64, 65, 66, 127, 128, 129, 200])
def test_chains_around_the_length_of_a_block(spark, depth):
    blockers = {i: i - 1 for i in range(1, depth + 1)} | {1000 + i: i for i in range(1, depth + 1, 9)}
    assert as_dict(blocking_chains(frame(spark, blockers))) == brute_force(blockers)


@pytest.mark.parametrize("block", [1, 2, 4])
def test_trees_of_many_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(blocking, "BLOCK", block)
    draw = random.Random(block)
    blockers = {i: max(0, i - draw.randint(1, 3)) for i in range(1, 120)} | {500: 501, 501: 500, 502: 501, 503: 999}
    assert as_dict(blocking_chains(frame(spark, blockers))) == brute_force(blockers)


def test_ten_thousand_sessions_in_a_row(spark, monkeypatch):
    """Only ids in the rounds: no column of a checkpoint is a text."""
    seen = []
    keep = blocking.reliable_checkpoint
    monkeypatch.setattr(blocking, "reliable_checkpoint", lambda df: seen.append(df.dtypes) or keep(df))
    n = 10_000
    sessions = spark.range(1, n + 1).select(F.col("id").alias("session_id"), (F.col("id") - 1).alias("blocking_session_id"))
    chains = blocking_chains(sessions)
    assert seen and all(kind != "string" for dtypes in seen for _, kind in dtypes)
    sizes = chains.groupBy().agg(F.count("*"), F.max("level"), F.sum(F.length("blocking_chain"))).first()
    digits = [len(str(i)) for i in range(1, n + 1)]
    wanted = sum((n - k) * d for k, d in enumerate(digits)) + 5 * n * (n - 1) // 2
    assert tuple(sizes) == (n, n - 1, wanted)
    assert chains.where("session_id = 300").first()["blocking_chain"] == " <-- ".join(map(str, range(1, 301)))


def test_cycle_and_lost_blocker_stay_out(spark):
    chains = blocking_chains(frame(spark, {1: 0, 2: 1, 3: 4, 4: 3, 5: 4, 6: 99, 7: 7}))
    assert as_dict(chains) == {1: "1", 2: "1 <-- 2"}


def test_hot_root(spark):
    blockers = {1: 0, **{i: 1 for i in range(2, 400)}, 500: 399, 600: 0}
    chains = blocking_chains(frame(spark, blockers))
    assert as_dict(chains) == brute_force(blockers)
    report = blocking_report(chains)
    assert report.where("session_id = 600").isEmpty()  # a root that blocks nobody
    assert report.count() == 400
    assert {r["target"] for r in unblock_plan(report).collect()} == {1, 399}
    rounds = {r["session_id"]: r["round_no"] for r in unblock_rounds(chains).collect()}
    assert rounds == {1: 1, 399: 2}


def test_scope_keeps_servers_apart(spark):
    a = frame(spark, {1: 0, 2: 1}).withColumn("server_id", F.lit("a"))
    b = frame(spark, {1: 2, 2: 0}).withColumn("server_id", F.lit("b"))
    chains = blocking_chains(a.unionByName(b), ["server_id"])
    assert {(r["server_id"], r["blocking_chain"]) for r in chains.collect()} == {
        ("a", "1"), ("a", "1 <-- 2"), ("b", "2"), ("b", "2 <-- 1"),
    }


def test_null_blocker_is_a_root(spark):
    assert as_dict(blocking_chains(spark.createDataFrame([(5, None)], SCHEMA))) == {5: "5"}
