"""Every registered query against its SQL oracle, on whole tables, and its plan."""

import subprocess
import sys
from pathlib import Path

import pytest
from oracle import connect, differences

import __spark_entry__ as entry_points
from opslens.plans import all_queries, oracles

QUERIES = all_queries()
ORACLES = oracles()


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    assert differences(df, duck, ORACLES[name]) == []
    plan = df._jdf.queryExecution().executedPlan().toString()
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "MapInPandas"):
        assert operator not in plan


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


def test_entry_returns_rows(spark):
    assert not entry_points.entry(spark).isEmpty()


def test_registry_loads_before_any_session():
    code = "import __spark_entry__ as e; print(*e.queries()); print(*e.oracle_sql())"
    root = Path(entry_points.__file__).parent
    done = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    queries, sql = (line.split() for line in done.stdout.splitlines())
    assert set(QUERIES) <= set(queries) and set(ORACLES) <= set(sql) <= set(queries)
