"""Filters and columns reach the scans; parameters need no join."""

import __spark_entry__ as entry_points
import pytest
from opslens.operators.sessions import who
from opslens.operators.space import space_report
from opslens.plans.inputs import Inputs
from opslens.plans.registry import _PLANS

QUERIES = entry_points.queries()


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_retention_cutoff_reaches_the_scan(spark, sf_dir):
    assert "LessThan(ts," in physical(QUERIES["q_cmdlog_cleanup"](spark, sf_dir))


def test_index_poll_filter_reaches_the_scan(spark, sf_dir):
    assert "GreaterThanOrEqual(l_shipdate," in physical(Inputs(spark, sf_dir).index_now)


def test_only_needed_columns_are_read(spark, sf_dir):
    plan = physical(QUERIES["q_isolation_mix"](spark, sf_dir))
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in plan


def test_selection_list_needs_no_join(spark, sf_dir):
    plan = physical(_PLANS["q_select_indexes"](Inputs(spark, sf_dir)))
    assert "Join" not in plan


# ---------------------------------------------------------------- shape of the costly plans, with broadcasts off


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def count(df, node: str) -> int:
    """Nodes of the plan before adaptive execution."""
    plan = physical(df).split("== Initial Plan ==")[-1]
    return sum(line.lstrip(" :+-*()0123456789").startswith(node) for line in plan.splitlines())


@pytest.mark.parametrize("kind", [2, 3])
def test_layered_report_reads_its_files_once(spark, sf_dir, no_broadcast, kind):
    report = space_report(Inputs(spark, sf_dir).file, kind, scope=())
    assert count(report, "FileScan") == 1
    assert count(report, "Exchange") == 1


def test_text_is_joined_last(spark, sf_dir, no_broadcast):
    t = Inputs(spark, sf_dir)
    report = who(t.request, t.session, batches=t.batch, grants=t.grant, user_processes=None)
    plan = physical(report)
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert "sql_handle" in joins[0] and all("sql_handle" not in j for j in joins[1:])
    assert count(report, "FileScan") == 4


def test_a_busy_session_is_read_once_for_its_tasks(spark, sf_dir, no_broadcast):
    t = Inputs(spark, sf_dir)
    owner = t.request.select("request_id", "session_id")
    tasks, waits = t.task.join(owner, "request_id"), t.wait.join(owner, "request_id").drop("request_id")
    alone = count(who(t.request, t.session, user_processes=None, child_tasks=True, tasks=tasks), "FileScan")
    both = count(who(t.request, t.session, user_processes=None, child_tasks=True, tasks=tasks, waits=waits), "FileScan")
    assert both == alone + 2  # the waits and their owners


def test_waits_meet_narrow_tasks_and_requests_come_last(spark, sf_dir, no_broadcast):
    t = Inputs(spark, sf_dir)
    sessions = t.wide_session
    report = who(t.wide_request, sessions, tasks=t.wide_task, waits=t.wide_wait, child_tasks=True, scope=["server_id"])
    plan = physical(report).split("== Initial Plan ==")[-1]
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert "request_id" in joins[0] and "exec_context_id" not in joins[0]
    wide = [line for line in plan.splitlines() if "Exchange" in line and "exec_context_id" in line]
    assert wide and sum("total_elapsed_ms" in line for line in wide) == 0


def test_role_gap_pairs_no_login_with_a_database(spark, sf_dir, no_broadcast):
    """Every join of the gap is on keys; logins meet databases as words of 64."""
    plan = physical(QUERIES["q_role_gap_all"](spark, sf_dir))
    assert "Cartesian" not in plan and "NestedLoop" not in plan and "__word" in plan


def test_merged_shuffle_partitions_stay_small(spark, sf_dir):
    """Also where the session's own target is large, a task of 1 GB of short keys stays within some 100 MB."""
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64m")
    QUERIES["q_check_plan"](spark, sf_dir)
    assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == "16m"
