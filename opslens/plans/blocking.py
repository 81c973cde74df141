"""Blocking chains and unblock plans."""

from __future__ import annotations

from pyspark.sql import DataFrame

from opslens.operators.blocking import (
    blocking_chains,
    blocking_report,
    unblock_plan,
    unblock_rounds,
)
from opslens.operators.selection import contains_filters
from opslens.plans.inputs import Inputs
from opslens.plans.registry import query

_CHAINS = """WITH RECURSIVE chain AS (
  SELECT session_id, blocking_session_id, session_id AS root_session_id, CAST(0 AS BIGINT) AS level,
    CAST(session_id AS VARCHAR) AS blocking_chain FROM v_session WHERE blocking_session_id = 0
  UNION ALL
  SELECT s.session_id, s.blocking_session_id, c.root_session_id, c.level + 1,
    concat(c.blocking_chain, ' <-- ', s.session_id)
  FROM v_session s JOIN chain c ON c.session_id = s.blocking_session_id)"""

_REPORT = """SELECT c.session_id, c.blocking_session_id, c.root_session_id, c.level, c.blocking_chain,
  s.login_name, s.host_name, s.database_name
FROM chain c JOIN v_session s USING (session_id)
WHERE (c.blocking_session_id <> 0
  OR EXISTS (SELECT 1 FROM chain d WHERE d.blocking_session_id = c.session_id))"""

_COLUMNS = ["login_name", "host_name", "database_name"]


@query("q_block_chain", f"{_CHAINS} {_REPORT}")
def q_block_chain(t: Inputs) -> DataFrame:
    return blocking_report(blocking_chains(t.session), t.session, _COLUMNS)


@query(
    "q_block_filtered",
    f"""{_CHAINS} {_REPORT} AND s.host_name ILIKE 'HOST3%' AND c.blocking_chain LIKE '7%'
    AND s.database_name = 'DB3'""",
)
def q_block_filtered(t: Inputs) -> DataFrame:
    return blocking_report(
        blocking_chains(t.session), t.session, _COLUMNS, host="HOST3%", chain="7%", database="DB3"
    )


@query(
    "q_unblock_plan",
    """SELECT DISTINCT blocking_session_id AS target, 'KILL' AS action, 'blocks a matching session' AS reason,
      concat('KILL ', blocking_session_id) AS command_text
    FROM v_session WHERE blocking_session_id > 0 AND host_name ILIKE '%HOST3%'""",
)
def q_unblock_plan(t: Inputs) -> DataFrame:
    return unblock_plan(contains_filters(t.session, {"host_name": "HOST3", "login_name": None}))


@query(
    "q_unblock_rounds",
    f"""{_CHAINS}, victims AS (SELECT blocking_session_id, count(*) AS n FROM chain
      WHERE blocking_session_id <> 0 GROUP BY 1)
    SELECT c.session_id, c.root_session_id, c.level + 1 AS round_no, v.n AS blocked_sessions,
      concat('KILL ', c.session_id) AS command_text
    FROM chain c JOIN victims v ON v.blocking_session_id = c.session_id""",
)
def q_unblock_rounds(t: Inputs) -> DataFrame:
    return unblock_rounds(blocking_chains(t.session)).select(
        "session_id", "root_session_id", "round_no", "blocked_sessions", "command_text"
    )
