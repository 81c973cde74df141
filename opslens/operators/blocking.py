"""Who blocks whom."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslens.functions import concat_nullsafe
from opslens.operators.selection import eq_filters, like_filters
from opslens.sources.workdir import reliable_checkpoint

ARROW = " <-- "
#: Ids that travel with a session; a power of two.
BLOCK = 64


def blocking_chains(
    sessions: DataFrame,
    scope: Sequence[str] = (),
    session: str = "session_id",
    blocker: str = "blocking_session_id",
) -> DataFrame:
    """Root, level and chain text of every session that hangs below an unblocked root.

    Pointer doubling: each round every open session adopts the pointer of the
    session it points to, so a chain of depth d closes in log2(d) joins instead
    of d.  Sessions in a cycle, or whose blocker is gone, never reach a root
    and do not appear; the loop ends when a round reaches no new root.

    No text travels through the rounds, only ids: besides root and pointer the last ``BLOCK`` ids at most.  The chain of
    a session deeper than that is put together afterwards, once, from the blocks of its ancestors.
    """
    scope = list(scope)
    ident = F.col(session).cast("long")
    parent = F.coalesce(F.col(blocker).cast("long"), F.lit(0).cast("long"))
    is_root = parent == 0
    state = sessions.select(
        *scope,
        ident.alias("id"),
        parent.alias("blocker"),
        F.when(is_root, ident).alias("root"),
        F.when(~is_root, parent).alias("pointer"),
        F.when(is_root, 0).otherwise(1).cast("long").alias("level"),
        F.array(ident).alias("ids"),
    )
    state = reliable_checkpoint(state)
    rooted = [state.where(F.col("root").isNotNull())]
    open_ = state.where(F.col("root").isNull())
    blocks, reach = None, 1
    while not open_.isEmpty():
        if reach == BLOCK:
            blocks = open_.select(*scope, "id", F.col("pointer").alias("up"), "ids")
        everyone = reduce(DataFrame.unionByName, [*rooted, open_])
        target = everyone.select(*scope, F.col("id").alias("pointer"), *_named("t_", "root", "pointer", "level", "ids"))
        # Every open session is ``reach`` levels below its pointer.  Once that is a block, ids no longer grow.
        ids = F.concat("t_ids", "ids") if reach < BLOCK else F.lit(None).cast("array<long>")
        stepped = open_.join(target, [*scope, "pointer"]).select(
            *scope,
            "id",
            "blocker",
            F.col("t_root").alias("root"),
            F.col("t_pointer").alias("pointer"),
            (F.col("t_level") + F.col("level")).alias("level"),
            ids.alias("ids"),
        )
        stepped = reliable_checkpoint(stepped)
        arrived = stepped.where(F.col("root").isNotNull())
        if arrived.isEmpty():
            break
        rooted.append(arrived)
        open_ = stepped.where(F.col("root").isNull())
        reach *= 2
    chains = reduce(DataFrame.unionByName, rooted)
    near = F.array_join(F.transform("ids", lambda i: i.cast("string")), ARROW)
    if blocks is None:
        chains = chains.select("*", near.alias("blocking_chain"))
    else:
        shallow = chains.where(F.col("ids").isNotNull()).select("*", near.alias("blocking_chain"))
        deep = chains.where(F.col("ids").isNull())
        chains = shallow.unionByName(deep.join(_long_chains(deep, shallow, blocks, scope), [*scope, "id"]))
    return chains.select(
        *scope,
        F.col("id").alias(session),
        F.col("blocker").alias(blocker),
        F.col("root").alias("root_session_id"),
        "level",
        "blocking_chain",
    )


def _named(prefix: str, *columns: str) -> list[Column]:
    return [F.col(c).alias(f"{prefix}{c}") for c in columns]


def _long_chains(deep: DataFrame, shallow: DataFrame, blocks: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Chain texts of sessions below the first ``BLOCK`` levels.

    ``blocks`` has the last ids of a session and, as ``up``, the ancestor that stands before them.  All such
    ancestors of a session, at most one for each block of its chain, come from doubling
    again, on ids; then their texts are collected, each by the session it belongs to.
    """
    scope = list(scope)
    step = reliable_checkpoint(blocks.drop("ids").join(deep.select(*scope, "id"), [*scope, "id"], "left_semi"))
    above = step.select(*scope, "id", F.lit(1).cast("long").alias("far"), "up")
    reach = 1
    while True:
        further = step.select(*scope, F.col("id").alias("up"), F.col("up").alias("t_up"))
        onward = above.join(further, [*scope, "up"])
        onward = onward.select(*scope, "id", (F.col("far") + reach).alias("far"), F.col("t_up").alias("up"))
        onward = reliable_checkpoint(onward)
        if onward.isEmpty():
            break
        above = above.unionByName(onward)
        step = step.select(*scope, "id", F.col("up").alias("middle")).join(
            step.select(*scope, F.col("id").alias("middle"), "up"), [*scope, "middle"]
        )
        step = reliable_checkpoint(step.select(*scope, "id", "up"))
        reach *= 2
    own = F.array_join(F.transform("ids", lambda i: i.cast("string")), ARROW).alias("text")
    texts = blocks.select(*scope, F.col("id").alias("up"), own).unionByName(
        shallow.select(*scope, F.col("id").alias("up"), F.col("blocking_chain").alias("text"))
    )
    self_ = deep.select(*scope, "id", F.lit(0).cast("long").alias("far"), F.col("id").alias("up"))
    pieces = above.unionByName(self_).join(texts, [*scope, "up"])
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("far")).alias("far"), "text")))
    return pieces.groupBy(*scope, "id").agg(
        F.array_join(F.transform(ordered, lambda p: p["text"]), ARROW).alias("blocking_chain")
    )


def blocking_report(
    chains: DataFrame,
    sessions: DataFrame | None = None,
    columns: Sequence[str] = (),
    scope: Sequence[str] = (),
    *,
    login: str | None = None,
    chain: str | None = None,
    database: str | None = None,
    host: str | None = None,
) -> DataFrame:
    """Roots that block somebody, and everybody who is blocked, with session columns."""
    scope = list(scope)
    blocked = chains.where(F.col("blocking_session_id") != 0)
    blockers = blocked.select(*scope, F.col("blocking_session_id").alias("session_id"))
    roots = chains.where(F.col("blocking_session_id") == 0).join(
        blockers, [*scope, "session_id"], "left_semi"
    )
    report = roots.unionByName(blocked)
    if sessions is not None:
        report = report.join(sessions.select(*scope, "session_id", *columns), [*scope, "session_id"])
    filters = {"login_name": login, "blocking_chain": chain, "host_name": host}
    return eq_filters(like_filters(report, filters), {"database_name": database})


def unblock_plan(blocked: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """The distinct blockers of the given blocked sessions, intermediate ones included."""
    return (
        blocked.where(F.col("blocking_session_id") > 0)
        .select(*scope, F.col("blocking_session_id").alias("target"))
        .distinct()
        .withColumn("action", F.lit("KILL"))
        .withColumn("reason", F.lit("blocks a matching session"))
        .withColumn("command_text", concat_nullsafe("KILL ", F.col("target")))
    )


def unblock_rounds(chains: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Every blocker reachable from a root, in the order it would have to go: root first."""
    scope = list(scope)
    victims = (
        chains.where(F.col("blocking_session_id") != 0)
        .groupBy(*scope, F.col("blocking_session_id").alias("session_id"))
        .agg(F.count(F.lit(1)).alias("blocked_sessions"))
    )
    return (
        chains.select(*scope, "session_id", "root_session_id", (F.col("level") + 1).alias("round_no"))
        .join(victims, [*scope, "session_id"])
        .withColumn("action", F.lit("KILL"))
        .withColumn("command_text", concat_nullsafe("KILL ", F.col("session_id")))
    )
