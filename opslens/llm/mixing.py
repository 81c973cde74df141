"""Mixing sources to target weights by capped water-filling; DataFrame operations only.

A source's target is its weight's share of all words, stopped at ``max_epochs`` times its size; what
the stopped ones leave is reshared by weight until none is above.  In closed form the target is
``min(cap, level * weight)``: sources are ranked by cap / weight, and the level is the only one at
which exactly the sources ranked before it are stopped.

A source is taken ``floor(target / size)`` times whole; the rest of the target is a sample without
replacement in the order of a seeded hash.  The last document of the sample is found by
counting words in hash buckets, level by level, so no source is ever sorted in one task.  What then is
missing is filled from the documents that still fit, ``FILLS`` times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opslens.llm.store import saved, set_aside

MAX_EPOCHS = 3
SEED = 20240229
#: Hash bits settled per counting level, and the number of levels.
LEVEL_BITS = 12
LEVELS = 4
FILLS = 3

_BLANKS = "[\\x20\\x09-\\x0D]+"


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+``; null: 0."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), f"^{_BLANKS}|{_BLANKS}$", "")
    return F.when(F.length(bare) == 0, 0).otherwise(F.regexp_count(bare, F.lit(_BLANKS)) + 1).cast("long")


def targets(sizes: DataFrame, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """``source, source_size, weight, target`` from one row per source (``source, source_size``).

    Weights are 1, 2, 3, repeating over the sources by code point, null last.  A source without
    words has target 0.  Sources are few beside documents: one row each is ranked here.
    """
    every = Window.orderBy(F.col("source").isNull(), F.col("source"))
    weighed = sizes.withColumn("weight", (F.row_number().over(every) - 1) % 3 + 1).withColumn(
        "cap", F.col("source_size") * F.lit(float(max_epochs))
    )
    ranked = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before = ranked.rowsBetween(Window.unboundedPreceding, -1)
    here_on = ranked.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy()
    levels = weighed.withColumn(
        "level",
        (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        / F.sum("weight").over(here_on),
    )
    # The level holds from the first source that is not stopped at it.
    levels = levels.withColumn("rank", F.row_number().over(ranked))
    reached = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("rank", "level"))
    level = F.min(reached).over(whole)["level"]
    target = F.least(F.col("cap"), F.coalesce(level * F.col("weight"), F.col("cap")))
    return levels.select("source", "source_size", "weight", target.alias("target"))


def mix(
    docs: DataFrame, columns: list[str], max_epochs: float = MAX_EPOCHS, seed: int = SEED
) -> DataFrame:
    """``columns`` of ``docs`` with ``__size, __source_size, __target, __reps``.

    ``__reps`` is how often the mix takes the row.

    A null source is a source of its own.  Rows without words are taken as often as their hash
    falls.  Rows that share id and text fall together, so a source of repeats of one row can miss its target
    by them.  An empty table gives no rows.
    """
    spot = F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"), F.coalesce("text", F.lit("")))
    kept = [F.col(f"`{c}`") for c in columns]
    marks = [word_count(F.col("text")).alias("__size"), spot.alias("__spot"), F.col("source").alias("__from")]
    sized = saved(docs.select(*kept, *marks), "sized")
    slim = sized.select(F.col("__from").alias("source"), "__size", "__spot")
    sizes = slim.groupBy("source").agg(F.sum("__size").alias("source_size"))
    plan = targets(sizes, max_epochs)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = plan.withColumn("whole", F.least(F.floor(rate + 1e-12), F.lit(int(max_epochs)))).withColumn(
        "rest", F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0))
    )
    plan = plan.withColumn("left0", F.col("rest"))
    for turn in range(FILLS + 1):
        plan = _cutoff(_open(slim, plan, turn), plan, turn)
    met = sized.join(
        plan.withColumnsRenamed({c: f"__{c}" for c in plan.columns}), F.col("__from").eqNullSafe(F.col("__source"))
    )
    drawn = _drawn(FILLS + 1, "__")
    reps = F.col("__whole") + F.when(drawn, 1).otherwise(0)
    return met.withColumn("__reps", F.least(reps, F.lit(int(max_epochs))).cast("int"))


def _drawn(turns: int, prefix: str = "") -> Column:
    """Whether the first ``turns`` samples hold a row: its hash is below the cut and it fits what was left."""
    drawn = F.lit(False)
    for t in range(turns):
        drawn = drawn | (
            (_high(F.col("__spot")) < F.col(f"{prefix}cut{t}")) & (F.col("__size") <= F.col(f"{prefix}left{t}"))
        )
    return drawn


def _open(slim: DataFrame, plan: DataFrame, turn: int) -> DataFrame:
    """Rows that no sample holds so far and that fit what is left."""
    known = plan.withColumnRenamed("source", "s")
    met = slim.join(known, F.col("source").eqNullSafe(F.col("s")))
    return met.where(~_drawn(turn) & (F.col("__size") <= F.col(f"left{turn}"))).select(slim.columns)


def _high(spot: Column) -> Column:
    """The leading LEVEL_BITS * LEVELS bits of the hash, as a number from 0."""
    return F.shiftrightunsigned(spot, 64 - LEVEL_BITS * LEVELS)


def _cutoff(rows: DataFrame, plan: DataFrame, turn: int) -> DataFrame:
    """``plan`` with ``cut{turn}``, and ``left{turn + 1}``, the words still missing after it.

    Rows of a source whose hash is below the cut carry at most ``left{turn}`` words.  Each level counts
    words in 2**LEVEL_BITS buckets of the one bucket in which the level before ended.
    """
    state = plan.select("source", F.lit(0).cast("long").alias("cut"), F.col(f"left{turn}").alias("left"))
    for level in range(1, LEVELS + 1):
        state = saved(state, "cutoff")
        named = state.withColumnsRenamed({"source": "s", "cut": "c", "left": "l"})
        bucket = F.shiftright(_high(F.col("__spot")), LEVEL_BITS * (LEVELS - level))
        inside = rows.join(named, F.col("source").eqNullSafe(F.col("s")))
        if level > 1:
            inside = inside.where(F.shiftright(bucket, LEVEL_BITS) == F.col("c"))
        counts = inside.groupBy("source", "l", bucket.alias("bucket")).agg(F.sum("__size").alias("words"))
        # At most 2**LEVEL_BITS rows of each source.
        counts = counts.withColumn("upto", F.sum("words").over(Window.partitionBy("source").orderBy("bucket")))
        under = F.col("upto") <= F.col("l")
        passed = counts.groupBy(F.col("source").alias("s")).agg(
            F.max(F.when(under, F.col("bucket"))).alias("last"),
            F.max(F.when(under, F.col("upto"))).alias("words"),
            F.min(F.when(~under, F.col("bucket"))).alias("over"),
        )
        at = F.col("cut") * (1 << LEVEL_BITS)
        # Go on inside the first bucket that is too large; with none, all of them are in.
        step = F.coalesce("over", at + (1 << LEVEL_BITS)) if level < LEVELS else F.coalesce(F.col("last") + 1, at)
        state = state.join(passed, F.col("source").eqNullSafe(F.col("s")), "left").select(
            "source",
            F.when(F.col("s").isNull(), at).otherwise(step).cast("long").alias("cut"),
            (F.col("left") - F.coalesce("words", F.lit(0))).alias("left"),
        )
    done = saved(state, "cutoff").select(
        F.col("source").alias("s"), F.col("cut").alias(f"cut{turn}"), F.col("left").alias(f"left{turn + 1}")
    )
    return saved(plan.join(done, F.col("source").eqNullSafe(F.col("s"))).drop("s"), "mix")


def repeat_rows(docs: DataFrame) -> DataFrame:
    """The mix itself: every row as often as it is taken; columns stay as they are."""
    apart, names, back = set_aside(docs, ["doc_id", "text", "source"])
    taken = mix(apart, names).where("__reps > 0")
    return taken.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__reps")))).select(*back)
