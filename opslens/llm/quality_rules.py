"""Quality rules with adaptive thresholds per language and source; DataFrame operations only.

Fixed base rules reject very short and very repetitive texts.  The others are ratios (symbols
per character, repeated lines per line, characters per word) whose limits come from
quantile sketches: each task sketches its rows of a language and source, the sketches merge, and a row
is rejected when it lies far outside the middle half of its group.  Junk that makes up over a quarter of a
group would carry that limit away, so it is held by what is usual elsewhere: the median, one vote a group, of
limits drawn from the lower half of each group.  Only a group that lies beyond it almost as a whole keeps
its own limit.  So a group of clean texts loses nothing, and neither does one that is noisy throughout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslens.llm.store import saved, set_aside

MIN_WORDS = 50
#: A limit lies this many interquartile ranges beyond the upper (or below the lower) quartile.
SPREAD = 6.0
#: A usual limit lies this many times the distance from the outer decile to the median beyond the median.
HALF_SPREAD = 7.0
#: Languages with fewer groups take the usual limits of the whole table.
MIN_GROUPS = 3
#: No limit is tighter than these values, whatever the group looks like.
LEAST_SYMBOLS = 0.05
LEAST_DUP_LINES = 0.40
LEAST_LONG_WORDS = 12.0
MOST_SHORT_WORDS = 2.0
#: Smaller groups take the limits of the whole table.
MIN_GROUP = 100
#: Accuracy of the sketches: rank error is at most 1 / SKETCH of a group's rows.
SKETCH = 10_000

_SPACES = "[\\x20\\x09-\\x0D]+"
_POSITION_BITS = 24
_MASK = (1 << _POSITION_BITS) - 1
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _words(text: Column) -> Column:
    bare = F.regexp_replace(text, f"^{_SPACES}|{_SPACES}$", "")
    return F.when(F.length(bare) == 0, F.array().cast("array<string>")).otherwise(F.split(bare, _SPACES))


def _lines(text: Column) -> Column:
    """Lines with a word."""
    return F.filter(F.split(text, "\n", -1), lambda line: F.length(F.btrim(line, F.lit(" \t\n\x0b\f\r"))) > 0)


def _at(array: str, index: Column) -> Column:
    return F.get(F.col(array), index)


def _packed(i: Column) -> Column:
    """Hash of the three words from i, with i in the low bits."""
    h = F.xxhash64(*[_at("__words", i + k) for k in range(3)])
    return h.bitwiseAND(F.lit(~_MASK)).bitwiseOR(i.cast("long"))


def _place(packed: Column) -> Column:
    return packed.bitwiseAND(F.lit(_MASK)).cast("int")


def _same_hash(a: Column, b: Column) -> Column:
    return F.shiftright(a, _POSITION_BITS) == F.shiftright(b, _POSITION_BITS)


def _same_words(a: Column, b: Column) -> Column:
    p, q = _place(a), _place(b)
    equal = [_at("__words", p + k) == _at("__words", q + k) for k in range(3)]
    return equal[0] & equal[1] & equal[2]


def _repeated(name: str, same) -> Column:
    """Elements of a sorted array that equal a neighbour."""

    def beside(x: Column, k: Column) -> Column:
        before, after = _at(name, k - 1), _at(name, k + 1)
        return F.coalesce((k > 0) & same(x, before), F.lit(False)) | F.coalesce(same(x, after), F.lit(False))

    return F.filter(F.col(name), beside)


def _covered(name: str) -> Column:
    """Words in three-word windows that begin at the sorted positions."""
    steps = F.transform(F.col(name), lambda p, k: F.least(F.lit(3), F.coalesce(_at(name, k + 1) - p, F.lit(3))))
    return F.aggregate(steps, F.lit(0), lambda total, step: total + step)


def measure(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` and the measures of every text (null: empty), plus ``n_lines``.

    Three-word windows are hashed with their position into one number and sorted; equal
    neighbours are compared word by word, so a hash collision cannot count.  Should unequal windows
    share a hash in one text, or the text have more words than positions fit, its windows
    are sorted by their words instead.
    """
    kept = [F.col(f"`{c}`") for c in columns]
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.select(*kept, text.alias("__text"))
    df = df.select(
        *columns_of(columns), "__text", _words(F.col("__text")).alias("__words"), _lines(F.col("__text")).alias("__lines")
    )
    n = F.size("__words")
    starts = F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>"))
    counts = [
        n.cast("long").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        F.regexp_count("__text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.size("__lines").cast("long").alias("n_lines"),
    ]
    df = df.select(
        *columns_of(columns), *counts, "__words", F.sort_array(F.transform(starts, _packed)).alias("__sorted")
    )
    df = df.select("*", _repeated("__sorted", _same_hash).alias("__equal"))

    def clashes(x: Column, k: Column) -> Column:
        after = _at("__equal", k + 1)
        return _same_hash(x, after) & ~_same_words(x, after)

    clash = F.exists(F.transform("__equal", clashes), lambda c: F.coalesce(c, F.lit(False)))
    by_words = F.array_sort(
        F.transform(
            starts,
            lambda i: F.struct(
                F.concat_ws(" ", *[_at("__words", i + k) for k in range(3)]).alias("w"), i.alias("i")
            ),
        )
    )
    odd = (n > _MASK) | clash
    none = F.array().cast("array<struct<w:string,i:int>>")
    df = df.select("*", F.when(odd, by_words).otherwise(none).alias("__slow"), odd.alias("__odd"))
    places = F.when(
        F.col("__odd"), F.transform(_repeated("__slow", lambda a, b: a["w"] == b["w"]), lambda x: x["i"])
    ).otherwise(F.transform("__equal", _place))
    df = df.select("*", F.sort_array(places).alias("__places"))
    return df.select(
        *columns_of(columns), *MEASURES[:4], _covered("__places").cast("long").alias("n_repeat_words"), "n_lines"
    )


def columns_of(names: list[str]) -> list[Column]:
    return [F.col(f"`{c}`") for c in names]


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


_RATIOS = {
    "symbols": ("n_symbols", "word_chars"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "word_length": ("word_chars", "n_words"),
}


def _ratio(name: str) -> Column:
    over, under = _RATIOS[name]
    return F.col(over) / F.greatest(F.col(under), F.lit(1))


_QUANTILES = [0.1, 0.25, 0.5, 0.75, 0.9]
#: Name of each limit, its ratio, the side of the bulk it lies on, and its loosest forced value.
_LIMITS = (
    ("most_symbols", "symbols", 1, LEAST_SYMBOLS),
    ("most_dup_lines", "dup_lines", 1, LEAST_DUP_LINES),
    ("longest", "word_length", 1, LEAST_LONG_WORDS),
    ("shortest", "word_length", -1, MOST_SHORT_WORDS),
)


def _beyond_quartile(q: Column, sign: int) -> Column:
    return q[3 if sign > 0 else 1] + sign * SPREAD * (q[3] - q[1])


def _beyond_median(q: Column, sign: int) -> Column:
    """A limit that only the half of the rows away from it shapes."""
    return q[2] + HALF_SPREAD * (q[2] - q[0 if sign > 0 else 4])


def limits(measured: DataFrame) -> DataFrame:
    """One row per language and source: ``lang, source`` and the limits of each ratio.

    Sketches are built per task and merged; rows that fail a base rule don't shape the limits.
    """
    ratios = measured.where(~base_failed()).select("lang", "source", *[_ratio(r).alias(r) for r in _RATIOS])
    sketches = [F.percentile_approx(r, _QUANTILES, SKETCH).alias(r) for r in _RATIOS]
    one = F.lit(1).alias("one")
    own = saved(ratios.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), *sketches), "sketches")
    every = ratios.agg(*sketches).select(one, *[F.col(r).alias(f"all_{r}") for r in _RATIOS])

    half = [_beyond_median(F.col(ratio), sign).alias(name) for name, ratio, sign, _ in _LIMITS]
    votes = own.where(F.col("n") >= MIN_GROUP).select("lang", *half)

    def usual(prefix: str) -> list[Column]:
        return [F.percentile_approx(name, 0.5, SKETCH).alias(f"{prefix}_{name}") for name, *_ in _LIMITS]

    by_lang = votes.groupBy(F.col("lang").alias("__lang")).agg(F.count(F.lit(1)).alias("groups"), *usual("lang"))
    by_lang = by_lang.where(F.col("groups") >= MIN_GROUPS)
    met = (
        own.join(by_lang, F.col("lang").eqNullSafe(F.col("__lang")), "left")
        .withColumn("one", one)
        .join(every, "one")
        .join(votes.agg(*usual("table")).withColumn("one", one), "one")
    )

    def bound(name: str, ratio: str, sign: int, forced: float) -> Column:
        q, a = F.col(ratio), F.col(f"all_{ratio}")
        loosest, tightest = (F.greatest, F.least) if sign > 0 else (F.least, F.greatest)
        norm = F.coalesce(f"lang_{name}", f"table_{name}", _beyond_median(a, sign))
        norm = loosest(norm, F.lit(forced))
        apart = q[0] > norm if sign > 0 else q[4] < norm
        limit = (
            F.when(F.col("n") < MIN_GROUP, tightest(_beyond_quartile(a, sign), norm))
            .when(apart, _beyond_quartile(q, sign))
            .otherwise(tightest(_beyond_quartile(q, sign), norm))
        )
        return loosest(limit, F.lit(forced)).alias(name)

    return met.select("lang", "source", *[bound(*limit) for limit in _LIMITS])


def judge(measured: DataFrame, bounds: DataFrame) -> DataFrame:
    """``measured`` with ``base_failed`` and ``kept``; ``bounds`` are its ``limits``, already written.

    A group of which every row fails a base rule has no limits and keeps nothing.  Null languages
    and sources are groups of their own.
    """
    bounds = bounds.withColumnsRenamed({"lang": "__lang", "source": "__source"})
    met = measured.join(
        bounds, F.col("lang").eqNullSafe(F.col("__lang")) & F.col("source").eqNullSafe(F.col("__source")), "left"
    )
    good = (
        ~base_failed()
        & (_ratio("symbols") <= F.col("most_symbols"))
        & (_ratio("dup_lines") <= F.col("most_dup_lines"))
        & (_ratio("word_length") <= F.col("longest"))
        & (_ratio("word_length") >= F.col("shortest"))
    )
    return met.select(
        *columns_of(measured.columns), base_failed().alias("base_failed"), F.coalesce(good, F.lit(False)).alias("kept")
    )


def quality_rules(docs: DataFrame) -> DataFrame:
    """Measures and verdict of every row: ``doc_id``, the measures, ``base_failed``, ``kept``.

    Empty and null texts fail the base rules; an empty table gives no rows.
    """
    measured = saved(measure(docs, ["doc_id", "lang", "source"]), "measures")
    return judge(measured, saved(limits(measured), "limits")).drop("lang", "source", "n_lines")


def keep_good(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` that pass; columns stay as they are.

    Texts are measured once for the limits and once for the verdict; only the measures are written in between.
    """
    apart, names, back = set_aside(docs, ["text", "lang", "source"])
    measured = saved(measure(docs, ["lang", "source"]), "measures")
    bounds = saved(limits(measured), "limits")
    return judge(measure(apart, [*names, "lang", "source"]), bounds).where("kept").select(*back)
