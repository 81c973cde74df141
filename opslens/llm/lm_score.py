"""Language-model scores from a hashed maximum-entropy model with a class-factored softmax.

P(word | history) = P(class | history) * P(word | class).  The most frequent words are classes of their
own; the others share classes by their last two bytes, and the most frequent endings have a class each.
P(class | history) is a softmax over hashed features of the history: the word before (n-gram),
the word two before (skip), and the class pairs one-two and three-four before.  P(word | class) comes from
counts, with one unseen word per class, so the probabilities sum to one.

1. Words of all training rows are counted (a shuffle by hash; 64 bits stand for a word).
2. Rounds of distributed gradient updates: each round has its own share of the training rows.  Every task starts from
   the model of the round, takes minibatch steps over its rows, and returns its changes with the
   number of times that each feature occurred; changes are averaged by it, block by block.
3. Scoring looks counts of up to ``KNOWN`` frequent words up in a table of bounded size; the other words join
   the counts of the whole corpus.

The model has a fixed size; counts grow with the corpus and never pass through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslens.llm.store import held_out, row_ids, saved
from opslens.llm.text import Words, chunks, mix

HELD_OUT = 10
SMOOTH = 0.1
OWN_CLASS = 24
ENDINGS = 28
CLASSES = 64
WORD_ROWS = 6144
ROUNDS = 3
BATCH = 4096
STEP = 0.3
#: Words whose counts every task holds.
KNOWN = 1 << 18

_END = np.uint64(0xE9D0_0000_0000_0001)
_START = np.uint64(0x57A2_7000_0000_0001)
_BACK = 4  # words of history
_NO_CLASS = CLASSES
_PAIR_ROWS = (CLASSES + 1) ** 2
_ROWS = 2 * WORD_ROWS + 2 * _PAIR_ROWS
#: First row of each kind of features.
_KINDS = [0, WORD_ROWS, 2 * WORD_ROWS, 2 * WORD_ROWS + _PAIR_ROWS]
_BLOCK = 512
_COUNT_BUFFER = 400_000
#: Logits within it need no shift: 64 exponentials of them sum to a finite 32-bit number above zero.
_SAFE = 80.0
_STEPS = 48
_PART = 1024
_ROW = np.dtype((np.void, 4 * CLASSES))
#: Sums of exponentials within it lost nothing that counts; others are taken again from shifted logits.
_LEAST, _MOST = 1e-25, 1e35


@dataclass
class Tokens:
    """Words of some documents, each followed by the end token; histories are padded at the front."""

    hashes: np.ndarray  # with _BACK start marks before each document
    endings: np.ndarray
    at: np.ndarray  # places of the tokens in ``hashes``
    bounds: np.ndarray  # tokens of document i


def tokens(words: Words) -> Tokens:
    sizes = words.sizes()
    n = len(words)
    whole = sizes + _BACK + 1
    starts = np.cumsum(whole) - whole
    hashes = np.full(int(whole.sum()), _START, np.uint64)
    endings = np.zeros(len(hashes), np.int64)
    spot = np.arange(len(words.hashes)) + np.repeat((np.arange(n) + 1) * _BACK + np.arange(n), sizes)
    hashes[spot] = words.hashes
    last = words.data[words.ends - 1].astype(np.int64) if len(words.ends) else np.zeros(0, np.int64)
    before = words.data[np.maximum(words.ends - 2, 0)].astype(np.int64) if len(words.ends) else last
    endings[spot] = last + 256 * np.where(words.ends - words.starts > 1, before, 0)
    hashes[starts + whole - 1] = _END
    real = np.ones(len(hashes), bool)
    for k in range(_BACK):
        real[starts + k] = False
    return Tokens(hashes, endings, np.flatnonzero(real), np.concatenate([[0], np.cumsum(sizes + 1)]))


def _distinct(h: np.ndarray, endings: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes in order, an ending and the count of each; a hash table needs fewer steps than a sort of all."""
    coded = pa.array(h).dictionary_encode()
    at, found = coded.indices.to_numpy(), coded.dictionary.to_numpy()
    place = np.empty(len(found), np.int64)
    place[at] = np.arange(len(at))
    order = np.argsort(found)
    return found[order], endings[place[order]], np.bincount(at, minlength=len(found))[order]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts; a task holds ``_COUNT_BUFFER`` distinct words or so."""
    held: list[tuple[np.ndarray, ...]] = []

    def merged() -> tuple[np.ndarray, ...]:
        h, e, c = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(h, kind="stable")
        h, e, c = h[order], e[order], c[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        return h[first], e[first], np.add.reduceat(c, first)

    def out() -> pa.RecordBatch:
        h, e, c = held[0]
        return pa.RecordBatch.from_pydict({"h": h.view(np.int64), "ending": e.astype(np.int32), "c": c})

    size = 0
    for b in batches:
        for words in chunks(b["text"], lower=True):
            t = tokens(words)
            held.append(_distinct(t.hashes[t.at], t.endings[t.at]))
            size += len(held[-1][0])
            if size > 2 * _COUNT_BUFFER:
                held = [merged()]
                size = len(held[0][0])
                if size > _COUNT_BUFFER:
                    yield out()
                    held, size = [], 0
    if held:
        held = [merged()]
        yield out()


def word_counts(training: DataFrame) -> DataFrame:
    """``h, ending, c`` of every distinct token of ``training`` (text)."""
    parts = training.select("text").mapInArrow(_counts, "h long, ending int, c long")
    return saved(parts.groupBy("h").agg(F.min("ending").alias("ending"), F.sum("c").alias("c")), "counts")


def _frequent(counts: DataFrame) -> DataFrame:
    """``h, ending, c`` of at most ``KNOWN`` words, all that occur at least as often as the rarest of them.

    The bound comes from a histogram of counts on a logarithmic scale, a few hundred rows.
    """
    level = F.floor(F.log2("c") * 8)
    sizes = counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("least"))
    bound, total = None, 0
    for row in sorted(sizes.collect(), key=lambda r: -r["level"]):
        total += row["n"]
        if total > KNOWN:
            break
        bound = row["least"]
    frequent = counts.select("h", "ending", "c")
    return frequent.where(F.col("c") >= bound) if bound is not None else frequent.limit(0)


@dataclass
class Model:
    own: np.ndarray  # sorted hashes of the words with a class of their own
    own_class: np.ndarray
    ending_class: np.ndarray  # class of each two-byte ending
    prior: np.ndarray  # log share of each class
    inside: np.ndarray  # what to add to log10(c + SMOOTH) for log10 P(word | class)
    weights: np.ndarray

    def classes(self, hashes: np.ndarray, endings: np.ndarray) -> np.ndarray:
        found = self.ending_class[endings]
        if len(self.own):
            at = np.minimum(np.searchsorted(self.own, hashes), len(self.own) - 1)
            found = np.where(self.own[at] == hashes, self.own_class[at], found)
        return np.where(hashes == _START, _NO_CLASS, found)

    def features(self, t: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """Class of each token, and the rows of its history's features."""
        kind = self.classes(t.hashes, t.endings)
        at = t.at
        rows = np.empty((4, len(at)), np.int64)
        word = (mix(t.hashes) >> np.uint64(20)).astype(np.int64) % WORD_ROWS
        rows[0] = word[at - 1]
        rows[1] = WORD_ROWS + word[at - 2]
        rows[2] = 2 * WORD_ROWS + kind[at - 1] * (CLASSES + 1) + kind[at - 2]
        rows[3] = 2 * WORD_ROWS + _PAIR_ROWS + kind[at - 3] * (CLASSES + 1) + kind[at - 4]
        return kind[at], rows

    def logits(self, rows: np.ndarray) -> np.ndarray:
        """Logits of each token, up to a constant of its own; their exponentials and the sums of them are finite."""
        out = self.weights.take(rows[0], axis=0)
        more = np.empty_like(out)
        for r in rows[1:]:
            # Rows are in range; other modes of take go through one more copy.
            out += self.weights.take(r, axis=0, out=more, mode="clip")
        out += self.prior
        # A maximum per token costs as much as two features; two over all tokens tell whether it is needed.
        if not -_SAFE < out.min(initial=0) <= out.max(initial=0) < _SAFE:
            out -= out.max(axis=1, keepdims=True)
        return out

    def shares(self, rows: np.ndarray, out: np.ndarray, more: np.ndarray) -> None:
        """P(class | history) of each token into ``out``; ``more`` is working space of its size."""
        self.weights.take(rows[0], axis=0, out=out, mode="clip")
        for r in rows[1:]:
            # Rows are in range; other modes of take go through one more copy.
            out += self.weights.take(r, axis=0, out=more, mode="clip")
        out += self.prior
        with np.errstate(over="ignore"):
            np.exp(out, out=out)
            total = np.einsum("ij->i", out)
        if not _LEAST < total.min(initial=1) <= total.max(initial=1) < _MOST:
            np.exp(self.logits(rows), out=out)
            total = np.einsum("ij->i", out)
        out *= (1 / total)[:, None]


class Scorer:
    """log10 P(class | history) of tokens.  Weights stay as they are, so each has its exponential taken once."""

    def __init__(self, model: Model):
        self.model = model
        # Every token has one feature of each kind: the prior joins the first, and a constant a row changes no share.
        self.weights = model.weights.copy()
        self.weights[: _KINDS[1]] += model.prior
        self.weights -= (self.weights.max(axis=1, keepdims=True) + self.weights.min(axis=1, keepdims=True)) / 2
        # Then products of exponentials, in any order, are finite and above zero.
        self.plain = np.maximum.reduceat(np.abs(self.weights).max(axis=1), _KINDS).sum() < _SAFE
        self.factors = np.exp(self.weights) if self.plain else None

    def gains(self, rows: np.ndarray, kind: np.ndarray) -> np.ndarray:
        gain = np.empty(len(kind))
        left, right = (np.empty((min(BATCH, len(kind)), CLASSES), np.float32) for _ in range(2))
        flat = self.weights.ravel()
        for at in range(0, len(kind), BATCH):
            r, y = rows[:, at : at + BATCH], kind[at : at + BATCH]
            if self.plain:
                a, b = left[: len(y)], right[: len(y)]
                self.factors.take(r[0], axis=0, out=a, mode="clip")
                for other in r[1:-1]:
                    a *= self.factors.take(other, axis=0, out=b, mode="clip")
                total = np.einsum("ij,ij->i", a, self.factors.take(r[-1], axis=0, out=b, mode="clip"))
                chosen = sum(flat.take(other * CLASSES + y) for other in r)
            else:
                logits = self.model.logits(r)
                chosen = logits[np.arange(len(y)), y]
                total = np.einsum("ij->i", np.exp(logits, out=logits))
            gain[at : at + BATCH] = (chosen - np.log(total)) / np.log(10)
        return gain


class Known:
    """Sorted hashes, and where those with the same leading bits begin; hashes spread evenly over these."""

    def __init__(self, hashes: np.ndarray):
        bits = max(1, len(hashes).bit_length() - 1)
        self.hashes, self.shift = hashes, np.uint64(64 - bits)
        lead = (hashes >> self.shift).astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(lead, minlength=1 << bits))]).astype(np.int32)

    def places(self, wanted: np.ndarray) -> np.ndarray:
        """Place of each hash in ``hashes``, or -1."""
        place = np.full(len(wanted), -1, np.int64)
        if not len(self.hashes):
            return place
        lead = (wanted >> self.shift).astype(np.int64)
        at, stop = self.starts.take(lead), self.starts.take(lead + 1)
        open_ = np.flatnonzero(at < stop)
        at, stop, wanted = at.take(open_), stop.take(open_), wanted.take(open_)
        while len(open_):
            hit = self.hashes.take(at) == wanted
            place[open_[hit]] = at[hit]
            on = np.flatnonzero(~hit & (at + 1 < stop))
            open_, at, stop, wanted = open_.take(on), at.take(on) + 1, stop.take(on), wanted.take(on)
        return place


def first_model(counts: DataFrame) -> tuple[Model, int, int, tuple[np.ndarray, np.ndarray]]:
    """A model without weights; tokens and distinct tokens in training; hashes and counts of frequent words.

    Collected are three sums of fixed size: the frequent words, 65,536 endings, and the totals.
    """
    total = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    n, v = int(total["n"] or 0), int(total["v"])
    top = _frequent(counts).toPandas().sort_values(["c", "h"], ascending=[False, True], ignore_index=True)
    sums = counts.groupBy("ending").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).toPandas()
    mass, distinct = np.zeros(1 << 16), np.zeros(1 << 16)
    mass[sums["ending"]], distinct[sums["ending"]] = sums["c"], sums["v"]
    hashes = top["h"].to_numpy(np.int64).view(np.uint64)
    own = hashes[:OWN_CLASS]
    np.subtract.at(mass, top["ending"][:OWN_CLASS].to_numpy(), top["c"][:OWN_CLASS].to_numpy(float))
    np.subtract.at(distinct, top["ending"][:OWN_CLASS].to_numpy(), 1)
    # Frequent endings have a class each; the others are dealt to the classes that remain.
    rest = CLASSES - OWN_CLASS - ENDINGS
    spread = (mix(np.arange(1 << 16, dtype=np.uint64)) % np.uint64(rest)).astype(np.int64)
    ending_class = OWN_CLASS + ENDINGS + spread
    ending_class[np.argsort(-mass, kind="stable")[:ENDINGS]] = OWN_CLASS + np.arange(ENDINGS)
    size = np.full(CLASSES, SMOOTH)
    np.add.at(size, ending_class, mass + SMOOTH * distinct)
    size[:OWN_CLASS] = SMOOTH
    size[: len(own)] = top["c"][:OWN_CLASS].to_numpy(float) + SMOOTH
    order = np.argsort(own)
    model = Model(
        own[order],
        order.astype(np.int64),
        ending_class,
        np.log(size / size.sum()).astype(np.float32),
        -np.log10(size),
        np.zeros((_ROWS, CLASSES), np.float32),
    )
    order = np.argsort(hashes)
    return model, n, v, (hashes[order], top["c"].to_numpy(np.int64)[order])


def _sums(p: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct feature rows, how often each occurs, and the sum of ``p`` (one row a token) over its tokens.

    Features are put in order of falling count, so those with a k-th occurrence lead: all k-th occurrences are
    added in one step.  Few features occur more than ``_STEPS`` times; the rest of these is added up one by one.
    """
    keys = rows.ravel().astype(np.min_scalar_type(_ROWS))  # short keys are sorted by radix
    order = np.argsort(keys, kind="stable")
    placed = keys.take(order)
    token = np.tile(np.arange(len(p)), len(rows)).take(order)
    first = np.flatnonzero(np.concatenate([[True], placed[1:] != placed[:-1]]))
    times = np.diff(first, append=len(keys))
    by = np.argsort((len(keys) - times).astype(np.min_scalar_type(len(keys))), kind="stable")
    first, times = first.take(by), times.take(by)
    total = p.take(token.take(first), axis=0)
    reach = np.searchsorted(-times, -np.arange(1, _STEPS + 1)).tolist()  # features with more than k occurrences
    for k, n in enumerate(reach[:-1], 1):
        if not n:
            break
        total[:n] += p.take(token.take(first[:n] + k), axis=0)
    for i in range(reach[-1]):
        total[i] += p.take(token[first[i] + _STEPS : first[i] + times[i]], axis=0).sum(axis=0)
    return placed.take(first).astype(np.int64), times, total


def descend(model: Model, kind: np.ndarray, rows: np.ndarray, seen: np.ndarray) -> None:
    """Minibatch steps over the tokens; steps of a feature shrink as it is seen more often."""
    room, more = (np.empty((min(BATCH, len(kind)), CLASSES), np.float32) for _ in range(2))
    part = np.empty((_PART, CLASSES), np.float32)
    # One item a row: numpy sets items at given places twice as fast as rows of numbers.
    whole = model.weights.view(_ROW).ravel()
    for at in range(0, len(kind), BATCH):
        r, y = rows[:, at : at + BATCH], kind[at : at + BATCH]
        p = room[: len(y)]
        model.shares(r, p, more[: len(y)])
        p.reshape(-1)[np.arange(len(y)) * CLASSES + y] -= 1
        # Kinds of features have rows of their own, so one grouping serves all of them.
        touched, times, slope = _sums(p, r)
        seen[touched] += times
        step = (STEP / np.sqrt(seen[touched]))[:, None]
        for a in range(0, len(touched), _PART):  # parts that stay in a core's cache
            t, change = touched[a : a + _PART], slope[a : a + _PART]
            change *= step[a : a + _PART]
            moved = np.subtract(model.weights.take(t, axis=0, out=part[: len(t)], mode="clip"), change, out=change)
            whole[t] = moved.view(_ROW).ravel()


def _round(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start: Model = shared.value
        model = Model(**{**start.__dict__, "weights": start.weights.copy()})
        seen = np.zeros(_ROWS, np.float32)
        for b in batches:
            for words in chunks(b["text"], lower=True):
                descend(model, *model.features(tokens(words)), seen)
        if not seen.any():
            return
        task = TaskContext.get().partitionId()
        moved = ((model.weights - start.weights) * seen[:, None]).astype(np.float32)
        for block in range(0, _ROWS, _BLOCK):
            yield pa.RecordBatch.from_pydict(
                {
                    "block": pa.array([block // _BLOCK], pa.int32()),
                    "task": pa.array([task], pa.int32()),
                    "seen": [seen[block : block + _BLOCK].tobytes()],
                    "moved": [moved[block : block + _BLOCK].tobytes()],
                }
            )

    return run


_SUMS_DDL = "block int, task int, seen binary, moved binary"


def _add_up(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("task")
    sums = {}
    for c in ("seen", "moved"):
        total = np.frombuffer(group[c].iloc[0], np.float32).copy()
        for other in group[c].iloc[1:]:
            total += np.frombuffer(other, np.float32)
        sums[c] = total.tobytes()
    return pd.DataFrame({"block": group["block"].iloc[:1], "task": group["task"].iloc[:1], **{c: [s] for c, s in sums.items()}})


def train(model: Model, training: DataFrame, rounds: int = ROUNDS) -> Model:
    """Rounds of averaged gradient steps; ``training`` has text and ``share``, the round of each row."""
    context = training.sparkSession.sparkContext
    for turn in range(rounds):
        shared = context.broadcast(model)
        changes = training.where(F.col("share") == turn).select("text").mapInArrow(_round(shared), _SUMS_DDL)
        # Added up in two steps, so that no task holds the changes of all tasks.
        some = changes.groupBy("block", F.pmod("task", F.lit(64)).alias("part")).applyInPandas(_add_up, _SUMS_DDL)
        sums = saved(some.groupBy("block").applyInPandas(_add_up, _SUMS_DDL), "round")
        weights = model.weights.copy()
        for row in sums.toLocalIterator():  # as many rows as the model has blocks
            seen = np.frombuffer(row["seen"], np.float32)
            moved = np.frombuffer(row["moved"], np.float32).reshape(-1, CLASSES)
            at = row["block"] * _BLOCK
            weights[at : at + _BLOCK] += moved / np.maximum(seen, 1)[:, None]
        model = Model(**{**model.__dict__, "weights": weights})
    return model


_SCORED = pa.schema(
    [
        ("rid", pa.int64()),
        ("doc_id", pa.int64()),
        ("held_out", pa.bool_()),
        ("n_tokens", pa.int64()),
        ("n_found", pa.int64()),
        ("found_log", pa.float64()),
        ("model_log", pa.float64()),
        ("rare", pa.list_(pa.int64())),
    ]
)
_SCORED_DDL = (
    "rid long, doc_id long, held_out boolean, n_tokens long, n_found long, found_log double, model_log double, "
    "rare array<long>"
)


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, hashes, counts = shared.value
        scorer, frequent = Scorer(model), Known(hashes)
        logs = np.append(np.log10(counts + SMOOTH), 0.0)  # the last for place -1
        ids = row_ids()
        for b in batches:
            for words in chunks(b["text"], lower=True):
                t = tokens(words)
                kind, rows = model.features(t)
                gain = scorer.gains(rows, kind) + model.inside[kind]
                own = t.hashes[t.at]
                place = frequent.places(own)
                found, log = place >= 0, logs.take(place)
                first = t.bounds[:-1]
                slim = b.slice(words.first, len(words))
                lost = np.concatenate([[0], np.cumsum(~found)])[t.bounds]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([next(ids) for _ in first], pa.int64()),
                        slim["doc_id"],
                        slim["held_out"],
                        pa.array(np.diff(t.bounds)),
                        pa.array(np.add.reduceat(found.astype(np.int64), first)),
                        pa.array(np.add.reduceat(log, first)),
                        pa.array(np.add.reduceat(gain, first)),
                        pa.ListArray.from_arrays(pa.array(lost, pa.int32()), pa.array(own[~found].view(np.int64))),
                    ],
                    schema=_SCORED,
                )

    return run


def lm_scores(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row of ``docs``.

    Null text is empty: one end token.  Rows that repeat an id are scored apart; rows without an id train.
    Without training rows every score is that of the unseen word.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    out = held_out("doc_id", HELD_OUT)
    share = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(rounds))
    picked = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), out.alias("held_out"), share.alias("share"))
    training = picked.where(~F.col("held_out"))
    counts = word_counts(training)
    model, n, v, (hashes, known) = first_model(counts)
    model = train(model, training, rounds)
    shared = spark.sparkContext.broadcast((model, hashes, known))
    scored = saved(picked.select("doc_id", "held_out", "text").mapInArrow(_score(shared), _SCORED_DDL), "scored")
    rare = scored.select("rid", F.explode("rare").alias("h")).groupBy("rid", "h").agg(F.count(F.lit(1)).alias("k"))
    met = rare.join(counts.select("h", "c"), "h", "left")
    log = F.col("k") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(SMOOTH))
    looked_up = met.groupBy("rid").agg(
        F.sum(log).alias("rare_log"), F.sum(F.when(F.col("c") > 0, F.col("k")).otherwise(0)).alias("rare_found")
    )
    whole = F.col("found_log") + F.coalesce("rare_log", F.lit(0.0))
    unit = float(np.log10(n + SMOOTH * (v + 1)))
    return (
        scored.drop("rare")
        .join(looked_up, "rid", "left")
        .select(
            "doc_id",
            "held_out",
            "n_tokens",
            (F.col("n_found") + F.coalesce("rare_found", F.lit(0))).cast("long").alias("n_known"),
            F.lit(n).cast("long").alias("train_tokens"),
            (whole - F.col("n_tokens") * F.lit(unit)).alias("base_score"),
            (whole + F.col("model_log")).alias("score"),
        )
    )
