"""Quality scores by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words.  Every passage is encoded from hashed words
and character shares, gated attention weighs the passages, and the weighted representation is
scored.  Only documents have labels; the attention learns which passages they come from.

The model is fitted on at most ``SAMPLE`` labelled training rows, the first in the order of a hash, with all
their passages, which minibatches read from a file.  Scoring reads every passage of every text.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslens.llm.store import held_out, saved
from opslens.llm.text import Words, chunks, mix

HELD_OUT = 5
THRESHOLD = 0.3
PASSAGE = 64
SAMPLE = 8192
BUCKETS = 96
HIDDEN = 24
GATE = 12
EPOCHS = 16
BATCH = 128
RATE = 0.01
DECAY = 1e-4

# Byte classes: lower-case letter, upper-case letter, digit, sentence mark, symbol, other ASCII, beyond ASCII.
_CLASS = np.full(256, 5, np.int64)
_CLASS[0x61:0x7B], _CLASS[0x41:0x5B], _CLASS[0x30:0x3A], _CLASS[0x80:] = 0, 1, 2, 6
_CLASS[list(b".,;:!?'\"()-")] = 3
_CLASS[list(b"#*$%&|<>{}[]=+/\\_~^@")] = 4
_KINDS = 7
_SHAPES = _KINDS + 5
WIDTH = _SHAPES + BUCKETS


def passages(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage, and the bounds of each document's passages.  No words: one passage of zeros."""
    sizes = words.sizes()
    each = np.maximum(-(-sizes // PASSAGE), 1)
    bounds = np.concatenate([[0], np.cumsum(each)])
    doc = words.of_doc()
    inside = np.arange(len(doc)) - words.bounds[doc]
    at = bounds[doc] + inside // PASSAGE
    total = int(bounds[-1])
    out = np.zeros((total, WIDTH), np.float32)
    if not len(doc):
        return out, bounds
    n = np.bincount(at, minlength=total)
    shares = np.maximum(n, 1)[:, None]

    lengths = words.ends - words.starts
    chars = np.bincount(at, lengths, total)
    spot = np.repeat(words.starts - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
    kinds = np.bincount(np.repeat(at, lengths) * _KINDS + _CLASS[words.data[spot]], minlength=total * _KINDS)
    out[:, :_KINDS] = kinds.reshape(total, _KINDS) / np.maximum(chars, 1)[:, None]

    marked = mix(words.hashes + at.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, first = np.unique(marked, return_index=True)
    distinct = np.bincount(at[first], minlength=total)
    again = np.zeros(len(doc))
    again[1:] = (words.hashes[1:] == words.hashes[:-1]) & (at[1:] == at[:-1])
    shape = out[:, _KINDS:_SHAPES]
    shape[:, 0] = chars / shares[:, 0] / 10
    shape[:, 1] = distinct / shares[:, 0]
    shape[:, 2] = np.bincount(at, again, total) / shares[:, 0]
    shape[:, 3] = np.bincount(at, lengths == 1, total) / shares[:, 0]
    shape[:, 4] = np.minimum(n, PASSAGE) / PASSAGE

    bucket = (words.hashes % np.uint64(BUCKETS)).astype(np.int64)
    hashed = np.bincount(at * BUCKETS + bucket, minlength=total * BUCKETS).reshape(total, BUCKETS)
    out[:, _SHAPES:] = np.sqrt(hashed / shares)
    return out, bounds


class Attention:
    """Gated-attention network over bags of passage features; plain numpy."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, prior: float, seed: int = 11) -> None:
        draw = np.random.default_rng(seed)

        def weights(*shape: int) -> np.ndarray:
            return (draw.normal(size=shape) / np.sqrt(shape[0])).astype(np.float32)

        self.mean, self.scale = mean, scale
        self.p = {
            "encode": weights(len(mean), HIDDEN),
            "shift": np.zeros(HIDDEN, np.float32),
            "tanh": weights(HIDDEN, GATE),
            "gate": weights(HIDDEN, GATE),
            "weigh": weights(GATE),
            "out": weights(HIDDEN),
            "bias": np.array([np.log(prior / (1 - prior))], np.float32),
        }

    def forward(self, x: np.ndarray, bounds: np.ndarray) -> dict[str, np.ndarray]:
        p, first = self.p, bounds[:-1]
        bag = np.repeat(np.arange(len(first)), np.diff(bounds))
        h = np.tanh((x - self.mean) / self.scale @ p["encode"] + p["shift"])
        t, s = np.tanh(h @ p["tanh"]), 1 / (1 + np.exp(-(h @ p["gate"])))
        e = (t * s) @ p["weigh"]
        a = np.exp(e - np.maximum.reduceat(e, first)[bag])
        a /= np.add.reduceat(a, first)[bag]
        z = np.add.reduceat(a[:, None] * h, first)
        score = 1 / (1 + np.exp(-np.clip(z @ p["out"] + p["bias"], -30, 30)))
        return {"bag": bag, "h": h, "t": t, "s": s, "a": a, "z": z, "score": score}

    def scores(self, x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return self.forward(x, bounds)["score"].astype(np.float64)

    def slopes(self, x: np.ndarray, bounds: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Gradient of the mean log loss."""
        p, f = self.p, self.forward(x, bounds)
        h, t, s, a, bag = f["h"], f["t"], f["s"], f["a"], f["bag"]
        wrong = (f["score"] - y) / len(y)
        to_bag = wrong[:, None] * p["out"]
        per = to_bag[bag]
        pull = (per * h).sum(1)
        to_e = a * (pull - np.add.reduceat(a * pull, bounds[:-1])[bag])
        both = to_e[:, None] * p["weigh"]
        to_t, to_s = both * s * (1 - t * t), both * t * s * (1 - s)
        to_h = a[:, None] * per + to_t @ p["tanh"].T + to_s @ p["gate"].T
        before = to_h * (1 - h * h)
        return {
            "encode": ((x - self.mean) / self.scale).T @ before,
            "shift": before.sum(0),
            "tanh": h.T @ to_t,
            "gate": h.T @ to_s,
            "weigh": (t * s).T @ to_e,
            "out": f["z"].T @ wrong,
            "bias": wrong.sum(keepdims=True),
        }


def fit(bags: Sequence[np.ndarray], labels: np.ndarray, seed: int = 5) -> Attention:
    """Adam over minibatches of bags; only those of one minibatch are in memory if ``bags`` lie in a file."""
    n = sum(len(x) for x in bags)
    mean = sum(x.sum(0, dtype=np.float64) for x in bags) / n
    spread = np.sqrt(sum(((x - mean) ** 2).sum(0) for x in bags) / n)
    prior = float(np.clip(labels.mean(), 0.01, 0.99))
    model = Attention(mean.astype(np.float32), (spread + 0.02).astype(np.float32), prior)
    first = {k: np.zeros_like(v) for k, v in model.p.items()}
    second = {k: np.zeros_like(v) for k, v in model.p.items()}
    draw, turn = np.random.default_rng(seed), 0
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS) + RATE / 20
        order = draw.permutation(len(bags))
        for at in range(0, len(order), BATCH):
            chosen = order[at : at + BATCH]
            x = np.concatenate([bags[i] for i in chosen])
            bounds = np.concatenate([[0], np.cumsum([len(bags[i]) for i in chosen])])
            turn += 1
            for k, slope in model.slopes(x, bounds, labels[chosen]).items():
                slope = slope + DECAY * model.p[k]
                first[k] = 0.9 * first[k] + 0.1 * slope
                second[k] = 0.99 * second[k] + 0.01 * slope * slope
                step = first[k] / (1 - 0.9**turn) / (np.sqrt(second[k] / (1 - 0.99**turn)) + 1e-8)
                model.p[k] = (model.p[k] - rate * step).astype(np.float32)
    return model


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for words in chunks(b["text"], lower=False):
            x, bounds = passages(words)
            bags = [x[bounds[i] : bounds[i + 1]].tobytes() for i in range(len(words))]
            label = b["label"].slice(words.first, len(words))
            order = b["spot"].slice(words.first, len(words))
            yield pa.RecordBatch.from_arrays([order, label, pa.array(bags, pa.binary())], names=["spot", "label", "bag"])


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            for words in chunks(b["text"], lower=False):
                x, bounds = passages(words)
                score = model.scores(x, bounds) if model else np.full(len(words), 0.5)
                slim = b.slice(words.first, len(words))
                yield pa.RecordBatch.from_arrays(
                    [slim["doc_id"], slim["held_out"], pa.array(score)], names=["doc_id", "held_out", "score"]
                )

    return run


def train(docs: DataFrame, labels: DataFrame) -> Attention | None:
    """Fit on a bounded sample of labelled rows outside the held-out fold; None without any.

    A document with several labels takes their mean; rows without a label or id don't count.
    """
    known = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id", HELD_OUT))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.avg("quality").alias("label"))
        .select("*", F.xxhash64(F.lit(3), "doc_id").alias("spot"))
        .orderBy("spot", "doc_id")
        .limit(SAMPLE)
    )
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    # At most SAMPLE rows, so it may be broadcast.  Of rows that repeat an id one counts, told by its text.
    met = texts.join(F.broadcast(known), "doc_id").groupBy("doc_id", "spot", "label")
    met = met.agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    sample = met.select("spot", "label", "text").mapInArrow(_encode, "spot long, label double, bag binary")
    rows = []
    with tempfile.TemporaryFile() as file:
        for r in saved(sample, "bags").toLocalIterator():
            rows.append((r["spot"], r["label"], file.tell() // (4 * WIDTH), len(r["bag"]) // (4 * WIDTH)))
            file.write(r["bag"])
        if not rows:
            return None
        file.flush()
        every = np.memmap(file, np.float32, "r").reshape(-1, WIDTH)
        rows.sort()
        bags = [every[at : at + n] for _, _, at, n in rows]
        return fit(bags, np.array([label for _, label, *_ in rows], np.float32))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs`` (doc_id, text).

    Null and empty texts are a bag of one empty passage.  Without labelled training rows all
    scores are 0.5.  An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    picked = docs.select(
        F.col("doc_id").cast("long"), F.col("text").cast("string"), held_out("doc_id", HELD_OUT).alias("held_out")
    )
    scored = picked.mapInArrow(_score(shared), "doc_id long, held_out boolean, score double")
    return scored.select("*", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
