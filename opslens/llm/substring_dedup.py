"""Repeated passages by FM-indexes over shards that are cut by content.

A window is ``LENGTH`` consecutive words.  Each window belongs to its anchor: the eight-word run in it with
the smallest hash.  Equal windows have equal anchors, so texts can be indexed anchor by anchor:

1. Every document lists its anchors.  Neighbouring windows share one, so a document of
   n words lists about n / 14.  Each comes with the hash of its segment, the words of its windows.
2. Anchors that occur once in the corpus cannot hold a repeated window and drop out.
3. Equal segments collapse to one with a count.  One copy of each is fetched from the texts and sent to the
   shard of its anchor, which builds an FM-index of its segments (wavelet matrix over packed
   bits), weighted by the counts, and streams the segments against it: backward search finds which of their
   windows weigh two or more.
4. The windows found go back to every occurrence of the segment, and from there to the documents.

An anchor with more than ``HOT_SEGMENTS`` different segments would not fit one shard.  Its windows
are counted by digest instead, over all tasks.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslens.llm.fm_index import FMIndex, repeated_windows
from opslens.llm.store import batch, saved
from opslens.llm.text import Words, chunks, grams, mix

LENGTH = 35
ANCHOR = 8
SEGMENTS_PER_SHARD = 8_000
HOT_SEGMENTS = 8_000

_SPAN = LENGTH - ANCHOR + 1
_PLACE_BITS = 24
_ANCHORS = pa.schema(
    [
        ("k1", pa.int64()),
        ("k2", pa.int32()),
        ("anchors", pa.list_(pa.int64())),
        ("digests", pa.list_(pa.int64())),
        ("firsts", pa.list_(pa.int32())),
        ("counts", pa.list_(pa.int32())),
    ]
)
_ANCHORS_DDL = "k1 long, k2 int, anchors array<long>, digests array<long>, firsts array<int>, counts array<int>"


def anchored(words: Words) -> tuple[np.ndarray, ...]:
    """Document, anchor hash, segment digest, first window and number of windows of every segment."""
    runs = grams(words.hashes, ANCHOR)
    if len(runs) < _SPAN:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int32, np.int32))
    mask = np.uint64((1 << _PLACE_BITS) - 1)
    low = (runs & ~mask) | (np.arange(len(runs), dtype=np.uint64) & mask)
    width = 1
    while 2 * width <= _SPAN:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[: len(low) - _SPAN + width], low[_SPAN - width :])
    doc = words.of_doc()
    start = np.flatnonzero(doc[: len(low)] == doc[LENGTH - 1 : LENGTH - 1 + len(low)])
    low = low[start]
    place = start + (((low & mask).astype(np.int64) - start) & int(mask))
    new = np.ones(len(start), bool)
    new[1:] = (place[1:] != place[:-1]) | (doc[start[1:]] != doc[start[:-1]])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(start)))
    begin, anchor, owner = start[first], place[first], doc[start[first]]
    end = begin + count + LENGTH - 1
    digest = _spans(words.hashes, begin, end, anchor - begin)
    return owner, runs[anchor].view(np.int64), digest, (begin - words.bounds[owner]).astype(np.int32), count.astype(np.int32)


def _spans(hashes: np.ndarray, begin: np.ndarray, end: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """Hash of the words from ``begin`` to ``end``, and of ``salt``."""
    radix = 0xD1342543DE82EF95
    steps = np.full(len(hashes) + 1, radix, np.uint64)
    steps[0] = 1
    power = np.multiply.accumulate(steps)
    steps[1:] = pow(radix, -1, 1 << 64)
    back = np.multiply.accumulate(steps)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * power[:-1])])
    h = (sums[end] - sums[begin]) * back[begin]
    return mix(h + (end - begin).astype(np.uint64) * np.uint64(64) + salt.astype(np.uint64)).view(np.int64)


def _list_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for words in chunks(b["text"], lower=False):
            owner, *lists = anchored(words)
            bounds = pa.array(np.searchsorted(owner, np.arange(len(words) + 1)), pa.int32())
            columns = [
                pa.ListArray.from_arrays(bounds, pa.array(values)) for values in lists
            ]
            slim = b.slice(words.first, len(words))
            yield pa.RecordBatch.from_arrays([slim["k1"], slim["k2"], *columns], schema=_ANCHORS)


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows with 96 bits that stand for the text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    second = F.shiftright(F.xxhash64(F.lit(1), text), 32).cast("int")
    return docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.xxhash64(text).alias("k1"), second.alias("k2"))


def occurrences(docs: DataFrame) -> DataFrame:
    """``k1, k2, anchor, digest, first, count`` of every segment of the keyed ``docs``."""
    lists = docs.select("k1", "k2", "text").mapInArrow(_list_anchors, _ANCHORS_DDL)
    zipped = lists.where(F.size("anchors") > 0).select(
        "k1", "k2", F.explode(F.arrays_zip("anchors", "digests", "firsts", "counts")).alias("s")
    )
    return zipped.select(
        "k1",
        "k2",
        F.col("s.anchors").alias("anchor"),
        F.col("s.digests").alias("digest"),
        F.col("s.firsts").alias("first"),
        F.col("s.counts").alias("count"),
    )


_CONTENT_DDL = "anchor long, digest long, n long, body binary"


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of the segments that each document stands for."""
    unpack = zstandard.ZstdDecompressor()
    schema = pa.schema([("anchor", pa.int64()), ("digest", pa.int64()), ("n", pa.int64()), ("body", pa.binary())])
    for b in batches:
        rows = []
        for body, wanted in zip(b["body"].to_pylist(), b["wanted"].to_pylist(), strict=True):
            words = unpack.decompress(body).split()
            for s in wanted:
                part = words[s["first"] : s["first"] + s["count"] + LENGTH - 1]
                rows.append((s["anchor"], s["digest"], s["n"], b" ".join(part)))
        if rows:
            yield batch(dict(zip(schema.names, zip(*rows, strict=True), strict=True)), schema)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as packed bytes: what is shuffled is small."""
    packer = zstandard.ZstdCompressor(level=3)
    for b in batches:
        bodies = pa.array([packer.compress(t) for t in b["text"].cast(pa.binary()).to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([*[b[c] for c in b.schema.names if c != "text"], bodies], names=[*[c for c in b.schema.names if c != "text"], "body"])


def _masks(anchor: np.ndarray, digest: np.ndarray, starts: list[np.ndarray]) -> pd.DataFrame:
    masks = [int(np.bitwise_or.reduce(np.int64(1) << s)) if len(s) else 0 for s in starts]
    found = pd.DataFrame({"anchor": anchor, "digest": digest, "mask": np.array(masks, np.int64)})
    return found[found["mask"] != 0]


def search_shard(segments: pd.DataFrame) -> pd.DataFrame:
    """``anchor, digest, mask``: bit j of ``mask`` is set when the segment's window j occurs twice or more."""
    found = list(chunks(pa.array(segments["body"], pa.binary()), lower=False))
    distinct, symbols = np.unique(np.concatenate([words.hashes for words in found]), return_inverse=True)
    texts = np.split(symbols + 1, np.cumsum(np.concatenate([words.sizes() for words in found]))[:-1])
    weights = segments["n"].to_numpy(np.int64)
    index = FMIndex(texts, weights, len(distinct) + 1, LENGTH)
    # A segment that occurs twice as a whole needs no search.
    whole = weights >= 2
    alone = np.flatnonzero(~whole)
    starts = [np.arange(len(t) - LENGTH + 1) for t in texts]
    if len(alone):
        for i, found in zip(alone, repeated_windows(index, [texts[i] for i in alone], LENGTH, 2), strict=True):
            starts[i] = found
    return _masks(segments["anchor"].to_numpy(), segments["digest"].to_numpy(), starts)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of the single windows of segments."""
    for b in batches:
        for i, body in enumerate(b["body"].to_pylist()):
            words = body.split()
            digests = [
                hashlib.blake2b(b" ".join(words[j : j + LENGTH]), digest_size=16).digest()
                for j in range(len(words) - LENGTH + 1)
            ]
            n = len(digests)
            yield pa.RecordBatch.from_pydict(
                {
                    "anchor": pa.array([b["anchor"][i].as_py()] * n, pa.int64()),
                    "digest": pa.array([b["digest"][i].as_py()] * n, pa.int64()),
                    "n": pa.array([b["n"][i].as_py()] * n, pa.int64()),
                    "window": pa.array(digests, pa.binary()),
                    "j": pa.array(range(n), pa.int32()),
                }
            )


def _count_windows(content: DataFrame) -> DataFrame:
    """``anchor, digest, mask`` of segments of hot anchors."""
    windows = content.mapInArrow(_windows, "anchor long, digest long, n long, window binary, j int")
    often = windows.groupBy("window").agg(F.sum("n").alias("n")).where("n > 1").select("window")
    bit = F.expr("shiftleft(1L, j)")
    return windows.join(often, "window", "left_semi").groupBy("anchor", "digest").agg(F.bit_or(bit).alias("mask"))


def repeated_segments(docs: DataFrame, places: DataFrame, hot_segments: int = HOT_SEGMENTS) -> DataFrame:
    """``anchor, digest, mask`` of all segments with a repeated window.

    ``docs`` are keyed; ``places`` are the (written) occurrences of anchors that occur twice or more.
    """
    first = F.min(F.struct("k1", "k2", "first", "count"))
    segments = saved(
        places.groupBy("anchor", "digest").agg(F.count(F.lit(1)).alias("n"), first.alias("at")), "segments"
    )
    total = segments.count()
    hot = (
        segments.groupBy("anchor").agg(F.count(F.lit(1)).alias("different")).where(F.col("different") > hot_segments)
    )
    hot = saved(hot.select("anchor"), "hot")
    wanted = segments.groupBy("at.k1", "at.k2").agg(
        F.collect_list(
            F.struct("anchor", "digest", "n", F.col("at.first").alias("first"), F.col("at.count").alias("count"))
        ).alias("wanted")
    )
    packed = docs.select("k1", "k2", "text").mapInArrow(_pack, "k1 long, k2 int, body binary")
    # Copies of a text collapse in each task before they are moved.
    bodies = packed.groupBy("k1", "k2").agg(F.min("body").alias("body"))
    content = bodies.join(wanted, ["k1", "k2"]).select("body", "wanted").mapInArrow(_fetch, _CONTENT_DDL)
    shards = max(1, -(-total // SEGMENTS_PER_SHARD))
    if hot.isEmpty():
        return _search(content, shards)
    content = saved(content, "content")
    return _search(content.join(hot, "anchor", "left_anti"), shards).unionByName(
        _count_windows(content.join(hot, "anchor", "left_semi"))
    )


def _search(content: DataFrame, shards: int) -> DataFrame:
    shard = F.pmod(F.xxhash64("anchor"), F.lit(shards)).alias("shard")
    return (
        content.select("*", shard).groupBy("shard").applyInPandas(
            lambda group: search_shard(group), "anchor long, digest long, mask long"
        )
    )


_RESULT = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_words", pa.int64()),
        ("n_removed", pa.int64()),
        ("kept_sha256", pa.string()),
        ("kept", pa.string()),
    ]
)


def covered_words(sizes: np.ndarray, marks: pa.ListArray) -> np.ndarray:
    """Words that lie in a marked window, over texts of ``sizes`` words one after the other."""
    base = np.cumsum(sizes) - sizes
    owner = np.repeat(base, marks.value_lengths().fill_null(0).to_numpy())
    flat = marks.flatten()
    first, mask = flat.field("first").to_numpy(), flat.field("mask").to_numpy()
    mark, window = np.nonzero((mask[:, None] >> np.arange(_SPAN)) & 1)
    starts = owner[mark] + first[mark] + window
    total = int(sizes.sum())
    edges = np.bincount(starts, minlength=total + 1) - np.bincount(starts + LENGTH, minlength=total + 1)
    return np.cumsum(edges[:total]) > 0


def _strip(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            split = [unpack.decompress(body.as_py()).split() for body in b["body"]]
            sizes = np.fromiter(map(len, split), np.int64, len(split))
            gone = covered_words(sizes, b["marks"])
            rows, end = [], 0
            for doc_id, words in zip(b["doc_id"].to_pylist(), split, strict=True):
                own = gone[end : end + len(words)]
                end += len(words)
                removed = int(own.sum())
                kept = b" ".join(itertools.compress(words, (~own).tolist()) if removed else words)
                text = kept.decode() if with_text else None
                rows.append((doc_id, len(words), removed, hashlib.sha256(kept).hexdigest(), text))
            if rows:
                yield batch(dict(zip(_RESULT.names, zip(*rows, strict=True), strict=True)), _RESULT)

    return run


def remove_repeats(docs: DataFrame, with_text: bool = True, hot_segments: int = HOT_SEGMENTS) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256, kept`` of every row of ``docs`` (doc_id, text).

    ``kept`` holds the words outside repeated windows, joined by one space (null unless ``with_text``).
    Null text has no words; texts shorter than a window keep all of theirs; rows that repeat a text lose it
    all once it has ``LENGTH`` words.  An empty table gives no rows.
    """
    keyed = _keyed(docs)
    every = saved(occurrences(keyed), "occurrences")
    # Written first: a join of two shuffles can split a hot anchor, one below an aggregate cannot.
    often = saved(every.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor"), "often")
    places = saved(every.join(often, "anchor", "left_semi"), "places")
    masks = saved(repeated_segments(keyed, places, hot_segments), "masks")
    marks = (
        places.join(masks, ["anchor", "digest"])
        .select("k1", "k2", F.struct("first", "mask").alias("mark"))
        .distinct()
        .groupBy("k1", "k2")
        .agg(F.collect_list("mark").alias("marks"))
    )
    packed = keyed.mapInArrow(_pack, "doc_id long, k1 long, k2 int, body binary")
    met = packed.join(marks, ["k1", "k2"], "left").select("doc_id", "body", "marks")
    return met.mapInArrow(_strip(with_text), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
