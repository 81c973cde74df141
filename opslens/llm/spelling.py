"""Spelling variants: words one edit apart, found on bit-sliced position indexes.

A vocabulary shard is held as bitsets, one for each (position, letter): bit k says that word k has that
letter there.  For a query word, three sets of words are carried along its letters, 64 words to an
operation: those equal so far, those with one letter replaced so far (same positions), and those with
one letter more so far (positions shifted by one).  A word with one letter less is met when the shorter
one asks.  Each pair counts at the first position where its words differ, so it is found exactly once.

Shards.  Words one edit apart agree before and behind the edit.  A bucket (m, start, stop, rest) holds
the words of m or m + 1 letters that agree in the letters before ``start`` and in the last m - ``stop``;
it looks for first differences in start .. stop.  The buckets of a word cover its positions in two
halves.  A bucket that is too large is halved again, over as many rounds as it takes: when one position
is left, the alphabet bounds it to ``LETTERS`` + ``LETTERS`` ** 2 words.  Buckets of one shape are hashed into
shards of about ``SHARD`` words.

A run beyond ``LONG`` bytes takes a plainer way to its hash, with the same result.

Null texts have no words; a null doc_id counts as empty text in the hash; rows that repeat an id count
once each; further columns are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslens.llm.store import batch, saved
from opslens.llm.text import mix

#: Text bytes handled at once.
CHUNK = 1 << 22
LONG = 64
#: a-z and U+00C0 .. U+00FF; A-Z is lower-cased before.
LETTERS = 90
_NONE = LETTERS
#: Words of a shard, and of a bucket before it is halved; of words over 16 letters accordingly less.
SHARD = 4096
BUCKET = 8192
#: Queries handled at once.
QUERIES = 1024

SHAPE = ["m", "start", "stop"]

_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_LEAD = 0xC3  # first byte of U+00C0 .. U+00FF in UTF-8
_RADIX = np.uint64(0x9E3779B97F4A7C15)


def _crc_table() -> np.ndarray:
    steps = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        steps = np.where(steps & 1, (steps >> 1) ^ np.uint32(0xEDB88320), steps >> 1)
    return steps


_CRC = _crc_table()

COUNTED = pa.schema([("word", pa.string()), ("n", pa.int64())])
NEAR = pa.schema([("word", pa.string()), ("near", pa.int64()), ("best", pa.string()), ("best_n", pa.int64())])


def spelling_variants(docs: DataFrame, least_letters: int = 5, least_n: int = 3) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every word of the vocabulary of ``docs``."""
    words = vocabulary(docs, least_letters, least_n)
    near = saved(near_words(words), "near")
    known = words.join(near, "word", "left").select(
        "word",
        "n",
        F.coalesce("near", F.lit(0)).cast("long").alias("n_near"),
        F.when(F.col("best_n") >= 2 * F.col("n"), F.col("best")).alias("form"),
        F.when(F.col("best_n") >= 2 * F.col("n"), F.col("best_n")).alias("form_n"),
    )
    known = saved(known, "forms")
    ends = last_forms(known.where("form is not null").select("word", "form"))
    return known.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def vocabulary(docs: DataFrame, least_letters: int = 5, least_n: int = 3) -> DataFrame:
    """``word, n``: words of at least so many letters and occurrences, after the planted slips."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            yield from _counted(rows, least_letters)

    texts = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    found = texts.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return saved(found.where(F.col("n") >= least_n), "vocabulary")


def _counted(rows: pa.RecordBatch, least: int) -> Iterator[pa.RecordBatch]:
    column = rows.column("text").cast(pa.large_binary()).fill_null(b"")
    heads = [zlib.crc32(f"{i or ''}:".encode()) for i in rows.column("doc_id").to_pylist()]
    heads = np.array(heads, np.uint32)
    _, at, raw = column.buffers()
    at = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        stop = int(np.searchsorted(at, at[row] + CHUNK, "right")) - 1
        stop = min(max(stop, row + 1), len(column))
        yield from _of_chunk(data[at[row] : at[stop]], at[row : stop + 1] - at[row], heads[row:stop], least)
        row = stop


def _of_chunk(data: np.ndarray, offsets: np.ndarray, heads: np.ndarray, least: int) -> Iterator[pa.RecordBatch]:
    lead = data == _LEAD
    letter = _LETTER[data] | lead
    letter[1:] |= lead[:-1]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = letter[:-1], letter[1:]
    starts = np.flatnonzero(letter & (~before | edge[:-1]))
    ends = np.flatnonzero(letter & (~after | edge[1:])) + 1
    leads = np.zeros(len(data) + 1, np.int32)
    np.cumsum(lead, out=leads[1:])
    letters = ends - starts - (leads[ends] - leads[starts])
    enough = letters >= least  # a slip only shortens
    starts, ends, letters = starts[enough], ends[enough], letters[enough]
    docs = np.searchsorted(offsets, starts, "right") - 1
    lower = _LOWER[data]

    sizes = ends - starts
    order = np.argsort(-sizes, kind="stable")
    order = order[np.searchsorted(-sizes[order], -LONG) :]
    hashes, crcs = _hashed(lower, starts[order], sizes[order], heads[docs[order]])
    slips = crcs % 97 == 0
    odd: Counter[bytes] = Counter()
    for i, h in zip(order[slips].tolist(), crcs[slips].tolist(), strict=True):
        odd[_slipped(lower[starts[i] : ends[i]].tobytes(), h)] += 1
    for i in np.flatnonzero(sizes > LONG).tolist():
        run = lower[starts[i] : ends[i]].tobytes()
        h = zlib.crc32(run, int(heads[docs[i]]))
        odd[_slipped(run, h) if h % 97 == 0 else run] += 1
    plain = order[~slips]
    _, first, times = np.unique(hashes[~slips], return_index=True, return_counts=True)
    yield batch({"word": _strings(lower, starts[plain[first]], sizes[plain[first]]), "n": times}, COUNTED)
    kept = [(w.decode(), n) for w, n in odd.items() if len(w.decode()) >= least]
    if kept:
        yield batch({"word": [w for w, _ in kept], "n": [n for _, n in kept]}, COUNTED)


def _hashed(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, heads: np.ndarray):
    """64-bit hashes of runs, and their CRC-32 behind that of their heads; longest runs first."""
    hashes = np.zeros(len(starts), np.uint64)
    crcs = ~heads
    for j in range(int(sizes[0]) if len(sizes) else 0):
        n = int(np.searchsorted(-sizes, -j))  # runs longer than j
        byte = data[starts[:n] + j]
        crcs[:n] = _CRC[(crcs[:n] ^ byte) & np.uint32(0xFF)] ^ (crcs[:n] >> np.uint32(8))
        hashes[:n] = hashes[:n] * _RADIX + byte
    return mix(hashes), ~crcs


def _slipped(run: bytes, h: int) -> bytes:
    """The run without the code point that the hash points at."""
    text = run.decode()
    at = h % len(text)
    return (text[:at] + text[at + 1 :]).encode()


def _strings(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    places = np.repeat(starts - offsets[:-1], sizes) + np.arange(offsets[-1])
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data[places]))


def near_words(words: DataFrame, bucket: int = BUCKET, shard: int = SHARD) -> DataFrame:
    """``word, near, best, best_n`` for each word with a near one: how many, and the most frequent."""

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (m, start, stop), rows in _shards(batches):
            yield from _searched(m, start, stop, rows["word"], np.array(rows["n"]))

    members = saved(bucketed(words, bucket), "buckets")
    shapes = members.groupBy(*SHAPE).agg(F.count(F.lit(1)).alias("rows"))
    per = F.ceil(F.col("rows") * F.greatest(F.col("m") / 16, F.lit(1)) / shard).cast("long")
    placed = members.join(shapes.select(*SHAPE, per.alias("shards")), SHAPE).withColumn(
        "shard", F.pmod(F.xxhash64("rest"), "shards")
    )
    where = [*SHAPE, "shard"]
    dealt = placed.select(*where, "word", "n").repartition(*where).sortWithinPartitions(*where)
    found = dealt.mapInArrow(find, "word string, near long, best string, best_n long")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), "best"))
    found = found.groupBy("word").agg(F.sum("near").alias("near"), best.alias("b"))
    return found.select("word", "near", F.col("b.best").alias("best"), (-F.col("b.n")).alias("best_n"))


def bucketed(words: DataFrame, limit: int = BUCKET) -> DataFrame:
    """Each word once in every bucket that can show one of its near words."""
    size = F.length("word")
    classes = words.select("*", F.explode(F.array(size, size - 1)).alias("m"))
    middle = F.floor(F.col("m") / 2).cast("int")
    members = _in_buckets(classes.select("*", F.lit(0).alias("start"), middle.alias("middle"), F.col("m").alias("stop")))
    done = None
    while True:
        members = saved(members, "buckets")
        counts = members.groupBy(*SHAPE, "rest").agg(F.count(F.lit(1)).alias("__words"))
        long = F.greatest(F.col("m") / 16, F.lit(1))
        counts = counts.where((F.col("__words") * long > limit) & (F.col("stop") - F.col("start") > 1))
        large = saved(counts.drop("__words"), "large")
        if large.isEmpty():
            return members if done is None else done.unionByName(members)
        small = members.join(large, [*SHAPE, "rest"], "left_anti")
        done = small if done is None else done.unionByName(small)
        middle = F.floor((F.col("start") + F.col("stop")) / 2).cast("int")
        members = _in_buckets(members.join(large, [*SHAPE, "rest"]).withColumn("middle", middle))


def _in_buckets(rows: DataFrame) -> DataFrame:
    halves = F.array(
        F.struct(F.col("start").alias("a"), F.col("middle").alias("b")),
        F.struct(F.col("middle").alias("a"), F.col("stop").alias("b")),
    )
    parts = rows.where("m > 0").select("word", "n", "m", F.explode(halves).alias("part")).select(
        "word", "n", "m", F.col("part.a").alias("start"), F.col("part.b").alias("stop")
    )
    behind = F.col("m") - F.col("stop")
    tail = F.when(behind > 0, F.expr("right(word, m - stop)")).otherwise("")
    return parts.select("*", F.concat_ws("|", F.expr("left(word, start)"), tail).alias("rest"))


def _shards(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int, int], dict[str, list]]]:
    """Whole shards of sorted batches."""

    def rows():
        for b in batches:
            columns = [b.column(c).to_pylist() for c in ("m", "start", "stop", "shard", "word", "n")]
            yield from zip(*columns, strict=True)

    for key, group in itertools.groupby(rows(), lambda r: r[:4]):
        words, counts = zip(*((r[4], r[5]) for r in group), strict=True)
        yield key[:3], {"word": list(words), "n": list(counts)}


def _searched(m: int, start: int, stop: int, words: list[str], counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    pairs = list(one_edit_pairs(words, m, start, stop))
    one = np.concatenate([p[0] for p in pairs]) if pairs else np.zeros(0, np.int64)
    other = np.concatenate([p[1] for p in pairs]) if pairs else np.zeros(0, np.int64)
    if not len(one):
        return
    order = sorted(range(len(words)), key=lambda k: (-counts[k], words[k]))
    rank = np.empty(len(words), np.int64)
    rank[order] = np.arange(len(words))
    best = np.full(len(words), len(words))
    np.minimum.at(best, one, rank[other])
    near = np.bincount(one, minlength=len(words))
    has = np.flatnonzero(near)
    top = [order[r] for r in best[has]]
    yield batch(
        {
            "word": [words[k] for k in has],
            "near": near[has],
            "best": [words[k] for k in top],
            "best_n": counts[top],
        },
        NEAR,
    )


def _packed(bits: np.ndarray) -> np.ndarray:
    """Rows of booleans as 64-bit words; bit k of a row is its element k."""
    padded = np.zeros((len(bits), -(-bits.shape[1] // 64) * 64), bool)
    padded[:, : bits.shape[1]] = bits
    return np.packbits(padded, axis=1, bitorder="little").view(np.uint64)


def one_edit_pairs(words: list[str], m: int, start: int, stop: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (k, l) of words one edit apart, both ways round.

    Words have m or m + 1 letters, one of each pair has m, and they first differ in start .. stop.
    """
    sizes = np.array([len(w) for w in words])
    letters = np.zeros((len(words), m + 2), np.uint32)
    letters[:, : m + 1] = np.array(words, f"<U{m + 1}").view(np.uint32).reshape(len(words), m + 1)
    codes = np.where(letters == 0, _NONE, np.where(letters < 0x80, letters - 0x61, letters - 0xC0 + 26)).astype(np.uint8)
    short, more = _packed(np.array([sizes == m, sizes == m + 1]))
    asking = np.flatnonzero(sizes == m)
    for block in range(0, len(asking), QUERIES):
        query = asking[block : block + QUERIES]
        equal = np.broadcast_to(short | more, (len(query), len(short)))
        replaced = np.zeros(equal.shape, np.uint64)
        shifted = np.zeros(equal.shape, np.uint64)
        here = _at(codes, 0)
        for i in range(m):
            following = _at(codes, i + 1)
            letter = codes[query, i]
            same = here[letter]
            if i >= start:
                ahead = following[letter]
                replaced &= same
                shifted &= ahead
                if i < stop:
                    differs = equal & ~same
                    replaced |= differs & short
                    shifted |= differs & more & ahead
            equal = equal & same
            here = following
        if stop == m:
            shifted |= equal & more
        for hits, long in ((replaced, False), (shifted, True)):
            row, word = np.nonzero(hits)
            bits = np.unpackbits(hits[row, word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            pair, bit = np.nonzero(bits)
            one, other = query[row[pair]], word[pair] * 64 + bit
            yield one, other
            if long:  # the longer one does not ask
                yield other, one


def _at(codes: np.ndarray, position: int) -> np.ndarray:
    """The index at a position: a bitset over the words for each letter."""
    index = np.zeros((LETTERS + 1, -(-len(codes) // 64)), np.uint64)
    column = codes[:, position]
    used = np.flatnonzero(np.bincount(column, minlength=LETTERS + 1))
    index[used] = _packed(column[None, :] == used[:, None].astype(np.uint8))
    return index


def last_forms(forms: DataFrame) -> DataFrame:
    """``word, root``: the end of each chain of ``forms``, by pointer doubling.

    Along a chain the number of occurrences at least doubles, so a chain has no more steps than that number
    has bits, and there are about six rounds.
    """
    paths = saved(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = paths.select(F.col("word").alias("root"), F.col("root").alias("further"))
        joined = saved(paths.join(step, "root", "left"), "roots")
        paths = joined.select("word", F.coalesce("further", "root").alias("root"))
        if joined.where("further is not null").isEmpty():
            return paths
