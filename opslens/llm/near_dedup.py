"""Near-duplicates by b-bit MinHash.

1. Every text becomes a set of word shingles, MinHash band keys, and a packed signature that keeps
   ``BITS`` low bits of each minimum.  Texts with equal sets form a class; one member stands for it.
2. Class members meet in band buckets.  Instead of all pairs, each bucket compares its
   head with its members, and the links are closed to components.  Of a bucket that then still holds several
   components, only members outside its largest one are compared with the others, in blocks,
   with longer signatures.  So every two members of a bucket were compared or are connected: no
   link that joins components is lost, and the work of a bucket of true copies stays near its size.
3. Candidates are screened by the signatures: equal low bits are counted with bit operations and
   corrected for chance.  What remains is confirmed on the full shingle sets of both texts.

With ``BANDS`` bands of ``ROWS`` minima a pair at similarity 0.8 is missed with odds of
(1 - 0.8**ROWS)**BANDS, below one in a million; the screens cut five deviations below it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslens.llm.store import batch, raw_hash, row_ids, rows_kept, saved
from opslens.llm.text import Words, chunks, grams, mix

WIDTH = 5
PERCENT = 80
BANDS = 36
ROWS = 5
BITS = 4
#: Deviations below the threshold at which the signature screen cuts.
SLACK = 5.0
#: How many times longer the signatures of the second comparison are, how much of them is looked at first,
#: and the sizes of its blocks.
SHARPER = 16
GLANCE = 4
LEADS = 128
OTHERS = 512

_MINIMA = BANDS * ROWS
_DRAW = np.random.default_rng(7919)
_FLIP = _DRAW.integers(1, 1 << 63, SHARPER * _MINIMA, dtype=np.uint64)
_TIMES = _DRAW.integers(1, 1 << 63, SHARPER * _MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

_ROWS = pa.schema(
    [
        ("rid", pa.int64()),
        ("doc_id", pa.int64()),
        ("raw", pa.int64()),
        ("n_shingles", pa.int64()),
        ("digest", pa.binary()),
        ("bands", pa.list_(pa.int64())),
        ("signature", pa.binary()),
        ("body", pa.binary()),
    ]
)
_ROWS_DDL = (
    "rid long, doc_id long, raw long, n_shingles long, digest binary, bands array<long>, signature binary, body binary"
)


def shingle_sets(words: Words, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each document; fewer words than ``width`` make one shingle."""
    every, bounds = grams(words.hashes, width), words.bounds.tolist()
    sets = []
    for first, end in zip(bounds[:-1], bounds[1:], strict=True):
        n = end - first
        if n >= width:
            s = np.sort(every[first : end - width + 1])
            fresh = np.empty(len(s), bool)
            fresh[0], fresh[1:] = True, s[1:] != s[:-1]
            sets.append(s[fresh])
        elif n:
            sets.append(mix(grams(words.hashes[first:end], n) + np.uint64(n)))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def minima(sets: list[np.ndarray], n: int = _MINIMA) -> np.ndarray:
    """MinHash minima, one row per hash function and one column per (nonempty) set."""
    values = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((n, len(sets)), np.uint64)
    scratch = np.empty_like(values)
    for k in range(n):
        np.bitwise_xor(values, _FLIP[k], out=scratch)
        np.multiply(scratch, _TIMES[k], out=scratch)
        np.minimum.reduceat(scratch, starts, out=out[k])
    return out


def band_keys(lows: np.ndarray) -> np.ndarray:
    keys = np.empty((BANDS, lows.shape[1]), np.uint64)
    for band in range(BANDS):
        h = np.full(lows.shape[1], band + 1, np.uint64)
        for row in range(band * ROWS, (band + 1) * ROWS):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + lows[row])
        keys[band] = h
    return keys.view(np.int64)


def pack(lows: np.ndarray) -> np.ndarray:
    """Low BITS bits of the minima, two to a byte; one row per set."""
    low = (lows & np.uint64((1 << BITS) - 1)).astype(np.uint8)
    return np.ascontiguousarray((low[0::2] | (low[1::2] << BITS)).T)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity of packed signatures, row by row, corrected for chance collisions of low bits."""
    differ = a ^ b
    differ |= differ >> 2
    differ |= differ >> 1
    unequal = np.bitwise_count(differ & np.uint8(0x11)).sum(axis=1)
    chance = 1 / (1 << BITS)
    return (1 - unequal / (2 * differ.shape[1]) - chance) / (1 - chance)


def cut(percent: int = PERCENT, n: int = _MINIMA) -> float:
    chance = 1 / (1 << BITS)
    p = percent / 100 * (1 - chance) + chance
    return (p - SLACK * (p * (1 - p) / n) ** 0.5 - chance) / (1 - chance)


def _rows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, packer = row_ids(), zstandard.ZstdCompressor(level=1)
        for b in batches:
            for words in chunks(b["text"], lower=True):
                sets = shingle_sets(words, width)
                full = [i for i, s in enumerate(sets) if len(s)]
                bands: list = [None] * len(sets)
                signatures: list = [None] * len(sets)
                digests: list = [None] * len(sets)
                if full:
                    lows = minima([sets[i] for i in full])
                    keys, packed = band_keys(lows), pack(lows)
                    for j, i in enumerate(full):
                        bands[i], signatures[i] = keys[:, j], packed[j].tobytes()
                        digests[i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest()
                at = words.offsets.tolist()
                whole = words.data.tobytes()
                slim = b.slice(words.first, len(words))
                yield batch(
                    {
                        "rid": [next(ids) for _ in sets],
                        "doc_id": slim["doc_id"],
                        "raw": slim["raw"],
                        "n_shingles": [len(s) for s in sets],
                        "digest": digests,
                        "bands": bands,
                        "signature": signatures,
                        "body": [packer.compress(whole[x:y]) for x, y in zip(at[:-1], at[1:], strict=True)],
                    },
                    _ROWS,
                )

    return run


def _screen(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    least = cut(percent)
    for b in batches:
        if b.num_rows:
            sides = [np.frombuffer(b"".join(b[c].to_pylist()), np.uint8).reshape(b.num_rows, -1) for c in ("sa", "sb")]
            yield b.select(["a", "b"]).filter(pa.array(estimate(*sides) >= least))


def _confirm(batches: Iterator[pa.RecordBatch], percent: int, width: int) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor()
    for b in batches:
        at: dict[int, int] = {}
        texts: list[bytes] = []
        for ids, bodies in ((b["a"], b["ta"]), (b["b"], b["tb"])):
            for i, body in zip(ids.to_pylist(), bodies, strict=True):
                if i not in at:
                    at[i] = len(texts)
                    texts.append(unpack.decompress(body.as_py()))
        sets = [s for words in chunks(pa.array(texts, pa.binary()), lower=False) for s in shingle_sets(words, width)]
        keep = []
        for x, y in zip(b["a"].to_pylist(), b["b"].to_pylist(), strict=True):
            s, t = sets[at[x]], sets[at[y]]
            both = np.sort(np.concatenate([s, t]))
            shared = int((both[1:] == both[:-1]).sum())
            keep.append(100 * shared >= percent * (len(both) - shared))
        yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int, width: int, screened: bool = False) -> DataFrame:
    """Those pairs ``a, b`` of row ids whose sets are similar enough."""

    def side(column: str, what: str, name: str) -> DataFrame:
        # Texts are never broadcast, however few there are.
        return texts.select(F.col("rid").alias(column), F.col(what).alias(name)).hint("merge")

    if not screened:
        signed = pairs.join(side("b", "signature", "sb"), "b").join(side("a", "signature", "sa"), "a")
        pairs = signed.mapInArrow(lambda bs: _screen(bs, percent), "a long, b long")
    full = pairs.join(side("b", "body", "tb"), "b").join(side("a", "body", "ta"), "a")
    return full.mapInArrow(lambda bs: _confirm(bs, percent, width), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """``node, label`` with the smallest node of each component; every node of ``links`` (a, b) once.

    Labels spread to neighbours and jump to their own label's label, so the
    rounds grow with the logarithm of the longest path.
    """
    both = saved(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    labels = saved(
        both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels"
    )
    while True:
        near = (
            both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        )
        spread = labels.join(near.withColumnRenamed("a", "node"), "node").select(
            "node", F.col("label").alias("old"), F.least("label", "near").alias("label")
        )
        target = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        moved = saved(
            spread.join(target, "label").select("node", "old", F.least("label", "next").alias("label")), "labels"
        )
        labels = moved.select("node", "label")
        if moved.where("label <> old").isEmpty():
            return labels


_SHARP = pa.schema([("rid", pa.int64()), ("sharp", pa.binary()), ("bands", pa.binary())])


def _sharpen(width: int):
    """Long signatures and band keys of the texts that are compared a second time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            texts = pa.array([unpack.decompress(x.as_py()) for x in b["body"]], pa.binary())
            for words in chunks(texts, lower=False):
                lows = minima(shingle_sets(words, width), SHARPER * _MINIMA)
                rid = b["rid"].slice(words.first, len(words))
                packed = [p.tobytes() for p in pack(lows)]
                keys = [k.tobytes() for k in np.ascontiguousarray(band_keys(lows[:_MINIMA]).T)]
                yield batch({"rid": rid, "sharp": packed, "bands": keys}, _SHARP)

    return run


def _stacked(column: pa.Array, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def compare_blocks(
    key: int, leads: dict[str, np.ndarray], others: dict[str, np.ndarray], least: dict[int, float]
) -> tuple[np.ndarray, np.ndarray]:
    """Likely links between leads and others of other components.

    A pair counts only in the first bucket that both share, and once when both are leads.  ``least`` holds
    the smallest estimates by the number of signature bytes looked at, few bytes first.
    """
    found = []
    for i, rid in enumerate(leads["rid"].tolist()):
        fits = (others["part"] != leads["part"][i]) & ~(others["waiting"] & (others["rid"] < rid))
        at = np.flatnonzero(fits)
        for width, bound in least.items():
            at = at[estimate(others["sharp"][at, :width], leads["sharp"][i, :width]) >= bound]
        same = others["bands"][at] == leads["bands"][i]
        own = np.flatnonzero(leads["bands"][i] == key)[:1]
        at = at[same.argmax(axis=1) == own] if len(own) else at[:0]
        found += [(rid, other) for other in others["rid"][at].tolist()]
    pairs = np.array(found, np.int64).reshape(-1, 2)
    return pairs.min(axis=1, initial=np.iinfo(np.int64).max), pairs.max(axis=1, initial=-1)


def _compare(percent: int):
    def side(blocks: pa.ListArray, row: int) -> dict[str, np.ndarray]:
        block = blocks[row].values
        return {
            "rid": block.field("rid").to_numpy(),
            "part": block.field("part").to_numpy(),
            "waiting": block.field("waiting").to_numpy(zero_copy_only=False),
            "sharp": _stacked(block.field("sharp"), np.uint8),
            "bands": _stacked(block.field("bands"), np.int64),
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = {n * _MINIMA // 2: cut(percent, n * _MINIMA) for n in (GLANCE, SHARPER)}
        for b in batches:
            for row, key in enumerate(b["key"].to_pylist()):
                a, z = compare_blocks(key, side(b["leads"], row), side(b["others"], row), least)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(z)], names=["a", "b"])

    return run


def links_between(members: DataFrame, rows: DataFrame, percent: int, width: int) -> DataFrame:
    """Confirmed links ``a, b`` that connect all similar ``members`` (rid, bands).

    ``rows`` hold their rid, signature and body, and may hold more.
    """
    spread = members.select("rid", F.explode("bands").alias("key"))
    heads = spread.groupBy("key").agg(F.min("rid").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1")
    buckets = saved(spread.join(saved(heads.drop("n"), "heads"), "key"), "buckets")
    inside = buckets.select("rid").distinct()
    texts = saved(rows.select("rid", "signature", "body").hint("merge").join(inside, "rid"), "texts")
    pairs = buckets.where("rid <> head").select(F.col("head").alias("a"), F.col("rid").alias("b")).distinct()
    first = saved(confirmed(pairs, texts, percent, width), "confirmed")

    # Buckets that hold several components now.
    labels = components(first)
    placed = saved(
        buckets.join(labels.withColumnRenamed("node", "rid"), "rid", "left").select(
            "key", "rid", F.coalesce("label", "rid").alias("part")
        ),
        "placed",
    )
    largest = (
        placed.groupBy("key", "part")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("key")
        .agg(
            F.max(F.struct("n", "part"))["part"].alias("largest"),
            F.sum("n").alias("members"),
            (F.sum("n") - F.max("n")).alias("waiting_members"),
        )
        .where("waiting_members > 0 AND members > 2")  # of two members the head was compared already
    )
    open_ones = saved(
        placed.join(saved(largest, "largest"), "key").select(
            "*", (F.col("part") != F.col("largest")).alias("waiting")
        ),
        "open",
    )
    if open_ones.isEmpty():
        return first
    again = texts.select("rid", "body").hint("merge").join(open_ones.select("rid").distinct(), "rid")
    sharp = saved(again.mapInArrow(_sharpen(width), "rid long, sharp binary, bands binary"), "sharp")
    entries = open_ones.join(sharp, "rid")
    entry = F.struct("rid", "part", "waiting", "sharp", "bands")

    def blocks(some: DataFrame, total: str, size: int, name: str) -> DataFrame:
        block = F.pmod(F.xxhash64("rid"), F.ceil(F.col(total) / size))
        return some.groupBy("key", block.alias(f"{name}_block")).agg(F.collect_list(entry).alias(name))

    leads = blocks(entries.where("waiting"), "waiting_members", LEADS, "leads")
    others = blocks(entries, "members", OTHERS, "others")
    likely = leads.join(others, "key").select("key", "leads", "others").mapInArrow(_compare(percent), "a long, b long")
    second = saved(confirmed(likely.distinct(), texts, percent, width, screened=True), "confirmed")
    return first.unionByName(second)


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """``rid, doc_id, raw, n_shingles, component_id, kept`` of every row of ``docs`` (doc_id, text).

    A-Z are lower-cased.  ``component_id`` is the smallest doc_id reachable over links; the row that
    carries it stays.  Null ids rank last, and of rows that share the smallest id one
    stays.  Texts without words are linked with nothing and stay.  An empty table gives no rows.
    """
    picked = docs.select(F.col("doc_id").cast("long"), "text", raw_hash().alias("raw"))
    rows = saved(picked.mapInArrow(_rows(width), _ROWS_DDL), "shingles")
    slim = rows.select("rid", "doc_id", "raw", "n_shingles", "digest")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")
    classes = saved(
        slim.where("n_shingles > 0")
        .groupBy("digest")
        .agg(F.min("rid").alias("member"), F.min(rank).alias("first")),
        "classes",
    )
    stand_ins = rows.select("rid", "bands").hint("merge").join(classes.select(F.col("member").alias("rid")), "rid")
    links = links_between(saved(stand_ins, "members"), rows, percent, width)
    labels = components(links)
    parts = classes.join(labels.withColumnRenamed("node", "member"), "member", "left").select(
        "digest", F.coalesce("label", "member").alias("part"), "first"
    )
    firsts = parts.groupBy("part").agg(F.min("first").alias("first"))
    verdicts = saved(parts.drop("first").join(firsts, "part").select("digest", "first"), "verdicts")
    met = slim.join(verdicts, "digest", "left")
    first = F.coalesce("first", rank)
    return met.select(
        "rid",
        "doc_id",
        "raw",
        "n_shingles",
        first["doc_id"].alias("component_id"),
        (first["rid"] == F.col("rid")).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row of each component of ``docs``; columns stay as they are."""
    return rows_kept(docs, near_duplicates(docs))
