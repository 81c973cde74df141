"""Exact duplicates: binary-fuse filters over an immutable snapshot screen the incoming rows.

Texts are equal when identical after lower-casing A-Z; null counts as empty.  A table of
digests is written once.  Its rows form a snapshot and an incoming batch:

1. The snapshot's distinct digests are dealt to buckets; each bucket builds one static filter.
2. Distinct incoming digests meet the filter of their bucket.  Most new ones end here.
3. Positives join the exact digests of the snapshot; duplicates inside a batch are grouped apart.
4. Every group with more than one row is checked byte by byte: partial aggregation keeps one text
   per task and group, so that a group with a third of all rows moves few texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslens.llm.store import ROWS_PER_TASK, batch, raw_hash, row_ids, rows_kept, saved

_DIGESTS = pa.schema(
    [
        ("rid", pa.int64()),
        ("doc_id", pa.int64()),
        ("raw", pa.int64()),
        ("incoming", pa.bool_()),
        ("digest", pa.binary()),
    ]
)
_DIGESTS_DDL = "rid long, doc_id long, raw long, incoming boolean, digest binary"


class BinaryFuse:
    """Static 3-wise binary-fuse filter with 16-bit fingerprints over distinct 64-bit keys."""

    def __init__(self, keys: np.ndarray) -> None:
        n = len(keys)
        segment = 1 << max(2, int(np.floor(np.log(max(n, 1)) / np.log(3.33) + 2.25)))
        ratio = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2)))
        self.segment = min(segment, 1 << 18)
        self.starts = max(1, -(-int(n * ratio) // self.segment) - 2)
        for seed in range(1, 200):
            self.seed = seed
            if (order := self._peel(keys)) is not None:
                break
        else:
            raise ValueError("keys are not distinct")
        self.slots = np.zeros((self.starts + 2) * self.segment, np.uint16)
        places, prints = self._places(keys)
        for which, at in reversed(order):
            others = self.slots[places[which]]
            value = prints[which] ^ others[:, 0] ^ others[:, 1] ^ others[:, 2]
            self.slots[at] = value ^ self.slots[at]

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = keys * np.uint64(0x9E3779B97F4A7C15) + np.uint64(self.seed * 0x632BE59BD9B4E019 % (1 << 64))
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        base = ((h >> np.uint64(40)) * np.uint64(self.starts)) >> np.uint64(24)
        mask = np.uint64(self.segment - 1)
        spread = (h * np.uint64(0xD1342543DE82EF95)) >> np.uint64(10)
        inner = np.stack([spread & mask, (spread >> np.uint64(18)) & mask, (spread >> np.uint64(36)) & mask], 1)
        places = (base[:, None] + np.arange(3, dtype=np.uint64)) * np.uint64(self.segment) + inner
        return places.astype(np.int64), (h & np.uint64(0xFFFF)).astype(np.uint16)

    def _peel(self, keys: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]] | None:
        """Rounds of (key numbers, slots): every slot held one key left when its round began."""
        places, _ = self._places(keys)
        size = (self.starts + 2) * self.segment
        counts = np.bincount(places.ravel(), minlength=size)
        number = np.arange(len(keys))
        owner = np.zeros(size, np.int64)
        for i in range(3):
            np.bitwise_xor.at(owner, places[:, i], number)
        order, left = [], len(keys)
        ready = np.flatnonzero(counts == 1)
        while len(ready):
            which, first = np.unique(owner[ready], return_index=True)
            order.append((which, ready[first]))
            left -= len(which)
            touched = places[which]
            np.subtract.at(counts, touched.ravel(), 1)
            for i in range(3):
                np.bitwise_xor.at(owner, touched[:, i], which)
            near = np.unique(touched)
            ready = near[counts[near] == 1]
        return order if left == 0 else None

    def __contains__(self, key: int) -> bool:
        return bool(self.has(np.array([key], np.uint64))[0])

    def has(self, keys: np.ndarray) -> np.ndarray:
        places, prints = self._places(keys)
        found = self.slots[places]
        return (found[:, 0] ^ found[:, 1] ^ found[:, 2]) == prints


def _digest_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids = row_ids()
    for b in batches:
        digests = [hashlib.sha256(t).digest() for t in _normalised(b)]
        rids = [next(ids) for _ in digests]
        yield batch({c: b[c] for c in ("doc_id", "raw", "incoming")} | {"rid": rids, "digest": digests}, _DIGESTS)


def _normalised(b: pa.RecordBatch) -> Iterator[bytes]:
    return (t.lower() if t else b"" for t in b["text"].cast(pa.binary()).to_pylist())


def _bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest and packed normalised text of every row."""
    packer = zstandard.ZstdCompressor(level=1)
    for b in batches:
        rows = [(hashlib.sha256(t).digest(), packer.compress(t)) for t in _normalised(b)]
        digest, body = zip(*rows, strict=True) if rows else ((), ())
        yield pa.RecordBatch.from_pydict({"digest": pa.array(digest, pa.binary()), "body": pa.array(body, pa.binary())})


def _keys(digests: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(d[:8] for d in digests), np.uint64)


def _build(group: pd.DataFrame) -> pd.DataFrame:
    made = BinaryFuse(np.unique(_keys(group["digest"])))
    return pd.DataFrame(
        {
            "bucket": [int(group["bucket"].iloc[0])],
            "seed": [made.seed],
            "segment": [made.segment],
            "starts": [made.starts],
            "slots": [made.slots.tobytes()],
        }
    )


def _screen(arrivals: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    if arrivals.empty or filters.empty:
        return arrivals[["digest"]].iloc[:0]
    known = BinaryFuse.__new__(BinaryFuse)
    row = filters.iloc[0]
    known.seed, known.segment, known.starts = int(row["seed"]), int(row["segment"]), int(row["starts"])
    known.slots = np.frombuffer(row["slots"], np.uint16)
    return arrivals[["digest"]][known.has(_keys(arrivals["digest"]))]


def digest_table(docs: DataFrame, incoming: Column) -> DataFrame:
    """Every row's id, hash of the raw text, and digest of the normalised text."""
    arrived = F.coalesce(incoming, F.lit(False)).alias("incoming")
    picked = docs.select(F.col("doc_id").cast("long"), "text", raw_hash().alias("raw"), arrived)
    return saved(picked.mapInArrow(_digest_rows, _DIGESTS_DDL), "digests")


def screen(snapshot: DataFrame, arrivals: DataFrame, buckets: int) -> DataFrame:
    """Digests of ``arrivals`` that the filters of the snapshot let through.  Both hold distinct ``digest``."""
    bucket = F.pmod(F.xxhash64("digest"), F.lit(buckets)).cast("int").alias("bucket")
    filters = (
        snapshot.select("digest", bucket)
        .groupBy("bucket")
        .applyInPandas(_build, "bucket int, seed int, segment int, starts int, slots binary")
    )
    return (
        arrivals.select("digest", bucket)
        .groupBy("bucket")
        .cogroup(filters.groupBy("bucket"))
        .applyInPandas(_screen, "digest binary")
    )


def _groups(rows: DataFrame) -> DataFrame:
    return rows.groupBy("digest").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.struct("doc_id", "rid")).alias("last")
    )


def exact_duplicates(docs: DataFrame, incoming: Column | None = None) -> DataFrame:
    """``rid, doc_id, raw, keep_id, group_size, kept, digest`` of every row of ``docs`` (doc_id, text).

    ``incoming`` marks the new batch (default: by a hash of the id, about half); the rest is the
    snapshot.  The result does not depend on it.  Of equal texts the row with the largest doc_id
    stays; null ids come last, and of rows that also share the id exactly one stays.  An empty
    table gives no rows.
    """
    if incoming is None:
        incoming = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 1
    rows = digest_table(docs, incoming)
    known = saved(_groups(rows.where(~F.col("incoming"))), "snapshot")
    new = saved(_groups(rows.where("incoming")), "arrivals")
    buckets = max(1, -(-known.count() // ROWS_PER_TASK), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    positives = screen(known.select("digest"), new.select("digest"), buckets)
    both = known.join(positives, "digest", "left_semi").select("digest")
    suspects = (
        both.union(known.where("n > 1").select("digest")).union(new.where("n > 1").select("digest")).distinct()
    )
    groups = saved(
        known.unionByName(new)
        .join(suspects, "digest", "left_semi")
        .groupBy("digest")
        .agg(F.sum("n").alias("n"), F.max("last").alias("last")),
        "groups",
    )
    _check_bytes(docs, groups)
    joined = rows.join(groups, "digest", "left")
    last = F.coalesce("last", F.struct("doc_id", "rid"))
    return joined.select(
        "rid",
        "doc_id",
        "raw",
        last["doc_id"].alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (last["rid"] == F.col("rid")).alias("kept"),
        "digest",
    )


def _check_bytes(docs: DataFrame, groups: DataFrame) -> None:
    """Compare the texts of every group; equal packed bytes mean equal texts.

    Texts are aggregated before they are shuffled, so each task sends two per digest at most.
    """
    rows = docs.select(F.col("text").cast("string")).mapInArrow(_bodies, "digest binary, body binary")
    spread = rows.groupBy("digest").agg(F.min("body").alias("low"), F.max("body").alias("high"))
    met = spread.join(groups.select("digest"), "digest")
    if not met.where(F.col("low") != F.col("high")).isEmpty():
        raise ValueError("two texts share a SHA-256 digest but not their bytes")


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` without all but the last of equal texts; columns stay as they are."""
    return rows_kept(docs, exact_duplicates(docs))
