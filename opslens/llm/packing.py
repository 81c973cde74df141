"""Best-fit packing of token pieces by a grouping genetic algorithm.

Documents become token pieces of at most ``CAPACITY``.  Pieces are dealt by hash to blocks of about
``BLOCK`` pieces.  Several islands evolve packings of each block: crossover injects whole well-filled
bins of one parent into the other, bins that hold the same documents are dissolved, and the
displaced documents go in by best fit.  After each epoch every island's elite also moves to the next
island (a shuffle of elites), and the best packing of a block wins.  Each block's emptiest bin goes
once more through the same steps together with those of other blocks.
"""

from __future__ import annotations

import itertools
import os
import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator
from sys import byteorder

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslens.llm.store import batch, row_ids, saved
from opslens.llm.text import chunks

CAPACITY = 2048
END_ID = 0
BLOCK = 4096
ISLANDS = 3
EPOCHS = 2
GENERATIONS = 6
POPULATION = 4
TOKENIZER = "word_bpe_49k.json"
#: Ids of words that a worker keeps at hand, distinct pieces of words, and the greatest length of these.
CACHE_IDS = 1 << 21
CACHE_PARTS = 150_000
CACHE_LENGTH = 64
#: New words that are sorted in among the others together.
LEVEL = 1 << 16

_PIECES = pa.schema(
    [
        ("rid", pa.int64()),
        ("doc_id", pa.int64()),
        ("piece", pa.int32()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids_crc32", pa.int64()),
    ]
)
_PIECES_DDL = "rid long, doc_id long, piece int, start long, length long, ids_crc32 long"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _letters_of_bytes() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: visible ones for themselves, then from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(0x100 + i) for i, b in enumerate(hidden)}


_LETTER_OF_BYTE = _letters_of_bytes()


class WordIds:
    """Token ids of texts, gathered with numpy from those of their distinct words.

    The tokenizer's pieces never span ASCII white space, so a text's ids are those of its words in a row.
    Words are told apart by 64-bit hashes.  New ones are learned together: plain words of Latin letters, digits and marks
    are split into pieces here, as the tokenizer would, and each new piece goes to the tokenizer's
    model; any other word goes through the whole tokenizer.
    """

    _made: dict[str, WordIds] = {}

    #: Lines with more than Latin characters that normalisation leaves alone, or with the start of a special token.
    _odd = re.compile(r"^[^\n]*?(?:<\||[^\n\x21-\x7e\u00a1-\u00ac\u00ae-\u012f\u0131-\u024f])[^\n]*$", re.MULTILINE)
    #: Fixed value: the tokenizer's own split, for lower-case text of those characters; and the ends of words.
    _letters = "a-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
    _digits = "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
    _split = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_letters}]+|[{_digits}]|[^\s{_letters}{_digits}]+|\n")

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        self.parts: dict[str, list[int]] = {}
        self._forget()

    @classmethod
    def of(cls, path: str) -> WordIds:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def _forget(self) -> None:
        self.ids = np.zeros(0, "<u4")
        # Sorted hashes with the places of their ids: all that was learned, and what was learned since it was sorted.
        nothing = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.levels = [nothing, nothing]

    def _places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and counts in ``ids`` of distinct hashes; a count of -1 where unknown."""
        starts, counts = np.zeros(len(hashes), np.int64), np.full(len(hashes), -1)
        for known, first, size in self.levels:
            if len(known):
                at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                hit = known[at] == hashes
                starts[hit], counts[hit] = first[at[hit]], size[at[hit]]
        return starts, counts

    def _learn(self, hashes: np.ndarray, words: list[bytes]) -> None:
        if len(self.ids) > CACHE_IDS:
            self._forget()
        found = self._learned(words)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat = np.frombuffer(b"".join(found), "<u4")
        first = len(self.ids) + np.cumsum(sizes) - sizes
        self.ids = np.concatenate([self.ids, flat])
        new = hashes, first, sizes
        self.levels[1] = _sorted(self.levels[1], new)
        if len(self.levels[1][0]) > LEVEL:
            self.levels = [_sorted(*self.levels), tuple(a[:0] for a in new)]

    def _learned(self, words: list[bytes]) -> list[bytes]:
        """Ids of new words, in their order."""
        texts = [w.decode() for w in words]
        odd = set(self._odd.findall("\n".join(texts)))
        plain = self._split_up("\n".join(t for t in texts if t not in odd))
        whole = self.tokenizer.encode
        return [_raw(whole(t, add_special_tokens=False).ids) if t in odd else next(plain) for t in texts]

    def _split_up(self, lines: str) -> Iterator[bytes]:
        if len(self.parts) > CACHE_PARTS:
            self.parts.clear()
        get, ids = self.parts.get, []
        for part in self._split.findall(lines.lower()):
            if part == "\n":
                yield b"".join(ids)
                ids = []
            else:
                ids.append(get(part) or self._part(part))
        yield b"".join(ids)

    def _part(self, part: str) -> bytes:
        mapped = part if part.isascii() else part.encode().decode("latin-1").translate(_LETTER_OF_BYTE)
        ids = _raw([t.id for t in self.tokenize(mapped)])
        if len(part) <= CACHE_LENGTH:
            self.parts[part] = ids
        return ids

    def encode(self, column: pa.Array) -> Iterator[bytes]:
        """Little-endian 32-bit ids of each text; null is empty."""
        for words in chunks(column, lower=False):
            distinct, where, back = np.unique(words.hashes, return_index=True, return_inverse=True)
            starts, counts = self._places(distinct)
            new = np.flatnonzero(counts < 0)
            if len(new):
                data, spans = words.data.tobytes(), where[new]
                pairs = zip(words.starts[spans].tolist(), words.ends[spans].tolist(), strict=True)
                self._learn(distinct[new], [data[a:z] for a, z in pairs])
                starts, counts = self._places(distinct)
                if (counts < 0).any():  # learning began anew
                    self._learn(distinct, [data[a:z] for a, z in zip(words.starts[where], words.ends[where], strict=True)])
                    starts, counts = self._places(distinct)
            sizes = counts[back]
            ends = np.cumsum(sizes)
            ids = self.ids[np.repeat(starts[back] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
            bounds = (4 * np.concatenate([[0], ends])[words.bounds]).tolist()
            yield from (ids[a:z] for a, z in itertools.pairwise(bounds))


def _raw(ids: list[int]) -> bytes:
    return array("I", ids).tobytes() if byteorder == "little" else np.array(ids, "<u4").tobytes()


def _sorted(one: tuple[np.ndarray, ...], other: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    both = [np.concatenate(pair) for pair in zip(one, other, strict=True)]
    order = np.argsort(both[0], kind="stable")
    return tuple(a[order] for a in both)


def _pieces(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, words, end = row_ids(), WordIds.of(path), np.uint32(END_ID).tobytes()
        step = 4 * CAPACITY
        for b in batches:
            rows = []
            for doc_id, raw in zip(b["doc_id"].to_pylist(), words.encode(b["text"]), strict=True):
                rid, raw = next(ids), raw + end
                for piece, at in enumerate(range(0, len(raw), step)):
                    part = raw[at : at + step]
                    rows.append((rid, doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            if rows:
                yield batch(dict(zip(_PIECES.names, zip(*rows, strict=True), strict=True)), _PIECES)

    return run


def pieces(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Token pieces of every row: ``rid, doc_id, piece, start, length, ids_crc32``; null text is empty."""
    picked = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return picked.mapInArrow(_pieces(path or tokenizer_path()), _PIECES_DDL)


class Packing:
    """Items in bins: ``bins[i]`` is the bin of item i, without gaps in the numbers."""

    def __init__(self, bins: np.ndarray, lengths: np.ndarray) -> None:
        self.bins = np.unique(bins, return_inverse=True)[1].astype(np.int32)
        self.loads = np.bincount(self.bins, lengths).astype(np.int64)

    @property
    def worth(self) -> tuple[int, float]:
        """Fewer bins first, then unevenly filled ones."""
        return -len(self.loads), float((self.loads.astype(float) ** 2).sum())


def best_fit(bins: np.ndarray, loads: np.ndarray, items: np.ndarray, lengths: np.ndarray) -> None:
    """Put ``items`` in turn into the fullest bin that takes them; sets their places in ``bins``."""
    top = len(loads)
    room = sorted(((CAPACITY - int(x)) << 32) + i for i, x in enumerate(loads) if 0 < x < CAPACITY)
    for item, length in zip(items.tolist(), lengths[items].tolist(), strict=True):
        at = bisect_left(room, length << 32)
        if at < len(room):
            space = room.pop(at)
            bins[item] = space & 0xFFFFFFFF
            space -= length << 32
        else:
            bins[item] = top
            space = ((CAPACITY - length) << 32) + top
            top += 1
        if space >> 32:
            insort(room, space)


def _by_size(items: np.ndarray, lengths: np.ndarray, draw: np.random.Generator, blur: float) -> np.ndarray:
    """Longest first; ``blur`` mixes neighbours."""
    return items[np.argsort(-lengths[items] * (1 + blur * draw.random(len(items))), kind="stable")]


def _fresh(lengths: np.ndarray, draw: np.random.Generator) -> Packing:
    """Best fit of the items in random order."""
    bins = np.zeros(len(lengths), np.int64)
    best_fit(bins, np.zeros(0, np.int64), draw.permutation(len(lengths)), lengths)
    return Packing(bins, lengths)


def crossover(into: Packing, source: Packing, lengths: np.ndarray, draw: np.random.Generator) -> Packing:
    """A child of ``into`` with some of the fullest bins of ``source``, and without its own emptiest quarter."""
    weights = source.loads / CAPACITY + draw.random(len(source.loads)) * 0.05
    chosen = np.argsort(-weights)[: max(1, len(weights) // 4)]
    chosen = chosen[draw.random(len(chosen)) < 0.5]
    injected = np.isin(source.bins, chosen)
    hit = np.zeros(len(into.loads), bool)
    hit[into.bins[injected]] = True
    worst = np.argsort(into.loads)[: len(into.loads) // 4 + 1]
    hit[worst] = True
    displaced = np.flatnonzero(hit[into.bins] & ~injected)
    bins = into.bins.astype(np.int64)
    loads = np.where(hit, 0, into.loads)
    bins[injected] = len(loads) + source.bins[injected]
    # Injected bins keep their contents; they are numbered after the others.
    added = np.zeros(len(source.loads), np.int64)
    added[chosen] = source.loads[chosen]
    best_fit(bins, np.concatenate([loads, added]), _by_size(displaced, lengths, draw, 0.02), lengths)
    return Packing(bins, lengths)


def evolve(lengths: np.ndarray, elites: list[np.ndarray], seed: list[int]) -> Packing:
    """One island's epoch, from the elites that live there and packings in no particular order.

    Every epoch breeds at least one generation; it ends early at the lower bound.
    """
    draw = np.random.default_rng(seed)
    least = -(-int(lengths.sum()) // CAPACITY)
    people = [Packing(e, lengths) for e in elites]
    while len(people) < POPULATION:
        people.append(_fresh(lengths, draw))
    for _ in range(GENERATIONS):
        people.sort(key=lambda p: p.worth, reverse=True)
        people = people[:POPULATION]
        for _ in range(POPULATION // 2):
            a, b = draw.choice(len(people), 2, replace=False)
            people.append(crossover(people[a], people[b], lengths, draw))
        if min(len(p.loads) for p in people) <= least:
            break
    return max(people, key=lambda p: p.worth)


_ISLANDS = pa.schema(
    [("block", pa.int64()), ("island", pa.int32()), ("lengths", pa.binary()), ("elite", pa.binary()), ("bins", pa.int64()), ("worth", pa.float64())]
)
_ISLANDS_DDL = "block long, island int, lengths binary, elite binary, bins long, worth double"


def _epoch(turn: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                lengths = np.frombuffer(row["lengths"], np.int32)
                elites = [np.frombuffer(e, np.int32) for e in row["elites"] or []]
                best = evolve(lengths, elites, [row["block"] % (1 << 62), row["island"], turn])
                bins, worth = -best.worth[0], best.worth[1]
                made = (row["block"], row["island"], row["lengths"], best.bins.tobytes(), bins, worth)
                yield batch({n: [v] for n, v in zip(_ISLANDS.names, made, strict=True)}, _ISLANDS)

    return run


def _blob(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for block, lengths in zip(b["block"].to_pylist(), b["lengths"].to_pylist(), strict=True):
            yield pa.RecordBatch.from_pydict({"block": [block], "lengths": [np.array(lengths, np.int32).tobytes()]})


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for row in b.to_pylist():
            lengths, bins = np.frombuffer(row["lengths"], np.int32), np.frombuffer(row["elite"], np.int32)
            order = np.argsort(bins, kind="stable")
            ends = np.cumsum(lengths[order])
            first = np.flatnonzero(np.diff(bins[order], prepend=-1))
            before = np.repeat(ends[first] - lengths[order][first], np.diff(np.append(first, len(order))))
            offset = np.empty(len(order), np.int64)
            offset[order] = ends - lengths[order] - before
            loads = np.bincount(bins, lengths)
            last = np.full(len(bins), bool(loads.min() < CAPACITY)) & (bins == loads.argmin())
            yield pa.RecordBatch.from_pydict(
                {
                    "rid": pa.array([k["rid"] for k in row["keys"]], pa.int64()),
                    "piece": pa.array([k["piece"] for k in row["keys"]], pa.int32()),
                    "length": pa.array(lengths, pa.int64()),
                    "block": pa.array(np.full(len(bins), row["block"]), pa.int64()),
                    "bin": pa.array(bins, pa.int64()),
                    "offset": pa.array(offset, pa.int64()),
                    "emptiest": pa.array(last),
                }
            )


_PLACED_DDL = "rid long, piece int, length long, block long, bin long, offset long, emptiest boolean"


def _packed_blocks(items: DataFrame) -> DataFrame:
    """Pack ``items`` (rid, piece, length < CAPACITY) block by block."""
    spark = items.sparkSession
    blocks = max(1, -(-items.count() // BLOCK))
    block = F.pmod(F.xxhash64("rid", "piece"), F.lit(blocks)).alias("block")
    grouped = saved(
        items.groupBy(block).agg(F.array_sort(F.collect_list(F.struct("length", "rid", "piece"))).alias("items")),
        "blocks",
    )
    lists = grouped.select("block", F.col("items.length").cast("array<int>").alias("lengths"))
    state = lists.mapInArrow(_blob, "block long, lengths binary").select(
        "block",
        F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"),
        "lengths",
        F.array().cast("array<binary>").alias("elites"),
    )
    width = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    for turn in range(EPOCHS):
        evolved = saved(state.repartition(width, "block", "island").mapInArrow(_epoch(turn), _ISLANDS_DDL), "islands")
        # An elite stays at home and also moves to the next island.
        homes = F.array(F.col("island"), ((F.col("island") + 1) % ISLANDS).cast("int"))
        moved = evolved.select("block", "lengths", "elite", F.explode(homes).alias("island"))
        state = moved.groupBy("block", "island").agg(
            F.first("lengths").alias("lengths"), F.sort_array(F.collect_list("elite")).alias("elites")
        )
    best = evolved.groupBy("block").agg(
        F.min(F.struct(F.col("bins"), (-F.col("worth")).alias("w"), F.col("island"), F.col("elite"), F.col("lengths"))).alias("best")
    )
    keys = grouped.select("block", F.transform("items", lambda x: F.struct(x["rid"].alias("rid"), x["piece"].alias("piece"))).alias("keys"))
    met = best.select("block", "best.elite", "best.lengths").join(keys, "block")
    return saved(met.mapInArrow(_placed, _PLACED_DDL), "placed")


def pack(parts: DataFrame) -> DataFrame:
    """``parts`` (written pieces) with ``sequence_id`` and ``offset``; a full piece is a sequence by itself."""
    # Numbers of a sequence: level, block and bin; a bin number stays below 2 ** 24.
    full = parts.where(F.col("length") >= CAPACITY).select(
        "rid", "piece", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    first = _packed_blocks(parts.where(F.col("length") < CAPACITY).select("rid", "piece", "length"))
    second = _packed_blocks(first.where("emptiest").select("rid", "piece", "length"))

    def numbered(placed: DataFrame, level: int) -> DataFrame:
        number = F.shiftleft((F.col("block") * 2 + level).cast("long"), 24) + F.col("bin")
        return placed.select("rid", "piece", number.alias("sequence_id"), "offset")

    places = full.unionByName(numbered(first.where("NOT emptiest"), 0)).unionByName(numbered(second, 1))
    return parts.join(places, ["rid", "piece"])


def best_fit_packing(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Pieces of every row of ``docs`` (doc_id, text) with their places.

    Rows that repeat an id are packed apart; an empty text is one piece that holds the end id; an empty
    table gives no rows.
    """
    return pack(saved(pieces(docs, path), "pieces"))
