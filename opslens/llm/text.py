"""Words and hashes of whole Arrow batches, without a Python step per word."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Text bytes handled at once; the working arrays take about 40 times as much.
CHUNK_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_RADIX = 0x9E3779B97F4A7C15
_RADIX_INVERSE = pow(_RADIX, -1, 1 << 64)
_BYTE_CODES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * 2 + 1


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[:1] = 1
    return np.multiply.accumulate(steps)


class _Tables:
    """Powers of the radix, as long as the longest chunk seen so far."""

    forward = _powers(_RADIX, CHUNK_BYTES * 2)
    back = _powers(_RADIX_INVERSE, CHUNK_BYTES * 2)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n <= len(cls.forward):
            return cls.forward, cls.back
        return _powers(_RADIX, n), _powers(_RADIX_INVERSE, n)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread all bits of 64-bit numbers (finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass
class Words:
    """Words of some documents: byte spans in ``data``, hashes, and the bounds of each document."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    bounds: np.ndarray  # words of document i: bounds[i] .. bounds[i + 1]
    first: int  # row of the first document in its batch
    offsets: np.ndarray  # bytes of document i in data: offsets[i] .. offsets[i + 1]

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def sizes(self) -> np.ndarray:
        return np.diff(self.bounds)

    def of_doc(self) -> np.ndarray:
        """Document of each word."""
        return np.repeat(np.arange(len(self)), self.sizes())


def chunks(column: pa.Array, lower: bool, hashed: bool = True) -> Iterator[Words]:
    """Split the texts of a column into words ``[^\\x20\\x09-\\x0D]+``; null counts as empty.

    ``lower`` folds A-Z only.  Hashes are 64-bit polynomials of the words' bytes.
    """
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, at, raw = column.buffers()
    at = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        stop = int(np.searchsorted(at, at[row] + CHUNK_BYTES, "right")) - 1
        stop = min(max(stop, row + 1), len(column))
        yield _words(data[at[row] : at[stop]], at[row : stop + 1] - at[row], row, lower, hashed)
        row = stop


def _words(data: np.ndarray, offsets: np.ndarray, first: int, lower: bool, hashed: bool) -> Words:
    if lower:
        data = _LOWER[data]
    solid = ~_SPACE[data]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    after_space = np.ones(len(data), bool)
    after_space[1:] = ~solid[:-1]
    after_space[inner] = True
    before_space = np.ones(len(data), bool)
    before_space[:-1] = ~solid[1:]
    before_space[inner - 1] = True
    starts = np.flatnonzero(solid & after_space)
    ends = np.flatnonzero(solid & before_space) + 1
    bounds = np.searchsorted(starts, offsets)
    hashes = np.zeros(0, np.uint64)
    if hashed:
        forward, back = _Tables.of(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE_CODES[data] * forward[: len(data)], out=sums[1:])
        hashes = mix((sums[ends] - sums[starts]) * back[starts])
    return Words(data, starts, ends, hashes, bounds, first, offsets)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive word hashes."""
    count = max(len(hashes) - n + 1, 0)
    out = np.zeros(count, np.uint64)
    for i in range(n):
        out = out * np.uint64(_RADIX) + hashes[i : i + count]
    return mix(out)
