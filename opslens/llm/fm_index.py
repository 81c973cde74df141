"""FM-index over integer texts: a wavelet matrix on packed bit vectors, searched for many patterns at once."""

from __future__ import annotations

import numpy as np


class BitRank:
    """Bits in 64-bit words, with the number of ones before each word."""

    def __init__(self, bits: np.ndarray) -> None:
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(ones)[:-1]]).astype(np.int32)
        self.zeros = len(bits) - int(ones.sum())

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Ones among the first i bits."""
        word = i >> 6
        below = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)


class Wavelet:
    """Wavelet matrix: how often a symbol occurs in a prefix."""

    def __init__(self, symbols: np.ndarray, sigma: int) -> None:
        self.bits = max(1, int(sigma - 1).bit_length())
        self.levels = []
        row = symbols
        for level in range(self.bits - 1, -1, -1):
            bit = ((row >> level) & 1).astype(np.uint8)
            self.levels.append(BitRank(bit))
            row = np.concatenate([row[bit == 0], row[bit == 1]])
        # Where each symbol's run begins in the last order.
        self.first = np.zeros(sigma, np.int64)
        present, at = np.unique(row, return_index=True)
        self.first[present] = at

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level, bits in zip(range(self.bits - 1, -1, -1), self.levels, strict=True):
            ones = bits.ones(i)
            i = np.where((symbol >> level) & 1, bits.zeros + ones, i - ones)
        return i - self.first[symbol]


def sorted_suffixes(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffix array of ``text``, in order at least to ``depth`` symbols (prefix doubling)."""
    n = len(text)
    rank = text.astype(np.int64)
    order = np.argsort(rank)
    done = 1
    while True:
        placed = rank[order]
        fresh = np.cumsum(np.concatenate([[0], placed[1:] != placed[:-1]]))
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        if done >= depth or fresh[-1] == n - 1:
            return order
        follow = np.zeros(n, np.int64)
        follow[: n - done] = rank[done:] + 1
        rank = rank * (n + 1) + follow
        order = np.argsort(rank)
        done *= 2


class FMIndex:
    """Backward search over weighted texts.

    ``texts`` are arrays of symbols from 1; each counts ``weights`` times.  Suffixes are sorted to
    ``depth`` symbols, which is enough for patterns of that length.
    """

    def __init__(self, texts: list[np.ndarray], weights: np.ndarray, sigma: int, depth: int) -> None:
        parts, owner = [], []
        for i, t in enumerate(texts):
            parts += [t, np.zeros(1, t.dtype)]
            owner.append(np.full(len(t) + 1, i))
        text = np.concatenate(parts).astype(np.int64)
        suffixes = sorted_suffixes(text, depth)
        self.sigma = sigma
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))]).astype(np.int64)
        self.wavelet = Wavelet(text[suffixes - 1], sigma)
        counted = weights[np.concatenate(owner)][suffixes]
        self.weight_before = np.concatenate([[0], np.cumsum(counted)])

    def whole(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        return np.zeros(n, np.int64), np.full(n, self.starts[-1])

    def step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns that gain ``symbol`` on the left."""
        base = self.starts[symbol]
        n = len(symbol)
        ranks = self.wavelet.rank(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        return base + ranks[:n], base + ranks[n:]

    def weight(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return self.weight_before[high] - self.weight_before[low]


def repeated_windows(index: FMIndex, texts: list[np.ndarray], length: int, least: int) -> list[np.ndarray]:
    """Starts in each text of the windows of ``length`` symbols that weigh ``least`` or more in the index.

    All texts advance together, one symbol per turn.  A text is first matched from its end to the left
    as far as it weighs enough, which settles its last windows.  The others are
    tried from the first on: a window is matched from its end; where that fails at p, every
    window that holds p and this end fails, so the next one to try begins at p + 1.
    """
    n = len(texts)
    sizes = np.array([len(t) for t in texts])
    base = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    flat = np.concatenate(texts).astype(np.int64)
    good = np.zeros(len(flat), bool)

    # From the end to the left, all texts at once.
    at, alive = sizes - 1, np.arange(n)
    low, high = index.whole(n)
    while len(alive):
        new_low, new_high = index.step(flat[base[alive] + at[alive]], low[alive], high[alive])
        fits = index.weight(new_low, new_high) >= least
        low[alive], high[alive] = new_low, new_high
        alive = alive[fits]
        at[alive] -= 1
        alive = alive[at[alive] >= 0]
    # Windows that begin after the first failure, at[i], are repeated.
    first_good = at + 1
    tail = np.maximum(sizes - length - first_good + 1, 0)
    spots = np.repeat(base + first_good - np.cumsum(tail) + tail, tail) + np.arange(tail.sum())
    good[spots] = True

    stop = np.minimum(first_good, sizes - length + 1)  # windows from here on are settled
    start = np.zeros(n, np.int64)
    alive = np.flatnonzero(start < stop)
    at = start + length - 1
    low, high = index.whole(n)
    while len(alive):
        new_low, new_high = index.step(flat[base[alive] + at[alive]], low[alive], high[alive])
        fits = index.weight(new_low, new_high) >= least
        low[alive], high[alive] = new_low, new_high
        reached = fits & (at[alive] == start[alive])
        good[(base[alive] + start[alive])[reached]] = True
        # Begin the next window where this one ended, well or not.
        over = reached | ~fits
        again = alive[over]
        start[again] = np.where(reached[over], start[again] + 1, at[again] + 1)
        low[again], high[again] = 0, index.starts[-1]
        at[alive[~over]] -= 1
        at[again] = start[again] + length - 1
        alive = alive[start[alive] < stop[alive]]
    return [np.flatnonzero(good[b : b + s]) for b, s in zip(base, sizes, strict=True)]
