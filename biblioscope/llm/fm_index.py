"""A compressed FM-index over a sequence of small integers, searched in batches.

The Burrows-Wheeler transform is held in a wavelet matrix of packed bits; a rank is a
table entry and a population count.  Suffixes are sorted by prefix doubling to a
depth that covers the longest pattern, which is all that backward search of such
patterns needs.
"""

from __future__ import annotations

import numpy as np


class Bits:
    """A bit vector with rank."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, np.uint8)
        padded[:len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)]).astype(np.int32)

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Ones before position ``i``."""
        word = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class FMIndex:
    """Index of ``text`` (integers from 0; 0 ends every segment and is in no pattern)."""

    def __init__(self, text: np.ndarray, depth: int):
        n = len(text)
        rank, step = np.unique(text, return_inverse=True)[1].astype(np.int64), 1
        while step < depth and n:
            nxt = np.zeros(n, np.int64)
            nxt[:n - step] = rank[step:] + 1
            uniq, rank = np.unique(rank * (n + 2) + nxt, return_inverse=True)
            if len(uniq) == n:
                break
            step *= 2
        self.suffixes = np.argsort(rank, kind="stable")
        self.symbols = int(text.max()) + 1 if n else 1
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=self.symbols))])
        bwt = text[self.suffixes - 1] if n else text
        self.levels, self.zeros = [], []
        for shift in reversed(range(max(1, (self.symbols - 1).bit_length()))):
            bit = ((bwt >> shift) & 1).astype(np.uint8)
            self.levels.append((shift, Bits(bit)))
            self.zeros.append(int(n - bit.sum()))
            bwt = np.concatenate([bwt[bit == 0], bwt[bit == 1]])
        self.origin = self._down(np.arange(self.symbols), np.zeros(self.symbols, np.int64))

    def _down(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Position ``i`` of the transform followed through the levels along ``symbol``."""
        for (shift, bits), zeros in zip(self.levels, self.zeros, strict=True):
            ones = bits.ones(i)
            i = np.where((symbol >> shift) & 1, zeros + ones, i - ones)
        return i

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges after one backward step: the patterns with ``symbol`` put before them."""
        base = self.starts[symbol] - self.origin[symbol]
        return base + self._down(symbol, low), base + self._down(symbol, high)

    def search(self, patterns: np.ndarray, least: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of the rows of ``patterns`` (all of one length), searched from the right.

        A row whose range falls below ``least`` suffixes is given up and gets an empty range.
        """
        q, length = patterns.shape
        low, high = np.zeros(q, np.int64), np.full(q, len(self.suffixes), np.int64)
        alive = np.arange(q)
        for j in reversed(range(length)):
            a, b = self.extend(patterns[alive, j], low[alive], high[alive])
            keep = b - a >= least
            low[alive], high[alive] = np.where(keep, a, 0), np.where(keep, b, 0)
            alive = alive[keep]
            if not len(alive):
                break
        return low, high

    def smallest(self, low: np.ndarray, high: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Smallest ``value`` of the positions in each (non-empty) suffix range; ranges are equal or disjoint."""
        if not len(low):
            return np.zeros(0, value.dtype)
        uniq, first, inverse = np.unique(low, return_index=True, return_inverse=True)
        ends = high[first]
        padded = np.append(value[self.suffixes], value.max())
        return np.minimum.reduceat(padded, np.stack([uniq, ends], axis=1).ravel())[::2][inverse]
