"""A compressed full-text index over word sequences: suffix order, BWT, wavelet matrix of packed bits, backward search."""
from __future__ import annotations

import numpy as np

SEPARATOR = 0


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Suffix order by prefix doubling. Every separator is a symbol of its own, so all suffixes differ early."""
    n = len(symbols)
    ends = symbols == SEPARATOR
    rank = symbols.astype(np.int64) + int(ends.sum())
    rank[ends] = np.arange(int(ends.sum()))
    order = np.argsort(rank, kind="stable")
    k = 0
    while True:
        if k:
            behind = np.full(n, 0, np.int64)
            behind[:-k] = rank[k:] + 1
            key = rank * (n + 2) + behind
            order = np.argsort(key)
            rank = np.empty(n, np.int64)
            s = key[order]
        else:
            s = rank[order]
        new = np.concatenate([[0], np.cumsum(s[1:] != s[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = new
        k = max(1, 2 * k)
        if new[-1] == n - 1 or k >= n:
            return order


class Bits:
    """A packed bit vector with ranks: 64-bit blocks and the ones before each."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, np.uint8)
        padded[:len(bits)] = bits
        self.blocks = np.packbits(padded, bitorder="little").view("<u8")
        ones = np.bitwise_count(self.blocks)
        self.before = np.concatenate([[0], np.cumsum(ones)]).astype(np.int32)

    def rank1(self, i: np.ndarray) -> np.ndarray:
        block = i >> 6
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[block] + np.bitwise_count(self.blocks[block] & low)


class Wavelet:
    """A wavelet matrix: the bit planes of a sequence, each ordered by the planes above it."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.levels = list(range(max(1, int(sigma - 1).bit_length()) - 1, -1, -1))
        self.planes, self.zeros = [], []
        now = symbols
        for level in self.levels:
            bit = (now >> level & 1).astype(np.uint8)
            self.planes.append(Bits(bit))
            one = bit.astype(bool)
            self.zeros.append(int(len(bit) - one.sum()))
            now = np.concatenate([now[~one], now[one]])
        self.start = self._down(np.arange(sigma), np.zeros(sigma, np.int64))

    def _down(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level, plane, zeros in zip(self.levels, self.planes, self.zeros):
            ones = plane.rank1(i)
            i = np.where(symbol >> level & 1, zeros + ones, i - ones)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before its position."""
        return self._down(symbol, i) - self.start[symbol]


class FmIndex:
    """Over one sequence of symbols 1.. with separators 0, the last symbol being one."""

    def __init__(self, symbols: np.ndarray):
        sigma = int(symbols.max()) + 1
        self.n, self.suffixes = len(symbols), suffix_array(symbols)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=sigma))]).astype(np.int64)
        self.wavelet = Wavelet(symbols[self.suffixes - 1].astype(np.int64), sigma)

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of backward search: the intervals of ``symbol`` followed by what [low, high) stand for."""
        base = self.first[symbol]
        return base + self.wavelet.rank(symbol, low), base + self.wavelet.rank(symbol, high)

    def matching_statistics(self, ends: np.ndarray, symbols: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each place: how many symbols up to it, ``most`` at most, occur elsewhere too, and their interval.

        Searching stops where a match has one occurrence left, which is the place itself.
        """
        low, high = np.zeros(len(ends), np.int64), np.full(len(ends), self.n, np.int64)
        length = np.zeros(len(ends), np.int64)
        active = np.arange(len(ends))
        for k in range(most):
            symbol = symbols[ends[active] - k]
            lo, hi = self.extend(symbol, low[active], high[active])
            go = hi - lo > 1
            active = active[go]
            low[active], high[active] = lo[go], hi[go]
            length[active] = k + 1
        return length, low, high
