"""A compressed FM-index over a sequence of integers, queried for many patterns at once.

The Burrows-Wheeler transform of the sequence lies in a wavelet matrix of packed bits
with block counts. Suffixes are sorted by their first ``depth`` symbols only, which
leaves every interval of a pattern of at most ``depth`` symbols exact.
"""

from __future__ import annotations

import numpy as np

ONE, SIXTY_THREE = np.uint64(1), np.uint64(63)


class WaveletMatrix:
    def __init__(self, values: np.ndarray, symbols: int):
        self.levels = max(1, int(symbols - 1).bit_length())
        self.bits, self.before, self.zeros = [], [], []
        x = values
        for level in range(self.levels - 1, -1, -1):
            bit = (x >> level) & 1
            packed = np.packbits(bit.astype(np.uint8), bitorder="little")
            packed = np.append(packed, np.zeros(16 - len(packed) % 8, np.uint8)).view(np.uint64)
            ones = np.bitwise_count(packed)
            self.bits.append(packed)
            self.before.append((np.cumsum(ones) - ones).astype(np.int32))
            self.zeros.append(int(len(x) - bit.sum()))
            x = np.concatenate((x[bit == 0], x[bit == 1]))
        self.base = self.descend(np.arange(symbols), np.zeros(symbols, np.int64))

    def descend(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        for n, level in enumerate(range(self.levels - 1, -1, -1)):
            block = place >> 6
            mask = (ONE << (place.astype(np.uint64) & SIXTY_THREE)) - ONE
            ones = self.before[n][block] + np.bitwise_count(self.bits[n][block] & mask)
            place = np.where((symbol >> level) & 1, self.zeros[n] + ones, place - ones)
        return place

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each place."""
        return self.descend(symbol, place) - self.base[symbol]


class FMIndex:
    """``values`` are symbols from 1 up, 0 parting sequences; ``owner`` is a number for each place, such as a document's."""

    def __init__(self, values: np.ndarray, owner: np.ndarray, depth: int):
        n, span = len(values), 1
        rank = values.astype(np.int64)
        while span < depth:
            after = np.zeros(n, np.int64)
            after[: n - span] = rank[span:] + 1 if n > span else 0
            rank = np.unique(rank * (int(rank.max(initial=0)) + 2) + after, return_inverse=True)[1]
            span *= 2
        order = np.argsort(rank, kind="stable")
        symbols = int(values.max(initial=0)) + 1
        self.first = np.concatenate(([0], np.cumsum(np.bincount(values, minlength=symbols))))
        self.wavelet = WaveletMatrix(values[order - 1], symbols)
        self.least = [owner[order].astype(np.int32)]
        while (step := 1 << (len(self.least) - 1)) * 2 <= n:
            top = self.least[-1]
            self.least.append(np.minimum(top[: len(top) - step], top[step:]))
        self.size = n

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of the patterns with a symbol put before each."""
        both = self.wavelet.rank(np.concatenate((symbol, symbol)), np.concatenate((lo, hi)))
        start = self.first[symbol]
        return start + both[: len(lo)], start + both[len(lo) :]

    def least_owner(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The least owner within each non-empty interval."""
        level = np.frexp((hi - lo).astype(np.float64))[1] - 1
        out = np.empty(len(lo), np.int32)
        for k in np.unique(level):
            at = level == k
            out[at] = np.minimum(self.least[k][lo[at]], self.least[k][hi[at] - (1 << int(k))])
        return out

    def longest_earlier(self, values: np.ndarray, ends: np.ndarray, most: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Matching statistics: the length of the longest stretch of ``values`` that ends at each of ``ends``, has ``most`` symbols at most,
        and occurs under a lesser owner than given.

        Backward search, all places in step; one leaves once no lesser owner is in its interval, for no longer match can have one then.
        """
        length, at = np.zeros(len(ends), np.int64), np.arange(len(ends))
        lo, hi = np.zeros(len(ends), np.int64), np.full(len(ends), self.size, np.int64)
        back = 0
        while len(at):
            lo, hi = self.extend(values[ends[at] - back], lo, hi)
            live = hi > lo
            live[live] = self.least_owner(lo[live], hi[live]) < owner[at[live]]
            back += 1
            at, lo, hi = at[live], lo[live], hi[live]
            length[at] = back
            more = most[at] > back
            at, lo, hi = at[more], lo[more], hi[more]
        return length

    def least_of(self, values: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The least owner of any occurrence of the ``size`` symbols of ``values`` from each of ``starts``, which occur."""
        lo, hi = np.zeros(len(starts), np.int64), np.full(len(starts), self.size, np.int64)
        for back in range(1, int(size.max(initial=0)) + 1):
            at = np.flatnonzero(size >= back)
            lo[at], hi[at] = self.extend(values[starts[at] + size[at] - back], lo[at], hi[at])
        return self.least_owner(lo, hi)
