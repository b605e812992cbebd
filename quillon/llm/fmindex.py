"""A compressed FM-index over sequences of whole numbers, with batches of queries searched in step.

The Burrows-Wheeler transform lies in a wavelet matrix: one row of packed bits for each bit of a symbol, with counts of
ones before each 64-bit word. A backward search step is one walk through the matrix for each end of an interval.
"""

from __future__ import annotations

import numpy as np


class WaveletMatrix:
    """rank(symbols, places): how often each symbol stands before its place."""

    def __init__(self, values: np.ndarray, bits: int):
        self.bits, self.n = bits, len(values)
        self.words, self.before, self.zeros = [], [], []
        for level in range(bits - 1, -1, -1):
            bit = (values >> level & 1).astype(np.uint8)
            packed = np.packbits(bit, bitorder="little")
            packed = np.append(packed, np.zeros(-len(packed) % 8 + 8, np.uint8)).view(np.uint64)
            ones = np.concatenate(([0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)))
            self.words.append(packed)
            self.before.append(ones.astype(np.int32) if len(values) < 2**31 else ones)
            self.zeros.append(len(values) - int(bit.sum()))
            values = np.concatenate((values[bit == 0], values[bit == 1]))

    def _ones(self, level: int, places: np.ndarray) -> np.ndarray:
        word, rest = places >> 6, (places & 63).astype(np.uint64)
        inside = self.words[level][word] & ((np.uint64(1) << rest) - np.uint64(1))
        return self.before[level][word] + np.bitwise_count(inside).astype(np.int64)

    def rank(self, symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
        start, end = np.zeros_like(places), places.copy()
        for level in range(self.bits):
            one = (symbols >> (self.bits - 1 - level) & 1).astype(bool)
            a, b = self._ones(level, start), self._ones(level, end)
            start, end = np.where(one, self.zeros[level] + a, start - a), np.where(one, self.zeros[level] + b, end - b)
        return end - start


def suffixes(text: np.ndarray, ends: np.ndarray, longest: int) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """The suffix array of text, whose ``ends`` are terminators that differ from each other and sort first, and the
    ranks of all prefixes of 1, 2, 4, ... symbols, from which prefixes of other lengths can be compared."""
    n = len(text)
    first = text.astype(np.int64) + len(ends)
    first[ends] = np.arange(len(ends))
    _, rank = np.unique(first, return_inverse=True)
    ranks, k = {1: rank.astype(np.int64)}, 1
    order = np.argsort(rank, kind="stable")
    while k <= longest:
        after = np.full(n, 0, np.int64)
        after[:-k] = ranks[k][k:] + 1 if k < n else 0
        key = ranks[k] * (n + 1) + after
        order = np.argsort(key, kind="stable")
        new = np.zeros(n, np.int64)
        new[order[1:]] = np.cumsum(key[order[1:]] != key[order[:-1]])
        ranks[2 * k] = new
        k *= 2
        if n and new.max() == n - 1:
            break
    return order, ranks


class FMIndex:
    """Searches windows of one length in sequences; each sequence has an owner, and a window's answer is its least owner."""

    def __init__(self, symbols: np.ndarray, offsets: np.ndarray, owners: np.ndarray, window: int, alphabet: int):
        """symbols: those of all sequences, from 1 to alphabet - 1; offsets: where each sequence starts (and the end)."""
        self.window = window
        size = np.diff(offsets)
        n = len(symbols) + len(size)
        text, ends = np.zeros(n, np.int64), offsets[1:] + np.arange(len(size))
        inside = np.ones(n, bool)
        inside[ends] = False
        text[inside] = symbols
        order, ranks = suffixes(text, ends, int(size.max(initial=0)) + 1)
        bwt = text[order - 1]  # the place before the first is the last terminator's
        self.smaller = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=alphabet))))
        self.matrix = WaveletMatrix(bwt, max(1, int(alphabet - 1).bit_length()))
        self.n = n
        # rows whose suffixes agree in the first window - 1 symbols, and in window, lie side by side
        near, full = self._agree(order, ranks, window - 1), self._agree(order, ranks, window)
        starts = np.flatnonzero(~near)
        group = np.cumsum(~near) - 1
        self.near_start, self.near_end = starts[group], np.append(starts[1:], n)[group]
        owner = np.repeat(owners, size + 1)[order]
        starts = np.flatnonzero(~full)
        self.least = np.minimum.reduceat(owner, starts)[np.cumsum(~full) - 1] if n else owner

    @staticmethod
    def _agree(order: np.ndarray, ranks: dict[int, np.ndarray], length: int) -> np.ndarray:
        """Whether each row's suffix has the first ``length`` symbols of the row above."""
        n = len(order)
        same, at = np.ones(n, bool), 0
        same[:1] = False
        most = max(ranks)
        while length:
            k = min(1 << (length.bit_length() - 1), most)
            place = order + at
            known = np.where(place < n, ranks[k][np.minimum(place, n - 1)], -1) if n else place
            same[1:] &= known[1:] == known[:-1]
            at, length = at + k, length - k
        return same

    def step(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the suffixes that start with the symbol and go on as one of low..high."""
        base = self.smaller[symbols]
        return base + self.matrix.rank(symbols, low), base + self.matrix.rank(symbols, high)

    def matches(self, symbols: np.ndarray, offsets: np.ndarray, missing: int) -> np.ndarray:
        """The least owner of each window of each sequence (all at least a window long), or ``missing``.

        Matching statistics cut at the window's length: from one window to that on its left, the interval is widened to
        the rows that agree in window - 1 symbols, and takes one step; where a window isn't there, the next one is
        searched from its end. A symbol of 0 is found nowhere.
        """
        w, count = self.window, np.diff(offsets) - self.window + 1
        first = np.cumsum(count) - count
        out = np.full(int(count.sum()), missing, np.int64)
        place = count - 1  # of each sequence's window, from its last to its first
        live = np.arange(len(count))
        low, high = np.zeros(len(count), np.int64), np.zeros(len(count), np.int64)
        while len(live) and self.n:
            start = offsets[live] + place[live]
            known = high[live] > low[live]
            rows = live[known]
            if len(rows):
                c = symbols[start[known]]
                a, b = self.step(c, self.near_start[low[rows]], self.near_end[low[rows]])
                low[rows], high[rows] = a, np.where(c > 0, b, a)
            rows, at = live[~known], start[~known]
            a, b = np.zeros(len(rows), np.int64), np.full(len(rows), self.n, np.int64)
            left = np.arange(len(rows))
            for j in range(w - 1, -1, -1):
                c = symbols[at[left] + j]
                x, y = self.step(c, a[left], b[left])
                a[left], b[left] = x, np.where(c > 0, y, x)
                left = left[b[left] > a[left]]
                if not len(left):
                    break
            low[rows], high[rows] = a, b
            found = live[high[live] > low[live]]
            out[first[found] + place[found]] = self.least[low[found]]
            place[live] -= 1
            live = live[place[live] >= 0]
        return out
