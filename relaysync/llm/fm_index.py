"""An FM-index over a sequence of small integers, searched for many patterns at once.

Symbol 0 separates segments.  Each separator counts as a symbol of its own in
the suffix order (by position), so the order is total and no match crosses
one.  Ranks come from a wavelet matrix (one bit vector a level, with counts);
suffix positions are kept at every ``SAMPLE``-th place and at each segment's
first, so walking back to a sample never passes a separator.
"""

from __future__ import annotations

import numpy as np

SAMPLE = 8


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of all suffixes, by doubling the compared length."""
    n = len(text)
    seps = np.flatnonzero(text == 0)
    rank = text.astype(np.int64) + len(seps)
    rank[seps] = np.arange(len(seps))
    width = 1
    while True:
        after = np.full(n, -1, dtype=np.int64)
        after[: max(0, n - width)] = rank[width:]
        key = rank * (int(rank.max()) + 2) + after + 1
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
        rank = np.empty(n, dtype=np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            return order
        width *= 2


class FMIndex:
    def __init__(self, text: np.ndarray, symbols: int):
        """``text`` ends with 0; its values are below ``symbols``."""
        n = len(text)
        order = suffix_array(text)
        bwt = text[order - 1]
        self.n = n
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])[:symbols]
        sampled = (order % SAMPLE == 0) | (bwt == 0)
        self.marks = np.concatenate([[0], np.cumsum(sampled)])
        self.positions = order[sampled]
        self.levels = []
        self.bits = max(1, int(symbols - 1).bit_length())
        for k in range(self.bits - 1, -1, -1):
            bit = (bwt >> k) & 1
            ones = np.concatenate([[0], np.cumsum(bit, dtype=np.int32)])
            self.levels.append((k, ones, n - int(ones[-1])))
            bwt = np.concatenate([bwt[bit == 0], bwt[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol among the first ``at`` of the transform."""
        lo, hi = np.zeros_like(at), at
        for k, ones, zeros in self.levels:
            one = (symbol >> k) & 1 == 1
            a, b = ones[lo], ones[hi]
            lo, hi = np.where(one, zeros + a, lo - a), np.where(one, zeros + b, hi - b)
        return hi - lo

    def access(self, at: np.ndarray) -> np.ndarray:
        """Symbols of the transform."""
        out = np.zeros_like(at)
        for k, ones, zeros in self.levels:
            a = ones[at]
            one = ones[at + 1] > a
            out |= one.astype(out.dtype) << k
            at = np.where(one, zeros + a, at - a)
        return out

    def search(self, patterns: np.ndarray, lengths: np.ndarray):
        """Backward search of all patterns (right-aligned rows): ranges of suffixes."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, dtype=np.int64)
        for step in range(1, patterns.shape[1] + 1):
            live = np.flatnonzero((lengths >= step) & (hi > lo))
            if not len(live):
                break
            c = patterns[live, patterns.shape[1] - step]
            lo[live], hi[live] = self.first[c] + self.rank(c, lo[live]), self.first[c] + self.rank(c, hi[live])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes, by walking back to the nearest sample."""
        at, steps = rows.copy(), np.zeros(len(rows), np.int64)
        out = np.full(len(rows), -1, dtype=np.int64)
        live = np.arange(len(rows))
        while len(live):
            a = at[live]
            hit = self.marks[a + 1] > self.marks[a]
            out[live[hit]] = self.positions[self.marks[a[hit]]] + steps[live[hit]]
            live, a = live[~hit], a[~hit]
            if len(live):
                c = self.access(a)
                at[live] = self.first[c] + self.rank(c, a)
                steps[live] += 1
        return out
