"""FM-index over an integer text, in numpy: suffix order, wavelet-tree ranks, sampled suffix positions."""

from __future__ import annotations

import numpy as np

SAMPLE = 8


def suffix_order(text: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Suffix positions in order, by prefix doubling. ``keys`` orders single symbols."""
    n = len(text)
    order = np.argsort(keys, kind="stable")
    rank = np.empty(n, np.int64)
    step = 1
    sorted_keys = keys[order]
    rank[order] = np.concatenate(([0], np.cumsum(sorted_keys[1:] != sorted_keys[:-1])))
    while n and rank[order[-1]] < n - 1:
        # only places whose rank is shared are sorted again; the others hold their final place
        by_rank = rank[order]
        shared = np.zeros(n, bool)
        tie = by_rank[1:] == by_rank[:-1]
        shared[1:] |= tie
        shared[:-1] |= tie
        slots = np.flatnonzero(shared)
        at = order[slots]
        following = at + step
        second = np.where(following < n, rank[np.minimum(following, n - 1)] + 1, 0)
        key = by_rank[slots] * (n + 1) + second
        again = np.argsort(key, kind="stable")
        order[slots] = at[again]
        key = key[again]
        first = np.concatenate(([True], key[1:] != key[:-1]))
        # a rank is the slot of its first place, so refining one group leaves all others as they are
        dense = rank_of_slots(by_rank, slots, first)
        rank[order] = dense
        step *= 2
    return order


def rank_of_slots(by_rank: np.ndarray, slots: np.ndarray, first: np.ndarray) -> np.ndarray:
    new = np.concatenate(([True], by_rank[1:] != by_rank[:-1]))
    new[slots[first]] = True
    return np.cumsum(new) - 1


class WaveletTree:
    """rank(symbol, i) over a sequence of small integers, one bit level after the other (matrix layout)."""

    def __init__(self, seq: np.ndarray, sigma: int):
        self.levels = max(1, int(sigma - 1).bit_length())
        self.ones, self.zeros = [], []
        for level in range(self.levels - 1, -1, -1):
            bit = (seq >> level) & 1
            ones = np.zeros(len(seq) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(seq) - int(ones[-1]))
            seq = np.concatenate((seq[bit == 0], seq[bit == 1]))
        self.begin = self._descend(np.arange(sigma), np.zeros(sigma, np.int64))

    def _descend(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k, (ones, zeros) in enumerate(zip(self.ones, self.zeros)):
            bit = (symbol >> (self.levels - 1 - k)) & 1
            up = ones[i]
            i = np.where(bit == 1, zeros + up, i - up)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before i."""
        return self._descend(symbol, i) - self.begin[symbol]


class FmIndex:
    """Index of runs of symbols 1..sigma-1, each closed by a 0. The zeros are ordered by position, so no match
    and no walk crosses the end of a run. Every SAMPLE-th position and each run's first one are sampled."""

    def __init__(self, text: np.ndarray, sigma: int):
        n = len(text)
        zero = text == 0
        closers = int(zero.sum())
        keys = np.where(zero, np.cumsum(zero) - 1, closers + text)
        order = suffix_order(text, keys)
        self.bwt = text[order - 1].astype(np.int64)  # order 0 wraps to the closing 0
        self.count = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=sigma))))[:sigma]
        self.tree = WaveletTree(self.bwt, sigma)
        sampled = (order % SAMPLE == 0) | (self.bwt == 0)
        self.sampled = sampled
        self.place = np.cumsum(sampled) - 1
        self.positions = order[sampled]
        self.n = n

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row intervals [lo, hi) of phrases of one length, a row of symbols each; backward search."""
        lo = np.zeros(len(phrases), np.int64)
        hi = np.full(len(phrases), self.n, np.int64)
        live = np.arange(len(phrases))
        for k in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[live, k]
            lo[live] = self.count[c] + self.tree.rank(c, lo[live])
            hi[live] = self.count[c] + self.tree.rank(c, hi[live])
            live = live[hi[live] > lo[live]]
        gone = np.ones(len(phrases), bool)
        gone[live] = False
        hi[gone] = lo[gone]
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: steps back through the text until a sampled position."""
        out = np.empty(len(rows), np.int64)
        steps = 0
        left = np.arange(len(rows))
        while len(left):
            done = self.sampled[rows]
            out[left[done]] = self.positions[self.place[rows[done]]] + steps
            left, rows = left[~done], rows[~done]
            c = self.bwt[rows]
            rows = self.count[c] + self.tree.rank(c, rows)
            steps += 1
        return out
