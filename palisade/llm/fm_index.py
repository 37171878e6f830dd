"""An FM-index over a sequence of small integers: wavelet-matrix ranks and sampled suffix positions."""

from __future__ import annotations

import numpy as np

SAMPLE = 8


def suffix_order(seq: np.ndarray) -> np.ndarray:
    """Suffix array by doubling: the rank of each suffix by its first 1, 2, 4, ... symbols until all differ."""
    n = len(seq)
    rank = np.unique(seq, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        key = rank * (n + 1)
        key[:-step] += rank[step:] + 1
        order = np.argsort(key, kind="stable")
        changed = np.empty(n, np.int64)
        changed[0] = 0
        np.cumsum(key[order][1:] != key[order][:-1], out=changed[1:])
        rank = np.empty(n, np.int64)
        rank[order] = changed
        step *= 2
        if changed[-1] == n - 1 or step >= n:
            return order


class WaveletMatrix:
    """rank(symbol, i): occurrences of a symbol before position i, for arrays of symbols and positions."""

    def __init__(self, seq: np.ndarray):
        self.bits = max(1, int(seq.max()).bit_length())
        self.ones, self.zeros = [], []
        level = seq
        for b in range(self.bits - 1, -1, -1):
            bit = (level >> b) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(len(level) - int(self.ones[-1][-1]))
            level = np.concatenate([level[bit == 0], level[bit == 1]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        low, high = np.zeros_like(i), i.copy()
        for k, (ones, zeros) in enumerate(zip(self.ones, self.zeros)):
            set_ = ((symbol >> (self.bits - 1 - k)) & 1).astype(bool)
            low = np.where(set_, zeros + ones[low], low - ones[low])
            high = np.where(set_, zeros + ones[high], high - ones[high])
        return high - low


class FmIndex:
    """Backward search and locate over ``seq`` (values of 1 and above)."""

    def __init__(self, seq: np.ndarray):
        text = np.append(seq.astype(np.int64), 0)
        order = suffix_order(text)
        self.n = len(text)
        self.bwt = text[order - 1]
        self.tree = WaveletMatrix(self.bwt)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=int(text.max()) + 2))])
        self.sampled = order % SAMPLE == 0
        self.place = np.concatenate([[0], np.cumsum(self.sampled)])
        self.samples = order[self.sampled]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges [low, high) of the rows of ``patterns`` (one length), all searched backwards together."""
        low = np.zeros(len(patterns), np.int64)
        high = np.full(len(patterns), self.n, np.int64)
        alive = np.arange(len(patterns))
        top = len(self.before) - 2
        for j in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[alive, j]
            known = c <= top
            low[alive[~known]] = high[alive[~known]] = 0
            alive, c = alive[known], c[known]
            low[alive] = self.before[c] + self.tree.rank(c, low[alive])
            high[alive] = self.before[c] + self.tree.rank(c, high[alive])
            alive = alive[low[alive] < high[alive]]
            if not len(alive):
                break
        none = np.ones(len(patterns), bool)
        none[alive] = False
        low[none] = high[none] = 0
        return low, high

    def locate(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pattern number, text position) of every occurrence in the ranges."""
        counts = high - low
        which = np.repeat(np.arange(len(low)), counts)
        row = np.repeat(low - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
        steps = np.zeros(len(row), np.int64)
        open_ = np.flatnonzero(~self.sampled[row])
        while len(open_):  # step back through the text until a sampled suffix
            c = self.bwt[row[open_]]
            row[open_] = self.before[c] + self.tree.rank(c, row[open_])
            steps[open_] += 1
            open_ = open_[~self.sampled[row[open_]]]
        return which, self.samples[self.place[row]] + steps
