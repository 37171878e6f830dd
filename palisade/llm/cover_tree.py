"""A cover tree over vectors made equally long, for inner products in windows.

A candidate x of length at most M gets one more coordinate, sqrt(M^2 - |x|^2); a query gets a zero. Then
|q - x|^2 = |q|^2 + M^2 - 2 <q, x>, so distances in the tree are inner products. A node covers its points within its
radius; its children are centres at least that far apart, found farthest first, the first of them its own centre. A
leaf is a stretch of points. From the radius follow the least and the largest inner product a node can hold.
"""

from __future__ import annotations

import numpy as np

FAN = 16
LEAF = 128
#: Of (M + |q|)^2: more than rounding can move a bound.
SLACK = 1e-6


def augmented(x: np.ndarray, longest: float) -> np.ndarray:
    return np.hstack([x, np.sqrt(np.maximum(0, longest * longest - (x * x).sum(axis=1)))[:, None]])


def distances(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - centre) ** 2).sum(axis=1))


def farthest_first(x: np.ndarray, most: int, stop: float = 0.0) -> tuple[list[int], np.ndarray, np.ndarray]:
    """(centres, nearest centre of every row, distance to it), until all rows are within ``stop`` or there are ``most``."""
    centres, near, dist = [0], np.zeros(len(x), np.int64), distances(x, x[0])
    while len(centres) < most:
        far = int(dist.argmax())
        if dist[far] <= stop:
            break
        d = distances(x, x[far])
        closer = d < dist
        near[closer], dist[closer] = len(centres), d[closer]
        centres.append(far)
    return centres, near, dist


def bounds(q: np.ndarray, centres: np.ndarray, radius: np.ndarray, longest: float) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest inner product of every query with points within ``radius`` of every (not augmented) centre."""
    length = np.sqrt((q * q).sum(axis=1))[:, None]
    product = q @ centres.T
    whole = length ** 2 + longest ** 2
    d = np.sqrt(np.maximum(0, whole - 2 * product))
    slack = SLACK * (longest + length) ** 2
    low = np.maximum(product - length * radius, (whole - (d + radius) ** 2) / 2) - slack
    high = np.minimum(product + length * radius, (whole - np.maximum(0, d - radius) ** 2) / 2) + slack
    return low, high


def label_bit(label: np.ndarray) -> np.ndarray:
    return np.left_shift(np.uint64(1), (label % 64).astype(np.uint64))


def top(key: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best of every key: larger score, then smaller id."""
    order = np.lexsort((ids, -score, key))
    sorted_key = key[order]
    start = np.flatnonzero(np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])) if len(order) else np.zeros(0, int)
    return order[np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order)))) < k]


class CoverTree:
    """Levels of (centre, radius, parent, labels, leaf); the points stand in the order of their leaves."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, longest: float):
        self.longest, self.levels, leaves = longest, [], []
        whole, bit = augmented(x, longest), label_bit(labels)
        level = [(np.arange(len(x)), -1, distances(whole, whole[0]).max() if len(x) else 0.0)] if len(x) else []
        while level:
            rows, below = [], []
            for points, parent, radius in level:
                split = len(points) > LEAF and radius > 0
                rows.append((points[0], radius, parent, np.bitwise_or.reduce(bit[points]), -1 if split else len(leaves)))
                if not split:
                    leaves.append(points)
                    continue
                centres, near, dist = farthest_first(whole[points], FAN, radius / 2)
                for c, centre in enumerate(centres):
                    mine = np.flatnonzero(near == c)
                    first = np.concatenate([[centre], mine[mine != centre]])  # the centre stands first
                    below.append((points[first], len(rows) - 1, dist[mine].max()))
            self.levels.append(tuple(np.array(c) for c in zip(*rows)))
            level = below
        order = np.concatenate(leaves) if leaves else np.zeros(0, np.int64)
        self.ends = np.concatenate([[0], np.cumsum([len(p) for p in leaves])]).astype(np.int64)
        self.centres = [x[centre] for centre, *_ in self.levels]
        self.ids, self.labels, self.x = ids[order], labels[order], x[order]

    def search(self, q: np.ndarray, own: np.ndarray, label: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(query, window, id, score) of the k best points of every query's windows [low, high].

        Of points with the query's label but another id (``same``), or of points with another label.
        """
        m, w = low.shape
        limit = low.copy()  # of every window: what a point must reach to matter
        n_leaves = len(self.ends) - 1
        leaf_low, leaf_high = np.full((m, n_leaves), np.inf), np.full((m, n_leaves), -np.inf)
        alive = None
        for (_, radius, parent, mask, leaf), centres in zip(self.levels, self.centres):
            lo, hi = bounds(q, centres, radius, self.longest)
            ok = np.zeros(lo.shape, bool)
            for i in range(w):
                ok |= (lo <= high[:, i:i + 1]) & (hi >= limit[:, i:i + 1])
            if same:
                ok &= (label_bit(label)[:, None] & mask[None, :]) > 0
            alive = ok if alive is None else ok & alive[:, parent]
            at = np.flatnonzero(leaf >= 0)
            leaf_low[:, leaf[at]] = np.where(alive[:, at], lo[:, at], np.inf)
            leaf_high[:, leaf[at]] = np.where(alive[:, at], hi[:, at], -np.inf)
        best_first = np.argsort(-leaf_high, axis=1, kind="stable")
        none = np.zeros(0, np.int64)
        key, ids, score = none, none, np.zeros(0)
        done, wave = 0, 1
        while done < n_leaves:
            leaf = best_first[:, done:done + wave]
            lo, hi = np.take_along_axis(leaf_low, leaf, 1), np.take_along_axis(leaf_high, leaf, 1)
            wanted = np.zeros(leaf.shape, bool)
            for i in range(w):
                wanted |= (lo <= high[:, i:i + 1]) & (np.minimum(hi, high[:, i:i + 1]) >= limit[:, i:i + 1])
            if not (leaf_high[np.arange(m), best_first[:, done]] > -np.inf).any():
                break
            found = [(key, ids, score)]
            row, column = np.nonzero(wanted)
            order = np.argsort(leaf[row, column], kind="stable")
            row, which = row[order], leaf[row, column][order]
            for part in np.split(np.arange(len(row)), np.flatnonzero(np.diff(which)) + 1) if len(row) else []:
                a, points = row[part], slice(self.ends[which[part[0]]], self.ends[which[part[0]] + 1])
                s = q[a] @ self.x[points].T
                equal = self.labels[points][None, :] == label[a][:, None]
                fit = equal & (self.ids[points][None, :] != own[a][:, None]) if same else ~equal
                for i in range(w):
                    at, point = np.nonzero(fit & (s >= limit[a, i][:, None]) & (s <= high[a, i][:, None]))
                    found.append((a[at] * w + i, self.ids[points][point], s[at, point]))
            key, ids, score = (np.concatenate([f[c] for f in found]) for c in range(3))
            keep = top(key, ids, score, k)
            key, ids, score = key[keep], ids[keep], score[keep]
            full, count = np.unique(key, return_counts=True)
            full = full[count == k]
            last = np.searchsorted(key, full, side="right") - 1
            limit[full // w, full % w] = np.maximum(limit[full // w, full % w], score[last])
            done, wave = done + wave, wave * 2
        return key // w, key % w, ids, score
