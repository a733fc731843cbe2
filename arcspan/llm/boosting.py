"""Histogram gradient-boosted trees for two classes, in numpy.

Features are cut into at most 64 quantile bins; trees grow level by level to a fixed depth on
histograms of gradients and Hessians of the log loss. A model is four flat arrays (feature,
threshold, leaf value, all trees in breadth-first order), and scoring walks all rows down one
level of a tree at a time by index arithmetic. Also here: isotonic calibration.

Edge cases: with no rows, or rows of one class only, the model is the smoothed share of the class;
missing features (NaN) count as the lowest value.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """A fitted model in flat arrays; tree t has its inner nodes at t * (2**depth - 1) on."""

    depth: int
    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of the rows of `x`."""
        x = np.nan_to_num(x, nan=-1e300, posinf=1e300, neginf=-1e300)
        rows, inner, leaves = np.arange(len(x)), 2**self.depth - 1, 2**self.depth
        out = np.full(len(x), self.base)
        for t in range(len(self.leaf) // leaves):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = t * inner + node
                node = 2 * node + 1 + (x[rows, self.feature[at]] > self.threshold[at])
            out += self.leaf[t * leaves + node - inner]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1."""
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, l2: float = 1.0, bins: int = 64) -> Trees:
    """Fit to features `x` (rows by columns) and labels `y` (0 or 1)."""
    n = len(y)
    share = (y.sum() + 0.5) / (n + 1)
    base = float(np.log(share / (1 - share)))
    inner, leaves = 2**depth - 1, 2**depth
    if n == 0 or y.min() == y.max():
        return Trees(depth, base, np.zeros(0, np.int64), np.zeros(0), np.zeros(0))
    x = np.nan_to_num(x, nan=-1e300, posinf=1e300, neginf=-1e300)
    columns = x.shape[1]
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins)[1:-1], method="lower")) for j in range(columns)]
    binned = np.stack([np.searchsorted(cuts[j], x[:, j], "left") for j in range(columns)], 1)
    offset = np.arange(columns) * bins
    feature, threshold, leaf = [], [], []
    margin = np.full(n, base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(n, np.int64)
        f, cut, at_bin = np.zeros(inner, np.int64), np.full(inner, np.inf), np.full(inner, bins)
        for level in range(depth):
            first, here = 2**level - 1, 2**level
            key = ((node - first)[:, None] * (columns * bins) + offset + binned).ravel()
            shape = (here, columns, bins)
            gs = np.bincount(key, np.repeat(g, columns), here * columns * bins).reshape(shape).cumsum(2)
            hs = np.bincount(key, np.repeat(h, columns), here * columns * bins).reshape(shape).cumsum(2)
            gt, ht = gs[:, :, -1:], hs[:, :, -1:]
            gain = gs**2 / (hs + l2) + (gt - gs) ** 2 / (ht - hs + l2) - gt**2 / (ht + l2)
            gain[(hs < 1) | (ht - hs < 1)] = 0
            best = gain.reshape(here, -1).argmax(1)
            for k in range(here):
                j, b = divmod(int(best[k]), bins)
                if gain[k, j, b] > 1e-9 and b < len(cuts[j]):
                    f[first + k], cut[first + k], at_bin[first + k] = j, cuts[j][b], b
            node = 2 * node + 1 + (binned[np.arange(n), f[node]] > at_bin[node])
        where = node - inner
        values = -np.bincount(where, g, leaves) / (np.bincount(where, h, leaves) + l2) * rate
        margin += values[where]
        feature.append(f)
        threshold.append(cut)
        leaf.append(values)
    return Trees(depth, base, np.concatenate(feature), np.concatenate(threshold), np.concatenate(leaf))


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots (score, probability) of the non-decreasing least-squares fit; between them, linear."""
    order = np.argsort(score, kind="stable")
    s, blocks = score[order], []
    for a, b in zip(s, y[order].astype(float)):
        blocks.append([b, 1, a, a])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            total, n, _, high = blocks.pop()
            blocks[-1] = [blocks[-1][0] + total, blocks[-1][1] + n, blocks[-1][2], high]
    knots = [(x, total / n) for total, n, low, high in blocks for x in ((low, high) if low < high else (low,))]
    if not knots:
        return np.array([0.0, 1.0]), np.array([0.0, 1.0])
    return np.array([k[0] for k in knots]), np.array([k[1] for k in knots])


def folds(keys: np.ndarray, k: int = 4) -> np.ndarray:
    """A fold for each row, from the integer key of its document: copies of a row share one."""
    mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(40)) % np.uint64(k)).astype(np.int64)
