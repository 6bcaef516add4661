"""Gradient-boosted trees with monotone constraints, kept as flat node arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """Node k of tree t goes to children 2k+1 and 2k+2; a leaf keeps its value in its lowest-left place."""

    depth: int
    base: float
    feature: np.ndarray  # (trees, inner nodes)
    threshold: np.ndarray  # go right beyond it; infinite where a node is no split
    value: np.ndarray  # (trees, 2 ** depth)

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of class 1 for each row, all trees side by side."""
        rows, trees = np.arange(len(x))[:, None], np.arange(len(self.feature))
        node = np.zeros((len(x), len(trees)), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[rows, self.feature[trees, node]] > self.threshold[trees, node])
        total = self.base + self.value[trees, node - (2**self.depth - 1)].sum(axis=1)
        return 1 / (1 + np.exp(-total))


def _best_split(bins: np.ndarray, grad: np.ndarray, hess: np.ndarray, n_bins: int, signs: list[int], lo: float, hi: float, penalty: float, least: float):
    """(gain, feature, last bin on the left, left value, right value) of the best split within the node's bounds, or None."""
    g, h = grad.sum(), hess.sum()
    own = np.clip(-g / (h + penalty), lo, hi)
    loss = lambda g, h, v: g * v + 0.5 * (h + penalty) * v * v
    best = None
    for f, sign in enumerate(signs):
        gl = np.cumsum(np.bincount(bins[:, f], grad, n_bins))[:-1]
        hl = np.cumsum(np.bincount(bins[:, f], hess, n_bins))[:-1]
        gr, hr = g - gl, h - hl
        left, right = np.clip(-gl / (hl + penalty), lo, hi), np.clip(-gr / (hr + penalty), lo, hi)
        gain = loss(g, h, own) - loss(gl, hl, left) - loss(gr, hr, right)
        gain[(hl < least) | (hr < least) | (sign * (right - left) < 0)] = -np.inf
        k = int(np.argmax(gain))
        if gain[k] > 1e-6 and (best is None or gain[k] > best[0]):
            best = (gain[k], f, k, left[k], right[k])
    return best


def fit(x: np.ndarray, y: np.ndarray, signs: list[int], trees: int = 60, depth: int = 4, rate: float = 0.2, n_bins: int = 64, penalty: float = 1.0, least: float = 2.0) -> Forest:
    """A forest for P(y = 1); signs: +1 or -1 where the score may only rise or fall with a feature, else 0.

    Every subtree of a constrained split is bounded by the middle of the two
    children's values, so that the constraint holds over whole trees.
    """
    inner, leaves = 2**depth - 1, 2**depth
    share = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    out = Forest(depth, float(np.log(share / (1 - share))), np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves)))
    if len(y) == 0 or y.min() == y.max():
        return out
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, n_bins + 1)[1:-1])) for f in range(x.shape[1])]
    bins = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    total = np.full(len(y), out.base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        grad, hess = p - y, p * (1 - p)
        nodes = [(0, np.arange(len(y)), -np.inf, np.inf)]
        while nodes:
            node, rows, lo, hi = nodes.pop()
            if node >= inner:
                value = np.clip(-grad[rows].sum() / (hess[rows].sum() + penalty), lo, hi) * rate if len(rows) else 0.0
                out.value[t, node - inner] = value
                total[rows] += value
                continue
            split = _best_split(bins[rows], grad[rows], hess[rows], n_bins, signs, lo, hi, penalty, least)
            if split is None:  # everything goes left
                nodes += [(2 * node + 1, rows, lo, hi), (2 * node + 2, rows[:0], lo, hi)]
                continue
            _, f, k, left, right = split
            out.feature[t, node], out.threshold[t, node] = f, cuts[f][k]
            middle = (left + right) / 2
            bounds = {0: (lo, hi, lo, hi), 1: (lo, middle, middle, hi), -1: (middle, hi, lo, middle)}[signs[f]]
            at = bins[rows, f] <= k
            nodes += [(2 * node + 1, rows[at], *bounds[:2]), (2 * node + 2, rows[~at], *bounds[2:])]
    return out
