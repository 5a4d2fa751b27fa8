"""Gradient-boosted trees in numpy, with monotone features and flat node arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class BoostedTrees:
    """Trees as node arrays of equal length: node i of a tree goes to ``left`` if feature < threshold, else to ``right``."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row: all trees of all rows go down one level at a time."""
        node = np.zeros((len(x), len(self.feature)), dtype=np.int64)
        tree = np.arange(len(self.feature))[None, :]
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            f = self.feature[tree, node]
            below = x[row, f] < self.threshold[tree, node]
            node = np.where(below, self.left[tree, node], self.right[tree, node])
        return self.base + self.value[tree, node].sum(axis=1)


def fit(x: np.ndarray, y: np.ndarray, monotone: np.ndarray, trees: int = 24, depth: int = 3, rate: float = 0.3, bins: int = 64, reg: float = 1.0) -> BoostedTrees:
    """Trees for logistic loss; ``monotone``: 1 where the score may never fall as the feature grows, 0 where it may.

    A split on a monotone feature must give the right side the greater value,
    and the two sides' descendants are held on either side of the midpoint, so
    every tree, and with it the sum, is monotone.
    """
    n, width = x.shape
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(0) for f in range(width)]
    binned = [np.searchsorted(c, x[:, f], side="right") for f, c in enumerate(cuts)]
    rate_of = min(max(float(y.mean()) if n else 0.5, 1e-3), 1 - 1e-3)
    base = float(np.log(rate_of / (1 - rate_of)))
    nodes = 2 ** (depth + 1) - 1
    shape = (trees, nodes)
    out = BoostedTrees(np.zeros(shape, np.int64), np.full(shape, np.inf), np.tile(np.arange(nodes), (trees, 1)), np.tile(np.arange(nodes), (trees, 1)), np.zeros(shape), base, depth)
    score = np.full(n, base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, np.maximum(p * (1 - p), 1e-9)
        todo = [(0, np.arange(n), -np.inf, np.inf, 0)]
        while todo:
            node, rows, low, high, level = todo.pop()
            weight = lambda a, b: min(max(rate * a / (b + reg), low), high)
            total_g, total_h = g[rows].sum(), h[rows].sum()
            out.value[t, node] = weight(total_g, total_h)
            best = (1e-9, None)
            if level < depth and len(rows) >= 2:
                for f in range(width):
                    k = len(cuts[f]) + 1
                    gl, hl = (np.cumsum(np.bincount(binned[f][rows], weights=v[rows], minlength=k))[:-1] for v in (g, h))
                    if not len(gl):
                        continue
                    gr, hr = total_g - gl, total_h - hl
                    vl, vr = (np.clip(rate * a / (b + reg), low, high) for a, b in ((gl, hl), (gr, hr)))
                    gain = gl**2 / (hl + reg) + gr**2 / (hr + reg) - total_g**2 / (total_h + reg)
                    allowed = (hl > 1e-6) & (hr > 1e-6) & ((vl <= vr) | (monotone[f] == 0))
                    gain = np.where(allowed, gain, -np.inf)
                    i = int(np.argmax(gain))
                    if gain[i] > best[0]:
                        best = (float(gain[i]), (f, i, float(vl[i]), float(vr[i])))
            if best[1] is None:
                score[rows] += out.value[t, node]
                continue
            f, i, vl, vr = best[1]
            l, r = 2 * node + 1, 2 * node + 2
            out.feature[t, node], out.threshold[t, node], out.left[t, node], out.right[t, node] = f, cuts[f][i], l, r
            goes = binned[f][rows] <= i
            middle = (vl + vr) / 2
            bounds = ((low, min(high, middle)), (max(low, middle), high)) if monotone[f] else ((low, high), (low, high))
            todo += [(l, rows[goes], *bounds[0], level + 1), (r, rows[~goes], *bounds[1], level + 1)]
    return out
