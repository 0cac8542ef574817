"""Gradient-boosted regression trees on binned features with logistic loss, in numpy."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class BoostedTrees:
    """Complete trees of fixed depth; node i has children 2i + 1 and 2i + 2."""

    depth: int
    base: float = 0.0
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)  # feature, bound (inner nodes), value (leaves)

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for feature, bound, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > bound[node])
            out += value[node - (2**self.depth - 1)]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x)))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 32, ridge: float = 1.0) -> BoostedTrees:
    share = min(max(y.mean(), 1e-3), 1 - 1e-3) if len(y) else 1e-3
    model = BoostedTrees(depth, float(np.log(share / (1 - share))))
    if not len(y):
        return model
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1)
    raw = np.full(len(y), model.base)
    inner = 2**depth - 1
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-raw))
        grad, hess = y - p, p * (1 - p)
        feature, bound = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(y), np.int64)
        for at in range(inner):
            rows = np.flatnonzero(node == at)
            best = 1e-6
            cut = None
            if len(rows) > 1:
                total_g, total_h = grad[rows].sum(), hess[rows].sum()
                for f, e in enumerate(edges):
                    if not len(e):
                        continue
                    g = np.cumsum(np.bincount(binned[rows, f], grad[rows], len(e) + 1))[:-1]
                    h = np.cumsum(np.bincount(binned[rows, f], hess[rows], len(e) + 1))[:-1]
                    gain = g**2 / (h + ridge) + (total_g - g) ** 2 / (total_h - h + ridge) - total_g**2 / (total_h + ridge)
                    if gain.max() > best:
                        best, cut = gain.max(), (f, int(gain.argmax()))
            if cut:
                feature[at], bound[at] = cut[0], edges[cut[0]][cut[1]]
                node[rows] = 2 * at + 1 + (binned[rows, cut[0]] > cut[1])
            else:
                node[rows] = 2 * at + 1
        leaf = node - inner
        value = rate * np.bincount(leaf, grad, 2**depth) / (np.bincount(leaf, hess, 2**depth) + ridge)
        raw += value[leaf]
        model.trees.append((feature, bound, value))
    return model
