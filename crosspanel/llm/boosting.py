"""Gradient-boosted regression trees for a binary outcome, in numpy, with Platt calibration."""

from __future__ import annotations

import numpy as np

BINS = 32


class Boosted:
    """Second-order boosting of shallow trees over quantile bins; small training sets only."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.2, ridge: float = 1.0) -> None:
        self.trees, self.depth, self.rate, self.ridge = trees, depth, rate, ridge
        self.forest: list[list[tuple[int, float, float]]] = []
        self.scale, self.shift, self.base = 1.0, 0.0, 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(q, c, "left") for q, c in zip(cuts, x.T, strict=True)], 1)
        self.base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        margin = np.full(len(y), self.base)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-margin))
            tree, step = self._grow(binned, cuts, y - p, p * (1 - p))
            self.forest.append(tree)
            margin += step
        return self

    def _grow(self, binned: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, h: np.ndarray) -> tuple[list[tuple[int, float, float]], np.ndarray]:
        """A complete tree as nodes (feature or -1, cut, value) in heap order, and its step for each row."""
        size = 2 ** (self.depth + 1) - 1
        tree = [(-1, 0.0, 0.0)] * size
        node = np.zeros(len(g), int)
        for at in range(size):
            rows = np.flatnonzero(node == at)
            if not len(rows):
                continue
            total_g, total_h = g[rows].sum(), h[rows].sum()
            best = (1e-6, -1, 0)
            if 2 * at + 2 < size and len(rows) >= 8:
                for f, q in enumerate(cuts):
                    if not len(q):
                        continue
                    left_g = np.cumsum(np.bincount(binned[rows, f], g[rows], len(q) + 1))[:-1]
                    left_h = np.cumsum(np.bincount(binned[rows, f], h[rows], len(q) + 1))[:-1]
                    gain = left_g**2 / (left_h + self.ridge) + (total_g - left_g) ** 2 / (total_h - left_h + self.ridge) - total_g**2 / (total_h + self.ridge)
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (float(gain[k]), f, k)
            if best[1] < 0:
                tree[at] = (-1, 0.0, self.rate * float(total_g / (total_h + self.ridge)))
            else:
                tree[at] = (best[1], float(cuts[best[1]][best[2]]), 0.0)
                node[rows] = 2 * at + 1 + (binned[rows, best[1]] > best[2])
        return tree, np.array([tree[n][2] for n in node])

    def margin(self, row: list[float]) -> float:
        total = self.base
        for tree in self.forest:
            at = 0
            while (f := tree[at][0]) >= 0:
                at = 2 * at + 1 + (row[f] > tree[at][1])
            total += tree[at][2]
        return total

    def calibrate(self, x: list[list[float]], y: np.ndarray) -> Boosted:
        """Platt scaling of the margin on rows that were not trained on."""
        m = np.array([self.margin(r) for r in x])
        a, b = 1.0, 0.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-(a * m + b)))
            w = p * (1 - p) + 1e-9
            grad = np.array([((y - p) * m).sum() - 1e-2 * (a - 1), (y - p).sum()])
            hess = np.array([[(w * m * m).sum() + 1e-2, (w * m).sum()], [(w * m).sum(), w.sum() + 1e-2]])
            da, db = np.linalg.solve(hess, grad)
            a, b = a + da, b + db
            if abs(da) + abs(db) < 1e-8:
                break
        self.scale, self.shift = float(a), float(b)
        return self

    def probability(self, row: list[float]) -> float:
        return float(1 / (1 + np.exp(-(self.scale * self.margin(row) + self.shift))))
