"""Small learners in numpy: isotonic calibration, ridge by normal equations, boosted trees."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Isotonic:
    """A nondecreasing map of scores to chances, by pooling adjacent violators; linear between the knots."""

    x: np.ndarray
    y: np.ndarray

    @classmethod
    def fit(cls, score: np.ndarray, label: np.ndarray) -> Isotonic:
        """Ties in score are pooled first. Each block is shrunk by one pseudo-row of the overall rate."""
        if not len(score):
            return cls(np.zeros(1), np.full(1, 0.5))
        x, inverse = np.unique(score, return_inverse=True)
        n = np.bincount(inverse).astype(float)
        s = np.bincount(inverse, label)
        rate = float(np.mean(label))
        blocks: list[list[float]] = []  # sum, rows, first x, last x
        for xi, si, ni in zip(x, s, n, strict=True):
            blocks.append([si, ni, xi, xi])
            while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
                b = blocks.pop()
                a = blocks[-1]
                a[0], a[1], a[3] = a[0] + b[0], a[1] + b[1], b[3]
        xs, ys = [], []
        for si, ni, lo, hi in blocks:
            p = (si + rate) / (ni + 1)
            xs += [lo, hi] if hi > lo else [lo]
            ys += [p, p] if hi > lo else [p]
        return cls(np.array(xs), np.maximum.accumulate(np.array(ys)))

    def __call__(self, score: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(score, self.x, self.y), 0.0, 1.0)


def ridge(gram: np.ndarray, moment: np.ndarray, penalty: float) -> np.ndarray:
    """Weights from the normal equations; the last feature is the constant and is not penalised."""
    a = gram + penalty * np.eye(len(gram))
    a[-1, -1] -= penalty * (1 - 1e-9)
    return np.linalg.solve(a, moment)


@dataclass
class Trees:
    """Gradient-boosted regression trees of fixed depth for the logistic loss, on binned features."""

    rounds: int = 80
    depth: int = 3
    rate: float = 0.15
    bins: int = 64
    smooth: float = 1.0
    least: float = 1.0  # hessian of a leaf
    start: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)], axis=1).astype(np.int64) if len(x) else np.zeros(x.shape, np.int64)

    def fit(self, x: np.ndarray, label: np.ndarray) -> Trees:
        n, m = x.shape
        mean = min(max(float(label.mean()) if n else 0.5, 1e-3), 1 - 1e-3)
        self.start = float(np.log(mean / (1 - mean)))
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins)[1:-1])) if n else np.zeros(0) for j in range(m)]
        self.trees = []
        if not n or label.min() == label.max():
            return self
        b = self._binned(x)
        cells = b + np.arange(m) * self.bins  # one histogram for all features
        f = np.full(n, self.start)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-f))
            g, h = label - p, p * (1 - p)
            split = np.full((2**self.depth - 1, 2), [0, self.bins], np.int64)  # feature, last bin to the left
            node = np.zeros(n, np.int64)
            for at in range(2**self.depth - 1):
                rows = np.flatnonzero(node == at)
                if len(rows) > 1:
                    c = cells[rows].ravel()
                    gg = np.bincount(c, np.repeat(g[rows], m), m * self.bins).reshape(m, self.bins)
                    hh = np.bincount(c, np.repeat(h[rows], m), m * self.bins).reshape(m, self.bins)
                    gl, hl = gg.cumsum(1)[:, :-1], hh.cumsum(1)[:, :-1]
                    gt, ht = gg[0].sum(), hh[0].sum()
                    gain = gl**2 / (hl + self.smooth) + (gt - gl) ** 2 / (ht - hl + self.smooth) - gt**2 / (ht + self.smooth)
                    gain[(hl < self.least) | (ht - hl < self.least)] = 0
                    k = int(gain.argmax())
                    if gain.flat[k] > 1e-6:
                        split[at] = divmod(k, self.bins - 1)
                right = b[rows, split[at, 0]] > split[at, 1]
                node[rows] = 2 * at + 1 + right
            leaf = node - (2**self.depth - 1)
            value = np.bincount(leaf, g, 2**self.depth) / (np.bincount(leaf, h, 2**self.depth) + self.smooth)
            self.trees.append((split[:, 0].copy(), split[:, 1].copy(), self.rate * value))
            f += self.rate * value[leaf]
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.start)
        if not len(x):
            return f
        b, rows = self._binned(x), np.arange(len(x))
        for feature, last, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (b[rows, feature[node]] > last[node])
            f += value[node - (2**self.depth - 1)]
        return f
