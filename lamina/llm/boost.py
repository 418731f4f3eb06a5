"""Small classifiers in numpy: gradient-boosted trees, logistic regression on products, and their mean."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Trees of fixed depth, complete: at each level every node has its own split.

    Fitting is deterministic. With fewer than two classes in the sample the model is the constant share.
    """

    def __init__(self, rounds: int = 120, depth: int = 3, rate: float = 0.15, bins: int = 32, least: float = 4.0, ridge: float = 1.0) -> None:
        self.rounds, self.depth, self.rate, self.bins, self.least, self.ridge = rounds, depth, rate, bins, least, ridge
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> Boosted:
        x, y = np.asarray(x, float), np.asarray(y, float)
        n, k = x.shape
        w = np.ones(n) if weight is None else np.asarray(weight, float)
        share = float((w * y).sum() / w.sum())
        share = min(max(share, 1e-3), 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        if y.min() == y.max():
            return self
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(k)]
        binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1)
        score = np.full(n, self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            g, h = w * (y - p), w * p * (1 - p)
            node = np.zeros(n, int)
            inner = (1 << self.depth) - 1
            feature, cut = np.full(inner, -1), np.full(inner, np.inf)
            for level in range(self.depth):
                wide, start = 1 << level, (1 << level) - 1
                best = np.full(wide, 1e-6)
                choice = np.full((wide, 2), -1)
                for j in range(k):
                    size = len(cuts[j]) + 1
                    if size < 2:
                        continue
                    at = (node - start) * size + binned[:, j]
                    gs = np.bincount(at, g, wide * size).reshape(wide, size).cumsum(1)
                    hs = np.bincount(at, h, wide * size).reshape(wide, size).cumsum(1)
                    gl, hl, gt, ht = gs[:, :-1], hs[:, :-1], gs[:, -1:], hs[:, -1:]
                    gain = gl**2 / (hl + self.ridge) + (gt - gl) ** 2 / (ht - hl + self.ridge) - gt**2 / (ht + self.ridge)
                    gain[(hl < self.least / 4) | (ht - hl < self.least / 4)] = -1
                    top = gain.argmax(1)
                    value = gain[np.arange(wide), top]
                    better = value > best
                    best[better] = value[better]
                    choice[better, 0], choice[better, 1] = j, top[better]
                for m in range(wide):
                    j, b = choice[m]
                    if j >= 0:
                        feature[start + m], cut[start + m] = j, cuts[j][b]
                f = feature[node]
                right = (f >= 0) & (x[np.arange(n), np.maximum(f, 0)] > cut[node])
                node = node * 2 + 1 + right
            leaf = node - inner
            gs, hs = np.bincount(leaf, g, 1 << self.depth), np.bincount(leaf, h, 1 << self.depth)
            value = self.rate * gs / (hs + self.ridge)
            score += value[leaf]
            self.trees.append((feature, cut, value))
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds."""
        x = np.asarray(x, float)
        n = len(x)
        out, rows = np.full(n, self.base), np.arange(n)
        for feature, cut, value in self.trees:
            node = np.zeros(n, int)
            for _ in range(self.depth):
                f = feature[node]
                node = node * 2 + 1 + ((f >= 0) & (x[rows, np.maximum(f, 0)] > cut[node]))
            out += value[node - len(feature)]
        return out


class Quadratic:
    """Logistic regression on standardised figures and their products, with a ridge; fitted by Newton steps."""

    def __init__(self, ridge: float = 5.0, steps: int = 12) -> None:
        self.ridge, self.steps = ridge, steps

    def _spread(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((np.asarray(x, float) - self.mean) / self.scale, -4, 4)
        i, j = np.triu_indices(z.shape[1])
        return np.hstack([z, z[:, i] * z[:, j] / 3, np.ones((len(z), 1))])

    def fit(self, x: np.ndarray, y: np.ndarray) -> Quadratic:
        x, y = np.asarray(x, float), np.asarray(y, float)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        a = self._spread(x)
        self.w = np.zeros(a.shape[1])
        for _ in range(self.steps):
            p = 1 / (1 + np.exp(-np.clip(a @ self.w, -30, 30)))
            h = p * (1 - p) + 1e-6
            step = np.linalg.solve((a * h[:, None]).T @ a + self.ridge * np.eye(len(self.w)), a.T @ (p - y) + self.ridge * self.w)
            self.w -= step
            if np.abs(step).max() < 1e-3:
                break
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds."""
        return self._spread(x) @ self.w


class Blend:
    """Mean log odds of trees and logistic regression: the one learns more from many rows, the other from few."""

    def __init__(self) -> None:
        self.trees, self.smooth = Boosted(), None

    def fit(self, x: np.ndarray, y: np.ndarray) -> Blend:
        self.trees.fit(x, y)
        if len(y) and np.min(y) != np.max(y):
            self.smooth = Quadratic().fit(x, y)
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds."""
        if self.smooth is None:
            return self.trees.score(x)
        return (self.trees.score(x) + self.smooth.score(x)) / 2
