"""Small learners on bounded samples, in numpy: logistic regression, gradient-boosted trees, isotonic regression."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


class Logistic:
    """L2-regularised logistic regression by Newton steps on standardised features."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, l2: float = 1.0):
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        z = np.column_stack([np.ones(len(x)), (x - self.mean) / self.scale])
        weight = np.ones(len(x)) if weight is None else weight
        penalty = np.full(z.shape[1], l2)
        penalty[0] = 1e-3
        self.w = np.zeros(z.shape[1])
        for _ in range(25):
            p = sigmoid(z @ self.w)
            step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (weight * (p - y)) + penalty * self.w)
            self.w -= step
            if np.abs(step).max() < 1e-6:
                break

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Each row is summed by itself, in one order: equal rows of batches of any size have equal bits, as by ``@`` they wouldn't."""
        return self.w[0] + np.ascontiguousarray((x - self.mean) / self.scale * self.w[1:]).sum(axis=1)


class Boosted:
    """Gradient-boosted regression trees for log loss, Newton leaf values, on features cut into quantile bins."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, least: float = 5.0, l2: float = 1.0):
        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
        binned = self.binned(x)
        base = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base, self.rate, self.depth = float(np.log(base / (1 - base))), rate, depth
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        margin = np.full(len(y), self.base)
        for _ in range(trees):
            p = sigmoid(margin)
            tree = self._grow(binned, p - y, p * (1 - p), bins, least, l2)
            self.trees.append(tree)
            margin += rate * self._leaf(tree, binned)

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(self.cuts)]).astype(np.int64)

    def _grow(self, b: np.ndarray, g: np.ndarray, h: np.ndarray, bins: int, least: float, l2: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A full tree of ``depth`` levels: feature and cut of each inner node (cut = bins where it doesn't split), value of each leaf."""
        n_inner = (1 << self.depth) - 1
        feature, cut = np.zeros(n_inner, np.int64), np.full(n_inner, bins)
        node = np.zeros(len(g), np.int64)
        for level in range(self.depth):
            first, many = (1 << level) - 1, 1 << level
            best = np.full(many, 1e-6)
            for j in range(b.shape[1]):
                key = (node - first) * (bins + 1) + b[:, j]
                gs, hs = (np.bincount(key, weights=v, minlength=many * (bins + 1)).reshape(many, bins + 1) for v in (g, h))
                gl, hl = gs.cumsum(axis=1), hs.cumsum(axis=1)
                gt, ht = gl[:, -1:], hl[:, -1:]
                gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
                gain[(hl < least / 10) | (ht - hl < least / 10)] = 0
                at = gain[:, :-1].argmax(axis=1)
                top = gain[np.arange(many), at]
                better = top > best
                best[better] = top[better]
                feature[first : first + many][better], cut[first : first + many][better] = j, at[better]
            node = 2 * node + 1 + (b[np.arange(len(b)), feature[node]] > cut[node])
        leaf = node - n_inner
        gs, hs = (np.bincount(leaf, weights=v, minlength=n_inner + 1) for v in (g, h))
        return feature, cut, -gs / (hs + l2)

    def _leaf(self, tree: tuple[np.ndarray, np.ndarray, np.ndarray], b: np.ndarray) -> np.ndarray:
        feature, cut, value = tree
        node = np.zeros(len(b), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (b[np.arange(len(b)), feature[node]] > cut[node])
        return value[node - len(feature)]

    def margin(self, x: np.ndarray) -> np.ndarray:
        b = self.binned(x)
        return self.base + self.rate * sum((self._leaf(t, b) for t in self.trees), np.zeros(len(x)))


class Isotonic:
    """Pool-adjacent-violators fit of labels on a margin; between the blocks' means it is linear, at the ends constant."""

    def __init__(self, margin: np.ndarray, y: np.ndarray):
        order = np.argsort(margin, kind="stable")
        blocks: list[list[float]] = []  # sum of labels, size, sum of margins
        for m, label in zip(margin[order], y[order]):
            blocks.append([float(label), 1.0, float(m)])
            while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
                last = blocks.pop()
                blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
        self.x = np.array([b[2] / b[1] for b in blocks] or [0.0])
        self.y = np.array([b[0] / b[1] for b in blocks] or [0.5])

    def __call__(self, margin: np.ndarray) -> np.ndarray:
        return np.interp(margin, self.x, self.y)
