"""Small learners in numpy: they are fitted on bounded samples in the driver and applied to batches by the executors."""

from __future__ import annotations

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


class Logistic:
    """Ridge logistic regression over standardised columns, by Newton steps."""

    def __init__(self, ridge: float = 1.0, steps: int = 25):
        self.ridge, self.steps = ridge, steps

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> Logistic:
        w = np.ones(len(y)) if weight is None else weight
        self.mean, self.scale = x.mean(0), x.std(0)
        self.scale[self.scale < 1e-9] = 1.0
        z = self._design(x)
        beta = np.zeros(z.shape[1])
        penalty = np.full(z.shape[1], self.ridge)
        penalty[-1] = 1e-6
        for _ in range(self.steps):
            p = sigmoid(z @ beta)
            gradient = z.T @ (w * (p - y)) + penalty * beta
            hessian = (z * (w * p * (1 - p))[:, None]).T @ z + np.diag(penalty)
            step = np.linalg.solve(hessian, gradient)
            beta -= step
            if np.abs(step).max() < 1e-6:
                break
        self.beta = beta
        return self

    def _design(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.hstack([z, np.ones((len(x), 1))])

    def score(self, x: np.ndarray) -> np.ndarray:
        return self._design(x) @ self.beta

    def predict(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.score(x))


class BoostedTrees:
    """Gradient-boosted regression trees for the log loss, over columns binned at quantiles; leaves by Newton steps."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, least: int = 5, ridge: float = 1.0):
        self.trees_wanted, self.depth, self.rate, self.bins, self.least, self.ridge = trees, depth, rate, bins, least, ridge

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = self._binned(x)
        share = np.clip(y.mean() if len(y) else 0.0, 1e-3, 1 - 1e-3)
        self.start = float(np.log(share / (1 - share)))
        z, self.trees = np.full(len(y), self.start), []
        for _ in range(self.trees_wanted if len(y) else 0):
            p = sigmoid(z)
            tree = self._tree(binned, p - y, p * (1 - p))
            self.trees.append(tree)
            z += self._walk(tree, binned)
        return self

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, v, side="left") for c, v in zip(self.cuts, x.T, strict=True)], axis=1)

    def _tree(self, binned: np.ndarray, g: np.ndarray, h: np.ndarray) -> list[tuple]:
        """Nodes in heap order: (column, last bin of the left side) or (value,)."""
        nodes: list[tuple] = [()] * (2 ** (self.depth + 1) - 1)
        todo = [(0, np.arange(len(g)))]
        while todo:
            at, rows = todo.pop()
            best = self._split(binned[rows], g[rows], h[rows]) if at < 2**self.depth - 1 else None
            if best is None:
                nodes[at] = (-self.rate * g[rows].sum() / (h[rows].sum() + self.ridge),)
                continue
            column, cut = best
            nodes[at] = (column, cut)
            left = binned[rows, column] <= cut
            todo += [(2 * at + 1, rows[left]), (2 * at + 2, rows[~left])]
        return nodes

    def _split(self, b: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[int, int] | None:
        best, found = 1e-6, None
        whole = g.sum() ** 2 / (h.sum() + self.ridge)
        for column, cuts in enumerate(self.cuts):
            n = len(cuts) + 1
            if n == 1:
                continue
            gs, hs, ns = (np.cumsum(np.bincount(b[:, column], weights=v, minlength=n))[:-1] for v in (g, h, np.ones(len(g))))
            gain = gs**2 / (hs + self.ridge) + (g.sum() - gs) ** 2 / (h.sum() - hs + self.ridge) - whole
            gain[(ns < self.least) | (len(g) - ns < self.least)] = -1
            k = int(gain.argmax())
            if gain[k] > best:
                best, found = gain[k], (column, k)
        return found

    def _walk(self, nodes: list[tuple], binned: np.ndarray) -> np.ndarray:
        out, todo = np.zeros(len(binned)), [(0, np.arange(len(binned)))]
        while todo:
            at, rows = todo.pop()
            if len(nodes[at]) == 1:
                out[rows] = nodes[at][0]
                continue
            column, cut = nodes[at]
            left = binned[rows, column] <= cut
            todo += [(2 * at + 1, rows[left]), (2 * at + 2, rows[~left])]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        binned = self._binned(x)
        z = np.full(len(x), self.start)
        for tree in self.trees:
            z += self._walk(tree, binned)
        return z


class Isotonic:
    """Pooled adjacent violators: a rising step function from scores to shares, joined linearly between block centres."""

    def fit(self, score: np.ndarray, y: np.ndarray) -> Isotonic:
        order = np.argsort(score, kind="stable")
        blocks: list[list[float]] = []  # sum of y, rows, sum of scores
        for s, t in zip(score[order], y[order], strict=True):
            blocks.append([float(t), 1.0, float(s)])
            while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
                a = blocks.pop()
                blocks[-1] = [p + q for p, q in zip(blocks[-1], a, strict=True)]
        self.x = np.array([b[2] / b[1] for b in blocks] or [0.0])
        self.y = np.array([b[0] / b[1] for b in blocks] or [0.5])
        return self

    def predict(self, score: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(score, self.x, self.y), 0.0, 1.0)
