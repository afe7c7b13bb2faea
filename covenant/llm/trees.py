"""Gradient-boosted trees in numpy: logistic loss, histograms, monotonic constraints, flat node arrays for scoring."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60.0, 60.0)))


@dataclass
class Forest:
    """All trees' nodes one after another. A leaf's children are itself, so scoring walks ``depth`` steps without a branch."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    bias: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of every row of ``x`` (rows x features)."""
        out = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for root in self.roots.tolist():
            node = np.full(len(x), root, np.int64)
            for _ in range(self.depth):
                node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            out += self.value[node]
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.margin(x))


def fit(x: np.ndarray, y: np.ndarray, monotone: np.ndarray | None = None, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, l2: float = 1.0, least: float = 1.0) -> Forest:
    """Fits on features ``x`` and 0/1 labels ``y``.

    ``monotone`` has +1, -1 or 0 for each feature: the margin may only rise, only fall, or do either, in it.
    A split that breaks a constraint isn't made, and the values below a constrained split stay on their
    side of the middle between its children, so the whole tree keeps the order. The same rows in any order
    may round differently; the same rows in the same order give the same forest. With no rows, or one
    class alone, the forest is a constant.
    """
    n, m = x.shape
    monotone = np.zeros(m, int) if monotone is None else np.asarray(monotone)
    mean = float(np.clip((y.sum() + 0.5) / (n + 1.0), 1e-4, 1 - 1e-4))
    nodes: list[list] = []  # feature, threshold, left, right, value
    roots: list[int] = []
    bias = float(np.log(mean / (1 - mean)))
    if n and 0 < y.sum() < n:
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
        binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
        score = np.full(n, bias)
        for _ in range(trees):
            p = sigmoid(score)
            g, h = p - y, p * (1 - p)
            roots.append(len(nodes))
            grown = [(len(nodes), np.arange(n), -np.inf, np.inf, 0)]
            nodes.append([0, np.inf, 0, 0, 0.0])
            while grown:
                at, rows, low, high, level = grown.pop()
                gs, hs = g[rows].sum(), h[rows].sum()
                value = float(np.clip(-gs / (hs + l2), low, high))
                nodes[at] = [0, np.inf, at, at, value * rate]
                found = None
                if level < depth and len(rows) >= 2:
                    for j in range(m):
                        k = len(edges[j])
                        if not k:
                            continue
                        gl = np.cumsum(np.bincount(binned[rows, j], g[rows], k + 1))[:-1]
                        hl = np.cumsum(np.bincount(binned[rows, j], h[rows], k + 1))[:-1]
                        gr, hr = gs - gl, hs - hl
                        gain = gl**2 / (hl + l2) + gr**2 / (hr + l2) - gs**2 / (hs + l2)
                        gain[(hl < least) | (hr < least)] = -np.inf
                        if monotone[j]:
                            vl, vr = np.clip(-gl / (hl + l2), low, high), np.clip(-gr / (hr + l2), low, high)
                            gain[(vr - vl) * monotone[j] < 0] = -np.inf
                        b = int(np.argmax(gain))
                        if gain[b] > 1e-6 and (found is None or gain[b] > found[0]):
                            found = gain[b], j, b, float(np.clip(-gl[b] / (hl[b] + l2), low, high)), float(np.clip(-gr[b] / (hr[b] + l2), low, high))
                if found is None:
                    score[rows] += value * rate
                    continue
                _, j, b, vl, vr = found
                goes = binned[rows, j] <= b
                middle = (vl + vr) / 2
                bounds = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}.get(int(monotone[j]), ((low, high), (low, high)))
                first = len(nodes)
                nodes[at] = [j, float(edges[j][b]), first, first + 1, 0.0]
                nodes += [[0, np.inf, first, first, 0.0], [0, np.inf, first + 1, first + 1, 0.0]]
                grown += [(first, rows[goes], *bounds[0], level + 1), (first + 1, rows[~goes], *bounds[1], level + 1)]
    columns = list(zip(*nodes, strict=True)) if nodes else [(), (), (), (), ()]
    return Forest(*(np.array(c, t) for c, t in zip(columns, (np.int64, float, np.int64, np.int64, float), strict=True)), np.array(roots, np.int64), depth, bias)


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: rising knots (score, probability) for ``np.interp``. Equal scores are pooled first."""
    if not len(score):
        return np.array([0.0]), np.array([0.5])
    at, inverse = np.unique(score, return_inverse=True)
    weight = np.bincount(inverse).astype(float)
    mean = np.bincount(inverse, y) / weight
    blocks: list[list[float]] = []  # mean, weight, first, last
    for k in range(len(at)):
        blocks.append([mean[k], weight[k], at[k], at[k]])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            m2, w2, _, last = blocks.pop()
            m1, w1, first, _ = blocks.pop()
            blocks.append([(m1 * w1 + m2 * w2) / (w1 + w2), w1 + w2, first, last])
    knots = [(x, m) for m, _, first, last in blocks for x in dict.fromkeys((first, last))]
    return np.array([k[0] for k in knots]), np.array([k[1] for k in knots])
