"""Histogram gradient boosting with a branch for missing values, calibration, and path-dependent SHAP."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

MISSING_BIN = 255


@dataclass
class Tree:
    """Nodes as arrays; a leaf has feature -1.  ``weight`` is the training rows that reach a node."""

    feature: list[int] = field(default_factory=list)
    threshold: list[float] = field(default_factory=list)
    missing_left: list[bool] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    weight: list[float] = field(default_factory=list)

    def add(self, value: float, weight: float) -> int:
        for column, x in ((self.feature, -1), (self.threshold, 0.0), (self.missing_left, True), (self.left, -1), (self.right, -1), (self.value, value), (self.weight, weight)):
            column.append(x)
        return len(self.feature) - 1

    def goes_left(self, node: int, x: np.ndarray) -> np.ndarray:
        v = x[:, self.feature[node]]
        return np.where(np.isnan(v), self.missing_left[node], v <= self.threshold[node])

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(len(x))
        work = [(0, np.arange(len(x)))]
        while work:
            node, rows = work.pop()
            if self.feature[node] < 0:
                out[rows] = self.value[node]
            elif len(rows):
                left = self.goes_left(node, x[rows])
                work += [(self.left[node], rows[left]), (self.right[node], rows[~left])]
        return out


@dataclass
class Booster:
    trees: list[Tree]
    base: float
    rate: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.base + self.rate * sum((t.predict(x) for t in self.trees), np.zeros(len(x)))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_booster(x: np.ndarray, y: np.ndarray, *, iterations: int = 200, rate: float = 0.05, leaves: int = 31, least: int = 5, damping: float = 0.0) -> Booster:
    """Leaf-wise trees on the logistic loss; NaN goes where it helps more."""
    edges = [_edges(c[~np.isnan(c)]) for c in x.T]
    binned = np.full(x.shape, MISSING_BIN, np.uint8)
    for j, cuts in enumerate(edges):
        known = ~np.isnan(x[:, j])
        binned[known, j] = np.searchsorted(cuts, x[known, j], side="left")
    share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    base = float(np.log(share / (1 - share)))
    score, trees = np.full(len(y), base), []
    for _ in range(iterations):
        p = sigmoid(score)
        tree, reached = _grow(binned, edges, p - y, p * (1 - p), leaves, least, damping)
        trees.append(tree)
        score = score + rate * np.asarray(tree.value)[reached]
    return Booster(trees, base, rate)


def _edges(known: np.ndarray) -> np.ndarray:
    """Bounds of the bins: between all values if they are few, else quantiles."""
    values = np.unique(known)
    if len(values) < MISSING_BIN:
        return (values[:-1] + values[1:]) / 2
    return np.unique(np.quantile(known, np.linspace(0, 1, MISSING_BIN)[1:-1], method="lower"))


def _grow(binned: np.ndarray, edges: list[np.ndarray], gradient: np.ndarray, curvature: np.ndarray, leaves: int, least: int, damping: float) -> tuple[Tree, np.ndarray]:
    tree = Tree()
    reached = np.zeros(len(gradient), np.int64)

    def leaf(rows: np.ndarray) -> int:
        return tree.add(-gradient[rows].sum() / (curvature[rows].sum() + damping + 1e-12), float(len(rows)))

    rows = np.arange(len(gradient))
    root = leaf(rows)
    best = {root: (*_best_split(binned, edges, gradient, curvature, rows, least, damping), rows)}
    count = 1
    while count < leaves:
        node = max(best, key=lambda k: best[k][0], default=None)
        if node is None or best[node][0] <= 1e-9:
            break
        _, j, cut, missing_left, rows = best.pop(node)
        b = binned[rows, j]
        left = np.where(b == MISSING_BIN, missing_left, b <= cut)
        tree.feature[node], tree.threshold[node], tree.missing_left[node] = j, float(edges[j][cut]) if cut < len(edges[j]) else np.inf, missing_left
        for side, part in (("left", rows[left]), ("right", rows[~left])):
            child = leaf(part)
            getattr(tree, side)[node] = child
            reached[part] = child
            best[child] = (*_best_split(binned, edges, gradient, curvature, part, least, damping), part)
        count += 1
    return tree, reached


def _best_split(binned: np.ndarray, edges: list[np.ndarray], gradient: np.ndarray, curvature: np.ndarray, rows: np.ndarray, least: int, damping: float) -> tuple[float, int, int, bool]:
    found = (0.0, -1, -1, True)
    if len(rows) < 2 * least:
        return found
    g, h = gradient[rows], curvature[rows]
    whole = g.sum() ** 2 / (h.sum() + damping + 1e-12)
    for j, cuts in enumerate(edges):
        b = binned[rows, j].astype(np.int64)
        b[b == MISSING_BIN] = len(cuts) + 1
        sums = [np.bincount(b, w, len(cuts) + 2) for w in (g, h, np.ones(len(rows)))]
        for missing_left in (True, False):
            left = [np.cumsum(s[:-1]) + (s[-1] if missing_left else 0) for s in sums]
            right = [s.sum() - a for s, a in zip(sums, left, strict=True)]
            ok = (left[2] >= least) & (right[2] >= least)
            gain = np.where(ok, left[0] ** 2 / (left[1] + damping + 1e-12) + right[0] ** 2 / (right[1] + damping + 1e-12) - whole, 0)
            k = int(gain.argmax())
            if gain[k] > found[0] + 1e-12:
                found = (float(gain[k]), j, k, missing_left)
            if not sums[2][-1]:
                break
    return found


@dataclass
class Calibrator:
    """Isotonic steps with linear parts between them, or a logistic curve."""

    method: str
    x: np.ndarray
    y: np.ndarray

    def __call__(self, raw: np.ndarray) -> np.ndarray:
        if self.method == "sigmoid":
            return sigmoid(self.x[0] * raw + self.x[1])
        return np.interp(raw, self.x, self.y)


def fit_calibrator(raw: np.ndarray, y: np.ndarray, method: str) -> Calibrator:
    if method == "sigmoid":
        return Calibrator(method, _logistic(raw, y), np.zeros(0))
    order = np.argsort(raw, kind="stable")
    values, start = np.unique(raw[order], return_index=True)
    sums = np.add.reduceat(y[order].astype(float), start)
    sizes = np.diff(np.append(start, len(y))).astype(float)
    blocks: list[list[float]] = []
    for k in range(len(values)):
        blocks.append([sums[k], sizes[k], k, k])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            s, n, _, last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + n, blocks[-1][2], last]
    xs = [values[int(k)] for b in blocks for k in dict.fromkeys((b[2], b[3]))]
    ys = [b[0] / b[1] for b in blocks for _ in dict.fromkeys((b[2], b[3]))]
    return Calibrator("isotonic", np.array(xs), np.array(ys))


def _logistic(raw: np.ndarray, y: np.ndarray) -> np.ndarray:
    n1, n0 = y.sum(), len(y) - y.sum()
    want = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x, theta = np.column_stack([raw, np.ones_like(raw)]), np.array([1.0, 0.0])
    for _ in range(60):
        p = sigmoid(x @ theta)
        step = np.linalg.solve(x.T @ (x * np.maximum(p * (1 - p), 1e-9)[:, None]) + 1e-9 * np.eye(2), x.T @ (p - want))
        theta -= np.clip(step, -3, 3)
    return theta


def shap_values(booster: Booster, x: np.ndarray) -> tuple[np.ndarray, float]:
    """Contributions of the features in log-odds, and the expected value; they add up to ``raw``.

    Shapley values of the game in which an unknown feature sends a row both ways by training weight,
    computed leaf by leaf from the features on the leaf's path.
    """
    out, expected = np.zeros(x.shape), booster.base
    for tree in booster.trees:
        for leaf, path in _paths(tree):
            value = booster.rate * tree.value[leaf]
            # Per feature on the path: does the row agree with all its splits, and the weight if unknown.
            features = sorted({tree.feature[n] for n, _ in path})
            known = np.ones((len(x), len(features)))
            unknown = np.ones(len(features))
            for node, left in path:
                k = features.index(tree.feature[node])
                agrees = tree.goes_left(node, x)
                known[:, k] *= agrees if left else ~agrees
                unknown[k] *= tree.weight[tree.left[node] if left else tree.right[node]] / tree.weight[node]
            expected += value * unknown.prod()
            for k in range(len(features)):
                out[:, features[k]] += value * (known[:, k] - unknown[k]) * _others(np.delete(known, k, 1), np.delete(unknown, k))
    return out, expected


def _others(known: np.ndarray, unknown: np.ndarray) -> np.ndarray:
    """The mean over orders of the product of known (before) and unknown (after) parts."""
    m = known.shape[1]
    by_size = np.zeros((len(known), m + 1))
    by_size[:, 0] = 1
    for k in range(m):
        by_size[:, 1:] = by_size[:, 1:] * unknown[k] + by_size[:, :-1] * known[:, k : k + 1]
        by_size[:, 0] *= unknown[k]
    weight, total = np.empty(m + 1), 1.0 / (m + 1)
    for s in range(m + 1):
        weight[s] = total
        total *= (s + 1) / (m - s) if s < m else 1
    return by_size @ weight


def _paths(tree: Tree) -> list[tuple[int, list[tuple[int, bool]]]]:
    out, work = [], [(0, [])]
    while work:
        node, path = work.pop()
        if tree.feature[node] < 0:
            out.append((node, path))
        else:
            work += [(tree.left[node], [*path, (node, True)]), (tree.right[node], [*path, (node, False)])]
    return out
