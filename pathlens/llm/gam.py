"""A generalised additive model with pairwise interactions, for two classes.

Training is cyclic boosting: in each round every feature in turn gets one
shallow tree fitted to the current gradient, whose leaves are added to the
feature's lookup table over quantile bins. Then pairs of features whose joint
cells explain most of the remaining gradient get tables of their own in the same
way. A score is the sigmoid of an intercept and one table entry per feature and
pair, so scoring is binning and adding.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np

BINS = 32
ROUNDS = 150
PAIR_ROUNDS = 60
PAIRS = 8
RATE = 0.15
RIDGE = 2.0
LEAVES = 4


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best split of neighbouring bins (0: none)."""
    if len(g) < 2:
        return 0.0, 0
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    right_g, right_h = g.sum() - left_g, h.sum() - left_h
    gain = left_g**2 / (left_h + RIDGE) + right_g**2 / (right_h + RIDGE) - g.sum() ** 2 / (h.sum() + RIDGE)
    gain[(left_h < 1e-3) | (right_h < 1e-3)] = 0
    at = int(np.argmax(gain))
    return float(gain[at]), at + 1 if gain[at] > 1e-9 else 0


def shallow_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Step per bin of a tree of at most ``LEAVES`` leaves on one feature."""
    leaves = [(0, len(g))]
    while len(leaves) < LEAVES:
        options = [(*best_cut(g[a:b], h[a:b]), a, b) for a, b in leaves]
        gain, cut, a, b = max(options)
        if not cut:
            break
        leaves.remove((a, b))
        leaves += [(a, a + cut), (a + cut, b)]
    out = np.zeros(len(g))
    for a, b in leaves:
        out[a:b] = -g[a:b].sum() / (h[a:b].sum() + RIDGE)
    return out


def cross_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and steps of a tree that cuts one feature and then each side by the other."""
    best, steps = 0.0, np.zeros_like(g)
    for axis in (0, 1):
        gg, hh = (g, h) if axis == 0 else (g.T, h.T)
        for cut in range(1, gg.shape[0]):
            out, gain = np.zeros_like(gg), 0.0
            for rows in (slice(0, cut), slice(cut, None)):
                a, b = gg[rows].sum(0), hh[rows].sum(0)
                won, at = best_cut(a, b)
                gain += won
                for cols in (slice(0, at), slice(at, None)) if at else (slice(None),):
                    out[rows, cols] = -a[cols].sum() / (b[cols].sum() + RIDGE)
            if gain > best:
                best, steps = gain, out if axis == 0 else out.T
    return best, steps


@dataclass
class Model:
    intercept: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1) if len(x) else np.zeros(x.shape, int)

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        out = np.full(len(x), self.intercept)
        for j, table in enumerate(self.tables):
            out += table[b[:, j]]
        for (i, j), table in zip(self.pairs, self.pair_tables):
            out += table[self.coarse[i][b[:, i]], self.coarse[j][b[:, j]]]
        return sigmoid(out)


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Learns from rows of features and labels 0 or 1; without rows, every score is 0.5."""
    features = x.shape[1]
    share = (y.sum() + 1) / (len(y) + 2)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(features)]
    model = Model(float(np.log(share / (1 - share))), edges, [np.zeros(len(e) + 1) for e in edges])
    if not len(x) or y.min() == y.max():
        return model
    b = model.bins(x)
    total = np.full(len(y), model.intercept)
    for _ in range(ROUNDS):
        for j in range(features):
            p = sigmoid(total)
            n = len(model.tables[j])
            step = RATE * shallow_tree(np.bincount(b[:, j], p - y, n), np.bincount(b[:, j], p * (1 - p), n))
            model.tables[j] += step
            total += step[b[:, j]]
    # pairs work on at most eight cells a side
    model.coarse = [np.minimum(np.arange(len(t)) * 8 // len(t), 7) for t in model.tables]
    cells = [c[b[:, j]] for j, c in enumerate(model.coarse)]

    def sums(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        p = sigmoid(total)
        code = cells[i] * 8 + cells[j]
        return np.bincount(code, p - y, 64).reshape(8, 8), np.bincount(code, p * (1 - p), 64).reshape(8, 8)

    gains = sorted(((cross_tree(*sums(i, j))[0], i, j) for i, j in combinations(range(features), 2)), reverse=True)
    model.pairs = [(i, j) for gain, i, j in gains[:PAIRS] if gain > 1e-6]
    model.pair_tables = [np.zeros((8, 8)) for _ in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for k, (i, j) in enumerate(model.pairs):
            step = RATE * cross_tree(*sums(i, j))[1]
            model.pair_tables[k] += step
            total += step[cells[i], cells[j]]
    return model
