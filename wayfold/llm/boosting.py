"""Histogram gradient-boosted trees in numpy: training on a bounded sample, flattened trees for scoring."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 64


@dataclass
class Forest:
    """Trees flattened into arrays: node -> feature (-1: leaf), threshold, left child (the right one follows),
    value; roots gives each tree's first node."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities; all rows step down all trees together, a level at a time."""
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            f = self.feature[at]
            right = x[rows, np.maximum(f, 0)] > self.threshold[at]
            at = np.where(f < 0, at, self.left[at] + right)
        return 1 / (1 + np.exp(-(self.base + self.value[at].sum(axis=1))))


def train(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, l2: float = 1.0, least: int = 20) -> Forest:
    """Logistic loss, second-order gains, features cut at quantiles into BINS bins. One class only, or no
    rows: a constant score."""
    rate_of_1 = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    base = float(np.log(rate_of_1 / (1 - rate_of_1)))
    feature, threshold, left, value, roots = [], [], [], [], []
    if len(y) and 0 < y.sum() < len(y):
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1).astype(np.int64)
        flat = binned + np.arange(x.shape[1]) * BINS
        margin = np.full(len(y), base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-margin))
            g, h = p - y, p * (1 - p)
            roots.append(len(feature))
            feature.append(-1), threshold.append(0.0), left.append(0), value.append(0.0)
            open_nodes = [(roots[-1], np.arange(len(y)), depth)]
            while open_nodes:
                node, rows, levels = open_nodes.pop()
                gs, hs = g[rows].sum(), h[rows].sum()
                value[node] = -rate * gs / (hs + l2)
                best = (1e-6, None)
                if levels and len(rows) >= 2 * least:
                    size = x.shape[1] * BINS
                    at = flat[rows].ravel()
                    gh, hh, n = (np.bincount(at, w, size).reshape(-1, BINS).cumsum(axis=1) for w in (np.repeat(g[rows], x.shape[1]), np.repeat(h[rows], x.shape[1]), None))
                    ok = (n >= least) & (len(rows) - n >= least)
                    gain = np.where(ok, gh**2 / (hh + l2) + (gs - gh) ** 2 / (hs - hh + l2) - gs**2 / (hs + l2), 0)
                    j, b = np.unravel_index(gain.argmax(), gain.shape)
                    if gain[j, b] > best[0] and b < len(cuts[j]):
                        best = (gain[j, b], (j, b))
                if best[1] is None:
                    margin[rows] += value[node]
                    continue
                j, b = best[1]
                feature[node], threshold[node], left[node] = int(j), float(cuts[j][b]), len(feature)
                goes = binned[rows, j] <= b
                for part in (rows[goes], rows[~goes]):
                    open_nodes.append((len(feature), part, levels - 1))
                    feature.append(-1), threshold.append(0.0), left.append(0), value.append(0.0)
    return Forest(np.array(feature, np.int64), np.array(threshold), np.array(left, np.int64), np.array(value), np.array(roots, np.int64), base, depth)
