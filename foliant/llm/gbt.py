"""Gradient-boosted trees for a yes/no target, on histograms, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Model:
    """Complete trees of one depth: feature and threshold of inner nodes, values of leaves."""

    base: float
    features: np.ndarray  # trees x (2^depth - 1)
    limits: np.ndarray
    leaves: np.ndarray  # trees x 2^depth

    def logits(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of yes for each row of x."""
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        depth = self.leaves.shape[1].bit_length() - 1
        for feature, limit, leaf in zip(self.features, self.limits, self.leaves, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > limit[at])
            out += leaf[at - len(limit)]
        return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 4, rate: float = 0.25, bins: int = 24, l2: float = 2.0) -> Model:
    """Newton boosting of the logistic loss; splits are sought over quantile bins."""
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    codes = np.stack([np.searchsorted(edges[f], x[:, f], side="left") for f in range(width)], axis=1)
    wide = codes + np.arange(width) * bins
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    score = np.full(n, base)
    inner, outer = (1 << depth) - 1, 1 << depth
    all_f, all_l, all_v = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        feature, limit = np.zeros(inner, np.int64), np.full(inner, np.inf)
        at = np.zeros(n, np.int64)
        for node in range(inner):
            own = np.flatnonzero(at == node)
            if len(own):
                flat = wide[own].ravel()
                sg = np.bincount(flat, np.repeat(g[own], width), width * bins).reshape(width, bins)
                sh = np.bincount(flat, np.repeat(h[own], width), width * bins).reshape(width, bins)
                left_g, left_h = sg.cumsum(axis=1)[:, :-1], sh.cumsum(axis=1)[:, :-1]
                total_g, total_h = g[own].sum(), h[own].sum()
                gain = left_g**2 / (left_h + l2) + (total_g - left_g) ** 2 / (total_h - left_h + l2) - total_g**2 / (total_h + l2)
                f, b = np.unravel_index(int(np.argmax(gain)), gain.shape)
                if gain[f, b] > 1e-3 and b < len(edges[f]):
                    feature[node], limit[node] = f, edges[f][b]
                at[own] = 2 * node + 1 + (x[own, feature[node]] > limit[node])
        leaf = at - inner
        value = rate * np.bincount(leaf, g, outer) / (np.bincount(leaf, h, outer) + l2)
        score += value[leaf]
        all_f.append(feature)
        all_l.append(limit)
        all_v.append(value)
    return Model(base, np.array(all_f), np.array(all_l), np.array(all_v))
