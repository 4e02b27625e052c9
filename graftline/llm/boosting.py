"""Gradient-boosted trees for two classes, on binned features, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 32


@dataclass
class Boosted:
    """Complete trees of one depth: a feature, a threshold (x > threshold goes right) and leaf values for each."""

    prior: float
    depth: int
    features: np.ndarray  # trees x (2 ** depth - 1)
    thresholds: np.ndarray
    leaves: np.ndarray  # trees x 2 ** depth

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        rows, total = np.arange(len(x)), np.full(len(x), self.prior)
        for f, t, leaf in zip(self.features, self.thresholds, self.leaves, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            total += leaf[at - (2**self.depth - 1)]
        return total


def _edges(column: np.ndarray) -> np.ndarray:
    values = np.unique(column)
    if len(values) > BINS:
        values = np.unique(np.quantile(column, np.linspace(0, 1, BINS)))
    return (values[:-1] + values[1:]) / 2


def train(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, trees: int = 40, depth: int = 4, rate: float = 0.3, ridge: float = 1.0) -> Boosted:
    """Newton boosting of the logistic loss; every split takes the largest gain over all binned features."""
    weight = np.ones(len(y)) if weight is None else weight
    edges = [_edges(x[:, j]) for j in range(x.shape[1])]
    flags = [j for j in range(x.shape[1]) if len(edges[j]) == 1]  # two values: counted all at once
    used = [j for j in range(x.shape[1]) if len(edges[j]) > 1]
    binned = {j: np.searchsorted(edges[j], x[:, j]) for j in used}
    high = np.stack([x[:, j] > edges[j][0] for j in flags], 1) if flags else np.zeros((len(y), 0), bool)
    set_rows, set_flags = np.nonzero(high)  # few flags are set in a row
    share = float(np.clip((weight * y).sum() / weight.sum(), 1e-6, 1 - 1e-6))
    prior = float(np.log(share / (1 - share)))
    score = np.full(len(y), prior)
    inner = 2**depth - 1
    features, thresholds, leaves = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = weight * (y - p), weight * p * (1 - p)
        at = np.zeros(len(y), np.int64)
        for node in range(inner):
            here = np.flatnonzero(at == node)
            best = (1e-6, None, None)
            gs, hs = g[here].sum(), h[here].sum()
            if flags and len(here) > 1:
                among = at[set_rows] == node
                gr, hr = (np.bincount(set_flags[among], v[set_rows[among]], len(flags)) for v in (g, h))
                gain = gr**2 / (hr + ridge) + (gs - gr) ** 2 / (hs - hr + ridge) - gs**2 / (hs + ridge)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), flags[k], 0)
            for j in used if len(here) > 1 else ():
                b, n = binned[j][here], len(edges[j]) + 1
                gl, hl = np.bincount(b, g[here], n).cumsum()[:-1], np.bincount(b, h[here], n).cumsum()[:-1]
                gain = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), j, k)
            if best[1] is not None:
                features[t, node], thresholds[t, node] = best[1], edges[best[1]][best[2]]
                at[here] = 2 * node + 1 + (x[here, best[1]] > thresholds[t, node])
            else:
                at[here] = 2 * node + 1
        for leaf in range(inner + 1):
            here = at == inner + leaf
            leaves[t, leaf] = rate * g[here].sum() / (h[here].sum() + ridge)
        score += leaves[t, at - inner]
    return Boosted(prior, depth, features, thresholds, leaves)
