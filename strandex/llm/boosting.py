"""Gradient-boosted trees for two classes, in numpy: histograms, logistic loss, Newton leaves."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Trees:
    """Complete trees of one depth; node i of a level has the children 2i and 2i + 1 of the next."""

    base: float
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def logit(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        depth = int(np.log2(self.leaf.shape[1]))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), dtype=np.int64)
            for level in range(depth):
                at = (1 << level) - 1 + node
                node = 2 * node + (x[rows, feature[at]] > cut[at])
            out += leaf[node]
        return out


def train(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 4, rate: float = 0.25, bins: int = 24, ridge: float = 1.0, columns: float = 0.4, seed: int = 1) -> Trees:
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.array([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)])
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    logit = np.full(len(y), base)
    features, cuts, leaves = [], [], []
    rnd = np.random.default_rng(seed)
    for _ in range(rounds):
        seen = np.flatnonzero(rnd.random(len(edges)) < columns)  # so that no cue stands for all others
        p = 1 / (1 + np.exp(-logit))
        g, h = y - p, p * (1 - p)
        node = np.zeros(len(y), dtype=np.int64)
        feature, cut = np.zeros((1 << depth) - 1, dtype=np.int64), np.full((1 << depth) - 1, np.inf)
        for level in range(depth):
            n = 1 << level
            best = np.full(n, 1e-9)
            all_g, all_h = np.bincount(node, g, n), np.bincount(node, h, n)
            for f in seen:
                width = len(edges[f]) + 1
                if width < 2:
                    continue
                cell = node * width + binned[f]
                left_g = np.bincount(cell, g, n * width).reshape(n, width).cumsum(axis=1)[:, :-1]
                left_h = np.bincount(cell, h, n * width).reshape(n, width).cumsum(axis=1)[:, :-1]
                right_g, right_h = all_g[:, None] - left_g, all_h[:, None] - left_h
                gain = left_g**2 / (left_h + ridge) + right_g**2 / (right_h + ridge) - (all_g**2 / (all_h + ridge))[:, None]
                top = gain.argmax(axis=1)
                value = gain[np.arange(n), top]
                for i in np.flatnonzero(value > best):
                    best[i] = value[i]
                    feature[n - 1 + i], cut[n - 1 + i] = f, edges[f][top[i]]
            at = n - 1 + node
            node = 2 * node + (x[np.arange(len(y)), feature[at]] > cut[at])
        n = 1 << depth
        leaf = rate * np.bincount(node, g, n) / (np.bincount(node, h, n) + ridge)
        logit += leaf[node]
        features.append(feature)
        cuts.append(cut)
        leaves.append(leaf)
    return Trees(base, np.array(features), np.array(cuts), np.array(leaves))
