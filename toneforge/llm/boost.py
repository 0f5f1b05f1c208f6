"""Gradient-boosted trees for a logistic loss: histograms, depth-wise trees, in NumPy."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Trees:
    edges: list[np.ndarray]
    #: For each tree: feature and bin of every inner node in heap order, and the leaves' values.
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    depth: int = 3
    base: float = 0.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        binned = np.column_stack([np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(self.edges)]) if len(x) else np.zeros((0, len(self.edges)), int)
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, leaf in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (binned[rows, feature[at]] > cut[at])
            out += leaf[at - (2**self.depth - 1)]
        return out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, penalty: float = 1.0) -> Trees:
    edges = []
    for k in range(x.shape[1]):
        edges.append(np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) if len(np.unique(x[:, k])) > bins else (np.unique(x[:, k])[:-1] + np.unique(x[:, k])[1:]) / 2)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = Trees(edges, [], depth, float(np.log(share / (1 - share))))
    binned = np.column_stack([np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(edges)])
    width, inner = x.shape[1], 2**depth - 1
    margin, rows = np.full(len(x), model.base), np.arange(len(x))
    cells = binned + np.arange(width) * bins
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        feature, cut, at = np.zeros(inner, np.int64), np.full(inner, bins, np.int64), np.zeros(len(x), np.int64)
        for level in range(depth):
            nodes = 2**level
            local = at - (nodes - 1)
            index = (local[:, None] * (width * bins) + cells).ravel()
            gs = np.bincount(index, np.repeat(g, width), nodes * width * bins).reshape(nodes, width, bins)
            hs = np.bincount(index, np.repeat(h, width), nodes * width * bins).reshape(nodes, width, bins)
            gl, hl = gs.cumsum(2), hs.cumsum(2)
            gt, ht = gl[:, :, -1:], hl[:, :, -1:]
            gain = gl**2 / (hl + penalty) + (gt - gl) ** 2 / (ht - hl + penalty) - gt**2 / (ht + penalty)
            flat = gain.reshape(nodes, -1)
            best = flat.argmax(1)
            good = flat[np.arange(nodes), best] > 1e-6
            feature[nodes - 1 : 2 * nodes - 1] = np.where(good, best // bins, 0)
            cut[nodes - 1 : 2 * nodes - 1] = np.where(good, best % bins, bins)
            at = 2 * at + 1 + (binned[rows, feature[at]] > cut[at])
        local = at - inner
        leaf = -rate * np.bincount(local, g, inner + 1) / (np.bincount(local, h, inner + 1) + penalty)
        margin += leaf[local]
        model.trees.append((feature, cut, leaf))
    return model
