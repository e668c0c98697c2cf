"""Gradient-boosted trees of one depth on binned features, for two classes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 32


@dataclass
class Trees:
    """Complete binary trees: at node i of tree t, feature[t, i] > limit[t, i] goes right (2i + 2), else left (2i + 1)."""

    feature: np.ndarray
    limit: np.ndarray
    value: np.ndarray
    start: float
    depth: int

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Log odds of each row."""
        out = np.full(len(rows), self.start)
        for first in range(0, len(rows), 4096):
            part = rows[first : first + 4096]
            line = np.arange(len(part))[:, None]
            node = np.zeros((len(part), len(self.feature)), np.int64)
            tree = np.arange(len(self.feature))[None, :]
            for _ in range(self.depth):
                node = 2 * node + 1 + (part[line, self.feature[tree, node]] > self.limit[tree, node])
            out[first : first + 4096] += self.value[tree, node - (2**self.depth - 1)].sum(axis=1)
        return out


def boost(rows: np.ndarray, labels: np.ndarray, trees: int = 50, depth: int = 5, rate: float = 0.25, ridge: float = 2.0) -> Trees:
    """Newton boosting of the logistic loss; every tree is grown level by level from histograms of a seeded half of the rows."""
    n, width = rows.shape
    rng = np.random.default_rng(3)
    cuts = [np.unique(np.quantile(rows[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(cuts[f], rows[:, f], "left") for f in range(width)])
    share = float(np.clip(labels.mean(), 1e-3, 1 - 1e-3))
    start = float(np.log(share / (1 - share)))
    score = np.full(n, start)
    nodes, leaves = 2**depth - 1, 2**depth
    feature, limit, value = np.zeros((trees, nodes), np.int64), np.full((trees, nodes), np.inf), np.zeros((trees, leaves))
    for t in range(trees):
        chance = 1 / (1 + np.exp(-score))
        slope, bend = labels - chance, np.maximum(chance * (1 - chance), 1e-6)
        place = np.zeros(n, np.int64)
        half = np.flatnonzero(rng.random(n) < 0.5) if n > 1000 else np.arange(n)
        half_bins, half_slope, half_bend = binned[:, half], slope[half], bend[half]
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            local = place[half] - first
            best = np.zeros(count)
            chosen, at = np.zeros(count, np.int64), np.full(count, BINS)
            whole = np.bincount(local, half_slope, count) ** 2 / (np.bincount(local, half_bend, count) + ridge)
            for f in range(width):
                if not len(cuts[f]):
                    continue
                cell = local * (BINS + 1) + half_bins[f]
                g = np.bincount(cell, half_slope, count * (BINS + 1)).reshape(count, -1).cumsum(axis=1)
                h = np.bincount(cell, half_bend, count * (BINS + 1)).reshape(count, -1).cumsum(axis=1)
                rest_g, rest_h = g[:, -1:] - g, h[:, -1:] - h
                gain = g**2 / (h + ridge) + rest_g**2 / (rest_h + ridge) - whole[:, None]
                gain[(h < 1.0) | (rest_h < 1.0)] = 0
                top = gain.argmax(axis=1)
                better = gain[np.arange(count), top] > best + 1e-9
                best[better] = gain[np.arange(count), top][better]
                chosen[better], at[better] = f, top[better]
            for i in np.flatnonzero(best > 0):
                feature[t, first + i] = chosen[i]
                limit[t, first + i] = cuts[chosen[i]][min(at[i], len(cuts[chosen[i]]) - 1)]
            place = 2 * place + 1 + (rows[np.arange(n), feature[t, place]] > limit[t, place])
        leaf = place - nodes
        value[t] = rate * np.bincount(leaf, slope, leaves) / (np.bincount(leaf, bend, leaves) + ridge)
        score += value[t, leaf]
    return Trees(feature, limit, value, start, depth)
