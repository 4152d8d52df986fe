"""Gradient-boosted trees for two classes, small enough to ship with a task."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 32


@dataclass(frozen=True)
class Trees:
    """Complete trees of one depth: a feature and limit per inner node, a value per leaf."""

    features: np.ndarray  # (trees, inner nodes)
    limits: np.ndarray
    leaves: np.ndarray  # (trees, leaves)
    start: float

    def margin(self, rows: np.ndarray) -> np.ndarray:
        total = np.full(len(rows), self.start)
        inner = self.features.shape[1] if len(self.features) else 0
        each = np.arange(len(rows))
        for features, limits, leaves in zip(self.features, self.limits, self.leaves, strict=True):
            node = np.zeros(len(rows), np.int64)
            while inner and len(node) and node[0] < inner:
                right = rows[each, features[node]] > limits[node]
                node = 2 * node + 1 + right
            total += leaves[node - inner]
        return total


def fit_trees(
    rows: np.ndarray, labels: np.ndarray, weights: np.ndarray | None = None, trees: int = 40,
    depth: int = 3, rate: float = 0.3, penalty: float = 1.0,
) -> Trees:
    """Boost the logistic loss; each split is the best by gain over binned features."""
    weights = np.ones(len(rows)) if weights is None else weights
    share = np.clip(np.average(labels, weights=weights) if len(labels) else 0.5, 1e-6, 1 - 1e-6)
    start = float(np.log(share / (1 - share)))
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in rows.T]
    binned = np.column_stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, rows.T, strict=True)])
    margin, inner = np.full(len(rows), start), 2**depth - 1
    features = np.zeros((trees, inner), np.int64)
    limits = np.full((trees, inner), np.inf)
    leaves = np.zeros((trees, 2**depth))
    for t in range(trees):
        chance = 1 / (1 + np.exp(-margin))
        gradient, curve = weights * (labels - chance), weights * chance * (1 - chance)
        node = np.zeros(len(rows), np.int64)
        for at in range(inner):
            here = node == at
            best = _best_split(binned[here], gradient[here], curve[here], cuts, penalty)
            if best is not None:
                features[t, at], limits[t, at] = best
            right = rows[:, features[t, at]] > limits[t, at]
            node = np.where(here, 2 * node + 1 + right, node)
        leaf = node - inner
        up = np.bincount(leaf, gradient, 2**depth)
        down = np.bincount(leaf, curve, 2**depth) + penalty
        leaves[t] = rate * up / down
        margin += leaves[t][leaf]
    return Trees(features, limits, leaves, start)


def _best_split(binned, gradient, curve, cuts, penalty):
    best, gain_of_best = None, 1e-6
    total_g, total_c = gradient.sum(), curve.sum()
    for f, limits in enumerate(cuts):
        if not len(limits):
            continue
        g = np.cumsum(np.bincount(binned[:, f], gradient, len(limits) + 1))[:-1]
        c = np.cumsum(np.bincount(binned[:, f], curve, len(limits) + 1))[:-1]
        rest_g, rest_c = total_g - g, total_c - c
        gain = g**2 / (c + penalty) + rest_g**2 / (rest_c + penalty) - total_g**2 / (total_c + penalty)
        k = int(gain.argmax())
        if gain[k] > gain_of_best:
            gain_of_best, best = gain[k], (f, limits[k])
    return best


def calibration(
    margins: np.ndarray, labels: np.ndarray, weights: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic calibration: ascending margins and the chance of a positive from each on."""
    weights = np.ones(len(labels)) if weights is None else weights
    order = np.argsort(margins, kind="stable")
    blocks: list[list[float]] = []  # first margin, positives, rows
    for m, y, w in zip(margins[order], labels[order], weights[order], strict=True):
        if blocks and blocks[-1][0] == m:
            blocks[-1][1] += w * y
            blocks[-1][2] += w
        else:
            blocks.append([m, w * y, w])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            _, y2, n2 = blocks.pop()
            blocks[-1][1] += y2
            blocks[-1][2] += n2
    return np.array([b[0] for b in blocks]), np.array([b[1] / b[2] for b in blocks])
