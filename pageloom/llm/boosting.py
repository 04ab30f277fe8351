"""Gradient-boosted trees with logistic loss, on a small table of features in memory."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from pageloom.llm.common import by_value

by_value(__name__)


@dataclass
class Trees:
    """Complete trees of one depth: node k splits into 2k + 1 and 2k + 2."""

    start: float
    feature: np.ndarray  # (trees, inner nodes)
    border: np.ndarray
    value: np.ndarray  # (trees, leaves)
    slope: float = 1.0
    shift: float = 0.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        rows, inner = np.arange(len(x)), self.feature.shape[1]
        for feature, border, value in zip(self.feature, self.border, self.value):
            node = np.zeros(len(x), np.int64)
            while inner and len(x) and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > border[node])
            total += value[node - inner]
        return total

    def probability(self, x: np.ndarray) -> np.ndarray:
        """Calibrated: the margin goes through a logistic curve fitted on held-out rows."""
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margin(x) + self.shift, -30, 30)))


def _split(x, gradient, hessian, rows, borders):
    """The split of ``rows`` that lowers the loss most, as (gain, feature, border)."""
    best = (1e-6, 0, np.inf)
    g, h = gradient[rows].sum(), hessian[rows].sum()
    for f, cuts in enumerate(borders):
        if not len(cuts):
            continue
        bucket = np.searchsorted(cuts, x[rows, f], side="left")
        gl = np.cumsum(np.bincount(bucket, gradient[rows], len(cuts) + 1))[:-1]
        hl = np.cumsum(np.bincount(bucket, hessian[rows], len(cuts) + 1))[:-1]
        gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
        k = int(np.argmax(gain))
        if gain[k] > best[0]:
            best = (float(gain[k]), f, float(cuts[k]))
    return best


def fit(
    x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32
) -> Trees:
    share = min(max(float(y.mean()), 0.01), 0.99)
    start = float(np.log(share / (1 - share)))
    borders = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[:-1])) for c in x.T]
    inner, leaves = 2**depth - 1, 2**depth
    made = Trees(
        start,
        np.zeros((trees, inner), np.int64),
        np.full((trees, inner), np.inf),
        np.zeros((trees, leaves)),
    )
    margin = np.full(len(y), start)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        gradient, hessian = p - y, p * (1 - p)
        members = {0: np.arange(len(y))}
        for node in range(inner):
            rows = members.pop(node)
            _, f, border = _split(x, gradient, hessian, rows, borders) if len(rows) else (0, 0, np.inf)
            made.feature[t, node], made.border[t, node] = f, border
            right = x[rows, f] > border
            members[2 * node + 1], members[2 * node + 2] = rows[~right], rows[right]
        for node, rows in members.items():
            step = -rate * gradient[rows].sum() / (hessian[rows].sum() + 1)
            made.value[t, node - inner] = step
            margin[rows] += step
    return made


def calibrate(model: Trees, x: np.ndarray, y: np.ndarray, rounds: int = 200) -> Trees:
    """Fit slope and shift of the logistic curve on rows that the trees have not seen."""
    m, slope, shift = model.margin(x), 1.0, 0.0
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(slope * m + shift, -30, 30)))
        slope -= 0.05 * float(((p - target) * m).mean())
        shift -= 0.05 * float((p - target).mean())
    model.slope, model.shift = max(slope, 0.05), shift
    return model
