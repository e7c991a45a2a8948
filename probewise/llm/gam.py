"""A generalised additive model with pairwise terms, boosted cyclically on binned features."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

BINS = 32
PAIR_BINS = 8


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def edges_of(values: np.ndarray, bins: int) -> np.ndarray:
    """Inner bin edges at the quantiles of ``values``; fewer where values repeat."""
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) if len(values) else np.zeros(0)


@dataclass
class AdditiveModel:
    """Lookup tables: one per feature, one per chosen pair; a score is a sum of entries."""

    base: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def scores(self, features: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row: bin every column once, add the entries."""
        total = np.full(len(features), self.base)
        for j, (edges, entries) in enumerate(zip(self.edges, self.tables)):
            total += entries[np.searchsorted(edges, features[:, j], side="right")]
        if self.pairs:
            coarse = {j: np.searchsorted(self.pair_edges[j], features[:, j], side="right")
                      for pair in self.pairs for j in pair}
            for (a, b), entries in zip(self.pairs, self.pair_tables):
                total += entries[coarse[a], coarse[b]]
        return _sigmoid(total)


def _step(gradient: np.ndarray, weight: np.ndarray, smooth: float) -> np.ndarray:
    return gradient / (weight + smooth)


def _gain(gradient, weight, smooth: float):
    return gradient * gradient / (weight + smooth)


def _tree(gradient: np.ndarray, weight: np.ndarray, leaves: int, smooth: float, least: float) -> np.ndarray:
    """Values by bin of the best tree on one binned feature: cut the leaf that gains most."""
    bounds = [0, len(gradient)]
    for _ in range(leaves - 1):
        best = (1e-9, 0)
        for low, high in zip(bounds, bounds[1:]):
            if high - low < 2:
                continue
            g, w = np.cumsum(gradient[low:high]), np.cumsum(weight[low:high])
            left_g, left_w, all_g, all_w = g[:-1], w[:-1], g[-1], w[-1]
            gains = (_gain(left_g, left_w, smooth) + _gain(all_g - left_g, all_w - left_w, smooth)
                     - _gain(all_g, all_w, smooth))
            gains[(left_w < least) | (all_w - left_w < least)] = 0
            at = int(gains.argmax())
            best = max(best, (float(gains[at]), low + at + 1))
        if not best[1]:
            break
        bounds = sorted(bounds + [best[1]])
    values = np.zeros(len(gradient))
    for low, high in zip(bounds, bounds[1:]):
        values[low:high] = _step(gradient[low:high].sum(), weight[low:high].sum(), smooth)
    return values


def _quadrants(gradient: np.ndarray, weight: np.ndarray, smooth: float, least: float) -> tuple[float, np.ndarray]:
    """Gain and values of the best tree with one cut on each of two features."""
    g = np.cumsum(np.cumsum(gradient, 0), 1)
    w = np.cumsum(np.cumsum(weight, 0), 1)
    all_g, all_w = g[-1, -1], w[-1, -1]
    parts = []
    for sums in (g, w):
        a = sums[:-1, :-1]
        parts.append((a, sums[:-1, -1:] - a, sums[-1:, :-1] - a, sums[-1, -1] - sums[:-1, -1:] - sums[-1:, :-1] + a))
    gains = sum(_gain(x, y, smooth) for x, y in zip(*parts)) - _gain(all_g, all_w, smooth)
    gains = np.where(np.minimum.reduce(parts[1]) < least, 0, gains) if gains.size else np.zeros((1, 1))
    i, j = np.unravel_index(int(gains.argmax()), gains.shape)
    values = np.zeros_like(gradient)
    if gains[i, j] > 0:
        for rows in (slice(0, i + 1), slice(i + 1, None)):
            for cols in (slice(0, j + 1), slice(j + 1, None)):
                values[rows, cols] = _step(gradient[rows, cols].sum(), weight[rows, cols].sum(), smooth)
    return float(gains[i, j]), values


def fit(features: np.ndarray, labels: np.ndarray, rounds: int = 200, rate: float = 0.1, leaves: int = 3,
        pairs: int = 6, pair_rounds: int = 60, smooth: float = 2.0, least: float = 1.0) -> AdditiveModel:
    """Boost one shallow tree per feature and round, feature after feature; then the pairs.

    Each tree sees the gradient left by all others and adds to its feature's table. The
    pairs with the largest gain on what the single features leave get tables of their own.
    Without rows, or with one class only, the score is the constant smoothed rate.
    """
    n = len(labels)
    rate_of_ones = (labels.sum() + 0.5) / (n + 1.0)
    model = AdditiveModel(float(np.log(rate_of_ones / (1 - rate_of_ones))))
    if n == 0 or labels.min() == labels.max():
        return model
    width = features.shape[1]
    model.edges = [edges_of(features[:, j], BINS) for j in range(width)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    binned = [np.searchsorted(e, features[:, j], side="right") for j, e in enumerate(model.edges)]
    total = np.full(n, model.base)
    for _ in range(rounds):
        for j in range(width):
            p = _sigmoid(total)
            size = len(model.tables[j])
            update = rate * _tree(np.bincount(binned[j], labels - p, size), np.bincount(binned[j], p * (1 - p), size),
                                  leaves, smooth, least)
            model.tables[j] += update
            total += update[binned[j]]
    model.pair_edges = [edges_of(features[:, j], PAIR_BINS) for j in range(width)]
    coarse = [np.searchsorted(e, features[:, j], side="right") for j, e in enumerate(model.pair_edges)]
    shape = [len(e) + 1 for e in model.pair_edges]

    def histograms(a: int, b: int, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell, size = coarse[a] * shape[b] + coarse[b], shape[a] * shape[b]
        return (np.bincount(cell, labels - p, size).reshape(shape[a], shape[b]),
                np.bincount(cell, p * (1 - p), size).reshape(shape[a], shape[b]))

    p = _sigmoid(total)
    ranked = sorted(((_quadrants(*histograms(a, b, p), smooth, least)[0], a, b)
                     for a in range(width) for b in range(a + 1, width)), reverse=True)
    model.pairs = [(a, b) for gain, a, b in ranked[:pairs] if gain > 0]
    model.pair_tables = [np.zeros((shape[a], shape[b])) for a, b in model.pairs]
    for _ in range(pair_rounds):
        for k, (a, b) in enumerate(model.pairs):
            _, update = _quadrants(*histograms(a, b, _sigmoid(total)), smooth, least)
            model.pair_tables[k] += rate * update
            total += rate * update[coarse[a], coarse[b]]
    return model
