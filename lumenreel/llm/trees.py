"""Gradient-boosted trees: logistic loss, histogram splits, complete trees of equal depth.

``BoostedTrees.fit`` fits one array.  ``grow`` fits trees to blocks of weighted rows that may lie anywhere: it asks only for
sums of arrays over all blocks, three a round.  Bins are fixed, and gradients are whole multiples of 1 / UNIT, so that sums are
exact and do not depend on how the rows are dealt out.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import numpy as np

#: Edges between the bins of ``grow``: whole numbers below 40 have a bin each.
EDGES = np.concatenate([np.arange(-0.5, 40), 39.5 * 1.3 ** np.arange(1, 23)])
BINS = len(EDGES) + 1
UNIT = 1 << 20
#: A block: group, bins (feature by row), label, weight and fold (0, 1 or 2) of its rows.
Block = tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def binned(x: np.ndarray) -> np.ndarray:
    return np.searchsorted(EDGES, x.astype(np.float64), "left").astype(np.uint8)


class BoostedTrees:
    """Probabilities of the positive class.  Fitting is deterministic; ties between splits go to the first feature and bin."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.3, bins: int = 32, least: float = 1.0, l2: float = 1.0) -> None:
        self.rounds, self.depth, self.rate, self.bins, self.least, self.l2 = rounds, depth, rate, bins, least, l2

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        n, width = x.shape
        share = np.clip(y.mean() if n else 0.5, 1e-3, 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) if n else np.zeros(1) for f in range(width)]
        binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1) if n else np.zeros((0, width), int)
        inner, top = (1 << self.depth) - 1, max(map(len, edges)) + 1
        values = np.full((width, top), np.inf)
        for f, e in enumerate(edges):
            values[f, : len(e)] = e
        z = np.full(n, self.base)
        self.feature, self.at, self.leaf = [], [], []
        offset = np.arange(width) * top
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-z))
            g, h = p - y, p * (1 - p)
            node = np.zeros(n, np.int64)
            feature, at = np.zeros(inner, np.int64), np.full(inner, np.inf)
            for level in range(self.depth):
                first, many = (1 << level) - 1, 1 << level
                cell = ((node - first)[:, None] * width * top + offset + binned).ravel()
                sums = [np.bincount(cell, weights=np.repeat(w, width), minlength=many * width * top).reshape(many, width, top) for w in (g, h)]
                best, ok = self._best(*sums, np.isfinite(values))
                feature[first : first + many] = best // top
                at[first : first + many] = np.where(ok, values[best // top, best % top], np.inf)
                node = 2 * node + 1 + (x[np.arange(n), feature[node]] > at[node])
            slot = node - inner
            leaf = -np.bincount(slot, weights=g, minlength=inner + 1) / (np.bincount(slot, weights=h, minlength=inner + 1) + self.l2) * self.rate
            self.feature.append(feature), self.at.append(at), self.leaf.append(leaf)
            z = z + leaf[slot]
        return self

    def _best(self, g: np.ndarray, h: np.ndarray, may: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best split of each node, as feature and bin in one, and whether it gains; sums are by node, feature and bin."""
        left_g, left_h = (np.cumsum(s, axis=2) for s in (g, h))
        all_g, all_h = left_g[:, :, -1:], left_h[:, :, -1:]
        gain = left_g**2 / (left_h + self.l2) + (all_g - left_g) ** 2 / (all_h - left_h + self.l2) - all_g**2 / (all_h + self.l2)
        gain = np.where((left_h >= self.least) & (all_h - left_h >= self.least) & may, gain, 0.0).reshape(len(g), -1)
        best = gain.argmax(axis=1)
        return best, gain[np.arange(len(g)), best] > 1e-9

    def start(self, n: float, positives: float) -> BoostedTrees:
        share = np.clip(positives / n if n else 0.5, 1e-3, 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        self.feature, self.at, self.bin, self.leaf = [], [], [], []
        return self

    def split(self, level: int, g: np.ndarray, h: np.ndarray) -> None:
        """The next level of the tree in the making, and after the last one its leaves; sums as for ``_best``."""
        first, many = (1 << level) - 1, 1 << level
        if not level:
            inner = (1 << self.depth) - 1
            self.feature.append(np.zeros(inner, np.int64)), self.at.append(np.full(inner, np.inf)), self.bin.append(np.full(inner, BINS, np.uint8))
        best, ok = self._best(g, h, np.arange(BINS) < len(EDGES))
        f, b, node = best // BINS, best % BINS, np.arange(many)
        self.feature[-1][first : first + many] = f
        self.at[-1][first : first + many] = np.where(ok, EDGES[np.minimum(b, len(EDGES) - 1)], np.inf)
        self.bin[-1][first : first + many] = np.where(ok, b, BINS)
        if level == self.depth - 1:
            whole = [s[:, 0].sum(axis=1) for s in (g, h)]
            left = [np.where(ok, np.cumsum(s, axis=2)[node, f, b], t) for s, t in zip((g, h), whole, strict=True)]
            sums = [np.stack([a, t - a], axis=1).ravel() for a, t in zip(left, whole, strict=True)]
            self.leaf.append(-sums[0] / (sums[1] + self.l2) * self.rate)

    def _node(self, tree: int, bins: np.ndarray, levels: int) -> np.ndarray:
        node = np.zeros(bins.shape[1], np.uint8)
        for level in range(levels):
            first, right = (1 << level) - 1, np.zeros(bins.shape[1], bool)
            for i in range(1 << level):
                over = bins[self.feature[tree][first + i]] > self.bin[tree][first + i]
                right = np.where(node == i, over, right) if level else over
            node = 2 * node + right
        return node

    def of_bins(self, bins: np.ndarray) -> np.ndarray:
        """Probabilities of rows in bins, by the trees that are done."""
        z = np.full(bins.shape[1], self.base)
        for tree, leaf in enumerate(self.leaf):
            z += leaf[self._node(tree, bins, self.depth)]
        return 1 / (1 + np.exp(-z))

    def level_sums(self, level: int, bins: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Sums of first and second derivatives of a block, by node of this level, feature and bin."""
        p, many = self.of_bins(bins), 1 << level
        node = self._node(-1, bins, level).astype(np.int64) * BINS
        both = [np.rint(v * UNIT) * n for v in (p - y, p * (1 - p))]
        return np.array([[np.bincount(node + b, weights=v, minlength=many * BINS).reshape(many, BINS) for b in bins] for v in both]).transpose(0, 2, 1, 3)

    def predict(self, x: np.ndarray) -> np.ndarray:
        z, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, at, leaf in zip(self.feature, self.at, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > at[node])
            z += leaf[node - len(feature)]
        return 1 / (1 + np.exp(-z))


Passes = Callable[[Callable[[Block], np.ndarray]], np.ndarray]


def _level_of(block: Block, models: dict[tuple[int, int], BoostedTrees], level: int) -> np.ndarray:
    group, bins, y, n, fold = block
    out = np.zeros((len(models), 2, 1 << level, len(bins), BINS))
    for i, ((k, without), m) in enumerate(models.items()):
        if k == group:
            at = fold != without
            out[i] = m.level_sums(level, bins[:, at], y[at], n[at])
    return out


def grow(passes: Passes, sizes: dict[tuple[int, int], tuple[float, float]]) -> dict[tuple[int, int], BoostedTrees]:
    """Trees of each (group, fold left out; 3 for none), all at once.  ``sizes``: their rows and positives, by weight.

    ``passes(f)`` is the sum of ``f(block)`` over all blocks.
    """
    models = {k: BoostedTrees().start(*v) for k, v in sizes.items()}
    first = next(iter(models.values()), BoostedTrees(0))
    for _ in range(first.rounds):
        for level in range(first.depth):
            sums = passes(partial(_level_of, models=models, level=level)) / UNIT
            for m, (g, h) in zip(models.values(), sums, strict=True):
                m.split(level, g, h)
    return models


def precise_threshold(scores: np.ndarray, y: np.ndarray, precision: float, least_positives: int, n: np.ndarray | None = None) -> float:
    """The score from which on the share of positives reaches ``precision``, half way down to the next example and at least 0.5.

    Infinite without enough positives, or if no score reaches the precision.  ``n``: how often each example counts.
    """
    n = np.ones(len(y)) if n is None else n
    if (y * n).sum() < least_positives:
        return float("inf")
    order = np.argsort(-scores, kind="stable")
    s, hits, seen = scores[order], np.cumsum((y * n)[order]), np.cumsum(n[order])
    last = np.append(s[1:] != s[:-1], True)  # equal scores stand or fall together
    ok = last & (hits / seen >= precision) & (y[order] == 1)
    if not ok.any():
        return float("inf")
    low = s[ok].min()
    return float(max(0.5, (low + s[s < low].max(initial=0.0)) / 2))
