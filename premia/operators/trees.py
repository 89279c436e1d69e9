"""Trees over binned features as flat arrays: descent, histograms, best splits, weighted medians."""

from __future__ import annotations

import numpy as np

# A leaf has feature -1. A split goes left up to ``bin``, or if that is -1 where ``mask`` has the bin's bit.
NODE = np.dtype(
    [("feature", "<i2"), ("bin", "<i2"), ("left", "<i4"), ("right", "<i4"), ("value", "<f8"), ("mask", "u1", (32,))]
)
BINS = 256
# Splits that gain less than this share of what the node has gained are rounding.
LEAST_GAIN = 1e-10


def leaf(value: float = 0.0) -> np.ndarray:
    node = np.zeros(1, NODE)
    node["feature"], node["value"] = -1, value
    return node


class Forest:
    """Several trees, one after another, with where each begins."""

    def __init__(self, trees: list[np.ndarray]):
        sizes = [len(t) for t in trees]
        self.roots = np.cumsum([0, *sizes])[:-1]
        whole = np.concatenate(trees) if trees else np.zeros(0, NODE)
        offset = np.repeat(self.roots, sizes)
        self.feature, self.bin = whole["feature"].astype(np.int64), whole["bin"].astype(np.int64)
        self.left, self.right = whole["left"] + offset, whole["right"] + offset
        self.value, self.mask = whole["value"].copy(), whole["mask"].copy()

    def descend(self, at: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The leaf each row of bins comes to from node ``at``."""
        at, rows = at.copy(), np.arange(len(at))
        while len(rows):
            node = at[rows]
            feature = self.feature[node]
            inner = feature >= 0
            rows, node, feature = rows[inner], node[inner], feature[inner]
            found, split = x[rows, feature].astype(np.int64), self.bin[node]
            left = found <= split
            named = np.flatnonzero(split < 0)
            if len(named):
                bits = self.mask[node[named], found[named] >> 3]
                left[named] = (bits >> (found[named] & 7)) & 1 > 0
            at[rows] = np.where(left, self.left[node], self.right[node])
        return at


def shrunk(g, l1: float):
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0.0)


def best_splits(counts, g, h, nominal: bool, min_leaf: int, l1: float, l2: float):
    """Best split of each node over one feature, from histograms of shape (nodes, bins).

    Returns gain (-1 where there is none), bin, mask, and the sums left of the split.
    """
    nodes, width = counts.shape
    if nominal:
        # Ordered by their mean step, categories are best parted by a threshold; empty bins come last.
        step = np.where(counts > 0, g / np.maximum(h, 1e-300), np.inf)
        order = np.argsort(step, axis=1, kind="stable")
    sums = [np.take_along_axis(a, order, 1) for a in (counts, g, h)] if nominal else (counts, g, h)
    left = [np.cumsum(a, 1)[:, :-1] for a in sums]
    whole = [a.sum(1, keepdims=True) for a in (counts, g, h)]
    right = [w - a for w, a in zip(whole, left, strict=True)]

    def score(g_, h_):
        return shrunk(g_, l1) ** 2 / np.maximum(h_ + l2, 1e-300)

    before = score(whole[1], whole[2])
    gain = score(left[1], left[2]) + score(right[1], right[2]) - before
    enough = (left[0] >= max(min_leaf, 1)) & (right[0] >= max(min_leaf, 1)) & (gain > LEAST_GAIN * (1 + before))
    gain = np.where(enough, gain, -1.0)
    at, rows = gain.argmax(1), np.arange(nodes)
    masks = np.zeros((nodes, 32), np.uint8)
    if nominal:
        rank = np.empty(counts.shape, np.int64)
        np.put_along_axis(rank, order, np.broadcast_to(np.arange(width), counts.shape), 1)
        chosen = (rank <= at[:, None]) & (counts > 0)
        masks[:, : -(-width // 8)] = np.packbits(chosen, axis=1, bitorder="little")
    bins = np.full(nodes, -1) if nominal else at
    return gain[rows, at], bins, masks, [a[rows, at] for a in left], [w[:, 0] for w in whole]


def crossing(low, high, weight, below: float, total: float, after: float):
    """Where the weight below a value comes to half of the total: a weighted median.

    ``low``, ``high`` and ``weight`` describe bins of values in ascending order, ``below`` is the weight
    under the first of them, ``total`` that of all values, ``after`` the next value above the last. Where
    the weight parts evenly, the median is the mean of the two middle values. Returns the median, or else
    the bin in which it lies, as low, high, weight below and next value.
    """
    upto = below + np.cumsum(weight)
    reached = 2 * upto >= total
    b = int(np.argmax(reached)) if reached.any() else len(low) - 1
    following = low[b + 1] if b + 1 < len(low) else after
    if 2 * upto[b] == total:
        return (high[b] + following) / 2 if np.isfinite(following) else high[b], None
    if low[b] == high[b]:
        return low[b], None
    return None, (low[b], high[b], upto[b] - weight[b], following)
