"""Trees of a random forest, grown on counts of binned rows instead of the rows.

A tree asks of a row only on which side of some thresholds its features lie.
Rows whose features fall into the same bins are one cell to it, so a table of
cells with their counts replaces the rows, however many there are, and what the
trees say of a row can be read from a table of cells as well. How often the
rows of a cell are drawn into a bag is the sum of their Poisson draws: one draw
with their count for a mean.
"""

from __future__ import annotations

import numpy as np


def codes(columns: list[np.ndarray], thresholds: list[np.ndarray]) -> np.ndarray:
    """Number of the cell of each row; a value equal to a threshold lies below it."""
    out = np.zeros(len(columns[0]), np.int32)
    for values, cuts in zip(columns, thresholds):
        if np.isnan(values).any():
            raise ValueError("features must not be missing")
        out = out * (len(cuts) + 1) + np.searchsorted(cuts, values, "left").astype(np.int32)
    return out


def weighted_cuts(values: np.ndarray, weights: np.ndarray, bins: int) -> np.ndarray:
    """At most ``bins - 1`` thresholds between which lie equal weights; none that has nothing above it."""
    order = np.argsort(values, kind="stable")
    values, upto = values[order], np.cumsum(weights[order])
    # what reaches its share but for the last digits of a sum has reached it
    at = np.searchsorted(upto, upto[-1] * np.arange(1, bins) / bins * (1 - 1e-9))
    cuts = np.unique(values[np.minimum(at, len(values) - 1)])
    return cuts[cuts < values[-1]]


def _best_split(hist: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gain in Gini impurity and the last bin on the left, for each node (first axis) with its bins and classes."""
    left = np.cumsum(hist, axis=1)[:, :-1]
    right = whole[:, None] - left
    a, b, n = left.sum(2), right.sum(2), whole.sum(1)
    with np.errstate(divide="ignore", invalid="ignore"):
        pure = (left**2).sum(2) / a + (right**2).sum(2) / b - ((whole**2).sum(1) / n)[:, None]
        gain = np.where((a > 0) & (b > 1e-12 * n[:, None]), pure / n[:, None], -1.0)
    at = gain.argmax(1)
    return np.take_along_axis(gain, at[:, None], 1)[:, 0], at


def grow(
    cells: np.ndarray, labels: np.ndarray, counts: np.ndarray, weights: np.ndarray, shape: list[int], classes: int, depth: int, tries: int, seed: list[int]
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Leaves of one tree: lowest bin and first bin beyond in each feature, and the share of each class.

    Each row of the input is a cell with a label, how many rows of the data it
    stands for and the weight of one of them. A node tries ``tries`` features.
    Sister leaves with the same prediction are one leaf.
    """
    rng = np.random.default_rng(seed)
    drawn = rng.poisson(counts)
    kept = np.flatnonzero(drawn)
    if not len(kept):  # an empty bag knows nothing but the data it was drawn from
        kept, drawn = np.arange(len(counts)), counts
    weight, label = drawn[kept] * weights[kept], labels[kept].astype(np.int64)
    bins = [b.astype(np.int16) for b in np.unravel_index(cells[kept], shape)]

    totals = [np.bincount(label, weight, classes)]
    lows, highs = [np.zeros(len(shape), np.int16)], [np.array(shape, np.int16)]
    children: dict[int, tuple[int, int]] = {}
    nodes, node = np.array([0]), np.zeros(len(kept), np.int64)
    for _ in range(depth):
        whole = np.array([totals[i] for i in nodes])
        chosen = rng.random((len(nodes), len(shape))).argsort(1).argsort(1) < tries
        gains = np.full((len(shape), len(nodes)), -1.0)
        ends = np.zeros((len(shape), len(nodes)), np.int64)
        hists: dict[int, np.ndarray] = {}
        for f, width in enumerate(shape):
            own = np.flatnonzero(chosen[:, f])
            if width < 2 or not len(own):
                continue
            number = np.full(len(nodes), -1)
            number[own] = np.arange(len(own))
            at = number[node]
            rows = np.flatnonzero(at >= 0)
            place = (at[rows] * width + bins[f][rows]) * classes + label[rows]
            hist = np.bincount(place, weight[rows], len(own) * width * classes).reshape(len(own), width, classes)
            gains[f, own], ends[f, own] = _best_split(hist, whole[own])
            hists |= zip(own * len(shape) + f, hist)
        best = gains.argmax(0)
        split = gains[best, np.arange(len(nodes))] > 1e-12
        if not split.any():
            break
        first = np.full(len(nodes), -1)
        following = []
        for k in np.flatnonzero(split):
            f, end = best[k], ends[best[k], k]
            parent, left = nodes[k], hists[k * len(shape) + f][: end + 1].sum(0)
            children[parent] = len(totals), len(totals) + 1
            first[k] = len(following)
            following += children[parent]
            totals += [left, np.maximum(totals[parent] - left, 0.0)]
            high, low = highs[parent].copy(), lows[parent].copy()
            high[f] = low[f] = end + 1
            lows += [lows[parent], low]
            highs += [high, highs[parent]]
        go = np.flatnonzero(split[node])
        at = node[go]
        value = np.empty(len(go), np.int16)
        for f in range(len(shape)):
            here = np.flatnonzero(best[at] == f)
            value[here] = bins[f][go[here]]
        node = first[at] + (value > ends[best[at], at])
        weight, label, bins = weight[go], label[go], [b[go] for b in bins]
        nodes = np.array(following)

    says = [int(t.argmax()) for t in totals]
    for parent in sorted(children, reverse=True):
        a, b = children[parent]
        if a not in children and b not in children and says[a] == says[b]:
            del children[parent]
    leaves, todo = [], [0]
    while todo:
        at = todo.pop()
        if at in children:
            todo += children[at]
        else:
            leaves.append(at)
    shares = np.array([totals[i] / totals[i].sum() for i in leaves])
    return np.array([lows[i] for i in leaves]), np.array([highs[i] for i in leaves]), shares


def votes(leaves: list[tuple[np.ndarray, np.ndarray, np.ndarray]], shape: list[int], classes: int) -> np.ndarray:
    """Summed shares of all trees, one row per cell and one column per class."""
    out = np.zeros([classes, *shape])
    for lows, highs, shares in leaves:
        for low, high, share in zip(lows, highs, shares):
            out[(slice(None), *map(slice, low, high))] += share.reshape(-1, *[1] * len(shape))
    return out.reshape(classes, -1).T.copy()
