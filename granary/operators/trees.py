"""Histogram trees for quantile loss over binned rows: what a task does with its rows, whole models or parts of one alike.

The gradient of the pinball loss has two values only, q above the score and q - 1 below it. So a histogram holds two counts
a bin, adds up exactly in any order, and a node's second child is its parent minus the first.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

#: Rows that are hashed at a time: what lies in between stays in the processor's cache.
CHUNK = 32_768


@dataclass
class Rows:
    """Binned rows of one model and one target: bins [feature, row] hold twice the bin, row is a hash that draws samples."""

    bins: np.ndarray
    y: np.ndarray
    row: np.ndarray
    time: np.ndarray

    def where(self, mask: np.ndarray) -> Rows:
        return self if mask.all() else Rows(self.bins[:, mask], self.y[mask], self.row[mask], self.time[mask])

    def by_time(self) -> Rows:
        """In order of time, feature by feature, so that no second copy of the bins is held."""
        order = np.argsort(self.time, kind="stable")
        for column in self.bins:
            column[:] = column[order]
        return Rows(self.bins, self.y[order], self.row[order], self.time[order])

    def between(self, begin: int, end: int) -> Rows:
        """A view of the rows at these places; nothing is copied."""
        return Rows(self.bins[:, begin:end], self.y[begin:end], self.row[begin:end], self.time[begin:end])


def sampled(row: np.ndarray, share: float, seed: int, tree: int) -> np.ndarray:
    """A repeatable share of the rows, drawn anew for every tree."""
    out, key = np.empty(len(row), bool), np.uint64((seed * 1_000_003 + tree) * 0x9E3779B97F4A7C15 % 2**64)
    below = np.uint64(max(math.ceil(share * 2**53), 0))
    for begin in range(0, len(row), CHUNK):
        x = row[begin:begin + CHUNK].view(np.uint64) ^ key
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out[begin:begin + CHUNK] = (x >> np.uint64(11)) < below
    return out


def histogram(bins: np.ndarray, place: np.ndarray, up: np.ndarray, places: int, n_bins: int) -> np.ndarray:
    """Rows below and above their score per [place, feature, bin, 2]."""
    base = place.astype(np.intp) * (2 * n_bins) + up
    cells = places * n_bins * 2
    out = np.empty((len(bins), cells), np.int64)
    for f, column in enumerate(bins):
        out[f] = np.bincount(base + column, minlength=cells)
    return out.reshape(len(bins), places, n_bins, 2).transpose(1, 0, 2, 3)


def paired(bins: np.ndarray, n_bins: int) -> list[np.ndarray]:
    """Two features a column, as the number of their cell among n_bins x n_bins; the last one may be alone."""
    made = []
    for f in range(0, len(bins), 2):
        column = (bins[f] >> 1).astype(np.uint16)
        if f + 1 < len(bins):
            column *= np.uint16(n_bins)
            column += bins[f + 1] >> 1
        made.append(column)
    return made


def pair_histogram(columns: list[np.ndarray], n_features: int, place: np.ndarray, up: np.ndarray, places: int, n_bins: int,
                   at: np.ndarray | None = None) -> np.ndarray:
    """`histogram` of paired columns, which are counted two features at a time; of the rows `at` only, if given, whose place and up
    are handed over alone."""
    cells = n_bins * n_bins
    kind = np.uint16 if 2 * places * cells <= 65_536 else np.uint32
    base = place.astype(kind)
    base += base
    base += up
    base *= kind(cells)
    out = np.empty((n_features, places, 2, n_bins), np.int64)
    for i, column in enumerate(columns):
        index = base + (column if at is None else column[at])
        counts = np.bincount(index, minlength=2 * places * cells).reshape(places, 2, n_bins, n_bins)
        if 2 * i + 1 < n_features:
            counts.sum(axis=3, out=out[2 * i])
            counts.sum(axis=2, out=out[2 * i + 1])
        else:  # alone: its bins lie where the second of two would
            counts.sum(axis=2, out=out[2 * i])
    return np.ascontiguousarray(out.transpose(1, 0, 3, 2))


class RootCounts:
    """Histogram of all rows in use, tree after tree: of the rows that went over to the other side of their score since the last tree,
    and of those out of use (or in use, if these are fewer) only."""

    def __init__(self, columns: list[np.ndarray], n_features: int, n_bins: int):
        self.columns, self.n_features, self.n_bins, self.up, self.hist = columns, n_features, n_bins, None, None

    def counted(self, up: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
        mine = up if at is None else up[at]
        return pair_histogram(self.columns, self.n_features, np.zeros(len(mine), np.uint8), mine, 1, self.n_bins, at)[0]

    def __call__(self, up: np.ndarray, use: np.ndarray) -> np.ndarray:
        if self.up is None:
            self.hist = self.counted(up)
        else:
            gone = self.counted(self.up, np.flatnonzero(up != self.up))
            self.hist = self.hist - gone + gone[..., ::-1]
        self.up = up
        if 2 * np.count_nonzero(use) < len(use):
            return self.counted(up, np.flatnonzero(use))
        rest = np.flatnonzero(~use)
        return self.hist - self.counted(up, rest) if len(rest) else self.hist


def best_splits(hist: np.ndarray, q: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per place of hist the feature (-1: none gains) and bin of the best cut, and whether its left side is the smaller one.

    Ties go to the first feature and the lowest bin. q is one quantile for each place.
    """
    left = np.cumsum(hist, axis=2)
    whole = left[:, :, -1:, :]
    right = whole - left
    share = q[:, None, None]

    def gain(sides: np.ndarray) -> np.ndarray:
        n = sides.sum(axis=3)
        g = share * sides[..., 1] - (1.0 - share) * sides[..., 0]
        return g * g / np.maximum(n, 1)

    gains = np.round(gain(left) + gain(right) - gain(whole), 9)
    n_left, n_right = left.sum(axis=3), right.sum(axis=3)
    gains[(n_left < least) | (n_right < least)] = -1.0
    flat = gains.reshape(len(hist), -1)
    best = np.argmax(flat, axis=1)
    at = np.arange(len(hist))
    feature, cut = np.divmod(best, hist.shape[2])
    none = flat[at, best] <= 1e-9
    return np.where(none, -1, feature), np.where(none, 0, cut), n_left[at, feature, cut] <= n_right[at, feature, cut]


def roots(n: int, depth: int) -> np.ndarray:
    """The node of rows before a tree, in one byte if all nodes of that depth fit it."""
    return np.ones(n, np.uint8 if depth < 8 else np.intp)


def moved(columns: np.ndarray, node: np.ndarray, feature: np.ndarray, limit: np.ndarray, level: int) -> np.ndarray:
    """The nodes of the rows one level further down: above its limit a value goes right. feature and limit are indexed by node, -1 where
    a node does not split."""
    splits = 2**level + np.flatnonzero(feature[2**level:2**(level + 1)] >= 0)
    if len(splits) > 32:
        f = np.where(node >> level == 1, feature[node], -1)
        row = np.arange(len(node))
        return np.where(f >= 0, (2 * node + (columns[np.maximum(f, 0), row] > limit[node])).astype(node.dtype), node)
    down, right = np.zeros(len(node), bool), np.zeros(len(node), bool)
    for k in splits.tolist():
        at = node == k
        down |= at
        at &= columns[feature[k]] > limit[k].item()
        right |= at
    out = node * down
    out += node
    out += right
    return out


def lower_quantile(values: np.ndarray, q: float) -> float:
    """The smallest value with at least a share q of all values up to it."""
    at = max(int(np.ceil(q * len(values) - 1e-9)), 1) - 1
    return float(np.partition(values, at)[at])


def pinball(miss: np.ndarray, q: float) -> np.ndarray:
    return np.maximum(q * miss, (q - 1.0) * miss)


def leaves(feature: np.ndarray) -> list[int]:
    """The nodes of a tree in which rows end."""
    found, open_nodes = [], [1]
    while open_nodes:
        node = open_nodes.pop()
        if feature[node] >= 0:
            open_nodes += [2 * node, 2 * node + 1]
        else:
            found.append(node)
    return found


def grow(rows: Rows, columns: list[np.ndarray], miss: np.ndarray, up: np.ndarray, use: np.ndarray, hist: np.ndarray, q: float,
         depth: int, least: int):
    """One tree on the rows in use, as arrays by node (feature, cut, value), and the leaf of every row. hist is that of all of them.

    Only the smaller child of a split is counted; the other one is the rest of its parent.
    """
    size = 2 ** (depth + 1)
    feature, cut, value = np.full(size, -1, np.int32), np.zeros(size, np.int64), np.zeros(size)
    node = roots(len(miss), depth)
    n_features, n_bins = hist.shape[:2]
    hist = hist[None]
    open_nodes = np.array([1])
    for level in range(depth):
        f, b, left_smaller = best_splits(hist, np.full(len(open_nodes), q), least)
        split = np.flatnonzero(f >= 0)
        if not len(split):
            break
        parents = open_nodes[split]
        feature[parents], cut[parents] = f[split], b[split]
        node = moved(rows.bins, node, feature, 2 * cut, level)
        if level + 1 == depth:
            break
        first = np.where(left_smaller[split], 2 * parents, 2 * parents + 1)
        place = np.zeros(size, node.dtype)
        place[first] = np.arange(len(first))
        mine = np.zeros(len(node), bool)
        for name in first.tolist():
            mine |= node == name
        mine &= use
        mine = np.flatnonzero(mine)
        smaller = pair_histogram(columns, n_features, place[node[mine]], up[mine], len(first), n_bins, mine)
        hist = np.concatenate((smaller, hist[split] - smaller))
        open_nodes = np.concatenate((first, first ^ 1))
    for name in leaves(feature):
        mine = node == name
        mine &= use
        rest = miss[mine]
        if len(rest):
            value[name] = lower_quantile(rest, q)
    return feature, cut, value, node


def boost(rows: Rows, q: float, n_bins: int, trees: int, rate: float, depth: int, least: int, subsample: float, seed: int,
          watched: bool = True):
    """All trees of one model on its rows: start value, feature, cut and value [tree, node], mean loss after each tree if watched."""
    size = 2 ** (depth + 1)
    feature, cut, value = np.full((trees, size), -1, np.int32), np.zeros((trees, size), np.int64), np.zeros((trees, size))
    start = lower_quantile(rows.y, q) if len(rows.y) else 0.0
    score, losses = np.full(len(rows.y), start), np.zeros(trees)
    columns = paired(rows.bins, n_bins)
    root = RootCounts(columns, len(rows.bins), n_bins)
    miss = rows.y - score
    for t in range(trees if len(rows.y) else 0):
        use, up = sampled(rows.row, subsample, seed, t), rows.y > score
        feature[t], cut[t], value[t], node = grow(rows, columns, miss, up, use, root(up, use), q, depth, least)
        step = rate * value[t]
        for begin in range(0, len(score), CHUNK):
            mine = slice(begin, begin + CHUNK)
            score[mine] += step[node[mine]]
            np.subtract(rows.y[mine], score[mine], out=miss[mine])
            if watched:
                losses[t] += pinball(miss[mine], q).sum()
    losses /= max(len(score), 1)
    return start, feature, cut, value, losses


def scores(bins: np.ndarray, start: float, rate: float, feature: np.ndarray, cut: np.ndarray, value: np.ndarray) -> np.ndarray:
    """What the given trees [tree, node] say of binned rows."""
    total = np.full(bins.shape[1], start)
    depth = int(np.log2(feature.shape[1])) - 1
    for t in range(len(feature)):
        node = roots(bins.shape[1], depth)
        for level in range(depth):
            node = moved(bins, node, feature[t], 2 * cut[t], level)
        total += rate * value[t][node]
    return total


def summary(values: np.ndarray, weights: np.ndarray, points: int) -> tuple[np.ndarray, np.ndarray]:
    """At most `points` of the weighted values, in order; no rank moves by more than half of the weight over `points`.

    Up to `points` values are all kept. Summaries of parts, laid together, are a summary of the whole.
    """
    order = np.argsort(values, kind="stable")
    values, upto = values[order], np.cumsum(weights[order])
    if len(values) <= points:
        return values, weights[order]
    ends = np.linspace(0, upto[-1], points + 1).round().astype(np.int64)
    return values[np.searchsorted(upto, (ends[1:] + ends[:-1] + 1) // 2)], np.diff(ends)


def summary_quantile(values: np.ndarray, weights: np.ndarray, q: float) -> float:
    """lower_quantile of weighted values."""
    order = np.argsort(values, kind="stable")
    upto = np.cumsum(weights[order])
    return float(values[order][min(np.searchsorted(upto, q * upto[-1] - 1e-9), len(values) - 1)])
