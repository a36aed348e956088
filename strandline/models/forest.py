"""Probability forests with Hellinger splits on NumPy; trees can be grown by tasks of their own."""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from strandline.session import ship_package

MIN_NODE = 10
#: Pairs of a row and a tree that are followed at once.
PATHS = 1 << 16


@dataclass(frozen=True)
class Tree:
    feature: np.ndarray  # -1: leaf
    split: np.ndarray
    left: np.ndarray
    right: np.ndarray
    share: np.ndarray  # positives of a leaf

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        while True:
            inner = self.feature[at] >= 0
            if not inner.any():
                return self.share[at]
            rows = np.flatnonzero(inner)
            node = at[rows]
            at[rows] = np.where(x[rows, self.feature[node]] <= self.split[node], self.left[node], self.right[node])


def hellinger(pos_left: np.ndarray, neg_left: np.ndarray, pos: int, neg: int) -> np.ndarray:
    """Distance of the classes' shares on both sides of a split."""
    a, b = pos_left / pos, neg_left / neg
    return np.sqrt((np.sqrt(a) - np.sqrt(b)) ** 2 + (np.sqrt(1 - a) - np.sqrt(1 - b)) ** 2)


def mixed(a: int, b: int) -> int:
    """A 64-bit mark from two numbers."""
    z = (a * 0x9E3779B97F4A7C15 + b + 1) & 0xFFFFFFFFFFFFFFFF
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = ((z ^ z >> shift) * factor) & 0xFFFFFFFFFFFFFFFF
    return z ^ z >> 31


def tried(mark: int, features: int) -> np.ndarray:
    """Which features the node of a mark tries, in order."""
    return np.random.default_rng(mark).choice(features, max(1, int(np.sqrt(features))), replace=False)


def grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator | None, depth: int = 0, min_node: int = MIN_NODE, rows: np.ndarray | None = None, mark: int = 0) -> tuple[Tree, np.ndarray]:
    """A tree on a bootstrap sample, trying floor(sqrt(features)) features a node, and the rows that it has not seen.
    Splits lie midway between values; a node of at most min_node rows, of one class, or at the depth (0: any) is a leaf.

    Without rng the sample is `rows`, and a node's features follow from its mark: the root's is given, a child's is
    mixed from its parent's and its side, so that it doesn't matter who grows which part of a tree."""
    rows = rng.integers(0, len(x), len(x)) if rng else rows
    tries = max(1, int(np.sqrt(x.shape[1])))
    feature, split, left, right, share = [], [], [], [], []
    work = [(rows, 0, -1, False, mark)]
    while work:
        own, level, parent, is_right, mark = work.pop()
        node = len(feature)
        if parent >= 0:
            (right if is_right else left)[parent] = node
        labels = y[own]
        pos = int(labels.sum())
        neg = len(own) - pos
        for column, value in ((feature, -1), (split, 0.0), (left, -1), (right, -1), (share, pos / max(1, len(own)))):
            column.append(value)
        if len(own) <= min_node or not pos or not neg or (depth and level >= depth):
            continue
        best = (0.0, -1, 0.0)
        for f in rng.choice(x.shape[1], tries, replace=False) if rng else tried(mark, x.shape[1]):
            order = np.argsort(x[own, f], kind="stable")
            v, lab = x[own, f][order], labels[order]
            cut = np.flatnonzero(v[1:] != v[:-1])
            if len(cut):
                p = np.cumsum(lab)[cut]
                gain = hellinger(p, cut + 1 - p, pos, neg)
                i = int(np.argmax(gain))
                if gain[i] > best[0]:
                    best = (float(gain[i]), int(f), float((v[cut[i]] + v[cut[i] + 1]) / 2))
        if best[1] < 0:
            continue
        feature[node], split[node] = best[1], best[2]
        low = x[own, best[1]] <= best[2]
        sides = (0, 0) if rng else (mixed(mark, 1), mixed(mark, 0))
        work += [(own[~low], level + 1, node, True, sides[0]), (own[low], level + 1, node, False, sides[1])]
    unseen = np.setdiff1d(np.arange(len(x)), rows)
    return Tree(np.array(feature), np.array(split), np.array(left), np.array(right), np.array(share)), unseen


def grow_levels(codes: np.ndarray, values: tuple[np.ndarray, ...], y: np.ndarray, times: np.ndarray, depth: int = 0, min_node: int = MIN_NODE, mark: int = 0) -> Tree:
    """grow()'s tree without rng, of rows given as places in each feature's sorted values and how often each is in the sample.
    All nodes of a level are split at once, so a node costs little beyond its rows."""
    features = codes.shape[1]
    tries, width = len(tried(0, features)), max(map(len, values))
    table = np.zeros((features, width))
    for j, v in enumerate(values):
        table[j, : len(v)] = v
    feature, split, children, shares = [], [], [], []  # by level
    rows, marks, level = np.flatnonzero(times), [mark], 0
    at = np.zeros(len(rows), np.int64)
    while marks:
        n = len(marks)
        weight = times[rows]
        total = np.bincount(at, weight, n).astype(np.int64)
        pos = np.bincount(at, weight * y[rows], n).astype(np.int64)
        neg = total - pos
        best, of, low, high = np.zeros(n), np.full(n, -1), np.zeros(n, np.int64), np.zeros(n, np.int64)
        open_ = (total > min_node) & (pos > 0) & (neg > 0) & (not depth or level < depth)
        wanted = np.zeros((n, tries), np.int64)
        for i in np.flatnonzero(open_):
            wanted[i] = tried(marks[i], features)
        stay = open_[at]
        rows, at, weight = rows[stay], at[stay], weight[stay]
        positive = weight * y[rows]
        for j in range(tries if len(rows) else 0):
            key = at * width + codes[rows, wanted[at, j]]
            order = np.argsort(key)
            key = key[order]
            heads = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            node, code = np.divmod(key[heads], width)
            p = np.cumsum(np.add.reduceat(positive[order], heads))
            w = np.cumsum(np.add.reduceat(weight[order], heads))
            first = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
            group = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(node)]))
            p, w = p - np.r_[0, p][first][group], w - np.r_[0, w][first][group]
            cut = np.flatnonzero(node[1:] == node[:-1])
            if not len(cut):
                continue
            own = node[cut]
            gain = hellinger(p[cut], w[cut] - p[cut], pos[own], neg[own])
            starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            most = np.maximum.reduceat(gain, starts)
            tops = np.flatnonzero(gain == np.repeat(most, np.diff(np.r_[starts, len(own)])))
            tops = tops[np.r_[True, own[tops][1:] != own[tops][:-1]]]  # the first of equal gains of a node
            tops = tops[gain[tops] > best[own[tops]]]
            i = own[tops]
            best[i], of[i], low[i], high[i] = gain[tops], wanted[i, j], code[cut[tops]], code[cut[tops] + 1]
        inner = np.flatnonzero(of >= 0)
        border = np.zeros(n)
        border[inner] = (table[of[inner], low[inner]] + table[of[inner], high[inner]]) / 2
        place = np.full(n, -1)
        place[inner] = 2 * np.arange(len(inner))
        feature.append(of), split.append(border), children.append(place), shares.append(pos / np.maximum(1, total))
        stay = of[at] >= 0
        rows, at = rows[stay], at[stay]
        at = place[at] + (table[of[at], codes[rows, of[at]]] > border[at])
        marks = [mixed(marks[i], side) for i in inner for side in (0, 1)]
        level += 1
    # numbered as grow() numbers them: a node, all on its left, all on its right
    base = np.r_[0, np.cumsum([len(c) for c in children])]
    down = np.concatenate([np.where(c >= 0, c + b, -1) for c, b in zip(children, base[1:])]).tolist()
    order_, stack = [], [0]
    while stack:
        i = stack.pop()
        order_.append(i)
        if down[i] >= 0:
            stack += (down[i] + 1, down[i])
    order = np.array(order_)
    number = np.empty(len(order) + 1, np.int64)
    number[order], number[-1] = np.arange(len(order)), -1
    left = np.array(down)[order]
    return Tree(np.concatenate(feature)[order], np.concatenate(split)[order], number[left], number[np.where(left >= 0, left + 1, -1)], np.concatenate(shares)[order])


@dataclass(frozen=True)
class Forest:
    trees: tuple[Tree, ...]
    oob_error: float = float("nan")

    def __getstate__(self) -> dict:
        return {"trees": self.trees, "oob_error": self.oob_error}

    @cached_property
    def _nodes(self) -> tuple[np.ndarray, ...]:
        """The trees as one table: roots; by node the feature, the split, both children and the share."""
        base = np.r_[0, np.cumsum([len(t.feature) for t in self.trees])]
        both = [np.stack([t.left, t.right], axis=1) + b for t, b in zip(self.trees, base)]
        feature, split, share = (np.concatenate([getattr(t, c) for t in self.trees]) for c in ("feature", "split", "share"))
        return base[:-1], feature.astype(np.int32), split.astype(np.float64), np.concatenate(both).ravel().astype(np.int32), share.astype(np.float64)

    def positive_share(self, x: np.ndarray) -> np.ndarray:
        """The mean of the trees' predict(x): rows go down all trees at the same time, about PATHS paths at once."""
        roots, feature, split, children, share = self._nodes
        step = max(1, PATHS // len(roots))
        out = np.empty(len(x))
        for first in range(0, len(x), step):
            own = np.ascontiguousarray(x[first : first + step])
            values, end = own.ravel(), np.repeat(roots, len(own))
            path = np.flatnonzero(feature[end] >= 0)
            node, begin = end[path], path % max(1, len(own)) * own.shape[1]
            while len(path):
                right = ~(values[begin + feature[node]] <= split[node])
                node = children[2 * node + right].astype(np.int64)
                inner = feature[node] >= 0
                end[path[~inner]] = node[~inner]
                path, node, begin = path[inner], node[inner], begin[inner]
            # tree by tree: the last bits of a sum must not depend on how many rows come at once
            out[first : first + step] = sum(share[end].reshape(len(roots), len(own)), np.zeros(len(own)))
        return out / len(roots)

    def decide(self, x: np.ndarray) -> np.ndarray:
        """P(positive) - P(negative)."""
        return 2 * self.positive_share(x) - 1


def _check(y: np.ndarray) -> None:
    if len(np.unique(y)) != 2:
        raise ValueError("a forest needs rows of exactly two classes")


def packed(tree: Tree) -> bytes:
    """A tree as a task sends it to the driver: leaves make most of its columns repeat."""
    return zlib.compress(pickle.dumps(tree), 1)


def unpacked(tree: bytes) -> Tree:
    return pickle.loads(zlib.decompress(tree))


def _oob(x: np.ndarray, y: np.ndarray, grown: Iterable[tuple[Tree, np.ndarray]]) -> float:
    """Mean squared lack of the true class's share over rows that some tree has not seen."""
    total, times = np.zeros(len(x)), np.zeros(len(x), np.int64)
    for tree, unseen in grown:
        total[unseen] += tree.predict(x[unseen])
        times[unseen] += 1
    seen = times > 0
    share = total[seen] / times[seen]
    return float(np.mean((1 - np.where(y[seen], share, 1 - share)) ** 2)) if seen.any() else float("nan")


def train_forest(x: np.ndarray, y: np.ndarray, trees: int = 500, depth: int = 0, seed: int = 0) -> Forest:
    """y: true for positives. Tree i is grown from (seed, i) alone."""
    x, y = np.asarray(x, np.float64), np.asarray(y, bool)
    _check(y)
    grown = [grow(x, y, np.random.default_rng([seed, i]), depth) for i in range(trees)]
    return Forest(tuple(t for t, _ in grown), _oob(x, y, grown))


def train_forest_distributed(spark: SparkSession, x: np.ndarray, y: np.ndarray, trees: int = 500, depth: int = 0, seed: int = 0) -> Forest:
    """The same forest, its trees grown by tasks; the training set is broadcast and must fit a task."""
    ship_package(spark)
    x, y = np.asarray(x, np.float64), np.asarray(y, bool)
    _check(y)
    data = spark.sparkContext.broadcast((x, y))

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from strandline.models.forest import grow, packed

        for frame in frames:
            grown = [packed(grow(*data.value, np.random.default_rng([seed, int(i)]), depth)[0]) for i in frame["id"]]
            yield pd.DataFrame({"id": frame["id"], "tree": grown})

    rows: DataFrame = spark.range(trees).repartition(min(trees, 4 * spark.sparkContext.defaultParallelism)).mapInPandas(work, "id long, tree binary")
    grown = tuple(unpacked(r["tree"]) for r in sorted(rows.collect(), key=lambda r: r["id"]))
    # the rows that a tree has not seen follow from its seed, whose first numbers are its sample
    unseen = (np.setdiff1d(np.arange(len(x)), np.random.default_rng([seed, i]).integers(0, len(x), len(x))) for i in range(trees))
    return Forest(grown, _oob(x, y, zip(grown, unseen)))
