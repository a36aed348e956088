"""Probability forests over all rows of a table, which no machine holds.

Features become numbers of at most 256 bins, once; bins are the values themselves where there are no more of them. A row's
times in a tree's bootstrap sample is a Poisson number drawn from the row's key and the tree. Trees grow level by level:
tasks count both classes by node, tried feature and bin, the counts are summed by Spark, the Hellinger distance is taken
at each border between bins, and only the best split of each node comes back to the driver, which sends it out again.
A node of few rows is finished by one task, which grows the rest of it at once.

The driver holds the trees, as scoring does; depth or min_node bound their size. It never holds rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.models.forest import MIN_NODE, Forest, Tree, grow_levels, mixed, packed, tried, unpacked
from strandline.session import materialize, ship_package

BINS = 256
#: A node of at most so many rows of its sample is finished by one task.
LOCAL_ROWS = 1 << 18
#: Counters that a task holds at once; a level of more is counted in several passes.
CELLS = 1 << 22
#: Rows that a task looks at at once, a byte a feature.
CHUNK_ROWS = 1 << 15
#: Trees that grow at the same time: a pass over the table serves all of them.
TREES_AT_ONCE = 25
#: Cumulative shares of a Poisson number of mean 1.
_POISSON = np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 20)]))


@dataclass(frozen=True)
class Bins:
    """By feature: the value that stands for each bin (its largest), and whether bins are single values."""

    values: tuple[np.ndarray, ...]
    exact: tuple[bool, ...]

    def place(self, x: np.ndarray) -> np.ndarray:
        """Bins of rows of features, as bytes."""
        out = np.empty(x.shape, np.uint8)
        for j, v in enumerate(self.values):
            out[:, j] = np.minimum(np.searchsorted(v, x[:, j]), len(v) - 1)
        return out

    def split(self, feature: int, low: float, high: float) -> float:
        """The threshold between two bins, given by their values, of which no row of a node lies between."""
        middle = (low + high) / 2
        if self.exact[feature]:
            return middle
        v = self.values[feature]
        return float(v[np.searchsorted(v, middle, side="right") - 1])


def quantile_bins(samples: DataFrame, column: str = "features", bins: int = BINS) -> Bins:
    """Bins of the features of all rows: their values where an estimate finds few enough, else quantiles. Both are
    aggregates of one row a feature; nulls and NaN are errors."""
    each = samples.select(F.posexplode(column).alias("i", "v")).select("i", F.col("v").cast("double").alias("v"))
    each = each.withColumn("v", F.when(F.col("v").isNull() | F.isnan("v"), F.raise_error(F.lit("features must be numbers")).cast("double")).otherwise(F.col("v") + F.lit(0.0)))
    shares = [float(k) / bins for k in range(1, bins)]
    found = each.groupBy("i").agg(F.approx_count_distinct("v", 0.05).alias("n"), F.percentile_approx("v", shares, 10 * bins).alias("q"), F.max("v").alias("top")).orderBy("i").collect()
    few = [r["i"] for r in found if r["n"] <= 1.5 * bins]
    values = {r["i"]: sorted(r["v"]) for r in each.where(F.col("i").isin(few)).groupBy("i").agg(F.collect_set("v").alias("v")).collect()} if few else {}
    out, exact = [], []
    for r in found:
        own = values.get(r["i"], [])
        exact.append(0 < len(own) <= bins)
        out.append(np.array(own if exact[-1] else sorted({*r["q"], r["top"]}), np.float64))
    return Bins(tuple(out), tuple(exact))


def binned(samples: DataFrame, bins: Bins, key: str, label: str) -> DataFrame:
    """id (a hash of the key), flag, bins (a byte a feature), written."""
    ship_package(samples.sparkSession)
    shared = samples.sparkSession.sparkContext.broadcast(bins)

    @F.pandas_udf("binary")
    def place(features: pd.Series) -> pd.Series:
        if not len(features):
            return pd.Series([], dtype=object)
        return pd.Series([row.tobytes() for row in shared.value.place(np.array(features.tolist(), np.float64))])

    return materialize(samples.select(F.xxhash64(key).alias("id"), F.col(label).cast("boolean").alias("flag"), place("features").alias("bins")), "binned")


def times_drawn(ids: np.ndarray, mark: int) -> np.ndarray:
    """How often rows are in the sample of the tree of a mark."""
    z = ids.astype(np.uint64) ^ np.uint64(mark)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ z >> np.uint64(shift)) * np.uint64(factor)
    z = z ^ z >> np.uint64(31)
    return np.searchsorted(_POISSON, (z >> np.uint64(11)).astype(np.float64) / 2.0**53, side="right")


@dataclass
class Growing:
    """A tree while it grows: nodes as lists, the first is the root; bin: rows of bins up to it go left."""

    mark: int
    marks: list[int] = field(default_factory=list)
    level: list[int] = field(default_factory=list)
    pos: list[int] = field(default_factory=list)
    neg: list[int] = field(default_factory=list)
    feature: list[int] = field(default_factory=list)
    bin: list[int] = field(default_factory=list)
    split: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)

    def add(self, mark: int, level: int, pos: int, neg: int) -> int:
        for column, value in zip((self.marks, self.level, self.pos, self.neg, self.feature, self.bin, self.split, self.left, self.right), (mark, level, pos, neg, -1, -1, 0.0, -1, -1)):
            column.append(value)
        return len(self.marks) - 1

    def rows(self, node: int) -> int:
        return self.pos[node] + self.neg[node]

    def ends(self, node: int, depth: int, min_node: int) -> bool:
        return self.rows(node) <= min_node or not self.pos[node] or not self.neg[node] or bool(depth and self.level[node] >= depth)

    def route(self) -> tuple[np.ndarray, ...]:
        return tuple(np.array(c, np.int64) for c in (self.feature, self.bin, self.left, self.right))


def routed(bins: np.ndarray, route: tuple[np.ndarray, ...]) -> np.ndarray:
    """The node that each row has come to."""
    feature, upto, left, right = route
    at = np.zeros(len(bins), np.int64)
    rows = np.arange(len(bins))
    while len(rows := rows[feature[at[rows]] >= 0]):
        node = at[rows]
        at[rows] = np.where(bins[rows, feature[node]] <= upto[node], left[node], right[node])
    return at


def _read(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, flags, bins) of a batch."""
    data = batch.column(2)
    _, offsets, values = data.buffers()
    offsets = np.frombuffer(offsets, np.int32)[data.offset : data.offset + len(data) + 1]
    bins = np.frombuffer(values, np.uint8)[offsets[0] : offsets[-1]].reshape(len(data), -1) if len(data) else np.zeros((0, 1), np.uint8)
    return batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False).astype(bool), bins


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches put together to CHUNK_ROWS rows: each tree's path costs little more for many rows than for few."""
    held, rows = [], 0
    for b in batches:
        held.append(b)
        rows += len(b)
        if rows >= CHUNK_ROWS:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, rows = [], 0
    if rows:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _root_counts(table: DataFrame, marks: list[int]) -> list[tuple[int, int]]:
    """Rows of both classes in each tree's sample."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from strandline.models.binned_forest import _chunks, _read, times_drawn

        total = np.zeros((len(marks), 2), np.int64)
        for b in _chunks(batches):
            ids, flags, _ = _read(b)
            for t, mark in enumerate(marks):
                n = times_drawn(ids, mark)
                total[t] += n[flags].sum(), n[~flags].sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(marks))), pa.array(total[:, 0]), pa.array(total[:, 1])], names=["t", "pos", "neg"])

    counts = table.mapInArrow(work, "t long, pos long, neg long").groupBy("t").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    found = {r["t"]: (r["pos"], r["neg"]) for r in counts.collect()}
    return [found.get(t, (0, 0)) for t in range(len(marks))]


def _best_splits(table: DataFrame, trees: list[Growing], nodes: list[tuple[int, int]], bins: Bins) -> dict[tuple[int, int], tuple]:
    """For nodes (tree, node): (feature, bin, next bin that holds rows, rows of both classes on the left) of the best split."""
    spark, tries = table.sparkSession, len(tried(0, len(bins.values)))
    by_tree: dict[int, list[int]] = {}
    for i, (t, _) in enumerate(nodes):
        by_tree.setdefault(t, []).append(i)
    plan = []
    for t, own in by_tree.items():
        slot = np.full(len(trees[t].marks), -1, np.int64)
        slot[[nodes[i][1] for i in own]] = own
        plan.append((trees[t].mark, trees[t].route(), slot))
    features = np.array([tried(trees[t].marks[n], len(bins.values)) for t, n in nodes])
    shared = spark.sparkContext.broadcast((plan, features))
    width = max(map(len, bins.values))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from strandline.models.binned_forest import _chunks, _read, routed, times_drawn

        plan, features = shared.value
        cells = [np.zeros(len(features) * tries * width, np.int64) for _ in (0, 1)]
        for b in _chunks(batches):
            ids, flags, x = _read(b)
            for mark, route, slot in plan:
                n = times_drawn(ids, mark)
                at = slot[routed(x, route)]
                use = np.flatnonzero((at >= 0) & (n > 0))
                for j in range(tries):
                    where = (at[use] * tries + j) * width + x[use, features[at[use], j]]
                    for side, wanted in enumerate((flags[use], ~flags[use])):
                        np.add.at(cells[side], where[wanted], n[use][wanted])
        held = np.flatnonzero(cells[0] | cells[1])
        columns = [held // (tries * width), held // width % tries, held % width, cells[0][held], cells[1][held]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["slot", "j", "bin", "pos", "neg"])

    counts = table.mapInArrow(work, "slot long, j long, bin long, pos long, neg long").groupBy("slot", "j", "bin").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    order = Window.partitionBy("slot", "j").orderBy("bin")
    upto, all_ = order.rowsBetween(Window.unboundedPreceding, Window.currentRow), Window.partitionBy("slot", "j")
    cuts = counts.select("slot", "j", "bin", F.lead("bin").over(order).alias("next"), *[F.sum(c).over(upto).alias(c) for c in ("pos", "neg")], *[F.sum(c).over(all_).alias(f"all_{c}") for c in ("pos", "neg")]).where("next IS NOT NULL")
    a, b = F.col("pos") / F.col("all_pos"), F.col("neg") / F.col("all_neg")
    inner, outer = F.sqrt(a) - F.sqrt(b), F.sqrt(1 - a) - F.sqrt(1 - b)
    gain = F.sqrt(inner * inner + outer * outer)
    best = cuts.withColumn("gain", gain).where("gain > 0").groupBy("slot").agg(F.max_by(F.struct("j", "bin", "next", "pos", "neg"), F.struct("gain", -F.col("j"), -F.col("bin"))).alias("b"))
    return {nodes[r["slot"]]: (int(features[r["slot"], r["b"]["j"]]), r["b"]["bin"], r["b"]["next"], r["b"]["pos"], r["b"]["neg"]) for r in best.collect()}


def _finish(table: DataFrame, trees: list[Growing], nodes: list[tuple[int, int]], bins: Bins, depth: int, min_node: int) -> dict[tuple[int, int], Tree]:
    """The rest of small nodes, each grown by a task that holds that node's rows alone."""
    spark = table.sparkSession
    plan = []
    for t in sorted({t for t, _ in nodes}):
        wanted = np.zeros(len(trees[t].marks), bool)
        wanted[[n for u, n in nodes if u == t]] = True
        plan.append((t, trees[t].mark, trees[t].route(), wanted))
    shared = spark.sparkContext.broadcast((plan, bins, {(t, n): (trees[t].marks[n], depth - trees[t].level[n] if depth else 0) for t, n in nodes}))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from strandline.models.binned_forest import _chunks, _read, routed, times_drawn

        for b in _chunks(batches):
            ids, flags, x = _read(b)
            for t, mark, route, wanted in shared.value[0]:
                n, at = times_drawn(ids, mark), routed(x, route)
                use = np.flatnonzero(wanted[at] & (n > 0))
                if len(use):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(use), t)), pa.array(at[use]), pa.array(flags[use]), pa.array(n[use]), b.column(2).take(pa.array(use))], names=["t", "node", "flag", "n", "bins"])

    def grown(key, part: pd.DataFrame) -> pd.DataFrame:
        from strandline.models.forest import grow_levels, packed

        _, bins, marks = shared.value
        codes = np.frombuffer(b"".join(part["bins"]), np.uint8).reshape(len(part), -1)
        mark, left = marks[int(key[0]), int(key[1])]
        tree = grow_levels(codes, bins.values, part["flag"].to_numpy(bool), part["n"].to_numpy(np.int64), left, min_node, mark)
        return pd.DataFrame({"t": [key[0]], "node": [key[1]], "tree": [packed(tree)]})

    out = table.mapInArrow(rows, "t long, node long, flag boolean, n long, bins binary").groupBy("t", "node").applyInPandas(grown, "t long, node long, tree binary")
    return {(r["t"], r["node"]): unpacked(r["tree"]) for r in out.collect()}


def _joined(tree: Growing, parts: dict[int, Tree], bins: Bins) -> Tree:
    """The whole tree: the nodes of tasks come after its own; borders of wide bins become thresholds."""
    columns = [list(tree.feature), list(tree.split), list(tree.left), list(tree.right), [p / max(1, p + n) for p, n in zip(tree.pos, tree.neg)]]
    for node, part in parts.items():
        moved = np.where(np.arange(len(part.feature)) == 0, node, np.arange(len(part.feature)) + len(columns[0]) - 1)
        split = [bins.split(f, s, s) if f >= 0 else 0.0 for f, s in zip(part.feature.tolist(), part.split.tolist())]
        own = [part.feature.tolist(), split, [int(moved[c]) if c >= 0 else -1 for c in part.left], [int(moved[c]) if c >= 0 else -1 for c in part.right], part.share.tolist()]
        for column, values in zip(columns, own):
            column[node] = values[0]
            column += values[1:]
    return Tree(*(np.array(c) for c in columns))


def train_forest_all_rows(samples: DataFrame, key: str, label: str = "flag", trees: int = 500, depth: int = 0, seed: int = 0, min_node: int = MIN_NODE, bins: int | Bins = BINS, local_rows: int = LOCAL_ROWS) -> Forest:
    """A forest on all rows of samples (features, key, label), with its out-of-bag error. Tree t follows from (seed, t), the
    keys, the rows and the bins alone, however rows are spread; rows of equal keys are drawn together. Where each feature has
    at most `bins` values, trees are those of `grow` on the same samples; else splits lie at quantiles, which are
    estimates: give the bins themselves where reruns over other partitions must agree."""
    found = bins if isinstance(bins, Bins) else quantile_bins(samples, bins=bins)
    table = binned(samples, found, key, label)
    if table.select("flag").distinct().count() != 2:
        raise ValueError("a forest needs rows of exactly two classes")
    done: list[Tree] = []
    for first in range(0, trees, TREES_AT_ONCE):
        marks = [mixed(mixed(seed, 0), t) for t in range(first, min(trees, first + TREES_AT_ONCE))]
        growing = [Growing(m) for m in marks]
        small: list[tuple[int, int]] = []
        level: list[tuple[int, int]] = []

        def sort_in(t: int, node: int) -> None:
            tree = growing[t]
            if not tree.ends(node, depth, min_node):
                (small if tree.rows(node) <= local_rows else level).append((t, node))

        for t, (pos, neg) in enumerate(_root_counts(table, marks)):
            sort_in(t, growing[t].add(marks[t], 0, pos, neg))
        at_once = max(1, CELLS // (len(tried(0, len(found.values))) * max(map(len, found.values))))
        while level:
            now, level = level, []
            for i in range(0, len(now), at_once):
                for (t, node), (f, upto, next_, pos, neg) in sorted(_best_splits(table, growing, now[i : i + at_once], found).items()):
                    g = growing[t]
                    g.feature[node], g.bin[node] = f, upto
                    g.split[node] = found.split(f, float(found.values[f][upto]), float(found.values[f][next_]))
                    g.left[node] = g.add(mixed(g.marks[node], 0), g.level[node] + 1, pos, neg)
                    g.right[node] = g.add(mixed(g.marks[node], 1), g.level[node] + 1, g.pos[node] - pos, g.neg[node] - neg)
                    for child in (g.left[node], g.right[node]):
                        sort_in(t, child)
        parts = _finish(table, growing, small, found, depth, min_node) if small else {}
        done += [_joined(g, {n: p for (u, n), p in parts.items() if u == t}, found) for t, g in enumerate(growing)]
    return Forest(tuple(done), out_of_bag(table, found, tuple(done), seed))


def out_of_bag(table: DataFrame, bins: Bins, trees: tuple[Tree, ...], seed: int) -> float:
    """Mean squared lack of the true class's share over rows that some tree has not seen: two sums a task."""
    shared = table.sparkSession.sparkContext.broadcast((bins, trees))
    marks = [mixed(mixed(seed, 0), t) for t in range(len(trees))]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from strandline.models.binned_forest import _chunks, _read, times_drawn

        bins, trees = shared.value
        rows, lack = 0, 0.0
        for b in _chunks(batches):
            ids, flags, codes = _read(b)
            if not len(ids):
                continue
            x = np.stack([v[codes[:, j]] for j, v in enumerate(bins.values)], axis=1)
            total, times = np.zeros(len(ids)), np.zeros(len(ids), np.int64)
            for tree, mark in zip(trees, marks):
                out = np.flatnonzero(times_drawn(ids, mark) == 0)
                total[out] += tree.predict(x[out])
                times[out] += 1
            seen = times > 0
            share = total[seen] / times[seen]
            rows += int(seen.sum())
            lack += float(((1 - np.where(flags[seen], share, 1 - share)) ** 2).sum())
        yield pa.RecordBatch.from_arrays([pa.array([rows]), pa.array([lack])], names=["rows", "lack"])

    found = table.mapInArrow(work, "rows long, lack double").agg(F.sum("rows"), F.sum("lack")).first()
    return found[1] / found[0] if found[0] else float("nan")


def permutation_importance(samples: DataFrame, forest: Forest, bins: Bins, key: str, label: str = "flag", seed: int = 0) -> DataFrame:
    """feature, importance, deviation, trees: how much a tree's squared error on the rows that it has not seen grows once a
    feature's values are dealt anew among them, and how much that differs from tree to tree. forest, bins and seed are
    those of train_forest_all_rows().

    Values are dealt in the order of a hash of the row and the tree, by batches: each row takes the value of the row that
    comes next in its batch's order. Rows are dealt to batches by their keys, so a batch is a random part of all rows.
    Features that a tree does not ask for leave its error as it is. One pass; a task returns two sums a tree and feature."""
    table = materialize(binned(samples, bins, key, label).repartition("id"), "dealt")
    shared = table.sparkSession.sparkContext.broadcast((bins, forest.trees))
    marks = [mixed(mixed(seed, 0), t) for t in range(len(forest.trees))]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from strandline.models.binned_forest import _read, times_drawn

        bins, trees = shared.value
        n, k = len(trees), len(bins.values)
        rows, more = np.zeros(n, np.int64), np.zeros((n, k))
        for b in batches:
            ids, flags, codes = _read(b)
            if not len(ids):
                continue
            x = np.stack([v[codes[:, j]] for j, v in enumerate(bins.values)], axis=1)
            for t, (tree, mark) in enumerate(zip(trees, marks)):
                out = np.flatnonzero(times_drawn(ids, mark) == 0)
                own, y = x[out], flags[out]
                rows[t] += len(out)
                before = (tree.predict(own) - y) ** 2
                order = np.argsort(np.random.default_rng(mark).permutation(len(out)), kind="stable")
                for f in np.unique(tree.feature[tree.feature >= 0]):
                    dealt = own.copy()
                    dealt[order, f] = own[np.roll(order, 1), f]
                    more[t, f] += ((tree.predict(dealt) - y) ** 2 - before).sum()
        t, f = (a.ravel() for a in np.meshgrid(np.arange(n), np.arange(k), indexing="ij"))
        yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(f.astype(np.int32)), pa.array(rows[t]), pa.array(more[t, f])], names=["t", "feature", "rows", "more"])

    sums = table.mapInArrow(work, "t long, feature int, rows long, more double").groupBy("t", "feature").agg(F.sum("rows").alias("rows"), F.sum("more").alias("more"))
    each = sums.where("rows > 0").withColumn("value", F.col("more") / F.col("rows"))
    return each.groupBy("feature").agg(F.avg("value").alias("importance"), F.stddev_pop("value").alias("deviation"), F.count("*").alias("trees"))
