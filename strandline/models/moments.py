"""Linear discriminants and perceptrons of all rows: what tasks find out about their rows is merged, no rows are gathered.

Discriminants need the rows' number, mean and centred products by class. Each task keeps them for its own rows, batch by
batch, and two such states merge exactly (Chan, Golub and LeVeque, 1983), without the differences of large sums that plain
sums of squares end in. A state travels as one row a feature, so that the merging itself is spread over features.

Perceptrons are mixed (McDonald, Hall and Mann, 2010): in each round every task passes once over its rows from the common
weights on; the weights of the tasks, each by its share of the mistakes, are the next common ones. On separable data
that ends as one machine does, without a mistake.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.models.linear import RIDGE, Linear
from strandline.session import materialize, ship_package

#: Tasks' states are merged in groups of about this number, then the groups.
FAN_IN = 64
STATE = "flag boolean, i int, part long, n long, mean array<double>, products array<double>"


@dataclass(frozen=True)
class Moments:
    """Rows, means of the features and sums of products of what they differ from the means by."""

    n: int
    mean: np.ndarray
    products: np.ndarray

    @staticmethod
    def of(x: np.ndarray) -> Moments:
        mean = x.mean(axis=0) if len(x) else np.zeros(x.shape[1])
        rest = x - mean
        slip = rest.mean(axis=0) if len(x) else mean  # what rounding of the mean has left
        rest -= slip
        return Moments(len(x), mean + slip, rest.T @ rest)

    def __add__(self, other: Moments) -> Moments:
        n = self.n + other.n
        if not n:
            return self
        d = other.mean - self.mean
        return Moments(n, self.mean + d * (other.n / n), self.products + other.products + np.outer(d, d) * (self.n * other.n / n))


def _merged_row(part: pd.DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """One feature's row of the sum of states, in the order of the tasks, so that reruns agree to the last bit."""
    part = part.sort_values("part")
    i, n, mean, products = int(part["i"].iloc[0]), 0, None, None
    for m, other, more in zip(part["n"], part["mean"], part["products"]):
        other, more = np.asarray(other), np.asarray(more)
        if mean is None:
            n, mean, products = int(m), other, more
        elif m:
            d, all_ = other - mean, n + int(m)
            products = products + more + d * (d[i] * (n * int(m) / all_))
            mean, n = mean + d * (int(m) / all_), all_
    return n, mean, products


def class_moments(samples: DataFrame, label: str = "flag", column: str = "features") -> dict[bool, Moments]:
    """Moments of the features of both classes over all rows; rows whose label or features are null are left out, a class
    without rows is missing. Only the products' matrix reaches the driver."""
    ship_package(samples.sparkSession)
    source = samples.where(F.col(label).isNotNull() & F.col(column).isNotNull()).select(F.col(label).cast("boolean").alias("flag"), F.col(column).cast("array<double>").alias("x"), F.spark_partition_id().cast("long").alias("part"))

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from strandline.models.moments import Moments

        held: dict[bool, Moments] = {}
        part = 0
        for b in batches:
            if not b.num_rows:
                continue
            part = b.column(2)[0].as_py()
            x = np.array(b.column(1).to_pylist(), np.float64)
            flags = b.column(0).to_numpy(zero_copy_only=False).astype(bool)
            for flag in (False, True):
                if (flags == flag).any():
                    new = Moments.of(x[flags == flag])
                    held[flag] = held[flag] + new if flag in held else new
        for flag, m in held.items():
            k = len(m.mean)
            yield pa.RecordBatch.from_arrays([pa.array([flag] * k), pa.array(range(k), pa.int32()), pa.array([part] * k, pa.int64()), pa.array([m.n] * k, pa.int64()), pa.array([m.mean.tolist()] * k), pa.array(m.products.tolist())], names=[f.split()[0] for f in STATE.split(", ")])

    def merge(key, rows: pd.DataFrame) -> pd.DataFrame:
        from strandline.models.moments import _merged_row

        n, mean, products = _merged_row(rows)
        return pd.DataFrame({"flag": [key[0]], "i": [key[1]], "part": [key[2]], "n": [n], "mean": [mean], "products": [products]})

    state = source.mapInArrow(states, STATE)
    for bucket in (F.floor(F.col("part") / FAN_IN), F.lit(0).cast("long")):
        state = state.withColumn("bucket", bucket).groupBy("flag", "i", "bucket").applyInPandas(merge, STATE)
    found: dict[bool, list] = {}
    for r in state.orderBy("flag", "i").collect():
        found.setdefault(r["flag"], []).append(r)
    return {flag: Moments(rows[0]["n"], np.array(rows[0]["mean"]), np.array([r["products"] for r in rows])) for flag, rows in found.items()}


def discriminant(a: Moments, b: Moments, gamma: float = RIDGE) -> Linear:
    """The discriminant of two classes from their moments, as train_lda gives it."""
    covariance = (a.products + b.products) / max(1, a.n + b.n - 2)
    k = len(a.mean)
    covariance = (1 - gamma) * covariance + gamma * np.trace(covariance) / k * np.eye(k)
    w = np.linalg.lstsq(covariance, a.mean - b.mean, rcond=None)[0]
    return Linear(w, -float(w @ (a.mean + b.mean) / 2))


def train_lda_all_rows(samples: DataFrame, label: str = "flag", gamma: float = RIDGE) -> Linear:
    found = class_moments(samples, label)
    if len(found) < 2:
        raise ValueError("a discriminant needs rows of both classes")
    return discriminant(found[True], found[False], gamma)


def _round(x: np.ndarray, y: np.ndarray, w: np.ndarray, b: float, rate: float) -> tuple[np.ndarray, float, np.ndarray, float, int]:
    """(weights, bias, their sums over the steps, mistakes) of one pass; rows without a mistake are skipped in stretches."""
    sum_w, sum_b, wrong, at, ahead = np.zeros_like(w), 0.0, 0, 0, 512
    while at < len(x):
        bad = y[at : at + ahead] * (x[at : at + ahead] @ w + b) <= 0
        good = int(np.argmax(bad)) if bad.any() else len(bad)
        sum_w += good * w
        sum_b += good * b
        at += good
        ahead = min(512, max(2, 2 * (good + 1)))  # rows beyond a mistake are looked at again
        if good < len(bad):
            w, b, wrong, at = w + rate * y[at] * x[at], b + rate * y[at], wrong + 1, at + 1
            sum_w += w
            sum_b += b
    return w, b, sum_w, sum_b, wrong


def train_perceptron_all_rows(samples: DataFrame, order: str, label: str = "flag", rounds: int = 100, rate: float = 1.0, column: str = "features") -> Linear:
    """Averaged weights over all steps of all rounds; ends early after a round without a mistake, else after `rounds`. Rows
    are dealt once by their keys and kept written, and ordered by them inside a task; a round sends each task's two
    vectors to the driver. Rows whose label or features are null are left out."""
    ship_package(samples.sparkSession)
    sc = samples.sparkSession.sparkContext
    rows = samples.where(F.col(label).isNotNull() & F.col(column).isNotNull()).select(F.col(label).cast("boolean").alias("flag"), F.col(column).cast("array<double>").alias("x"), F.col(order).alias("key"))
    table = materialize(rows.repartition(F.xxhash64("key")).sortWithinPartitions("key").select("flag", "x"), "dealt")
    first = table.select(F.size("x")).first()
    if first is None:
        raise ValueError("no rows to train on")
    w, b = np.zeros(first[0]), 0.0
    total_w, total_b, steps = np.zeros(first[0]), 0.0, 0
    for _ in range(rounds):
        shared = sc.broadcast((w, b))

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from strandline.models.moments import _round

            v, c = shared.value
            sum_v, sum_c, wrong, n = np.zeros_like(v), 0.0, 0, 0
            for batch in batches:
                if batch.num_rows:
                    x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                    y = np.where(batch.column(0).to_numpy(zero_copy_only=False).astype(bool), 1.0, -1.0)
                    v, c, more_v, more_c, bad = _round(x, y, v, c, rate)
                    sum_v, sum_c, wrong, n = sum_v + more_v, sum_c + more_c, wrong + bad, n + len(x)
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([wrong]), pa.array([[*v.tolist(), c]]), pa.array([[*sum_v.tolist(), sum_c]])], names=["n", "wrong", "end", "sums"])

        parts = [r for r in table.mapInArrow(work, "n long, wrong long, end array<double>, sums array<double>").where("n > 0").collect()]
        parts.sort(key=lambda r: (r["n"], r["wrong"], r["end"]))
        for r in parts:
            total_w, total_b, steps = total_w + np.array(r["sums"][:-1]), total_b + r["sums"][-1], steps + r["n"]
        wrong = sum(r["wrong"] for r in parts)
        if not wrong:
            break
        mixed = sum(np.array(r["end"]) * (r["wrong"] / wrong) for r in parts if r["wrong"])
        w, b = mixed[:-1], float(mixed[-1])
    return Linear(total_w / max(1, steps), total_b / max(1, steps))
