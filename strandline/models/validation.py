"""Cross-validation of machines, and probabilities from their decision values."""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.config import Settings, SvmType
from strandline.models.svm import Vote, train_svm
from strandline.models.vector import decide, more_than
from strandline.models.whole import train_all_rows, train_votes
from strandline.operators.ordered import running
from strandline.session import materialize, ship_package

#: Of Newton's steps, and what ends them.
STEPS, ENOUGH, LEAST_STEP = 100, 1e-9, 1e-10


def folded(samples: DataFrame, folds: int, key: str, label: str, seed: int = 0) -> DataFrame:
    """samples with fold, 0 to folds - 1: each label's rows are dealt in turn, in the order of a seeded hash of the key, so
    that folds hold equal shares of each label. A label's rows are ranked by one task: give bounded samples."""
    place = F.row_number().over(Window.partitionBy(label).orderBy(F.xxhash64(F.lit(f"fold {seed}"), key), key))
    return samples.withColumn("fold", F.pmod(place - 1, F.lit(folds)).cast("int"))


def grid(base: Settings, **values: Sequence) -> list[Settings]:
    """Settings for each combination of values, in order: grid(Settings(), cost=[1, 10], gamma=[0.1])."""
    return [replace(base, **dict(zip(values, chosen))) for chosen in itertools.product(*values.values())]


def cross_validated(samples: DataFrame, points: Sequence[Settings], key: str, label: str = "flag", folds: int = 5, kind: str = "svm", seed: int = 0) -> DataFrame:
    """point, fold, key, label, decision: of each row by the machine that was trained without its fold. kind: svm (a decision
    value, label true or false, or a number for regression) or vote (a class).

    Rows are stored once. Up to Settings.training_rows of the first point, each pair of a point and a fold is a task of its
    own, which reads them all, trains and decides; beyond, machines are trained one after another over all chunks."""
    ship_package(samples.sparkSession)
    rows = samples.select("features", F.col(label).cast("double").alias("label"), F.col(key).alias("key"))
    if more_than(rows, "key", points[0].training_rows):
        return _validated_by_all_rows(rows, points, folds, kind, seed).withColumnRenamed("key", key)
    stored = materialize(folded(rows, folds, "key", "label", seed), "folds")
    jobs = F.array(*[F.struct(F.lit(p).alias("point"), F.lit(f).alias("left_out")) for p in range(len(points)) for f in range(folds)])
    each = stored.select("*", F.explode(jobs).alias("job")).select("features", "label", "key", "fold", "job.*")
    own_task = F.col("point") * folds + F.col("left_out")  # hashes of so few keys would meet in a task

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = list(frames)
        if held:
            for job, df in pd.concat(held).groupby(["point", "left_out"]):
                yield run(job, df)

    def run(job, df: pd.DataFrame) -> pd.DataFrame:
        from strandline.models.validation import decisions

        df = df.sort_values("key")
        x, y, out = np.array(df["features"].tolist(), np.float64), df["label"].to_numpy(), (df["fold"] == job[1]).to_numpy()
        found = decisions(x[~out], y[~out], x[out], points[job[0]], kind)
        return pd.DataFrame({"point": job[0], "fold": job[1], "key": df["key"][out], "label": y[out], "decision": found})

    key_type = samples.schema[key].dataType.simpleString()
    out = each.repartitionById(len(points) * folds, own_task).mapInPandas(work, f"point int, fold int, key {key_type}, label double, decision double")
    return out.withColumnRenamed("key", key)


def _validated_by_all_rows(rows: DataFrame, points: Sequence[Settings], folds: int, kind: str, seed: int) -> DataFrame:
    """cross_validated() of rows (features, label, key) that no task holds. A machine's decisions are written before the next
    one is trained, so that no two are held."""
    place = running(rows, [F.col("label"), F.xxhash64(F.lit(f"fold {seed}"), "key"), F.col("key")], {})
    firsts = materialize(place.groupBy("label").agg(F.min("place").alias("first")), "first-places")
    fold = F.pmod(F.col("place") - F.col("first"), F.lit(folds)).cast("int")
    stored = materialize(place.join(F.broadcast(firsts), "label").select("features", "label", "key", fold.alias("fold")), "folds")
    out = None
    for p, s in enumerate(points):
        for f in range(folds):
            given, others = stored.where(F.col("fold") != f), stored.where(F.col("fold") == f)
            machine = _machine_of_all_rows(given, s, kind)
            decided = others.withColumn("decision", F.lit(0.0)) if machine is None else decide(others, machine, out="decision")
            one = materialize(decided.select(F.lit(p).alias("point"), "fold", "key", "label", "decision"), "decisions")
            out = one if out is None else out.unionByName(one)
    return out


def _machine_of_all_rows(rows: DataFrame, s: Settings, kind: str):
    """decisions()' machine; None where its rows lack what training needs."""
    if kind == "vote":
        return train_votes(rows, s, [], "label", ["key"], "key").get(())
    regression = s.svm_type in (SvmType.EPSILON_SVR, SvmType.NU_SVR)
    positive, n = rows.agg(F.count_if(F.col("label") > 0), F.count("*")).first()
    if not n or not regression and (not positive or positive == n and s.svm_type is not SvmType.ONE_CLASS):
        return None
    y = F.col("label") if regression else F.when(F.col("label") > 0, 1.0).otherwise(-1.0)
    return train_all_rows(rows.select(F.lit(0).alias("machine"), F.col("key").alias("id"), "features", y.alias("y")), s, ["machine"])[0,]


def decisions(x: np.ndarray, y: np.ndarray, others: np.ndarray, s: Settings, kind: str) -> np.ndarray:
    """Decision values of other rows by a machine trained on x and y; 0 where a fold lacks what training needs."""
    if not len(others) or not len(x):
        return np.zeros(len(others))
    options = {"svm_type": s.svm_type, "kernel": s.kernel, "cost": s.cost, "nu": s.nu, "c0": s.c0, "gamma": s.gamma}
    if kind == "vote":
        return Vote.train(x, y, **options).choose(others)
    regression = s.svm_type in (SvmType.EPSILON_SVR, SvmType.NU_SVR)
    if not regression and s.svm_type is not SvmType.ONE_CLASS and len(np.unique(y > 0)) < 2:
        return np.zeros(len(others))
    return train_svm(x, y if regression else np.where(y > 0, 1.0, -1.0), p=s.p, **options).decide(others)


def summary(validated: DataFrame, kind: str = "svm") -> DataFrame:
    """point, rows, accuracy, squared_error (mean) of cross_validated()."""
    right = F.col("decision") == F.col("label") if kind == "vote" else (F.col("decision") > 0) == (F.col("label") > 0)
    off = F.col("decision") - F.col("label")
    return validated.groupBy("point").agg(F.count("*").alias("rows"), F.avg(right.cast("double")).alias("accuracy"), F.avg(off * off).alias("squared_error"))


# ---- probabilities ----


@dataclass(frozen=True)
class Sigmoid:
    """P(positive) = 1 / (1 + exp(a * score + b))."""

    a: float
    b: float

    def column(self, score: Column) -> Column:
        z = score * self.a + self.b
        return F.when(z >= 0, F.exp(-z) / (1 + F.exp(-z))).otherwise(1 / (1 + F.exp(z)))


def fit_sigmoid(scored: DataFrame, label: str = "flag") -> Sigmoid:
    """Platt's sigmoid of (score, label) by Newton's method with halved steps (Lin, Lin and Weng, 2007). Targets are drawn
    in from 1 and 0 by the numbers of rows. Each step is one aggregate of seven sums over all rows, worked out by Spark;
    rows with a null score or label are left out, and without rows of both labels there is no sigmoid."""
    rows = scored.where(F.col("score").isNotNull() & F.col(label).isNotNull()).select(F.col("score").cast("double").alias("x"), F.col(label).cast("boolean").alias("y"))
    rows = materialize(rows, "scores")
    positive, negative = rows.agg(F.count_if("y"), F.count_if(~F.col("y"))).first()
    if not positive or not negative:
        raise ValueError("a sigmoid needs scores of both labels")
    target = F.when(F.col("y"), F.lit((positive + 1) / (positive + 2))).otherwise(F.lit(1 / (negative + 2)))

    def loss(a: float, b: float) -> Column:
        z = F.col("x") * a + b
        return F.sum(F.when(z >= 0, target * z + F.log1p(F.exp(-z))).otherwise((target - 1) * z + F.log1p(F.exp(z))))

    a, b = 0.0, float(np.log((negative + 1) / (positive + 1)))
    value = rows.agg(loss(a, b)).first()[0]
    for _ in range(STEPS):
        p = Sigmoid(a, b).column(F.col("x"))
        d, w, x = target - p, p * (1 - p), F.col("x")
        ga, gb, haa, hbb, hab = rows.agg(F.sum(x * d), F.sum(d), F.sum(x * x * w), F.sum(w), F.sum(x * w)).first()
        if max(abs(ga), abs(gb)) < ENOUGH * (positive + negative):
            break
        haa, hbb = haa + 1e-12, hbb + 1e-12
        det = haa * hbb - hab * hab
        da, db = -(hbb * ga - hab * gb) / det, -(haa * gb - hab * ga) / det
        slope, step = ga * da + gb * db, 1.0
        while step >= LEAST_STEP:
            new = rows.agg(loss(a + step * da, b + step * db)).first()[0]
            if new < value + 1e-4 * step * slope:
                a, b, value = a + step * da, b + step * db, new
                break
            step /= 2
        else:
            break
    return Sigmoid(float(a), float(b))


def coupled(r: np.ndarray) -> np.ndarray:
    """Probabilities of k classes from those of pairs (Wu, Lin and Weng, 2004): of rows of k x k matrices, r[i, j] being the
    share of i against j. They minimize the sum of (r_ji p_i - r_ij p_j)^2 under the sum of 1."""
    n, k, _ = r.shape
    q = -np.swapaxes(r, 1, 2) * r
    at = np.arange(k)
    q[:, at, at] = (np.swapaxes(r, 1, 2) ** 2 * ~np.eye(k, dtype=bool)).sum(axis=2)
    system = np.zeros((n, k + 1, k + 1))
    system[:, :k, :k], system[:, :k, k], system[:, k, :k] = q, 1.0, 1.0
    right = np.zeros((n, k + 1, 1))
    right[:, k] = 1.0
    p = np.clip(np.linalg.solve(system, right)[:, :k, 0], 0.0, 1.0)
    return p / p.sum(axis=1, keepdims=True)


def coupled_column(pairs: Column, classes: int) -> Column:
    """Class probabilities from an array of the shares of i against j, pairs in the order (0, 1), (0, 2), ... (1, 2), ...;
    shares are kept a ten-millionth from 0 and 1. Null where the array is, or isn't as long as there are pairs."""

    @F.pandas_udf("array<double>")
    def solve(arrays: pd.Series) -> pd.Series:
        from strandline.models.validation import coupled

        each = list(itertools.combinations(range(classes), 2))
        good = arrays.map(lambda v: v is not None and len(v) == len(each)).to_numpy(bool)
        out = pd.Series([None] * len(arrays), dtype=object)
        if good.any():
            values = np.clip(np.array(arrays[good].tolist(), np.float64), 1e-7, 1 - 1e-7)
            r = np.full((len(values), classes, classes), 0.5)
            for c, (i, j) in enumerate(each):
                r[:, i, j], r[:, j, i] = values[:, c], 1 - values[:, c]
            out[good] = pd.Series(list(coupled(r)), index=out.index[good])
        return out

    return solve(pairs)
