"""Vector classifiers over DataFrames of (key columns, features array, flag or class)."""

from __future__ import annotations

from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.config import Settings
from strandline.models.binned_forest import train_forest_all_rows
from strandline.models.forest import train_forest_distributed
from strandline.models.linear import train_perceptron
from strandline.models.moments import train_lda_all_rows, train_perceptron_all_rows
from strandline.models.svm import Vote, train_svm
from strandline.models.whole import train_all_rows, train_votes
from strandline.session import ship_package

OWN_KINDS = ("svm", "vote", "forest", "lda", "perceptron")
#: Rounds over all rows at most; each is a Spark job.
MIXED_ROUNDS = 200


def min_max(samples: DataFrame, column: str = "features") -> DataFrame:
    """samples with scaled: each place of the array to [-1, 1] by its range over all rows; a constant one to 0. The
    ranges are one row per place."""
    ranges = samples.select(F.posexplode(column).alias("i", "v")).groupBy("i").agg(F.min("v").alias("low"), F.max("v").alias("high"))
    arrays = ranges.agg(F.sort_array(F.collect_list(F.struct("i", "low", "high"))).alias("r"))
    r = F.col("r")
    span = lambda x: x["high"].cast("double") - x["low"].cast("double")
    one = lambda v, x: F.when(span(x) > 0, (v.cast("double") - x["low"].cast("double") - span(x) / 2) * 2 / span(x)).otherwise(F.lit(0.0))
    return samples.crossJoin(F.broadcast(arrays)).withColumn("scaled", F.zip_with(F.col(column), r, one)).drop("r")  # one row is joined


def sampled(samples: DataFrame, rows: int, key: str, group: str | None = None) -> DataFrame:
    """All rows, or of more than `rows` (of each group) those with the smallest hashes of the key. Counts say up to which
    hash at most twice as many rows lie, so no more of a frequent group are ranked; a few groups' counts are broadcast."""
    own = group or "_all"
    marked = samples.withColumn("_at", F.xxhash64(F.lit("sample"), key)).withColumn("_share", (F.col("_at") / 2.0**64) + 0.5)
    marked = marked if group else marked.withColumn(own, F.lit(0))
    counts = marked.groupBy(own).agg(F.count("*").alias("_n"))
    near = marked.join(F.broadcast(counts), own).where((F.col("_n") <= rows) | (F.col("_share") * F.col("_n") <= 2.0 * rows))
    ranked = near.withColumn("_place", F.row_number().over(Window.partitionBy(own).orderBy("_at", key)))
    return ranked.where(F.col("_place") <= rows).select(samples.columns)


def more_than(samples: DataFrame, column: str, rows: int) -> bool:
    return samples.select(column).limit(rows + 1).count() > rows


def gather(samples: DataFrame, label: str, order: str) -> tuple[np.ndarray, np.ndarray]:
    """All vectors and labels in a fixed order: the driver holds training sets that are known to be small."""
    found = samples.select("features", label, order).orderBy(order).select("features", label).toPandas()
    return np.array(found["features"].tolist(), dtype=np.float64), found[label].to_numpy()


class VectorMachine(Protocol):
    """What scores vectors: decide() gives a number a row. A machine with choose() gives a class a row instead. It is sent to
    the executors, so it must be picklable."""

    def decide(self, x: np.ndarray) -> np.ndarray: ...


class Trainer(Protocol):
    """Makes a machine from samples (features, a label and the columns to order by)."""

    def __call__(self, samples: DataFrame, settings: Settings, order: str, label: str) -> VectorMachine: ...


_TRAINERS: dict[str, Trainer] = {}


def register(kind: str, trainer: Trainer) -> None:
    """Let fit(), and so feature models, know a kind of classifier of one's own; names of its own kinds are taken."""
    if kind in OWN_KINDS or kind in _TRAINERS:
        raise ValueError(f"there is a classifier called {kind}")
    _TRAINERS[kind] = trainer


def fit(samples: DataFrame, kind: str, settings: Settings, order: str, label: str = "flag"):
    """A classifier of `kind`: svm, vote, forest, lda or perceptron. All take all rows; discriminants never gather them, the
    others only if they are no more than Settings.training_rows. Other kinds are those that were registered."""
    s = settings
    if kind in _TRAINERS:
        return _TRAINERS[kind](samples, settings, order, label)
    if kind not in OWN_KINDS:
        raise ValueError(f"no classifier is called {kind}")
    if kind == "lda":
        return train_lda_all_rows(samples, label)
    if more_than(samples, order, s.training_rows):
        if kind == "forest":
            return train_forest_all_rows(samples, order, label, s.trees, s.depth, s.seed)
        if kind == "perceptron":
            return train_perceptron_all_rows(samples, order, label, min(s.perceptron_rounds, MIXED_ROUNDS))
        if kind == "vote":
            return train_votes(samples, s, [], label, [order], order)[()]
        sign = F.when(F.col(label).cast("boolean"), 1.0).otherwise(-1.0)
        return train_all_rows(samples.select(F.lit(0).alias("machine"), F.col(order).alias("id"), "features", sign.alias("y")), s, ["machine"])[0,]
    x, y = gather(samples, label, order)
    if kind == "svm":
        return train_svm(x, np.where(y.astype(bool), 1.0, -1.0), s.svm_type, s.kernel, s.cost, s.nu, s.p, s.c0, s.gamma)
    if kind == "vote":
        return Vote.train_distributed(samples.sparkSession, x, y.astype(np.float64), svm_type=s.svm_type, kernel=s.kernel, cost=s.cost, nu=s.nu, c0=s.c0, gamma=s.gamma)
    if kind == "forest":
        return train_forest_distributed(samples.sparkSession, x, y.astype(bool), s.trees, s.depth, s.seed)
    return train_perceptron(x, y.astype(bool), s.perceptron_rounds)


def decide(rows: DataFrame, machine, column: str = "features", out: str = "score") -> DataFrame:
    """rows with the machine's decision value, or the chosen class of a vote."""
    ship_package(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast(machine)

    @F.pandas_udf("double")
    def value(features: pd.Series) -> pd.Series:
        if not len(features):
            return pd.Series([], dtype="float64")
        x = np.array(features.tolist(), dtype=np.float64)
        m = shared.value
        return pd.Series((m.choose if hasattr(m, "choose") else m.decide)(x))

    return rows.withColumn(out, value(column))
