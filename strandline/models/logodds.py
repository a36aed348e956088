"""Log-odds weights over non-negative feature sums: one aggregate over the training samples."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.config import WeightMode


def weight_column(p: Column, n: Column, n_pos: Column, n_neg: Column, mode: WeightMode, beta: float) -> Column:
    """Weight of a feature whose sum is p over n_pos positives and n over n_neg negatives."""
    tp, fp = p / n_pos, n / n_neg
    if mode is WeightMode.PPV:
        return F.when(tp + fp > 0, tp / (tp + fp)).otherwise(F.lit(0.0))
    if mode is WeightMode.BIPPV:
        return F.when(tp + fp > 0, (tp - fp) / (tp + fp)).otherwise(F.lit(0.0))
    none = (p == 0) | (n == 0)
    add = {WeightMode.PREDICTOR: F.when(none, 1.0).otherwise(0.0), WeightMode.CONSTANT: F.lit(beta), WeightMode.ZERO: F.lit(0.0)}[mode]
    weight = F.log((p + add) / n_pos) - F.log((n + add) / n_neg)
    return F.when(none, F.lit(0.0)).otherwise(weight) if mode is WeightMode.ZERO else weight


def weights(samples: DataFrame, mode: WeightMode = WeightMode.PREDICTOR, beta: float = 1e-8) -> DataFrame:
    """feature_id, weight from samples in long form (sample columns, flag, feature_id, value). Sums over a feature's rows
    are all that is needed; the numbers of samples enter as a ratio, so rows per feature serve as well."""
    sums = samples.groupBy("feature_id").agg(
        F.sum(F.when(F.col("flag"), F.col("value")).otherwise(0.0)).alias("p"), F.sum(F.when(~F.col("flag"), F.col("value")).otherwise(0.0)).alias("n"), F.count_if("flag").alias("n_pos"), F.count_if(~F.col("flag")).alias("n_neg")
    )
    return sums.select("feature_id", weight_column(F.col("p"), F.col("n"), F.col("n_pos"), F.col("n_neg"), mode, beta).alias("weight"))


def weigh(sums: list[tuple[float, float]], n_pos: int, n_neg: int, mode: WeightMode = WeightMode.PREDICTOR, beta: float = 1e-8) -> list[float]:
    """The same weights from (positive sum, negative sum) of each feature."""
    out = []
    for p, n in sums:
        tp, fp = p / max(n_pos, 1), n / max(n_neg, 1)
        if mode is WeightMode.PPV:
            out.append(tp / (tp + fp) if tp + fp > 0 else 0.0)
        elif mode is WeightMode.BIPPV:
            out.append((tp - fp) / (tp + fp) if tp + fp > 0 else 0.0)
        elif mode is WeightMode.ZERO and (p == 0 or n == 0):
            out.append(0.0)
        else:
            add = beta if mode is WeightMode.CONSTANT else 1.0 if mode is WeightMode.PREDICTOR and (p == 0 or n == 0) else 0.0
            out.append(math.log((p + add) / max(n_pos, 1)) - math.log((n + add) / max(n_neg, 1)))
    return out


def score(values: DataFrame, weighted: DataFrame, keys: tuple[str, ...] = ("seq_id", "win")) -> DataFrame:
    """keys, score: sum of value times weight; a row a feature of weights is joined."""
    return values.join(weighted, "feature_id").groupBy(*keys).agg(F.sum(F.col("value") * F.col("weight")).alias("score"))
