"""Ranking metrics over scored rows (score, flag, and a tie-breaking key), and calibration of thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.operators.ordered import running


def confusion(scored: DataFrame, threshold: float) -> DataFrame:
    """tp, fp, tn, fn, accuracy, ppv of one row; score >= threshold is positive; ppv without positives is NaN."""
    hit = F.col("score") >= threshold
    counts = scored.agg(*[F.count_if(c).alias(n) for n, c in (("tp", hit & F.col("flag")), ("fp", hit & ~F.col("flag")), ("tn", ~hit & ~F.col("flag")), ("fn", ~hit & F.col("flag")))])
    n = F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")
    nan = F.lit(float("nan"))
    return counts.select("*", F.when(n > 0, (F.col("tp") + F.col("tn")) / n).otherwise(nan).alias("accuracy"), F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(nan).alias("ppv"))


def _ranked(scored: DataFrame, key: str) -> tuple[DataFrame, int, int]:
    counts = scored.agg(F.count_if("flag").alias("p"), F.count_if(~F.col("flag")).alias("n")).first()
    flag = F.col("flag").cast("long")
    return running(scored.select("score", "flag", key), [F.desc("score"), F.asc(key)], {"tp": flag, "fp": 1 - flag}), counts["p"], counts["n"]


def _partial_area(rows: DataFrame, x: float, at: Column, before: Column, height: Column, height_before: Column) -> DataFrame:
    """Trapezoids over the rows in order until `at` reaches x, the last one cut at x."""
    part = (F.lit(x) - before) / (at - before)
    end = height_before + (height - height_before) * part
    area = F.when(at < x, (at - before) * (height + height_before) / 2).otherwise((F.lit(x) - before) * (end + height_before) / 2)
    return rows.where(before < x).agg(F.coalesce(F.sum(F.when(at > before, area)), F.lit(0.0)).alias("area"))


def roc_area(scored: DataFrame, x: float, key: str) -> DataFrame:
    """Area under the ROC up to the false positive rate x, not normalized: row by row, the highest score first, equal
    scores by key."""
    rows, p, n = _ranked(scored, key)
    if not p or not n:
        return rows.limit(0).agg(F.lit(float("nan")).alias("area"))
    one = F.col("flag").cast("long")
    return _partial_area(rows, x, F.col("fp") / n, (F.col("fp") - 1 + one) / n, F.col("tp") / p, (F.col("tp") - one) / p)


def prc_area(scored: DataFrame, x: float, key: str) -> DataFrame:
    """Area under precision over recall up to the recall x, from (0, 0) on."""
    rows, p, _ = _ranked(scored, key)
    if not p:
        return rows.limit(0).agg(F.lit(float("nan")).alias("area"))
    one = F.col("flag").cast("long")
    precision = F.col("tp") / F.col("place")
    before = F.when(F.col("place") > 1, (F.col("tp") - one) / (F.col("place") - 1)).otherwise(F.lit(0.0))
    return _partial_area(rows, x, F.col("tp") / p, (F.col("tp") - one) / p, precision, before)


def calibrate_precision(scored: DataFrame, wanted: float, key: str) -> DataFrame:
    """threshold: lowest scores go first; at the first row whose precision, with it and all above, reaches `wanted` the
    threshold is interpolated from the row before, (0, -1) before the first. Equal precisions give the score before; if
    none reaches it, the last two rows are used."""
    counts = scored.agg(F.count_if("flag").alias("p"), F.count("*").alias("n")).first()
    p, n = counts["p"], counts["n"]
    one = F.col("flag").cast("long")
    rows = running(scored.select("score", "flag", key), [F.asc("score"), F.asc(key)], {"gone": one})
    rows = rows.withColumn("precision", (F.lit(p) - (F.col("gone") - one)) / (F.lit(n) - F.col("place") + 1))
    first = rows.agg(F.coalesce(F.min(F.when(F.col("precision") >= wanted, F.col("place"))), F.lit(n)).alias("first"))
    two = rows.join(F.broadcast(first), F.col("place").between(F.col("first") - 1, F.col("first")))  # one row
    ends = two.agg(F.max_by("score", "place").alias("s"), F.max_by("precision", "place").alias("q"), F.min_by("score", "place").alias("s0"), F.min_by("precision", "place").alias("q0"), F.count("*").alias("n"))
    s0, q0 = F.when(F.col("n") > 1, F.col("s0")).otherwise(F.lit(0.0)), F.when(F.col("n") > 1, F.col("q0")).otherwise(F.lit(-1.0))
    threshold = F.when(F.col("q") == q0, s0).otherwise(s0 + (F.lit(wanted) - q0) * (F.col("s") - s0) / (F.col("q") - q0))
    return ends.select(threshold.alias("threshold"))


def quantile_threshold(scores: DataFrame, rate_per_kb: float, per: int = 1000) -> DataFrame:
    """threshold: the score that int(rate * per) scores are before, the highest first."""
    skip = int(rate_per_kb * per)
    top = scores.orderBy(F.desc("score")).limit(skip + 1)  # so many are kept of each task
    return top.agg(F.min("score").alias("threshold"))


def majority_vote(votes: DataFrame) -> DataFrame:
    """seq_id, class_order: of votes (seq_id, class_order) the class with most votes, the first by order among equals."""
    n = votes.groupBy("seq_id", "class_order").agg(F.count("*").alias("n"))
    return n.groupBy("seq_id").agg(F.max_by("class_order", F.struct("n", -F.col("class_order"))).alias("class_order"))
