"""Predicted intervals: merging, the best of overlapping windows, cores inside windows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.config import CoreMode
from strandline.session import join_large, materialize, ship_package


#: Positions of a stretch of a chromosome that one task merges.
STRETCH = 1 << 20


def _carried(df: DataFrame, key: str, value: Column, name: str) -> DataFrame:
    """df with name: the largest value of the rows before in the order of (start, end, score), over stretches: inside a
    stretch by a window, and from the stretches before by a window over one row a stretch."""
    line = Window.partitionBy(key, "_stretch").orderBy("start", "end", "score")
    before = Window.partitionBy(key).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    tops = df.groupBy(key, "_stretch").agg(F.max(value).alias("_top")).select(key, "_stretch", F.max("_top").over(before).alias("_from"))
    inside = F.max(value).over(line.rowsBetween(Window.unboundedPreceding, -1))
    return join_large(df.withColumn("_inside", inside), tops, [key, "_stretch"]).withColumn(name, F.greatest("_inside", "_from")).drop("_inside", "_from")


def merge(intervals: DataFrame, slack: int = 0, key: str = "chrom", spread: bool = False) -> DataFrame:
    """key, start, end, score: by start, an interval joins those before if it starts at most slack after their largest
    end; the largest end and score remain. Rows with a null key, start or end are left out.

    spread: a key may hold more intervals than a task should, as a chromosome does. They are then merged by stretches of
    positions, and what earlier stretches reach to is carried on."""
    rows = intervals.select(key, "start", "end", "score").where(F.col(key).isNotNull() & F.col("start").isNotNull() & F.col("end").isNotNull())
    if spread:
        # one row an interval, so that the order is total: equal rows could come in another order when they are read again
        rows = rows.groupBy(key, "start", "end").agg(F.max("score").alias("score"))
        rows = materialize(rows.withColumn("_stretch", F.floor(F.col("start") / STRETCH)), "intervals")
        marked = _carried(rows, key, F.col("end"), "_reach")
        marked = materialize(marked.withColumn("_first", F.when(F.col("_reach").isNull() | (F.col("start") > F.col("_reach") + slack), F.col("start"))), "marked-intervals")
        numbered = _carried(marked, key, F.col("_first"), "_before").withColumn("_island", F.coalesce("_first", "_before"))
    else:
        line = Window.partitionBy(key).orderBy("start", "end", "score")
        reach = F.max("end").over(line.rowsBetween(Window.unboundedPreceding, -1))
        marked = rows.withColumn("_first", F.when(reach.isNull() | (F.col("start") > reach + slack), F.col("start")))
        numbered = marked.withColumn("_island", F.max("_first").over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return numbered.groupBy(key, F.col("_island").alias("start")).agg(F.max("end").alias("end"), F.max("score").alias("score"))


def predicted_windows(scored: DataFrame, threshold: float) -> DataFrame:
    """Windows (seq_id, win_start, win_len, score) at or over the threshold, as intervals."""
    return scored.where(F.col("score") >= threshold).select("seq_id", F.col("win_start").alias("start"), (F.col("win_start") + F.col("win_len")).alias("end"), "score")


def best_of_overlapping(predictions: DataFrame, key: str = "chrom") -> DataFrame:
    """Of predictions (key, win_start, win_end, start, end, score) by window: windows that each start at or before the end
    of the one before them are a run, and a run keeps its best prediction, the first by window, start and end of equal
    scores. What comes before the first run's window plays no part, so runs are islands of windows, found by stretches."""
    rows = predictions.select(key, "win_start", "win_end", "start", "end", "score")
    windows = rows.groupBy(key, F.col("win_start").alias("start"), F.col("win_end").alias("end")).agg(F.max("score").alias("score"))
    stretched = materialize(windows.withColumn("_stretch", F.floor(F.col("start") / STRETCH)), "predicted-windows")
    marked = _carried(stretched, key, F.struct("start", "end"), "_last")
    marked = materialize(marked.withColumn("_first", F.when(F.col("_last").isNull() | (F.col("_last.end") < F.col("start")), F.col("start"))).drop("_last"), "marked-windows")
    runs = _carried(marked, key, F.col("_first"), "_before").select(key, F.col("start").alias("win_start"), F.col("end").alias("win_end"), F.coalesce("_first", "_before").alias("_run"))
    first = F.min_by(F.struct("start", "end", "score"), F.struct((-F.col("score")).alias("s"), "win_start", "win_end", "start", "end"))
    return join_large(rows, runs, [key, "win_start", "win_end"]).groupBy(key, "_run").agg(first.alias("b")).select(key, "b.*")


Hit = tuple[int, int, float]  # motif start, motif end, weight


def window_cores(hits: list[Hit], win_start: int, win_end: int, threshold: float, mode: CoreMode, size: int, reach: int = 250) -> list[tuple[int, int, float]]:
    """Cores (start, end, score) in one window that is predicted, from its positive occurrences, by sums over prefixes.

    A hit's site is its middle and `reach` bases to both sides. strong: sites whose hits weigh the threshold together. A
    site's hits are, by start, those from the site's start on up to the first that ends after the site. motifs: strong
    sites, or all if there are none, joined where they overlap, with the largest weight; those at the threshold, if any.
    continuous: of the stretches from one site's start to the end of it or a later one, `size` bases at most, that with
    the most weight a base; the last site begins none, and stretches that the window cuts below a site's length are out."""
    if not hits:
        return []
    start, end, weight = (np.array(x) for x in zip(*hits))
    order = np.lexsort((end, start))
    start, end, weight = start[order].astype(np.int64), end[order].astype(np.int64), weight[order].astype(np.float64)
    middle = start + (end - start) // 2
    left, right = middle - reach, middle + reach
    if mode is CoreMode.CONTINUOUS:
        return _densest(start, end, weight, left, right, win_end, size)
    total = np.r_[0.0, np.cumsum(weight)]
    first = np.searchsorted(start, left)
    beyond = [i + int(np.argmax(np.r_[end[i:] > r, True])) for i, r in zip(first, right)]
    sums = total[beyond] - total[first]
    strong = sums >= threshold
    low, high = np.maximum(left, 0), np.minimum(right, win_end)
    if mode is CoreMode.MOTIFS_STRONG:
        return [(int(a), int(b), float(w)) for a, b, w in zip(low[strong], high[strong], sums[strong])]
    if strong.any():
        low, high, score = low[strong], high[strong], sums[strong]
    else:
        low, high, score = left, right, weight
    heads = np.flatnonzero(np.r_[True, low[1:] >= np.maximum.accumulate(high)[:-1]])
    joined = [(int(a), int(b), float(w)) for a, b, w in zip(low[heads], np.maximum.reduceat(high, heads), np.maximum.reduceat(score, heads))]
    return [x for x in joined if x[2] >= threshold] or joined


def _densest(start: np.ndarray, end: np.ndarray, weight: np.ndarray, left: np.ndarray, right: np.ndarray, win_end: int, size: int) -> list[tuple[int, int, float]]:
    by_site = np.lexsort((end, start, (left + right) // 2))
    left, right = left[by_site], right[by_site]
    by_end = np.argsort(end, kind="stable")
    best = None
    for i in range(len(left) - 1):
        over = right[i:] > left[i] + size
        stop = i + int(np.argmax(np.r_[over, True]))
        low, high = max(int(left[i]), 0), np.minimum(right[i:stop], win_end)
        inner = by_end[start[by_end] >= low]
        sums = np.r_[0.0, np.cumsum(weight[inner])][np.searchsorted(end[inner], high, side="right")]
        density = np.where(high - low >= right[i] - left[i], sums / np.maximum(high - low, 1), -np.inf)
        if len(density) and density.max() > -np.inf and (best is None or density.max() > best[0]):
            j = int(np.argmax(density))
            best = (density[j], low, int(high[j]), float(sums[j]))
    return [best[1:]] if best else []


def core_predictions(hits: DataFrame, windows: DataFrame, threshold: float, mode: CoreMode, size: int, numbered: bool = False) -> DataFrame:
    """seq_id, win[, nth], start, end, score of the cores of windows (seq_id, win, win_start, win_len, score) at or over the
    threshold, from positive occurrences by window (seq_id, win, start, end, weight). One group is one window; nth: a
    core's place among its window's."""
    ship_package(hits.sparkSession)
    told = hits.groupBy("seq_id", "win").agg(F.collect_list(F.struct("start", "end", "weight")).alias("hits"))
    met = join_large(windows.where(F.col("score") >= threshold), told, ["seq_id", "win"])

    @F.pandas_udf("array<struct<start:bigint,end:bigint,score:double>>")
    def cores(found: pd.Series, win_start: pd.Series, win_len: pd.Series) -> pd.Series:
        from strandline.operators.intervals import window_cores

        out = [window_cores([(h["start"], h["end"], h["weight"]) for h in hs], int(a), int(a + n), threshold, mode, size) for hs, a, n in zip(found, win_start, win_len)]
        return pd.Series([[{"start": s, "end": e, "score": w} for s, e, w in x] for x in out])

    each = met.select("seq_id", "win", F.posexplode(cores("hits", "win_start", "win_len")).alias("nth", "c"))
    return each.select("seq_id", "win", *(["nth"] if numbered else []), "c.*")


def gated_cores(cores: DataFrame, threshold: float) -> DataFrame:
    """Numbered cores with last (the score of their window's last core) and kept: a genome's prediction takes all cores of
    a window, those below the threshold too, if its last one is at or over it, and none otherwise."""
    line = Window.partitionBy("seq_id", "win")  # the cores of one window
    return cores.withColumn("last", F.max_by("score", "nth").over(line)).withColumn("kept", F.col("last") >= threshold)


def core_track(windows: DataFrame, cores: DataFrame, nothing: float) -> DataFrame:
    """windows with, as score, that of their last gated core; `nothing` for windows without cores."""
    last = cores.groupBy("seq_id", "win").agg(F.first("last").alias("last"))
    return join_large(windows.drop("score"), last, ["seq_id", "win"], "left").withColumn("score", F.coalesce("last", F.lit(float(nothing)))).drop("last")
