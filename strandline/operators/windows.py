"""Positional sliding windows and the windows that occurrences and pairs lie in."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.session import ship_package

CORE_SIZES = (500, 600, 750, 1000, 1500, 2000, 2500, 3000)
CORE_STEP = 50


def n_windows(length: Column, size: int, step: int) -> Column:
    """With k = size - step: one window below k bases, none at k, else ceil((length - k) / step); none of nothing."""
    k = size - step
    return F.when(length <= 0, 0).when(length < k, 1).otherwise(F.ceil((length - k) / step)).cast("long")


def window_start(i: Column, step: int) -> Column:
    return (i * step).cast("long")


def window_length(i: Column, length: Column, size: int, step: int) -> Column:
    return (F.least(i * step + size, length) - i * step).cast("long")


def sliding(seqs: DataFrame, size: int, step: int, length: str = "len", keep: tuple[str, ...] = ("seq_id",)) -> DataFrame:
    """keep, win, win_start, win_len of each window of each sequence."""
    if not 0 < step < size:
        raise ValueError("a window's step must be over 0 and below its size")
    n = n_windows(F.col(length), size, step)
    each = seqs.select(*keep, F.col(length).alias("_len"), n.alias("_n")).where("_n > 0")
    each = each.withColumn("win", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    return each.select(*keep, "win", window_start(F.col("win"), step).alias("win_start"), window_length(F.col("win"), F.col("_len"), size, step).alias("win_len"))


def as_stretches(seqs: DataFrame) -> DataFrame:
    """seq_id, seq_len, begin, owned, seq (binary) of sequences (seq_id, seq), each one stretch, or of stretches (with len,
    begin and owned), as they are."""
    seq = F.col("seq").cast("binary")
    length = F.coalesce(F.octet_length(seq), F.lit(0)).cast("long")
    parts = (F.col("len"), F.col("begin"), F.col("owned")) if "begin" in seqs.columns else (length, F.lit(0), length)
    return seqs.select(F.col("seq_id").cast("long").alias("seq_id"), *[c.cast("long").alias(n) for c, n in zip(parts, ("seq_len", "begin", "owned"))], seq.alias("seq"))


def window_gc(seqs: DataFrame, size: int, step: int) -> DataFrame:
    """seq_id, win, gc of each window of seqs (seq_id, seq): the share of G and C, other symbols in the length. One pass
    with running counts, so a sequence is not copied by window. Sequences may come in stretches with an overlap of a
    window's size or more; a window belongs to the stretch that owns its start."""
    if not 0 < step < size:
        raise ValueError("a window's step must be over 0 and below its size")
    ship_package(seqs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lengths, begins, owned = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            for seq_id, n, begin, own, seq in zip(ids, lengths, begins, owned, batch.column(4)):
                text, k = np.frombuffer(seq.as_py() or b"", np.uint8), size - step
                count = 0 if not n or n == k else 1 if n < k else -(-(n - k) // step)
                win = np.arange(-(-begin // step), min(count, -(-(begin + own) // step)), dtype=np.int64)
                if not len(win):
                    continue
                sums = np.r_[0, np.cumsum((text == ord("G")) | (text == ord("C")), dtype=np.int64)]
                start = win * step - begin
                end = np.minimum(start + size, n - begin)
                if end.max() > len(text):
                    raise ValueError("stretches overlap by less than a window")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(win), seq_id, np.int64)), pa.array(win), pa.array((sums[end] - sums[start]) / (end - start))], names=["seq_id", "win", "gc"])

    return as_stretches(seqs).mapInArrow(work, "seq_id long, win long, gc double")


def window_range(start: Column, end: Column, length: Column, size: int, step: int) -> tuple[Column, Column]:
    """First and last of the windows that hold [start, end), by arithmetic; the first is after the last if none does."""
    first = F.greatest(F.lit(0), F.ceil((end - size) / step)).cast("long")
    return first, F.least(n_windows(length, size, step) - 1, F.floor(start / step)).cast("long")


def windows_of(start: Column, end: Column, length: Column, size: int, step: int) -> Column:
    """Array of the windows that hold [start, end): no join is needed. Empty for what no window holds."""
    first, last = window_range(start, end, length, size, step)
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))


def occurrences_in_windows(occ: DataFrame, size: int, step: int) -> DataFrame:
    """occ with a row for each window it lies in whole: win."""
    return occ.withColumn("win", F.explode(windows_of(F.col("start"), F.col("end"), F.col("seq_len"), size, step)))


def training_windows(seqs: DataFrame, size: int, step: int) -> DataFrame:
    """Windows of sequences by their train_mode: the whole sequence ("full") or sliding ones ("win")."""
    full = seqs.where("train_mode = 'full' AND len > 0").select("seq_id", F.lit(0).cast("long").alias("win"), F.lit(0).cast("long").alias("win_start"), F.col("len").cast("long").alias("win_len"))
    return full.unionByName(sliding(seqs.where("train_mode = 'win'"), size, step))


def multi_size(seqs: DataFrame, sizes: tuple[int, ...] = CORE_SIZES, step: int = CORE_STEP) -> DataFrame:
    """Windows of several sizes: seq_id, size, win, win_start, win_len."""
    parts = [sliding(seqs, s, step).withColumn("size", F.lit(s)) for s in sizes]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def best_core(scored: DataFrame) -> DataFrame:
    """seq_id, core_start, core_end, core_score: of windows (seq_id, size, win_start, win_len, score) the first with the
    highest score over 0, by size, then place; (0, 0, 0) where none is over 0."""
    best = F.max_by(F.struct("win_start", (F.col("win_start") + F.col("win_len")).alias("win_end"), "score"), F.struct("score", -F.col("size"), -F.col("win_start")))
    out = scored.groupBy("seq_id").agg(best.alias("b"))
    over = F.col("b.score") > 0
    zero = F.lit(0).cast("long")
    return out.select("seq_id", F.when(over, F.col("b.win_start")).otherwise(zero).alias("core_start"), F.when(over, F.col("b.win_end")).otherwise(zero).alias("core_end"), F.when(over, F.col("b.score")).otherwise(F.lit(0.0)).alias("core_score"))
