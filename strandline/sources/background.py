"""Background sequence models: independent bases and Markov chains; training on DataFrames, seeded generation."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.iupac import BASES
from strandline.operators.scan import kmer_text, rolling_codes
from strandline.session import ship_package

PSEUDOCOUNT = 1


def train_iid(seqs: DataFrame) -> DataFrame:
    """base, n, p over all sequences; other symbols count nowhere. Without any base each p is 0.25."""
    counts = [F.coalesce(F.sum((F.length("seq") - F.length(F.translate("seq", b, ""))).cast("long")), F.lit(0)).alias(b) for b in BASES]
    total = sum((F.col(b) for b in BASES), F.lit(0))
    row = seqs.agg(*counts)
    p = [F.struct(F.lit(b).alias("base"), F.col(b).alias("n"), F.when(total > 0, F.col(b) / total).otherwise(F.lit(0.25)).alias("p")) for b in BASES]
    return row.select(F.explode(F.array(*p)).alias("x")).select("x.*")


def _word_counts(seqs: DataFrame, k: int, add_rc: bool) -> DataFrame:
    """word, n of k-mers at the ends of which a chain counts: the first of each run of bases is left out."""
    ship_package(seqs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total = np.zeros(4**k, np.int64)
            for seq in b.column(0).to_pylist():
                codes = rolling_codes(np.frombuffer(seq or b"", np.uint8), k)
                counted = np.r_[False, (codes[1:] >= 0) & (codes[:-1] >= 0)] if len(codes) else np.zeros(0, bool)
                total += np.bincount(codes[counted], minlength=4**k)
            if add_rc:
                at = np.arange(4**k)
                back = np.zeros_like(at)
                for j in range(k):  # complement of a base is 3 - code
                    back = back * 4 + 3 - (at >> 2 * j & 3)
                total = total + total[back]
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([kmer_text(int(c), k) for c in at], pa.string()), pa.array(total[at])], names=["word", "n"])

    return seqs.select(F.col("seq").cast("binary")).mapInArrow(work, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def train_markov(seqs: DataFrame, order: int = 4, add_rc: bool = True) -> DataFrame:
    """context, nA, nC, nG, nT, total for each of the 4**order contexts: (order + 1)-mers of both strands (or one), the
    first complete one of each run of bases left out, plus a pseudocount. Counts are summed by batch before a shuffle."""
    spark = seqs.sparkSession
    counts = _word_counts(seqs, order + 1, add_rc)
    next_base = F.substring("word", order + 1, 1)
    found = counts.groupBy(F.substring("word", 1, order).alias("context")).agg(*[F.sum(F.when(next_base == b, F.col("n")).otherwise(0)).alias(f"n{b}") for b in BASES])
    contexts = spark.createDataFrame([(kmer_text(i, order),) for i in range(4**order)], "context string")
    cells = [(F.coalesce(f"n{b}", F.lit(0)) + PSEUDOCOUNT).alias(f"n{b}") for b in BASES]
    return contexts.join(found, "context", "left").select("context", *cells).withColumn("total", sum((F.col(f"n{b}") for b in BASES), F.lit(0)))


def sequence_seed(seed: int, stream: str, i: int) -> int:
    """The seed of sequence i of a stream: other streams, and other numbers in one, have seeds of their own."""
    return int.from_bytes(hashlib.blake2b(f"{seed}|{stream}|{i}".encode(), digest_size=8).digest(), "big")


#: Random numbers of sequences that are made together.
DRAWS = 1 << 22


def _generated(spark: SparkSession, n: int, length: int, seed: int, stream: str, name: str, make) -> DataFrame:
    """make(generators, length) gives a sequence for each generator."""
    ship_package(spark)

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at_once = max(1, DRAWS // max(1, length))
        for frame in frames:
            seeds = [sequence_seed(seed, stream, int(i)) for i in frame["id"]]
            seqs: list[str] = []
            for first in range(0, len(seeds), at_once):
                seqs += make([np.random.default_rng(s) for s in seeds[first : first + at_once]], length)
            yield pd.DataFrame({"seq_id": frame["id"], "name": [f"{name} {i} seed {s}" for i, s in zip(frame["id"], seeds)], "seq": seqs, "len": length})

    return spark.range(n).mapInPandas(work, "seq_id long, name string, seq string, len int")


def markov_sequences(rngs: list[np.random.Generator], length: int, order: int, totals: np.ndarray, steps: np.ndarray) -> list[str]:
    """A sequence of a chain from each generator, all of them a base further at a time. totals: running totals of the
    contexts; steps: running shares of the bases after each context."""
    state = np.searchsorted(totals, np.array([rng.random() for rng in rngs]) * totals[-1], side="right")
    bases = np.empty((max(length, order), len(rngs)), np.uint8)
    for j in range(order):
        bases[j] = state >> 2 * (order - 1 - j) & 3
    draws = np.stack([rng.random(max(0, length - order)) for rng in rngs], axis=1)
    for j, x in enumerate(draws, order):
        base = np.minimum(3, (steps[state] <= x[:, None]).sum(axis=1))
        bases[j] = base
        state = (state << 2 | base) & (4**order - 1)
    letters = np.frombuffer(BASES.encode(), np.uint8)[bases[:length].T]
    return [row.tobytes().decode() for row in letters]


def generate_iid(spark: SparkSession, n: int, length: int, p: dict[str, float] | None = None, seed: int = 0, stream: str = "") -> DataFrame:
    """n sequences, each from a seed of its own, by seed, stream and number, that its name states."""
    weights = np.array([(p or {}).get(b, 0.25) for b in BASES])
    weights = weights / weights.sum()

    def make(rngs: list[np.random.Generator], length: int) -> list[str]:
        letters = np.frombuffer(BASES.encode(), np.uint8)
        return [letters[rng.choice(4, length, p=weights)].tobytes().decode() for rng in rngs]

    return _generated(spark, n, length, seed, stream, "iid", make)


def generate_markov(spark: SparkSession, model: DataFrame, n: int, length: int, seed: int = 0, stream: str = "") -> DataFrame:
    """n sequences of a chain, seeded as generate_iid's are; the first context is drawn by the contexts' totals. The model has 4**order rows."""
    rows = sorted(model.collect(), key=lambda r: r["context"])
    order = len(rows[0]["context"])
    totals = np.cumsum([r["total"] for r in rows], dtype=np.float64)
    steps = np.cumsum([[r[f"n{b}"] for b in BASES] for r in rows], axis=1) / np.array([[r["total"]] for r in rows])

    def make(rngs: list[np.random.Generator], length: int) -> list[str]:
        from strandline.sources.background import markov_sequences

        return markov_sequences(rngs, length, order, totals, steps)

    return _generated(spark, n, length, seed, stream, "markov", make)


