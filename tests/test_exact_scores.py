"""Scores and islands that do not depend on the order of rows."""

from pyspark.sql import functions as F

from strandline.models.sequence import PairSum
from strandline.operators import intervals
from strandline.operators.features import Windows
from strandline.plans.motif_queries import PAIRED


def test_pair_sums_are_one_division(spark, monkeypatch):
    """Shares of 401 bases: summed up one by one they miss the quotient of the whole number."""
    parts = [(0, 0, 12), (0, 1, 13), (0, 2, 4), (1, 1, 10), (1, 2, 2), (2, 2, 15)]
    counts = spark.createDataFrame([(1, 0, 401, a, b, n) for a, b, n in parts], "seq_id long, win long, win_len long, a int, b int, n long")
    monkeypatch.setattr("strandline.models.sequence.pair_counts", lambda *_: counts)
    occ = spark.createDataFrame([], "seq_id long")
    w = Windows(occ, occ, 500, 100, 6, known={"stored": occ, "windows": spark.createDataFrame([(1, 0, 0, 401)], "seq_id long, win long, win_start long, win_len long")})
    assert 56 * 1000 / 401 != sum(n * 1000 / 401 for *_, n in parts)
    assert PairSum(PAIRED).scored(w).first()["score"] == 56 * 1000 / 401


def test_equal_intervals_are_one_before_islands_are_told(spark, monkeypatch):
    """Windows that overlap tell the same core; whichever copy is read first, it belongs to its own island."""
    seen = []
    real = intervals.materialize

    def kept(df, name):
        out = real(df, name)
        seen.append((name, out.groupBy("chrom", "start", "end").count().where("count > 1").count()))
        return out

    monkeypatch.setattr(intervals, "materialize", kept)
    rows = spark.range(3000).select(F.lit("c").alias("chrom"), (F.col("id") % 50 * 100).alias("start"), (F.col("id") % 50 * 100 + 40).alias("end"), F.lit(2.0).alias("score"))
    merged = intervals.merge(rows, 0, spread=True).collect()
    assert sorted((r.start, r.end) for r in merged) == [(i * 100, i * 100 + 40) for i in range(50)]
    assert all(copies == 0 for _, copies in seen)
