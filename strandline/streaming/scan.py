"""Motif scans and interval merging over streams of sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators.scan import scan
from strandline.sources.fasta import parse_records
from strandline.sources.motifs import MotifSet


def stream_fasta(spark: SparkSession, folder: str) -> DataFrame:
    """name, seq, seq_id of the records of FASTA files as they arrive; seq_id is a hash of the name."""
    raw = spark.readStream.option("lineSep", ">").text(folder).where(F.col("value") != "")
    return parse_records(raw).where(F.length("seq") > 0).withColumn("seq_id", F.xxhash64("name"))


def stream_scan(seqs: DataFrame, motifs: MotifSet, automaton: bool = True) -> DataFrame:
    """Occurrences of a stream: no state, so any output mode will do."""
    return scan(seqs, motifs, automaton)


def stream_merge(intervals: DataFrame, slack_seconds: int, watermark: str = "1 hour") -> DataFrame:
    """Merge a stream of intervals (chrom, at timestamp, score) whose times are at most slack apart: one row a session
    with its highest score, once the watermark has passed it."""
    late = intervals.withWatermark("at", watermark)
    return late.groupBy("chrom", F.session_window("at", f"{slack_seconds} seconds").alias("s")).agg(F.max("score").alias("score"), F.count("*").alias("n")).select("chrom", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "score", "n")
