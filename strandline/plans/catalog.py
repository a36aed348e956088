"""Registered queries of the sequence-motif operators and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandline.plans import model_queries, motif_queries, training_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = motif_queries.QUERIES | model_queries.QUERIES | training_queries.QUERIES
ORACLE: dict[str, str] = motif_queries.ORACLE | model_queries.ORACLE | training_queries.ORACLE


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences of four motifs on both strands, counted by window."""
    return QUERIES["occ_per_window"](spark, sf_dir)
