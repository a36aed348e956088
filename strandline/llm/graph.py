"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014) on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.session import materialize


#: Rows of small tables, of which an upper bound is known before they are written, that a task writes: with hundreds of
#: shuffle partitions a few rows would be as many files.
ROWS_A_TASK = 2000


def written(df: DataFrame, name: str, rows: int, each: int = ROWS_A_TASK) -> DataFrame:
    """A table of at most so many rows, written by as many tasks as they need."""
    return materialize(df.coalesce(max(1, -(-rows // each))), name)


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def connected_components(edges: DataFrame, src: str, dst: str, rows: int | None = None) -> DataFrame:
    """(node, root) for each node with an edge: root is the smallest node of its component, itself included.

    Nodes are of any orderable type, null ends and loops are ignored, repeated edges count once. Each round is two
    joins and two partial aggregations on edges; its result is written to the shared folder, and so are the smallest
    neighbours, so that both sides of a join are read from tables and a hub's edges can be split. Stars stay stars. rows: a
    bound of the edges, if one is known."""
    e = edges.where(F.col(src) != F.col(dst)).select(F.greatest(src, dst).alias("a"), F.least(src, dst).alias("b")).distinct()
    e = materialize(e, "edges") if rows is None else written(e, "edges", rows)
    before = None
    while (now := _signature(e)) != before:
        before = now
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        n = 2 * now[0]  # ends of edges; no table of a round has more rows, the last one twice as many
        low = written(low, "neighbours", n)
        large = both.join(low, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where(F.col("a") != F.col("b")).distinct()
        large = written(large, "large-star", n)
        low = written(large.groupBy("a").agg(F.min("b").alias("m")), "neighbours", n)
        moved = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where(F.col("a") != F.col("b"))
        small = moved.unionByName(low.select("a", F.col("m").alias("b")))
        e = written(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "small-star", 2 * n)
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
