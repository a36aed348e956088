"""Range self-joins of occurrences: pairs within a reach, by window and motif."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.config import Distance, Settings
from strandline.functions.sequences import between_distance, center, center_distance, gap, overlapping
from strandline.operators.windows import window_length, window_range, windows_of
from strandline.session import join_large


def occurrence_pairs(occ: DataFrame, reach: int) -> DataFrame:
    """Each unordered pair of different occurrences of a sequence whose starts differ by at most reach, once: seq_id,
    seq_len and a_*, b_* (motif_id, reverse, start, end), with a first by start, then motif, then strand.

    Starts are cut into buckets of `reach` bases; the right side of the equi-join stands in its bucket and the one
    before, so a long sequence is spread over its buckets and no key holds more than a stretch of it."""
    size = max(1, reach)
    bucket = F.floor(F.col("start") / size)

    def side(p: str) -> list[Column]:
        return [F.col(c).alias(f"{p}_{c}") for c in ("motif_id", "reverse", "start", "end")]

    left = occ.select("seq_id", "seq_len", bucket.alias("bucket"), *side("a"))
    right = occ.select("seq_id", F.explode(F.array(bucket, bucket - 1)).alias("bucket"), *side("b"))
    later = F.struct("b_start", "b_motif_id", "b_reverse") > F.struct("a_start", "a_motif_id", "a_reverse")
    near = F.col("b_start") - F.col("a_start") <= reach
    return join_large(left, right, ["seq_id", "bucket"]).where(later & near).drop("bucket")


def ordered_pairs(occ: DataFrame, reach: int, tasks: int | None = None) -> DataFrame:
    """The pairs of occurrence_pairs in both orders, with bucket, that of the first. All partners of an occurrence meet it in
    the task of (seq_id, bucket), so what is summed up by these and the occurrence needs no shuffle of pairs. tasks: so many
    take the pairs; unless stated, Spark tells by the occurrences' bytes, which are few beside what a task sums up."""
    size = max(1, reach)
    bucket = F.floor(F.col("start") / size)

    def side(p: str) -> list[Column]:
        return [F.col(c).alias(f"{p}_{c}") for c in ("motif_id", "reverse", "start", "end")]

    left = occ.select("seq_id", "seq_len", bucket.alias("bucket"), *side("a"))
    right = occ.select("seq_id", F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("bucket"), *side("b"))
    other = F.struct("b_start", "b_motif_id", "b_reverse") != F.struct("a_start", "a_motif_id", "a_reverse")
    near = F.abs(F.col("b_start") - F.col("a_start")) <= reach
    if tasks:
        left, right = (x.repartition(tasks, "seq_id", "bucket") for x in (left, right))
    return join_large(left, right, ["seq_id", "bucket"]).where(other & near)


def both_orders(pairs: DataFrame) -> DataFrame:
    """Each pair as (a, b) and as (b, a)."""
    swapped = pairs.select(*[F.col(c).alias(("b" if c[0] == "a" else "a") + c[1:]) if c[:2] in ("a_", "b_") else F.col(c) for c in pairs.columns])
    return pairs.unionByName(swapped)


def self_pairs(occ: DataFrame) -> DataFrame:
    columns = [F.col(c).alias(f"{p}_{c}") for p in "ab" for c in ("motif_id", "reverse", "start", "end")]
    return occ.select("seq_id", "seq_len", *columns)


def pairs_in_windows(pairs: DataFrame, size: int, step: int) -> DataFrame:
    """pairs with a row for each window that holds both: win."""
    start, end = F.least("a_start", "b_start"), F.greatest("a_end", "b_end")
    return pairs.withColumn("win", F.explode(windows_of(start, end, F.col("seq_len"), size, step)))


ENDS = ("a_start", "a_end", "b_start", "b_end")


def pair_gap() -> Column:
    return gap(*map(F.col, ENDS))


def pair_centers() -> Column:
    return center_distance(*map(F.col, ENDS))


def signed_centers() -> Column:
    return center(F.col("b_start"), F.col("b_end")) - center(F.col("a_start"), F.col("a_end"))


def is_pair(settings: Settings, least: int = 0, most: int | None = None) -> Column:
    """The pair predicate: distance within bounds and, if asked for, no overlap."""
    d = between_distance(*map(F.col, ENDS)) if settings.distance is Distance.BETWEEN else pair_centers()
    ok = (d >= least) & (d <= (settings.pair_cutoff if most is None else most))
    return ok if settings.pairs_can_overlap else ok & ~overlapping(*map(F.col, ENDS))


def pair_counts(occ: DataFrame, settings: Settings, max_len: int) -> DataFrame:
    """Pair counts of the pairwise models: seq_id, win, win_len, a, b (a <= b), n. Equal motifs count each unordered pair and
    each occurrence with itself, different ones all pairs."""
    pairs = occurrence_pairs(occ, settings.pair_cutoff + max_len).unionByName(self_pairs(occ)).where(is_pair(settings))
    same = F.col("a_motif_id") == F.col("b_motif_id")
    if not settings.homo_pairs:
        pairs = pairs.where(~same)
    if not settings.hetero_pairs:
        pairs = pairs.where(same)
    size, step = settings.window_size, settings.window_step
    first, last = window_range(F.least("a_start", "b_start"), F.greatest("a_end", "b_end"), F.col("seq_len"), size, step)
    placed = pairs.select("seq_id", "seq_len", F.least("a_motif_id", "b_motif_id").alias("a"), F.greatest("a_motif_id", "b_motif_id").alias("b"), first.alias("first"), last.alias("last")).where("first <= last")
    # pairs that lie in the same windows are counted before they are told by window
    ranges = placed.groupBy("seq_id", "first", "last", "a", "b").agg(F.first("seq_len").alias("seq_len"), F.count("*").alias("n"))
    each = ranges.withColumn("win", F.explode(F.sequence("first", "last")))
    return each.groupBy("seq_id", "win", "a", "b").agg(window_length(F.col("win"), F.first("seq_len"), size, step).alias("win_len"), F.sum("n").alias("n"))
