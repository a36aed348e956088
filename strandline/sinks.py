"""Rows and files of predictions, scores and weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Value of a track where nothing is predicted.
NONE_PREDICTED = -9999999999


def significant(value: Column, digits: int = 6) -> Column:
    """A number with so many significant digits and no trailing zeros, as text: plain from 1e-4 to 10**digits, else with
    an exponent of two digits or more."""
    size = F.abs(value)
    scientific = F.format_string(f"%.{digits - 1}e", value)
    exponent = F.regexp_extract(scientific, r"e([+-]\d+)", 1).cast("int")
    places = F.greatest(F.lit(0), digits - 1 - exponent)
    plain = F.lit("")
    for n in range(digits + 4):
        plain = F.when(places == n, F.format_string(f"%.{n}f", value)).otherwise(plain)
    plain = F.when(plain.contains("."), F.regexp_replace(plain, r"\.?0+$", "")).otherwise(plain)
    short = F.concat(F.regexp_replace(F.regexp_extract(scientific, r"^(.*)e", 1), r"\.?0+$", ""), F.lit("e"), F.regexp_extract(scientific, r"e([+-]\d+)", 1))
    return F.when(size == 0, F.lit("0")).when((exponent < -4) | (exponent >= digits), short).otherwise(plain)


def gff_rows(predictions: DataFrame, source: str = "strandline") -> DataFrame:
    """line of each prediction (chrom, start, end, score); starts are counted from 0."""
    fields = [F.col("chrom").cast("string"), F.lit(source), F.lit("Prediction"), F.col("start").cast("string"), F.col("end").cast("string"), significant(F.col("score")), F.lit("."), F.lit("."), F.lit("1")]
    return predictions.select(F.concat_ws("\t", *fields).alias("line"))


def wig_rows(scored: DataFrame, step: int, span: int, threshold: float | None = None) -> DataFrame:
    """chrom, place, line of a fixed-step track of windows (chrom, win, score): a header (place -1), then a value a
    window; below the threshold, if there is one, the mark of nothing predicted."""
    value = F.col("score") if threshold is None else F.when(F.col("score") >= threshold, F.col("score")).otherwise(F.lit(float(NONE_PREDICTED)))
    values = scored.select("chrom", F.col("win").alias("place"), F.when(value == NONE_PREDICTED, F.lit(str(NONE_PREDICTED))).otherwise(significant(value)).alias("line"))
    head = F.format_string(f"fixedStep chrom=%s start=1 step={step} span={span}", F.col("chrom").cast("string"))
    return values.unionByName(scored.select("chrom").distinct().select("chrom", F.lit(-1).cast("long").alias("place"), head.alias("line")))


def wig_scores(scored: DataFrame, size: int, step: int) -> DataFrame:
    """name, place, line of a track of raw scores of each window of named sequences (name, win, score), six decimals."""
    head = F.format_string(f"fixedStep start=1 step={step} span={size} chrom=%s", F.col("name"))
    values = scored.select("name", F.col("win").alias("place"), F.format_string("%f", "score").alias("line"))
    return values.unionByName(scored.select("name").distinct().select("name", F.lit(-1).cast("long").alias("place"), head.alias("line")))


def score_table(scored: DataFrame) -> DataFrame:
    """line of each (score, flag): ten decimals and + or -."""
    return scored.select(F.format_string("%.10f\t%s", "score", F.when(F.col("flag"), "+").otherwise("-")).alias("line"))


def core_table(cores: DataFrame) -> DataFrame:
    """line of each (name, core_start, core_end, core_score)."""
    return cores.select(F.format_string("%s\t%d\t%d\t%f", "name", "core_start", "core_end", "core_score").alias("line"))


def write_lines(lines: DataFrame, path: str, order: list[str] | None = None) -> None:
    """Text files of the column line; with an order, files and their rows follow it."""
    if order:
        lines = lines.repartitionByRange(*order).sortWithinPartitions(*order)
    lines.select("line").write.mode("overwrite").text(path)
