"""FASTA readers and class dimension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def parse_records(lines: DataFrame) -> DataFrame:
    """name, seq of records that were split at `>`: the header is the rest of its line, line ends go, case stays."""
    at = F.locate("\n", F.col("value"))
    name = F.when(at > 0, F.substring("value", F.lit(1), at - 1)).otherwise(F.col("value"))
    seq = F.when(at > 0, F.regexp_replace(F.substring("value", at + 1, F.length("value")), r"[\r\n]", "")).otherwise(F.lit(""))
    return lines.select(F.regexp_replace(name, "\r$", "").alias("name"), seq.alias("seq"))


def read_fasta(spark: SparkSession, path: str, on_empty: str = "drop") -> DataFrame:
    """seq_id, name, seq, len of each record, in file order. A `>` starts a record wherever it stands.

    on_empty: what records without bases do: "drop", "keep", or "error", which fails the whole load. Files are split only
    between records when Spark reads them, so the largest record must fit a task."""
    records = parse_records(spark.read.option("lineSep", ">").text(path).where(F.col("value") != ""))
    records = records.withColumn("seq_id", F.monotonically_increasing_id()).withColumn("len", F.length("seq"))
    if on_empty == "drop":
        records = records.where("len > 0")
    elif on_empty == "error":
        records = records.withColumn("seq", F.when(F.col("len") > 0, F.col("seq")).otherwise(F.raise_error(F.concat(F.lit("empty sequence: "), "name"))))
    return records.select("seq_id", "name", "seq", "len")


def read_flat(spark: SparkSession, path: str) -> DataFrame:
    """One row: all records of the files joined into one sequence, headers left out. One task joins and holds it, so it is for
    small files; byteranges.flat_stretches() is the same sequence in stretches."""
    records = read_fasta(spark, path)
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq_id", "seq"))), lambda r: r["seq"]), "")
    return records.agg(joined.alias("seq")).select(F.lit(0).cast("long").alias("seq_id"), F.lit(path).alias("name"), "seq", F.length("seq").alias("len"))


def total_length(seqs: DataFrame) -> int:
    """Bases over all sequences."""
    return seqs.agg(F.coalesce(F.sum(F.length("seq").cast("long")), F.lit(0))).first()[0]


def with_class(seqs: DataFrame, class_value: float, train_mode: str = "full") -> DataFrame:
    """Sequences of one class; train_mode: "full" or "win"."""
    if train_mode not in ("full", "win"):
        raise ValueError("train_mode is full or win")
    return seqs.withColumn("class_value", F.lit(float(class_value))).withColumn("train_mode", F.lit(train_mode))


class Classes:
    """Class dimension: numeric value, name, positive or not."""

    #: Fixed aliases of values.
    ALIASES = {"N": 0.0, "+": 1.0, "-": -1.0, "++": 2.0, "--": -2.0}

    def __init__(self) -> None:
        self.rows: list[tuple[float, str, bool]] = []

    def register(self, value: float, name: str, positive: bool) -> None:
        if any(v == value or n == name for v, n, _ in self.rows):
            raise ValueError(f"class {name} or value {value} is registered")
        self.rows.append((float(value), name, positive))

    def value(self, name: str) -> float:
        """Value of a registered name, of an alias, or of a number."""
        for v, n, _ in self.rows:
            if n == name:
                return v
        return self.ALIASES[name] if name in self.ALIASES else float(name)

    def to_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, "class_value double, class_name string, flag boolean")


def alias_value(name: Column) -> Column:
    """Values of aliases and of numbers in a column; null for anything else."""
    out = name.try_cast("double")
    for alias, value in Classes.ALIASES.items():
        out = F.when(name == alias, F.lit(value)).otherwise(out)
    return out


def clone_rows(seqs: DataFrame, fractions: list[float], seed: int = 0) -> list[DataFrame]:
    """Random disjoint parts of the sequences."""
    return seqs.randomSplit(fractions, seed)
