"""Running sums over a total order, without one task for all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.session import materialize


def running(df: DataFrame, order: Sequence[Column], sums: dict[str, Column]) -> DataFrame:
    """df with the columns of sums summed over the rows up to and with each one, and place (1 for the first row).

    Rows are range-partitioned by the order and written once; a window over each range and the totals of the ranges
    before it give the sums, so no task sees more than a range."""
    marked = df.withColumns(dict(sums)).repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    marked = materialize(marked, "ordered")
    totals = marked.groupBy("_range").agg(*[F.sum(c).alias(f"_all_{c}") for c in sums], F.count("*").alias("_all_place"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    offsets = totals.select("_range", *[F.coalesce(F.sum(f"_all_{c}").over(before), F.lit(0)).alias(f"_before_{c}") for c in (*sums, "place")])
    within = Window.partitionBy("_range").orderBy(*order)
    upto = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = marked.withColumns({c: F.sum(c).over(upto) for c in sums} | {"place": F.row_number().over(within)}).join(offsets, "_range")
    return out.withColumns({c: F.col(c) + F.col(f"_before_{c}") for c in (*sums, "place")}).drop("_range", *[f"_before_{c}" for c in (*sums, "place")])
