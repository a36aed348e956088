"""Batches that workers get."""

import pyarrow as pa
from pyspark.sql import functions as F

from strandline.session import map_arrow


def test_long_texts_come_in_batches_of_few_bytes(spark):
    """200 texts of 100,000 bases in one partition: 20 MB that fewer rows than a batch's would bring at once."""
    texts = spark.range(0, 200, 1, 1).select(F.repeat(F.lit("ACGT"), 25_000).cast("binary").alias("seq"))
    sizes = map_arrow(texts, lambda batches: (pa.RecordBatch.from_arrays([pa.array([len(b)]), pa.array([b.nbytes])], names=["n", "bytes"]) for b in batches), "n long, bytes long").collect()
    assert sum(r.n for r in sizes) == 200
    assert max(r.bytes for r in sizes) < 9 << 20
