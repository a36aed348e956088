"""Files read as one sequence: no row, task or worker holds it."""

from __future__ import annotations

import tracemalloc

from strandline.plans import model_queries
from strandline.sources import byteranges


def test_flat_query_never_joins_all_records(spark, monkeypatch):
    seen = []

    def stretches(*args, **options):
        seen.append(byteranges.flat_stretches(*args, **options))
        return seen[-1]

    monkeypatch.setattr(model_queries, "flat_stretches", stretches)
    found = model_queries.QUERIES["fasta_flat"](spark, "/root/testdata/sf0.001").collect()
    rows = model_queries.sequences(spark, "/root/testdata/sf0.001").selectExpr("sum(len) AS len", "sum(length(replace(seq, 'A', ''))) AS others").collect()
    assert len(seen) == 1 and [tuple(r) for r in found] == [tuple(r) for r in rows]


def test_a_task_holds_little_of_a_long_range(spark, tmp_path):
    path = tmp_path / "long.fa"
    path.write_bytes(b">one\n" + b"ACGTACGTACGTACGTACGTACGTACGTACGTACGTACGTACGTACGTACGTACGTACGTACG\n" * (1 << 19))
    index = byteranges.build_index(spark, str(path))
    reader = byteranges.FastaReader({"index": index.removeprefix("file:")})
    tracemalloc.start()
    owned = [n for p in reader.partitions() for b in reader.read(p) for n in b.column(4).to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(owned) == 63 << 19
    assert peak < 32 << 20
