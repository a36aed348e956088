import random

import pytest
from pyspark.sql import functions as F

from strandline.config import Settings, SvmType
from strandline.models.sequence import FeatureModel, Hierarchical
from strandline.operators.features import Feature
from strandline.operators.scan import scan, scan_stretches
from strandline.operators.windows import window_gc
from strandline.plans.motif_queries import motif_set
from strandline.sources import byteranges
from strandline.sources.byteranges import build_index, flat_stretches, read_stretches, records
from strandline.sources.fasta import read_fasta, read_flat

MOTIFS = motif_set(("GAF", "GAGAG", 0), ("PAL", "GATC", 0), ("G8", "GAGAGAGA", 1))


def joined(stretches):
    """Records put together again from what each stretch owns."""
    out = {}
    for r in sorted(stretches.collect(), key=lambda r: (r.seq_id, r.begin)):
        name, length, seq = out.get(r.seq_id, (r.name, r.len, ""))
        assert (name, length, len(seq)) == (r.name, r.len, r.begin)
        out[r.seq_id] = (name, length, seq + r.seq[: r.owned])
    assert all(len(s) == n for _, n, s in out.values())
    return [(name, s) for _, (name, _, s) in sorted(out.items())]


TEXT = "before the first\nACGT\n>one a b\r\nGAGA\r\nGATC\r\n>two\n" + "GAGAGATC\n" * 40 + ">empty\n>>three > four\nACGT>five" + "\n\n" + "A" * 300 + "\n>six\nGATC"


@pytest.mark.parametrize("chunk", [1, 2, 3, 7, 64, 1000])
def test_every_way_to_cut_gives_the_records_of_the_reader(spark, tmp_path, chunk):
    path = str(tmp_path / "a.fa")
    text = TEXT if chunk > 3 else TEXT.replace("GAGAGATC\n" * 40, "GAGAGATC\n" * 3).replace("A" * 300, "A" * 9)
    (tmp_path / "a.fa").write_bytes(text.encode())
    want = [(r.name, r.seq) for r in read_fasta(spark, path).orderBy("seq_id").collect()]
    stretches = read_stretches(spark, path, overlap=5, chunk=chunk)
    assert joined(stretches) == want
    assert [r.name for r in records(stretches).orderBy("seq_id").collect()] == [n for n, _ in want]


@pytest.mark.parametrize("chunk", [9, 50, 4096])
def test_hits_across_borders(spark, tmp_path, chunk):
    path = str(tmp_path / "b.fa")
    (tmp_path / "b.fa").write_text(">x\n" + "GAGAGAGATC\nGAGAG\n" * 30 + ">y\n" + "GATCGA" * 50 + "\n>z\nGAT")
    seqs = read_fasta(spark, path)
    names = seqs.select("seq_id", "name")
    want = scan(seqs, MOTIFS).join(names, "seq_id").drop("seq_id")
    stretches = read_stretches(spark, path, overlap=MOTIFS.max_len - 1, chunk=chunk)
    got = scan_stretches(stretches, MOTIFS).join(records(stretches).select("seq_id", "name"), "seq_id").drop("seq_id")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []


def test_files_of_a_folder_empty_ones_and_a_kept_index(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for i, text in enumerate([">a\nGATC\n>b\nGAGAG", "", ">c\nACGTACGT\n", ">d only a header"]):
        (folder / f"{i}.fa").write_text(text)
    index = build_index(spark, str(folder), str(tmp_path / "index"), chunk=4)
    assert joined(read_stretches(spark, index=index)) == [("a", "GATC"), ("b", "GAGAG"), ("c", "ACGTACGT")]
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "x.fa").write_text("")
    assert read_stretches(spark, str(tmp_path / "none")).count() == 0


def test_one_record_is_read_by_many_tasks(spark, tmp_path):
    """4 MB in one line: 16 ranges, 16 tasks, none with more than its range and the overlap."""
    path = str(tmp_path / "long.fa")
    (tmp_path / "long.fa").write_text(">chromosome\n" + "GAGAGATCAA" * 419_430)
    stretches = read_stretches(spark, path, overlap=7, chunk=1 << 18)
    parts = stretches.withColumn("task", F.spark_partition_id()).groupBy("task").agg(F.max(F.length("seq")).alias("most")).collect()
    assert len(parts) == 17 and max(r.most for r in parts) <= (1 << 18) + 7
    assert scan_stretches(stretches, MOTIFS.only([1])).count() == 2 * 419_430
    assert {(r.name, r.len) for r in records(stretches).collect()} == {("chromosome", 4_194_300)}


def test_compressed_files_and_endless_headers_are_refused(spark, tmp_path):
    (tmp_path / "a.fa.gz").write_bytes(b"x")
    with pytest.raises(ValueError, match="compressed"):
        build_index(spark, str(tmp_path / "a.fa.gz"))
    (tmp_path / "h.fa").write_text(">" + "x" * 200_000 + "\nACGT")
    with pytest.raises(Exception, match="header is longer"):
        build_index(spark, str(tmp_path / "h.fa"))


@pytest.mark.parametrize("kind", ["sum", "svm", "forest"])
def test_models_score_stretches_as_whole_sequences(spark, tmp_path, kind):
    rng = random.Random(3)
    text = "".join(f">c{i}\n" + "".join(rng.choice("ACGTGAGAG") for _ in range(n)) + "\n" for i, n in enumerate([2600, 90, 1301]))
    (tmp_path / "g.fa").write_text(text)
    seqs = read_fasta(spark, str(tmp_path / "g.fa"))
    settings = Settings(window_size=200, window_step=50, train_step=100, svm_type=SvmType.C_SVC, trees=5)
    if kind == "sum":
        model = FeatureModel(MOTIFS, settings, features=(Feature("nOcc"), Feature("GC")))
    else:
        train = seqs.withColumn("class_value", F.when(F.col("name") == "c0", 1.0).otherwise(-1.0)).withColumn("train_mode", F.lit("win"))
        model = Hierarchical(MOTIFS, settings, kind=kind).fit(train)
    whole = model.score_windows(seqs).join(seqs.select("seq_id", "name"), "seq_id")
    stretches = read_stretches(spark, str(tmp_path / "g.fa"), overlap=model.reach(), chunk=137)
    w = model.windows_of_stretches(stretches, model.scan_motifs())
    cut = model.scored(w).join(records(stretches).select("seq_id", "name"), "seq_id")
    show = lambda df: sorted((r.name, r.win, r.win_start, r.win_len, round(r.score, 9)) for r in df.collect())
    assert show(cut) == show(whole) and len(show(cut)) > 60


def test_gc_needs_windows_to_be_whole(spark, tmp_path):
    (tmp_path / "g.fa").write_text(">x\n" + "ACGT" * 200)
    with pytest.raises(Exception, match="overlap by less"):
        window_gc(read_stretches(spark, str(tmp_path / "g.fa"), overlap=10, chunk=100), 200, 50).collect()


@pytest.mark.parametrize("size,overlap", [(7, 3), (50, 0), (13, 40), (10_000, 5)])
def test_flat_stretches_are_the_flat_reader_cut(spark, tmp_path, size, overlap):
    (tmp_path / "a.fa").write_text(">a\nGATCGA\n>b\nG\n>none\n>c\n" + "GAGA\nTC\n" * 20)
    (tmp_path / "b.fa").write_text(">d\nTTTTA")
    want = read_flat(spark, str(tmp_path)).first().seq
    rows = sorted(flat_stretches(spark, str(tmp_path), overlap, size).collect(), key=lambda r: r.begin)
    assert [(r.begin, r.owned) for r in rows] == [(i, min(size, len(want) - i)) for i in range(0, len(want), size)]
    assert all(r.len == len(want) and r.seq == want[r.begin : r.begin + r.owned + overlap] for r in rows)


def test_small_ranges_share_tasks(spark, tmp_path):
    """Thousands of ranges are no thousands of tasks, and all their bases are read."""
    path = tmp_path / "many.fa"
    path.write_text("".join(f">r{i}\n{'ACGT' * 25}\n" for i in range(2000)))
    parts = read_stretches(spark, str(path), overlap=5, chunk=100)
    assert parts.rdd.getNumPartitions() == 1
    assert parts.selectExpr("sum(owned)", "count(distinct seq_id)").first() == (200_000, 2000)


def test_planning_holds_no_ranges(tmp_path):
    """The driver used to hold and send a row of the index a range."""
    import pickle

    import pyarrow as pa
    import pyarrow.parquet as pq

    n, chunk = 50_000, 10_000
    columns = {"path": ["f"] * n, "file_no": [0] * n, "start": [i * chunk for i in range(n)], "stop": [(i + 1) * chunk for i in range(n)]}
    rest = {"record": pa.array([0] * n), "offset": pa.array([0] * n), "in_header": pa.array([False] * n), "open_name": pa.array(["doc 1"] * n), "open_len": pa.array([1] * n), "last_name": pa.array(["doc 2"] * n), "last_len": pa.array([1] * n)}
    pq.write_table(pa.table(columns | rest), tmp_path / "part-0.parquet")
    reader = byteranges.FastaReader({"index": str(tmp_path)})
    tasks = reader.partitions()
    assert 10 < len(tasks) < 1000 and len(pickle.dumps(tasks)) < 100_000
    starts = [r.start for p in (tasks[0], tasks[1], tasks[-1]) for r in reader._ranges(p)]
    assert starts[0] == 0 and starts[-1] == (n - 1) * chunk and len(set(starts)) == len(starts)
    assert sum(len(reader._ranges(p)) for p in tasks) == n
