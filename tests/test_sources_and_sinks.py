import random

import numpy as np
import pytest

from strandline import sinks
from strandline.functions.iupac import sequence_of_text
from strandline.operators import scan
from strandline.sources import background, fasta, readers
from strandline.sources.motifs import MotifSet, distinct_patterns, kmers
from strandline.streaming.scan import stream_fasta, stream_merge, stream_scan
from pyspark.sql import functions as F


def test_fasta(spark, tmp_path):
    path = tmp_path / "a.fa"
    path.write_text(">one x:1..2 (+)\r\nACGT\r\nNNac\n\n>two\nGG>three\nTT\n>empty\n>last")
    rows = [(r.name, r.seq, r.len) for r in fasta.read_fasta(spark, str(path)).orderBy("seq_id").collect()]
    assert rows == [("one x:1..2 (+)", "ACGTNNac", 8), ("two", "GG", 2), ("three", "TT", 2)]
    assert fasta.read_fasta(spark, str(path), "keep").count() == 5
    assert fasta.total_length(fasta.read_fasta(spark, str(path))) == 12
    with pytest.raises(Exception, match="empty sequence"):
        fasta.read_fasta(spark, str(path), "error").collect()
    flat = fasta.read_flat(spark, str(path)).first()
    assert flat.seq == "ACGTNNacGGTT" and flat.len == 12
    parts = fasta.clone_rows(fasta.read_fasta(spark, str(path)), [0.5, 0.5])
    assert sum(p.count() for p in parts) == 3
    assert fasta.with_class(flat_df := fasta.read_flat(spark, str(path)), 1, "win").first().train_mode == "win" and flat_df.count() == 1


def test_classes(spark):
    c = fasta.Classes()
    c.register(1, "pos", True)
    c.register(-1, "neg", False)
    for bad in ((1, "x", True), (3, "neg", False)):
        with pytest.raises(ValueError):
            c.register(*bad)
    assert [c.value(x) for x in ("pos", "+", "--", "N", "4.5")] == [1, 1, -2, 0, 4.5]
    assert c.to_df(spark).count() == 2


def test_motif_files(spark, tmp_path):
    (tmp_path / "m.xml").write_text('<motifs><motif name="G" seq="GAGAG" misses="1"/><other name="R" seq="CTCTC" misses="0"/><x name="Z" seq="YGAGYG" misses="0"/><motif name="bad" seq="GG"/></motifs>')
    m = MotifSet()
    assert m.add_xml(spark, str(tmp_path / "m.xml")) == 2
    assert [(x.name, x.pattern, x.mismatches) for x in m] == [("G", "GAGAG", 1), ("Z", "YGAGYG", 0)]
    (tmp_path / "w.txt").write_text(">w one\nA |\t1.0\t\t2\nC |\t0\t0\t\nG |\t-1\t3\nT |\t0.5\t0.5\n")
    assert m.add_pwm_table(spark, str(tmp_path / "w.txt"), 2.0) == 1
    assert m[2].pwm == ((1.0, 2.0), (0.0, 0.0), (-1.0, 3.0), (0.5, 0.5)) and m.max_len == 6
    assert m.with_threshold(3.0)[2].threshold == 3.0
    (tmp_path / "bad.txt").write_text(">w\nA |\t1\nC |\t1\t2\nG |\t1\nT |\t1\n")
    with pytest.raises(ValueError):
        m.add_pwm_table(spark, str(tmp_path / "bad.txt"))
    assert m.to_df(spark).count() == 3
    assert sorted(r.pattern for r in kmers(spark, 1).collect()) == ["A", "C", "G", "T"]
    plain = MotifSet()
    plain.add_kmers(3)
    assert sorted((r.motif_id, r.pattern) for r in distinct_patterns(kmers(spark, 3)).collect())[0] == (0, "AAA")
    assert {r.pattern for r in distinct_patterns(kmers(spark, 3)).collect()} == {x.pattern for x in plain}


def test_background(spark):
    seqs = spark.createDataFrame([("ACGTNACG",), ("AAAA",), ("",), (None,)], "seq string")
    assert {r.base: r.n for r in background.train_iid(seqs).collect()} == {"A": 6, "C": 2, "G": 2, "T": 1}
    assert [r.p for r in background.train_iid(seqs.where("false")).collect()] == [0.25] * 4
    rng = random.Random(0)
    texts = ["".join(rng.choice("ACGTACGTN") for _ in range(rng.randint(0, 60))) for _ in range(30)]
    for add_rc in (False, True):
        counts = {}
        for t in texts:
            for run in t.split("N"):
                for i in range(1, len(run) - 2):
                    words = [run[i : i + 3]] + ([run[i : i + 3].translate(str.maketrans("ACGT", "TGCA"))[::-1]] if add_rc else [])
                    for w in words:
                        counts[w] = counts.get(w, 0) + 1
        model = background.train_markov(spark.createDataFrame([(t,) for t in texts], "seq string"), 2, add_rc)
        rows = model.collect()
        assert len(rows) == 16
        for r in rows:
            assert [r[f"n{b}"] for b in "ACGT"] == [counts.get(r.context + b, 0) + 1 for b in "ACGT"] and r.total == sum(r[f"n{b}"] for b in "ACGT")


def test_generation_follows_its_model(spark):
    seqs = background.generate_iid(spark, 20, 3000, {"A": 0.1, "C": 0.2, "G": 0.3, "T": 0.4}, seed=3)
    text = "".join(r.seq for r in seqs.orderBy("seq_id").collect())
    assert [text.count(b) / len(text) for b in "ACGT"] == pytest.approx([0.1, 0.2, 0.3, 0.4], abs=0.01)
    assert [r.seq for r in seqs.repartition(7).orderBy("seq_id").collect()] == [r.seq for r in seqs.orderBy("seq_id").collect()]
    train = spark.createDataFrame([("ACACACACACACGTGTGTGTGT" * 30,)], "seq string")
    model = background.train_markov(train, 2, add_rc=False)
    out = background.generate_markov(spark, model, 10, 2000, seed=1).collect()
    assert all(len(r.seq) == 2000 for r in out) and f"seed {background.sequence_seed(1, str(), 9)}" in out[9].name
    again = background.train_markov(spark.createDataFrame([(r.seq,) for r in out], "seq string"), 2, add_rc=False)
    a, b = ({r.context: r.nA / r.total for r in m.collect()} for m in (model, again))
    assert abs(a["AC"] - b["AC"]) < 0.05


def test_text_as_bases(spark):
    df = spark.createDataFrame([("Ab-Cd É z",)], "t string")
    assert df.select(sequence_of_text(F.col("t"))).first()[0] == "ACGTC"


def test_sinks(spark, tmp_path):
    p = spark.createDataFrame([("2L", 0, 500, 12.5), ("2L", 700, 900, 1234567.0), ("2L", 5, 6, 0.00001234)], "chrom string, start long, end long, score double")
    assert [r.line for r in sinks.gff_rows(p, "s").collect()] == ["2L\ts\tPrediction\t0\t500\t12.5\t.\t.\t1", "2L\ts\tPrediction\t700\t900\t1.23457e+06\t.\t.\t1", "2L\ts\tPrediction\t5\t6\t1.234e-05\t.\t.\t1"]
    w = spark.createDataFrame([("c", 0, 1.5), ("c", 1, -2.0)], "chrom string, win long, score double")
    assert [r.line for r in sinks.wig_rows(w, 100, 500, 0.0).orderBy("place").collect()] == ["fixedStep chrom=c start=1 step=100 span=500", "1.5", "-9999999999"]
    n = w.withColumnRenamed("chrom", "name")
    assert [r.line for r in sinks.wig_scores(n, 500, 100).orderBy("place").collect()] == ["fixedStep start=1 step=100 span=500 chrom=c", "1.500000", "-2.000000"]
    s = spark.createDataFrame([(0.5, True), (-1.0, False)], "score double, flag boolean")
    assert [r.line for r in sinks.score_table(s).collect()] == ["0.5000000000\t+", "-1.0000000000\t-"]
    c = spark.createDataFrame([("n", 1, 2, 0.5)], "name string, core_start long, core_end long, core_score double")
    assert sinks.core_table(c).first().line == "n\t1\t2\t0.500000"
    sinks.write_lines(sinks.wig_rows(w, 100, 500), str(tmp_path / "w"), ["chrom", "place"])
    assert [r.value for r in spark.read.text(str(tmp_path / "w")).collect()] == ["fixedStep chrom=c start=1 step=100 span=500", "1.5", "-2"]
    values = [0.0, 1.0, 123456.0, 0.1, 1e-5, 99999.5, -3.25e10, 100000.0]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(sinks.significant(F.col("v"))).collect()]
    assert got == ["%g" % v for v in values]


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.fa").write_text(">one\nGAGAGAG\n>two\nCTCTC\n")
    m = MotifSet()
    m.add_iupac("GAF", "GAGAG")
    query = stream_scan(stream_fasta(spark, str(tmp_path / "in")), m).writeStream.format("memory").queryName("hits").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted((r.start, r.reverse) for r in spark.table("hits").collect()) == [(0, False), (0, True), (2, False)]
    spark.createDataFrame([("c", "2024-01-01 00:00:00", 1.0), ("c", "2024-01-01 00:00:30", 3.0), ("c", "2024-01-01 00:05:00", 2.0)], "chrom string, at string, score double").write.json(str(tmp_path / "e"))
    events = spark.readStream.schema("chrom string, at timestamp, score double").json(str(tmp_path / "e"))
    query = stream_merge(events, 60).writeStream.format("memory").queryName("merged").outputMode("append").option("checkpointLocation", str(tmp_path / "d")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    batch = spark.createDataFrame([("c", "2024-01-01 00:00:00", 1.0), ("c", "2024-01-01 00:00:30", 3.0), ("c", "2024-01-01 00:05:00", 2.0)], "chrom string, at string, score double").withColumn("at", F.to_timestamp("at"))
    assert sorted((r.n, r.score) for r in stream_merge(batch, 60).collect()) == [(1, 2.0), (2, 3.0)]


def test_rolling_codes():
    codes = scan.rolling_codes(np.frombuffer(b"ACGNTT", np.uint8), 2)
    assert codes.tolist() == [1, 6, -1, -1, 15] and scan.kmer_text(6, 2) == "CG"


def test_a_cluster_needs_a_shared_folder():
    from unittest.mock import MagicMock

    from strandline.session import shared_root

    cluster = MagicMock()
    cluster.sparkContext.master = "spark://host:7077"
    cluster.sparkContext.getConf().get.return_value = cluster.conf.get.return_value = None
    cluster.sparkContext._jsc.sc().getCheckpointDir().isDefined.return_value = False
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_root(cluster)


def test_chains_side_by_side_are_those_one_by_one():
    rng = np.random.default_rng(0)
    order, counts = 2, rng.integers(1, 50, (16, 4)).astype(float)
    totals, steps = np.cumsum(counts.sum(axis=1)), np.cumsum(counts, axis=1) / counts.sum(axis=1)[:, None]

    def plain(seed, length):
        r = np.random.default_rng(seed)
        state = int(np.searchsorted(totals, r.random() * totals[-1], side="right"))
        out = [state >> 2 & 3, state & 3][:length]
        for x in r.random(max(0, length - order)):
            base = min(3, int(np.searchsorted(steps[state], x, side="right")))
            out.append(base)
            state = (state << 2 | base) & 15
        return "".join("ACGT"[b] for b in out)

    for length in (0, 1, 2, 3, 500):
        got = background.markov_sequences([np.random.default_rng(s) for s in range(7)], length, order, totals, steps)
        assert got == [plain(s, length) for s in range(7)]


def test_readers_of_others(spark, tmp_path):
    (tmp_path / "x.txt").write_text("a\tACGT\nb\tGG\n")

    def table(spark, path, on_empty="drop"):
        cut = F.split("value", "\t")
        return spark.read.text(path).select(F.monotonically_increasing_id().alias("seq_id"), cut[0].alias("name"), cut[1].alias("seq"), F.length(cut[1]).alias("len"))

    readers.register("tabs", table)
    assert sorted((r.name, r.seq, r.len) for r in readers.read_sequences(spark, str(tmp_path / "x.txt"), name="tabs").collect()) == [("a", "ACGT", 4), ("b", "GG", 2)]
    assert readers.names() == ["fasta", "tabs"]
    for bad in (lambda: readers.register("tabs", table), lambda: readers.read_sequences(spark, "x", name="none")):
        with pytest.raises(ValueError):
            bad()
