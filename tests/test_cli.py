import random

import pytest

from strandline.cli import ROLES, assisted, parser, run, sequences_of
from strandline.sources.fasta import Classes


@pytest.fixture(scope="module")
def data(tmp_path_factory):
    folder = tmp_path_factory.mktemp("cli")
    rng = random.Random(1)

    def write(name, n, planted, length=700):
        lines = []
        for i in range(n):
            s = [rng.choice("ACGT") for _ in range(length)]
            for _ in range(6 if planted else 0):
                at = rng.randrange(20, length - 20)
                s[at : at + 11] = "GAGAGGCCATC"
            lines += [f">{name}{i} part", "".join(s)]
        (folder / f"{name}.fa").write_text("\n".join(lines) + "\n")
        return str(folder / f"{name}.fa")

    (folder / "m.xml").write_text('<motifs><motif name="GAF" seq="GAGAG" misses="0"/><motif name="PS" seq="GCCAT" misses="0"/></motifs>')
    (folder / "w.txt").write_text(">w\nA |\t1\t-1\t1\nC |\t-1\t-1\t-1\nG |\t-1\t1\t-1\nT |\t-1\t-1\t-1\n")
    return folder, write("pos", 24, True), write("neg", 24, False), write("genome", 2, True, 3000)


def read(spark, path):
    return [r.value for r in spark.read.text(str(path)).collect()]


@pytest.mark.parametrize("model", ["pair-logodds", "logodds", "svm", "hierarchical-svm"])
def test_train_calibrate_validate_predict(spark, data, capsys, tmp_path, model):
    folder, pos, neg, genome = data
    options = ["--motif-xml", f"{folder}/m.xml", "--model", model, "--train-fasta", pos, "+", "full", "--train-fasta", neg, "negative", "win", "--calibrate-fasta", pos, "+", "--calibrate-fasta", neg, "-", "--calibrate-precision", "0.9"]
    options += ["--validate-fasta", pos, "+", "--validate-iid", neg, "20", "700", "-", "--score-table", f"{tmp_path}/s", "--genome", genome, "--gff", f"{tmp_path}/g", "--wig", f"{tmp_path}/w", "--export", f"{tmp_path}/x", "--feature", "nOcc", "--feature", "nPair", "60", "--svm-type", "c_svc"]
    if model.startswith("hier"):
        options += ["--core-mode", "motifs"]
    fitted = run(spark, options)
    out = capsys.readouterr().out
    assert "threshold" in out and "ROC 1.0" in out
    assert len(read(spark, tmp_path / "s")) == 44 and len(read(spark, tmp_path / "x")) >= 2
    gff = read(spark, tmp_path / "g")
    assert gff and all(line.split("\t")[0] in ("genome0", "genome1") for line in gff)
    wig = read(spark, tmp_path / "w")
    assert sum(line.startswith("fixedStep chrom=genome") for line in wig) == 2 and len(wig) == 2 * 27
    assert fitted.settings.threshold != 0


def test_other_options(spark, data, tmp_path):
    folder, pos, neg, genome = data
    run(spark, ["--motif-iupac", "GAF", "GAGAG", "0", "--motif-kmer", "1", "--motif-random", "2", "6", "--motif-pwm", f"{folder}/w.txt", "--pwm-threshold", "3", "--model", "pair-sum", "--no-automaton", "--distance", "between", "--no-overlap", "--score", genome, f"{tmp_path}/s", "--core", genome, f"{tmp_path}/c"])
    assert len(read(spark, tmp_path / "s")) == 2 * 27 and len(read(spark, tmp_path / "c")) == 2
    m = run(spark, ["--motif-pwm", f"{folder}/w.txt", "--pwm-calibrate", "1", "--model", "pair-sum"])
    assert m.motifs[0].threshold == 3.0
    with pytest.raises(ValueError):
        run(spark, ["--model", "sum", "--motif-iupac", "a", "GA", "0", "--export", f"{tmp_path}/none"])
    with pytest.raises(ValueError):
        run(spark, ["--window-step", "600"])


def test_assisted(spark, data, capsys):
    folder, pos, _, genome = data
    run(spark, ["--motif-xml", f"{folder}/m.xml", "--model", "pair-logodds", "--auto", pos, genome, "--background-order", "2", "--auto-ratio", "2"])
    assert "threshold" in capsys.readouterr().out


def test_no_sequence_has_two_roles(spark, data):
    _, pos, _, genome = data
    a = assisted(spark, parser().parse_args(["--auto", pos, genome, "--background-order", "2", "--auto-ratio", "1", "--train-iid", genome, "5", "700", "-", "full"]))
    classes = Classes()
    for row in ((1.0, "positive", True), (-1.0, "negative", False)):
        classes.register(*row)
    parts = {role: [(r.seq, r.class_value) for r in sequences_of(spark, a, role, classes).collect()] for role in ROLES}
    every = [s for rows in parts.values() for s, _ in rows]
    assert len(every) == len(set(every)) and all(any(v > 0 for _, v in rows) for rows in parts.values())
    assert sum(v > 0 for rows in parts.values() for _, v in rows) == 24
    again = {role: sorted(r.seq for r in sequences_of(spark, a, role, classes).collect()) for role in ROLES}
    assert again == {role: sorted(s for s, _ in rows) for role, rows in parts.items()}


def test_machine_options(spark, data, tmp_path):
    folder, pos, neg, _ = data
    fitted = run(spark, ["--motif-xml", f"{folder}/m.xml", "--train-fasta", pos, "+", "full", "--train-fasta", neg, "-", "full", "--svm-type", "c_svc", "--gamma", "0.5", "--kernel", "quadratic", "--local-feature", "GC", "--training-rows", "40", "--export", f"{tmp_path}/x"])
    machine = next(iter(fitted.machines.values())).machines[0]
    assert machine.gamma == 0.5 and machine.support.shape[1] == 1
    lines = read(spark, tmp_path / "x")
    assert any("against" in x and "GC x GC" in x for x in lines) and any("bias" in x for x in lines)
    assert any(r.item == "local feature 0" and r.value == "GC" for r in fitted.describe(sequences_of(spark, parser().parse_args(["--train-fasta", pos, "+", "full"]), "train", Classes())).collect())
