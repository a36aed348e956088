import itertools
import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.config import Kernel, Settings, SvmType
from strandline.models import binned_forest, cascade, store, svm, validation, vector
from strandline.models.forest import train_forest
from strandline.models.linear import Linear
from strandline.models.sequence import Hierarchical
from strandline.models.svm import Vote, train_svm
from strandline.sources.motifs import MotifSet


def table(spark, x, y):
    return spark.createDataFrame([(i, a.tolist(), bool(b), float(b)) for i, (a, b) in enumerate(zip(x, y))], "id long, features array<double>, flag boolean, label double")


def made(n=120, k=3, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, k))
    return x, x[:, 0] + 0.5 * x[:, 1] ** 2 + rng.normal(0, 0.3, n) > 0.2


def objective(q, linear, alpha):
    return 0.5 * alpha @ q @ alpha + linear @ alpha


@pytest.mark.parametrize("kind", list(SvmType))
@pytest.mark.parametrize("kernel", [Kernel.LINEAR, Kernel.RBF])
def test_shrinking_finds_the_same_machine(monkeypatch, kind, kernel):
    monkeypatch.setattr(svm, "SPARSE", 0)  # else it waits for more rows
    x, flags = made(400, 4, 7)
    y = np.where(flags, 1.0, -1.0) if kind not in (SvmType.EPSILON_SVR, SvmType.NU_SVR) else x[:, 0] * 2 + x[:, 1]
    a, b = (train_svm(x, y, kind, kernel, cost=3.0, nu=0.3, p=0.1, shrink=s) for s in (True, False))
    assert np.abs(a.decide(x) - b.decide(x)).max() < 2e-2


def test_shrinking_works_out_fewer_entries(monkeypatch):
    monkeypatch.setattr(svm, "CACHE", 8)  # rows aren't kept: what is asked for is worked out
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 5))
    y = np.where(x[:, 0] + rng.normal(0, 0.6, 1500) > 0, 1.0, -1.0)
    counts, values = [], []
    for shrink in (True, False):
        k = svm.KernelRows(x, Kernel.RBF, 0.2, 0.0, 8)
        q = svm.Signed(k, y, np.arange(1500))
        alpha, rho, _ = svm.minimize(q, -np.ones(1500), y, np.full(1500, 5.0), np.zeros(1500), shrink=shrink)
        counts.append(k.entries)
        full = y[:, None] * y * svm.kernel_matrix(x, x, Kernel.RBF, 0.2, 0.0)
        values.append(objective(full, -np.ones(1500), alpha))
        assert alpha @ y == pytest.approx(0, abs=1e-8)
    assert counts[0] < 0.8 * counts[1]
    assert values[0] == pytest.approx(values[1], rel=1e-4)


def test_folds_are_stratified_and_seeded(spark):
    x, y = made(103)
    rows = validation.folded(table(spark, x, y), 5, "id", "flag", 3)
    counts = rows.groupBy("flag", "fold").count().collect()
    for flag in (True, False):
        own = [r["count"] for r in counts if r["flag"] == flag]
        assert len(own) == 5 and max(own) - min(own) <= 1
    pick = lambda seed: sorted(map(tuple, validation.folded(table(spark, x, y), 5, "id", "flag", seed).select("id", "fold").collect()))
    assert pick(3) == sorted((r.id, r.fold) for r in rows.collect()) != pick(4)


def test_cross_validation_decides_each_row_without_its_fold(spark):
    x, y = made()
    data = table(spark, x, y)
    points = validation.grid(Settings(svm_type=SvmType.C_SVC, kernel=Kernel.RBF), cost=[0.01, 10.0], gamma=[0.3])
    out = validation.cross_validated(data, points, "id", folds=4).collect()
    assert len(out) == 2 * 120 and {r.id for r in out} == set(range(120))
    fold = {r.id: r.fold for r in validation.folded(data.select("id", F.col("flag").cast("double").alias("label")), 4, "id", "label").collect()}
    for p, f in itertools.product(range(2), range(4)):
        left_out = np.array([fold[i] == f for i in range(120)])
        want = train_svm(x[~left_out], np.where(y[~left_out], 1.0, -1.0), SvmType.C_SVC, Kernel.RBF, points[p].cost, gamma=0.3).decide(x[left_out])
        got = {r.id: r.decision for r in out if r.point == p and r.fold == f}
        assert [got[i] for i in np.flatnonzero(left_out)] == pytest.approx(want.tolist())
    found = {r.point: r for r in validation.summary(validation.cross_validated(data, points, "id", folds=4)).collect()}
    assert found[1].rows == 120 and found[1].accuracy > 0.8
    votes = validation.cross_validated(data.withColumn("label", F.col("id") % 3), [Settings(svm_type=SvmType.C_SVC)], "id", "label", 3, "vote")
    assert validation.summary(votes, "vote").first().rows == 120


def plain_loss(x, t, a, b):
    z = a * x + b
    return (np.logaddexp(0, z) - (1 - t) * z).sum()


def test_sigmoid_is_the_least_loss(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=500) * 3
    y = rng.random(500) < 1 / (1 + np.exp(-1.5 * x + 0.7))
    rows = spark.createDataFrame([(float(a), bool(b)) for a, b in zip(x, y)] + [(None, True), (1.0, None)], "score double, flag boolean")
    s = validation.fit_sigmoid(rows)
    t = np.where(y, (y.sum() + 1) / (y.sum() + 2), 1 / ((~y).sum() + 2))
    best = plain_loss(x, t, s.a, s.b)
    assert -2.2 < s.a < -1.0
    for da, db in itertools.product((-1e-3, 0, 1e-3), repeat=2):
        assert best <= plain_loss(x, t, s.a + da, s.b + db) + 1e-9
    got = rows.where("score IS NOT NULL AND flag IS NOT NULL").select("score", s.column(F.col("score")).alias("p")).collect()
    assert [r.p for r in got] == pytest.approx([1 / (1 + np.exp(s.a * r.score + s.b)) for r in got])
    with pytest.raises(ValueError):
        validation.fit_sigmoid(rows.where("flag"))


def test_coupling(spark):
    rng = np.random.default_rng(3)
    p = rng.dirichlet(np.ones(4), 50)
    r = p[:, :, None] / (p[:, :, None] + p[:, None, :])
    np.testing.assert_allclose(validation.coupled(r), p, atol=1e-9)
    rows = spark.createDataFrame([([0.9, 0.8, 0.3],), ([0.5, 0.5, 0.5],), ([1.0, 1.0, 0.5],), (None,), ([0.1],)], "pairs array<double>")
    out = [r.p for r in rows.select(validation.coupled_column(F.col("pairs"), 3).alias("p")).collect()]
    assert out[1] == pytest.approx([1 / 3] * 3) and out[2][0] > 0.99 and out[3] is None and out[4] is None
    assert all(abs(sum(x) - 1) < 1e-12 for x in out[:3])


def test_kept_machines_decide_the_same(spark, tmp_path):
    x, y = made(60)
    sign = np.where(y, 1.0, -1.0)
    labels = np.digitize(x[:, 0], [-0.5, 0.5]).astype(float)
    machines = [train_svm(x, sign, SvmType.C_SVC, k) for k in (Kernel.LINEAR, Kernel.RBF)] + [Vote.train(x, labels, svm_type=SvmType.C_SVC), train_forest(x, y, 7), Linear(np.array([1.0, 2.0, 3.0]), -0.5)]
    rows = table(spark, x, y)
    for i, m in enumerate(machines):
        folder = f"file://{tmp_path}/m{i}"
        assert store.save(m, folder) == 1 and store.save(m, folder) == 2 and store.versions(folder) == [1, 2]
        kept = store.load(folder)
        assert kept.path.endswith("/v2")
        assert [r.score for r in vector.decide(rows, kept).collect()] == [r.score for r in vector.decide(rows, m).collect()]
    s = validation.Sigmoid(-1.5, 0.25)
    store.save(s, str(tmp_path / "s"))
    assert store.load(str(tmp_path / "s")).machine() == s


def test_broken_and_unknown_files_are_errors(tmp_path):
    folder = str(tmp_path / "m")
    with pytest.raises(ValueError, match="no version"):
        store.load(folder)
    store.save(Linear(np.ones(2), 0.0), folder)
    data = (tmp_path / "m/v1/machine.npz").read_bytes()
    (tmp_path / "m/v1/machine.npz").write_bytes(data[:-1] + bytes([data[-1] ^ 1]))
    with pytest.raises(ValueError, match="manifest"):
        store.load(folder).machine()
    (tmp_path / "m/v1/manifest.json").write_text('{"format": 99, "kind": "svm", "sha256": ""}')
    with pytest.raises(ValueError, match="format 99"):
        store.load(folder)
    with pytest.raises(ValueError, match="no format"):
        store.save(object(), folder)
    (tmp_path / "m/v2").mkdir()
    (tmp_path / "m/v2/machine.npz").write_bytes(b"")  # a writer that died before its manifest
    assert store.versions(folder) == [1]


def test_importance_finds_what_decides(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 12, (1500, 5)) * 1.0
    y = (x[:, 1] > 5) ^ (x[:, 3] > 8)
    data = table(spark, x, y)
    bins = binned_forest.quantile_bins(data)
    forest = binned_forest.train_forest_all_rows(data, "id", trees=20, seed=3, bins=bins)
    rows = {r.feature: r for r in binned_forest.permutation_importance(data, forest, bins, "id", seed=3).collect()}
    assert set(rows) == set(range(5)) and all(r.trees == 20 for r in rows.values())
    order = sorted(rows, key=lambda f: -rows[f].importance)
    assert set(order[:2]) == {1, 3}
    assert min(rows[1].importance, rows[3].importance) > 10 * max(abs(rows[f].importance) for f in (0, 2, 4))


def test_cascade_reaches_the_objective_of_one_machine(spark):
    rng = np.random.default_rng(9)
    rows, want = [], {}
    for g, n in (("many", 1800), ("few", 150), ("one sign", 40)):
        x = rng.normal(size=(n, 4)) * [1, 5, 0.2, 1]
        y = np.where(x[:, 0] + 0.3 * x[:, 1] + rng.normal(0, 0.5, n) > 0, 1.0, -1.0) if g != "one sign" else np.ones(n)
        rows += [(g, i, a.tolist(), float(b)) for i, (a, b) in enumerate(zip(x, y))]
        want[g] = (x, y)
    data = spark.createDataFrame(rows, "g string, id long, features array<double>, y double").repartition(5)
    s = Settings(svm_type=SvmType.C_SVC, kernel=Kernel.RBF, cost=2.0)
    found = cascade.train_cascade(data, s, ["g"], part_rows=500)
    assert set(found) == {("many",), ("few",), ("one sign",)}
    assert (found["one sign",].decide(want["one sign"][0]) > 0).all()
    for g in ("many", "few"):
        one = train_svm(*want[g], SvmType.C_SVC, Kernel.RBF, 2.0)
        assert cascade.objective(found[g,]) == pytest.approx(cascade.objective(one), rel=1e-3)
        assert np.mean((found[g,].decide(want[g][0]) > 0) == (one.decide(want[g][0]) > 0)) > 0.995
    left = {r.g: r for r in cascade.violations(data, found, ["g"], 2.0).collect()}
    assert left["many"].n == 1800 and left["many"].wrong <= 9 and left["few"].wrong == 0
    with pytest.raises(ValueError):
        cascade.train_cascade(data, Settings(svm_type=SvmType.NU_SVC), ["g"], 100)


@pytest.mark.parametrize("kind", ["svm", "forest"])
def test_motifs_with_many_samples_are_trained_on_all(spark, kind):
    rng = random.Random(4)
    rows = [(i, "".join(rng.choice("ACGT") if i % 2 else rng.choice("AACCGT") for _ in range(400)), float(i % 3), "full") for i in range(90)]
    seqs = spark.createDataFrame(rows, "seq_id long, seq string, class_value double, train_mode string")
    motifs = MotifSet()
    motifs.add_iupac("CG", "CG")
    motifs.add_iupac("G6", "GAGACC")
    base = Settings(svm_type=SvmType.C_SVC, trees=15, cost=0.5, local_features=("GC", "nOcc"))
    whole = Hierarchical(motifs, base, kind=kind).fit(seqs)
    parts = Hierarchical(motifs, replace(base, training_rows=700), kind=kind).fit(seqs)
    assert set(parts.machines) == set(whole.machines)
    a, b = whole.machines[0], parts.machines[0]
    x = np.array([[v, w, g] for v in (0.0, 5.0, 20.0, 40.0) for w in (0.0, 1.0) for g in (0.3, 0.5, 0.7)])
    if kind == "svm":
        assert a.classes == b.classes
        for m, n in zip(a.machines, b.machines):
            assert cascade.objective(n) == pytest.approx(cascade.objective(m), rel=2e-3)
    else:
        assert np.abs(a.decide(x) - b.decide(x)).mean() < 0.25


class Nearest:
    """Decides by the nearer class mean."""

    def __init__(self, a, b):
        self.a, self.b = a, b

    def decide(self, x):
        return ((x - self.b) ** 2).sum(axis=1) - ((x - self.a) ** 2).sum(axis=1)


def test_classifiers_of_others(spark):
    x, y = made(80)

    def train(samples, settings, order, label):
        means = {r[label]: np.array(r["m"]) for r in samples.groupBy(label).agg(F.array(*[F.avg(F.col("features")[i]) for i in range(3)]).alias("m")).collect()}
        return Nearest(means[True], means[False])

    vector.register("nearest", train)
    rows = table(spark, x, y)
    machine = vector.fit(rows, "nearest", Settings(), "id")
    assert np.mean((machine.decide(x) > 0) == y) > 0.6
    for bad in (lambda: vector.register("nearest", train), lambda: vector.register("svm", train), lambda: vector.fit(rows, "none", Settings(), "id")):
        with pytest.raises(ValueError):
            bad()
