"""Support vector machines of all rows: the same as one machine's, from chunks of a table."""

import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.config import Kernel, Settings, SvmType
from strandline.models import cascade, svm, validation, vector, whole
from strandline.models.sequence import FeatureModel, Hierarchical
from strandline.operators.features import Feature
from strandline.plans.motif_queries import PAIRED


def _rows(n=700, k=4, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, k)) * ([1, 5, 0.2, 1] * k)[:k]
    x[:, 0] = np.round(x[:, 0])
    return x, x[:, 0] + 0.3 * x[:, 1] + rng.normal(0, 0.8, n) > 0.3


def _table(spark, x, flags):
    return spark.createDataFrame([(i, a.tolist(), bool(f), float(i % 3)) for i, (a, f) in enumerate(zip(x, flags))], "id long, features array<double>, flag boolean, label double")


@pytest.fixture
def small(monkeypatch):
    for name, value in (("CHUNK", 200), ("WORKING", 64), ("SENT_ROWS", 400)):
        monkeypatch.setattr(whole, name, value)


def _off(spark, kind, kernel, nu=0.3):
    """How far decisions of a machine of many rows are from those of one that holds them all, as a share of their range."""
    x, flags = _rows()
    s = Settings(svm_type=kind, kernel=kernel, nu=nu, p=0.1, c0=1.0, cost=2.0, training_rows=100)
    one = svm.train_svm(x, np.where(flags, 1.0, -1.0), kind, kernel, s.cost, s.nu, s.p, s.c0).decide(x)
    return np.abs(vector.fit(_table(spark, x, flags), "svm", s, "id").decide(x) - one).max() / np.ptp(one)


def test_linear_machines_take_all_rows(spark, small):
    """They used to be trained on training_rows of the rows."""
    assert _off(spark, SvmType.C_SVC, Kernel.LINEAR) < 2e-3


def test_votes_take_all_rows(spark, small):
    x, flags = _rows()
    labels = np.arange(len(x)) % 3
    x = x + labels[:, None]
    s = Settings(svm_type=SvmType.C_SVC, training_rows=100)
    one = svm.Vote.train(x, labels.astype(float), svm_type=s.svm_type, kernel=s.kernel, cost=s.cost, nu=s.nu, c0=s.c0, gamma=s.gamma)
    found = vector.fit(_table(spark, x, flags), "vote", s, "id", "label")
    assert found.classes == one.classes and len(found.machines) == 3
    for a, b in zip(found.machines, one.machines):
        np.testing.assert_allclose(a.decide(x), b.decide(x), atol=2e-2)
    assert np.mean(found.choose(x) == one.choose(x)) > 0.99


def test_quadratic_machines_take_all_rows(spark, small):
    assert _off(spark, SvmType.C_SVC, Kernel.QUADRATIC) < 2e-3


def test_quadratic_support_folds_into_few_vectors():
    rng = np.random.default_rng(1)
    support, weights, x = rng.normal(size=(300, 5)), rng.normal(size=300), rng.normal(size=(40, 5))
    vectors, few, rest = whole.folded_quadratic((support * weights[:, None]).T @ support, support.T @ weights, weights.sum(), 0.2, 1.0)
    assert vectors.shape == (10, 5)
    want = svm.kernel_matrix(x, support, Kernel.QUADRATIC, 0.2, 1.0) @ weights
    np.testing.assert_allclose(svm.kernel_matrix(x, vectors, Kernel.QUADRATIC, 0.2, 1.0) @ few + rest, want)


@pytest.mark.parametrize("kind", [SvmType.C_SVC, SvmType.ONE_CLASS])
def test_rbf_machines_take_all_rows(spark, small, kind):
    assert _off(spark, kind, Kernel.RBF) < 2e-3


@pytest.mark.parametrize("kernel", list(Kernel))
def test_tiles_of_a_kernel_add_up(kernel, monkeypatch):
    monkeypatch.setattr(svm, "TILE", 7)
    rng = np.random.default_rng(2)
    a, b, w = rng.normal(size=(20, 3)), rng.normal(size=(30, 3)), rng.normal(size=30)
    np.testing.assert_allclose(svm.kernel_times(a, b, w, kernel, 0.4, 1.0), svm.kernel_matrix(a, b, kernel, 0.4, 1.0) @ w)
    assert not len(svm.kernel_times(a[:0], b, w, kernel, 0.4, 1.0)) and not svm.kernel_times(a, b[:0], w[:0], kernel, 0.4, 1.0).any()


def test_epsilon_regression_takes_all_rows(spark, small):
    assert _off(spark, SvmType.EPSILON_SVR, Kernel.LINEAR) < 2e-3


@pytest.mark.parametrize("kind, nu", [(SvmType.NU_SVR, 0.8), (SvmType.NU_SVC, 0.6)])
def test_nu_machines_take_all_rows(spark, small, kind, nu):
    assert _off(spark, kind, Kernel.LINEAR, nu) < 2e-3


def test_large_machines_are_no_cascades(spark, small, monkeypatch):
    """A task used to hold the support of all rows."""
    monkeypatch.setattr(cascade, "HELD", 300)
    x, flags = _rows(700)
    y = np.where(flags, 1.0, -1.0)
    rows = [("large", i, a.tolist(), b) for i, (a, b) in enumerate(zip(x, y.tolist()))] + [("few", i, x[i].tolist(), float(y[i])) for i in range(120)]
    samples = spark.createDataFrame(rows, "g string, id long, features array<double>, y double")
    sizes, real = [], cascade.materialize

    def kept(df, name):
        out = real(df, name)
        if name == "support":
            sizes.append(out.count())
        return out

    monkeypatch.setattr(cascade, "materialize", kept)
    s = Settings(svm_type=SvmType.C_SVC, kernel=Kernel.RBF)
    found = cascade.train_cascade(samples, s, ["g"], 100)
    assert max(sizes) <= 120
    for key, n in (("large", 700), ("few", 120)):
        one = svm.train_svm(x[:n], y[:n], s.svm_type, s.kernel, s.cost)
        assert cascade.objective(found[key,]) == pytest.approx(cascade.objective(one), rel=1e-3)
        np.testing.assert_allclose(found[key,].decide(x), one.decide(x), atol=2e-2)


def test_cross_validation_takes_all_rows(spark, small):
    """It used to drop all but training_rows of the rows."""
    x, flags = _rows(300)
    rows = _table(spark, x, flags)
    plain = [Settings(svm_type=SvmType.C_SVC, kernel=Kernel.RBF, cost=c) for c in (0.5, 2.0)]
    few = [Settings(svm_type=SvmType.C_SVC, kernel=Kernel.RBF, cost=c, training_rows=100) for c in (0.5, 2.0)]
    a, b = ({(r.point, r.id): (r.fold, r.label, r.decision) for r in validation.cross_validated(rows, p, "id", folds=2).collect()} for p in (plain, few))
    assert len(b) == 600 and a.keys() == b.keys()
    assert all(a[k][:2] == b[k][:2] and abs(a[k][2] - b[k][2]) < 1e-2 for k in a)


def test_cross_validation_without_a_sign_decides_nothing(spark, small):
    x, _ = _rows(150)
    rows = _table(spark, x, np.zeros(150, bool))
    found = validation.cross_validated(rows, [Settings(svm_type=SvmType.C_SVC, training_rows=100)], "id", folds=2).collect()
    assert len(found) == 150 and all(r.decision == 0.0 for r in found)


def _sequences(spark, n):
    rng = random.Random(4)
    rows = [(i, "".join(rng.choice("ACGT") if i % 2 else rng.choice("AAGGCT") for _ in range(500)), float(i % 2), "full") for i in range(n)]
    return spark.createDataFrame(rows, "seq_id long, seq string, class_value double, train_mode string")


def test_motifs_of_many_samples_hold_no_support(spark, small):
    """A task and each scoring worker used to hold nearly all of them."""
    base = Settings(svm_type=SvmType.C_SVC, cost=0.5, local_features=("GC", "nOcc"))
    seqs = _sequences(spark, 40)
    one, many = (Hierarchical(PAIRED, s, kind="svm").fit(seqs) for s in (base, replace(base, training_rows=30)))
    assert one.machines.keys() == many.machines.keys()
    for m in one.machines:
        a, b = one.machines[m].machines[0], many.machines[m].machines[0]
        assert len(b.support) == 1 < len(a.support)
        assert cascade.objective(b) == pytest.approx(cascade.objective(a), rel=2e-3)


def test_feature_models_train_on_all_windows(spark, small):
    """They used to be trained on training_rows of the windows."""
    seqs = _sequences(spark, 60)
    one, many = (FeatureModel(PAIRED, s, features=(Feature("nOcc"), Feature("GC")), kind="svm").fit(seqs).machine for s in (Settings(), Settings(training_rows=10)))
    rng = np.random.default_rng(0)
    x = one.scaler.low + rng.random((50, len(one.scaler.low))) * (one.scaler.high - one.scaler.low)
    np.testing.assert_allclose(many.decide(x), one.decide(x), atol=5e-3)
