"""What machines hold and read while they are trained and score."""

import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from strandline.config import Kernel, Settings, SvmType
from strandline.models import cascade, validation
from strandline.models.moments import _round
from strandline.models.svm import Scaler, Svm, Vote, kernel_matrix, solved


def test_scoring_holds_blocks_of_the_kernel():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1000, 8))
    for kernel in Kernel:
        m = Svm(Scaler(-np.ones(8), np.ones(8)), rng.normal(size=(20_000, 8)), rng.normal(size=20_000), 0.3, kernel, 1 / 8, 1.0)
        tracemalloc.start()
        found = m.decide(x)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert most < 64 << 20  # the kernel of all is 160 MB
        plain = np.concatenate([kernel_matrix(m.scaler(x[i : i + 50]), m.support, kernel, m.gamma, m.c0) @ m.coefficients - m.rho for i in range(0, 1000, 50)])
        np.testing.assert_allclose(found, plain, rtol=1e-9, atol=1e-6)
        assert not len(m.decide(x[:0]))


def test_pairs_of_a_vote_are_trained_by_tasks(spark):
    rng = np.random.default_rng(2)
    labels = rng.integers(0, 4, 200).astype(float)
    x = rng.normal(size=(200, 3)) + labels[:, None]
    options = {"svm_type": SvmType.C_SVC, "kernel": Kernel.LINEAR, "cost": 1.0, "nu": 0.5, "c0": 0.0, "gamma": None}
    one, spread = Vote.train(x, labels, **options), Vote.train_distributed(spark, x, labels, **options)
    assert one.classes == spread.classes and len(spread.machines) == 6
    np.testing.assert_array_equal(one.choose(x), spread.choose(x))


def test_rounds_of_a_cascade_copy_no_support(spark, monkeypatch):
    """Labels that nothing parts: nearly all rows are support, and each part of a later round used to hold all of them."""
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(240, 4)), np.where(rng.random(240) < 0.5, 1.0, -1.0)
    samples = spark.createDataFrame([(0, i, x[i].tolist(), float(y[i])) for i in range(240)], "g int, id long, features array<double>, y double")
    sizes, real = [], cascade.materialize

    def kept(df, name):
        out = real(df, name)
        if name == "support":
            sizes.append(out.count())
        return out

    monkeypatch.setattr(cascade, "materialize", kept)
    s = Settings(svm_type=SvmType.C_SVC, kernel=Kernel.RBF)
    found = cascade.train_cascade(samples, s, ["g"], 20)[0,]
    plain, _ = solved(x, y, s.svm_type, s.kernel, s.cost, s.nu, s.p, s.c0, s.gamma)
    assert abs(cascade.objective(found) - cascade.objective(plain)) < 1e-3 * abs(cascade.objective(plain))
    assert max(sizes) <= 240


def test_folds_are_tasks_of_their_own(spark):
    rng = np.random.default_rng(4)
    rows = spark.createDataFrame([(i, rng.normal(size=2).tolist(), bool(i % 2)) for i in range(60)], "vec_id long, features array<double>, flag boolean")
    points = validation.grid(Settings(svm_type=SvmType.C_SVC), cost=[0.1, 1.0])
    found = validation.cross_validated(rows, points, "vec_id").withColumn("task", F.spark_partition_id())
    tasks = found.groupBy("task").agg(F.countDistinct("point", "fold").alias("jobs"), F.count("*").alias("n")).collect()
    assert [r.jobs for r in tasks] == [1] * 10 and sum(r.n for r in tasks) == 120


def test_a_round_of_many_mistakes_looks_few_rows_ahead():
    """Each mistake used to cost 512 rows of products."""
    looked = []

    class Counted(np.ndarray):
        def __matmul__(self, w):
            looked.append(len(self))
            return np.asarray(self) @ np.asarray(w)

    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(4000, 3)), np.where(rng.random(4000) < 0.5, 1.0, -1.0)
    w, b, wrong = np.zeros(3), 0.0, 0
    for row, label in zip(x, y):
        if label * (row @ w + b) <= 0:
            w, b, wrong = w + label * row, b + label, wrong + 1
    found = _round(x.view(Counted), y, np.zeros(3), 0.0, 1.0)
    np.testing.assert_allclose(np.asarray(found[0]), w)
    assert found[4] == wrong and sum(looked) < 10 * len(x)
