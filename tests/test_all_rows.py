"""Machines that train on all rows, against those that hold their rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.models import binned_forest as B
from strandline.models.forest import grow, mixed
from strandline.models.linear import train_lda
from strandline.models.moments import Moments, class_moments, train_lda_all_rows, train_perceptron_all_rows


def table(spark, x, y, parts=4):
    rows = [(i, a.tolist(), bool(b)) for i, (a, b) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id long, features array<double>, flag boolean").repartition(parts)


def nested(tree, node=0):
    """A tree as nested tuples, so that the order of its nodes doesn't matter."""
    if tree.feature[node] < 0:
        return round(float(tree.share[node]), 12)
    return (int(tree.feature[node]), float(tree.split[node]), nested(tree, tree.left[node]), nested(tree, tree.right[node]))


def made(n, features, values, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, values, (n, features)) * 0.37 - 1.5
    y = x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(0, 1, n) > 0
    return x, y


@pytest.mark.parametrize("local_rows,depth", [(10**9, 0), (40, 0), (11, 4), (0, 3)])
def test_trees_are_those_of_one_machine(spark, monkeypatch, local_rows, depth):
    x, y = made(600, 7, 30)
    monkeypatch.setattr(B, "CELLS", 2 * 30 * 3)  # three nodes a pass
    found = B.train_forest_all_rows(table(spark, x, y), "id", trees=4, depth=depth, seed=5, local_rows=local_rows)
    ids = np.array([r[0] for r in spark.createDataFrame([(i,) for i in range(len(x))], "id long").orderBy("id").select(F.xxhash64("id")).collect()])
    for t, tree in enumerate(found.trees):
        mark = mixed(mixed(5, 0), t)
        times = B.times_drawn(ids, mark)
        want, _ = grow(x, y, None, depth, rows=np.repeat(np.arange(len(x)), times), mark=mark)
        assert nested(tree) == nested(want)
    share, times = np.zeros(len(x)), np.zeros(len(x))
    for t, tree in enumerate(found.trees):
        out = B.times_drawn(ids, mixed(mixed(5, 0), t)) == 0
        share[out] += tree.predict(x[out])
        times[out] += 1
    p = share[times > 0] / times[times > 0]
    assert found.oob_error == pytest.approx(np.mean((1 - np.where(y[times > 0], p, 1 - p)) ** 2))


def test_many_values_are_split_at_quantiles(spark):
    rng = np.random.default_rng(3)
    x = np.c_[rng.normal(size=(4000, 3)), rng.integers(0, 2, 4000)]
    y = (x[:, 0] > 0.3) ^ (x[:, 3] > 0)
    data = table(spark, x, y)
    bins = B.quantile_bins(data, bins=64)
    assert bins.exact == (False, False, False, True) and max(map(len, bins.values)) <= 64
    one = B.train_forest_all_rows(data, "id", trees=15, seed=2, bins=bins, local_rows=500)
    two = B.train_forest_all_rows(data.repartition(9), "id", trees=15, seed=2, bins=bins, local_rows=10**9)
    assert [nested(t) for t in one.trees] == [nested(t) for t in two.trees]
    fresh = np.c_[rng.normal(size=(4000, 3)), rng.integers(0, 2, 4000)]
    assert np.mean((one.decide(fresh) > 0) == ((fresh[:, 0] > 0.3) ^ (fresh[:, 3] > 0))) > 0.95
    assert one.oob_error < 0.1


def test_forests_refuse_what_they_cannot_learn(spark):
    x, y = made(50, 3, 5)
    with pytest.raises(ValueError, match="two classes"):
        B.train_forest_all_rows(table(spark, x, np.ones(50)), "id", trees=2)
    with pytest.raises(ValueError, match="two classes"):
        B.train_forest_all_rows(table(spark, x, y).limit(0), "id", trees=2)
    rare = B.train_forest_all_rows(table(spark, x, np.arange(50) == 7), "id", trees=6)  # samples without the rare row are leaves
    assert min(len(t.feature) for t in rare.trees) == 1 and len(rare.trees) == 6
    x[3, 1] = np.nan
    with pytest.raises(Exception, match="must be numbers"):
        B.train_forest_all_rows(table(spark, x, y), "id", trees=2)


def test_draws_are_those_of_a_poisson_number():
    n = B.times_drawn(np.arange(200_000, dtype=np.int64) * 7919, mixed(1, 2))
    assert abs(n.mean() - 1) < 0.01 and abs((n == 0).mean() - np.exp(-1)) < 0.005 and abs(n.var() - 1) < 0.02


@pytest.mark.parametrize("shift", [0.0, 1e8])
def test_moments_far_from_zero(spark, shift):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 5)) @ rng.normal(size=(5, 5)) + shift
    y = rng.random(3000) < 0.3
    rows = table(spark, x, y, 7)
    found = class_moments(rows.unionByName(rows.limit(1).withColumn("flag", F.lit(None).cast("boolean"))))
    for flag in (True, False):
        own = x[y == flag]
        rest = own - own.mean(axis=0)
        assert found[flag].n == len(own)
        np.testing.assert_allclose(found[flag].mean, own.mean(axis=0), rtol=1e-12, atol=1e-9)
        np.testing.assert_allclose(found[flag].products, rest.T @ rest, rtol=1e-6, atol=1e-3 if shift else 1e-8)
    if not shift:
        a, b = train_lda_all_rows(rows), train_lda(x, y)
        np.testing.assert_allclose(a.weights, b.weights, rtol=1e-7)
        assert a.bias == pytest.approx(b.bias)
    with pytest.raises(ValueError):
        train_lda_all_rows(rows.where("flag"))
    assert class_moments(rows.limit(0)) == {}


def test_states_merge_in_any_grouping():
    x = np.random.default_rng(2).normal(size=(40, 3)) * 1e3
    parts = [Moments.of(x[i : i + 10]) for i in range(0, 40, 10)]
    left, right = (parts[0] + parts[1]) + (parts[2] + parts[3]), parts[0] + (parts[1] + (parts[2] + parts[3]))
    np.testing.assert_allclose(left.products, right.products, rtol=1e-12)
    np.testing.assert_allclose(left.products, Moments.of(x).products, rtol=1e-12)


def test_mixed_perceptron_ends_without_a_mistake(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(2000, 4))
    side = x @ [1.0, -2.0, 0.5, 1.5] + 0.4
    x, y = x[np.abs(side) > 0.3], side[np.abs(side) > 0.3] > 0
    rows = table(spark, x, y, 5)
    machine = train_perceptron_all_rows(rows, "id", rounds=200)
    assert np.mean((machine.decide(x) > 0) == y) > 0.99
    again = train_perceptron_all_rows(rows.repartition(3), "id", rounds=200)
    np.testing.assert_allclose(machine.weights, again.weights)
    with pytest.raises(ValueError):
        train_perceptron_all_rows(rows.limit(0), "id")
