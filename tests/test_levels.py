"""Trees grown a level at a time are those grown a node at a time."""

from __future__ import annotations

import time

import numpy as np
import pytest

from strandline.models.forest import grow, grow_levels


def _rows(n: int, features: int, bins: int):
    rng = np.random.default_rng(n)
    values = tuple(np.sort(rng.normal(size=bins)) for _ in range(features))
    codes = rng.integers(0, bins, (n, features)).astype(np.uint8)
    return codes, values, rng.random(n) < 0.3 + 0.4 * (codes[:, 0] > bins // 2), rng.poisson(1, n)


@pytest.mark.parametrize("n, features, bins, depth, min_node", [(400, 9, 200, 0, 10), (400, 4, 3, 0, 1), (300, 16, 50, 3, 10), (5, 4, 4, 0, 10), (300, 1, 1, 0, 10)])
def test_levels_and_nodes(n, features, bins, depth, min_node):
    codes, values, y, times = _rows(n, features, bins)
    x = np.stack([v[codes[:, j]] for j, v in enumerate(values)], axis=1)
    want, _ = grow(x, y, None, depth, min_node, np.repeat(np.arange(n), times), 77)
    found = grow_levels(codes, values, y, times, depth, min_node, 77)
    for name in ("feature", "split", "left", "right", "share"):
        assert np.array_equal(getattr(want, name), getattr(found, name)), name


def test_levels_are_faster_than_nodes():
    codes, values, y, times = _rows(20_000, 64, 256)
    x = np.stack([v[codes[:, j]] for j, v in enumerate(values)], axis=1)
    at = time.process_time()
    grow(x, y, None, 0, 10, np.repeat(np.arange(len(y)), times), 5)
    by_node = time.process_time() - at
    grow_levels(codes, values, y, times, 0, 10, 5)
    by_level = time.process_time() - at - by_node
    print(by_node, by_level)
    assert by_level < by_node


def test_driver_gets_little_of_a_tree(spark):
    from strandline.models import forest

    codes, values, y, _ = _rows(3000, 16, 256)
    x = np.stack([v[codes[:, j]] for j, v in enumerate(values)], axis=1)
    tree, unseen = forest.grow(x, y, np.random.default_rng([0, 0]))
    assert 3 * len(forest.packed(tree)) < tree.feature.nbytes * 5 + unseen.nbytes
    one, many = forest.train_forest(x, y, 8), forest.train_forest_distributed(spark, x, y, 8)
    assert one.oob_error == many.oob_error
    assert all(np.array_equal(a.split, b.split) for a, b in zip(one.trees, many.trees))
