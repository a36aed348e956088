"""Rows go down all trees of a forest at the same time."""

import pickle

import numpy as np

from strandline.models import forest


def test_shares_are_the_mean_of_the_trees(monkeypatch):
    """To the last bit, whatever is followed at once and where a feature is NaN, without a pass for each tree; the table that
    serves it isn't sent along."""
    rng = np.random.default_rng(3)
    x = rng.random((400, 5)).round(2)
    one_leaf = forest.Tree(*(np.array([v]) for v in (-1, 0.0, -1, -1, 0.25)))
    grown = [forest.grow(x, x[:, 0] + rng.random(400) > 1, np.random.default_rng(i))[0] for i in range(7)]
    model = forest.Forest((one_leaf, *grown))
    x[3, 0] = np.nan
    sent, wanted = len(pickle.dumps(model)), np.mean([t.predict(x) for t in model.trees], axis=0)
    monkeypatch.setattr(forest.Tree, "predict", None)
    for paths in (1, 100, 1 << 16):
        monkeypatch.setattr(forest, "PATHS", paths)
        assert np.array_equal(model.positive_share(x), wanted)
    assert len(model.positive_share(x[:0])) == 0 and len(pickle.dumps(model)) == sent
