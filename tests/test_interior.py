"""Linear machines of many rows: solved in their weights, to the optimum of the solver by pairs."""

from __future__ import annotations

import time

import numpy as np
import pytest

from strandline.config import SvmType
from strandline.models import svm


def _rows(n: int, features: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(0)
    x = rng.normal(size=(n, features))
    x[:, 0] = np.round(x[:, 0])
    return x, np.where(0.7 * x[:, 1] + 0.5 * rng.normal(size=n) > 0.3, 1.0, -1.0)


def _objective(machine: svm.Svm, x: np.ndarray, y: np.ndarray, svm_type: SvmType, p: float) -> float:
    w, f = machine.coefficients @ machine.support, machine.decide(x)
    loss = np.maximum(0, 1 - y * f) if svm_type is SvmType.C_SVC else np.maximum(0, np.abs(y - f) - p)
    return 0.5 * w @ w + loss.sum()


@pytest.mark.parametrize("svm_type, p", [(SvmType.C_SVC, 0.0), (SvmType.EPSILON_SVR, 0.1), (SvmType.EPSILON_SVR, 0.995)])
def test_weights_are_those_of_pairs(svm_type, p, monkeypatch):
    x, y = _rows(600, 6)
    by_pairs = svm.train_svm(x, y, svm_type, p=p)
    monkeypatch.setattr(svm, "INTERIOR_ROWS", 0)
    monkeypatch.setattr(svm, "minimize", None)
    found = svm.train_svm(x, y, svm_type, p=p)
    assert _objective(found, x, y, svm_type, p) <= _objective(by_pairs, x, y, svm_type, p) + 1e-4
    assert np.abs(found.decide(x) - by_pairs.decide(x)).max() < 1e-2


def test_many_rows_take_seconds():
    x, y = _rows(20_000, 16)
    before = time.process_time()
    machine = svm.train_svm(x, y, SvmType.EPSILON_SVR)
    assert time.process_time() - before < 60
    assert len(machine.support)


@pytest.mark.parametrize("y", [np.ones(50), np.r_[np.ones(49), -1.0]])
def test_one_class_and_constant_features(y, monkeypatch):
    x = np.zeros((50, 3))
    x[:, 0] = np.arange(50)
    for svm_type in (SvmType.C_SVC, SvmType.EPSILON_SVR):
        by_pairs = svm.train_svm(x, y, svm_type, p=0.1)
        monkeypatch.setattr(svm, "INTERIOR_ROWS", 0)
        found = svm.train_svm(x, y, svm_type, p=0.1)
        monkeypatch.undo()
        assert _objective(found, x, y, svm_type, 0.1) <= _objective(by_pairs, x, y, svm_type, 0.1) + 1e-3
