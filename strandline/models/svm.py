"""Support vector machines on NumPy, trained by sequential minimal optimization.

Training sets are the occurrences of one motif or the windows of a training set, at most Settings.training_rows vectors,
which fit a task (models.whole trains on more): rows of the kernel are made when they are asked for, and CACHE bytes of them are kept. Scoring is a
vectorized function over Arrow batches.
"""

from __future__ import annotations

from collections import OrderedDict
from dataclasses import dataclass
from functools import cached_property
from itertools import combinations

import numpy as np

from strandline.config import Kernel, SvmType

TOLERANCE = 1e-3
TAU = 1e-12
#: Bytes of kernel rows that a training holds.
CACHE = 1 << 28
#: Rows and columns of a kernel that are held at once where it is only multiplied.
TILE = 512
#: Of how many variables a row is kept where shrinking begins to pay.
SPARSE = 4
#: Rows from which a linear machine is solved in its weights, and steps of that at most (some 30 are usual).
INTERIOR_ROWS, INTERIOR_STEPS = 2000, 200


@dataclass(frozen=True)
class Scaler:
    """Each feature to [-1, 1] by its range in training; constant ones to 0, and no clipping later."""

    low: np.ndarray
    high: np.ndarray

    @staticmethod
    def fit(x: np.ndarray) -> Scaler:
        return Scaler(x.min(axis=0), x.max(axis=0))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        span = self.high - self.low
        return np.where(span > 0, (x - self.low - span / 2) * 2 / np.where(span > 0, span, 1), 0.0)


def kernel_matrix(a: np.ndarray, b: np.ndarray, kernel: Kernel, gamma: float, c0: float) -> np.ndarray:
    if kernel is Kernel.RBF:
        return np.exp(-gamma * np.maximum(0, (a**2).sum(1)[:, None] + (b**2).sum(1) - 2 * a @ b.T))
    dot = a @ b.T
    return dot if kernel is Kernel.LINEAR else (gamma * dot + c0) ** (2 if kernel is Kernel.QUADRATIC else 3)


def kernel_times(a: np.ndarray, b: np.ndarray, weights: np.ndarray, kernel: Kernel, gamma: float, c0: float) -> np.ndarray:
    """The kernel of a with b, times weights; a tile of it at a time, worked out in place."""
    out = np.zeros(len(a))
    if kernel is Kernel.LINEAR:
        return a @ (weights @ b)
    if kernel is Kernel.RBF:  # one product gives -gamma |a - b|^2
        a = np.c_[2 * gamma * a, -gamma * (a**2).sum(axis=1), np.ones(len(a))]
        b = np.c_[b, np.ones(len(b)), -gamma * (b**2).sum(axis=1)]
    else:
        a = gamma * a
    for i in range(0, len(a), TILE):
        for j in range(0, len(b), TILE):
            tile = a[i : i + TILE] @ b[j : j + TILE].T
            if kernel is Kernel.RBF:
                np.exp(np.minimum(tile, 0.0, out=tile), out=tile)
            else:
                tile += c0
                np.power(tile, 3, out=tile) if kernel is Kernel.CUBIC else np.square(tile, out=tile)
            out[i : i + TILE] += tile @ weights[j : j + TILE]
    return out


class KernelRows:
    """Rows of the kernel of z with its own rows `columns` (all at first), the last used ones kept; entries counts what was
    worked out."""

    def __init__(self, z: np.ndarray, kernel: Kernel, gamma: float, c0: float, cache: int = CACHE):
        self.z, self.options, self.cache = z, (kernel, gamma, c0), cache
        self.kept: OrderedDict[int, np.ndarray] = OrderedDict()
        self.entries = 0
        self.columns, self.part = np.arange(len(z)), z

    def over(self, columns: np.ndarray) -> None:
        """Rows are over these columns from now on; kept rows lose the others, or go if there are new ones."""
        place = np.searchsorted(self.columns, columns)
        if len(columns) <= len(self.columns) and np.array_equal(self.columns[np.minimum(place, len(self.columns) - 1)], columns):
            self.kept = OrderedDict((i, row[place]) for i, row in self.kept.items())
        else:
            self.kept.clear()
        self.columns, self.part = columns, self.z[columns]

    def __getitem__(self, i: int) -> np.ndarray:
        if i in self.kept:
            self.kept.move_to_end(i)
        else:
            self.kept[i] = self.row(i, self.part)
            if len(self.kept) > self.most:
                self.kept.popitem(last=False)
        return self.kept[i]

    @property
    def most(self) -> int:
        """Rows that are kept; more of them as they get shorter."""
        return max(2, self.cache // (8 * max(1, len(self.columns))))

    def row(self, i: int, part: np.ndarray) -> np.ndarray:
        """A row with any vectors, not kept."""
        self.entries += len(part)
        return kernel_matrix(self.z[i : i + 1], part, *self.options)[0]

    def times(self, a: np.ndarray, b: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """The kernel of a with b, times weights."""
        self.entries += len(a) * len(b)
        return kernel_times(a, b, weights, *self.options)

    def diagonal(self) -> np.ndarray:
        kernel, gamma, c0 = self.options
        if kernel is Kernel.RBF:
            return np.ones(len(self.z))
        dot = (self.z**2).sum(axis=1)
        return dot if kernel is Kernel.LINEAR else (gamma * dot + c0) ** (2 if kernel is Kernel.QUADRATIC else 3)


class Signed:
    """Q of a problem whose variable i is vector at[i] with sign[i]: sign_i sign_j K(at_i, at_j), over the active variables."""

    def __init__(self, k: KernelRows, sign: np.ndarray, at: np.ndarray):
        self.k, self.sign, self.at = k, sign, at
        self.diagonal = k.diagonal()[at]
        self.activate(np.arange(len(at)))

    def activate(self, active: np.ndarray) -> None:
        self.active = active
        vectors, self.inside = np.unique(self.at[active], return_inverse=True)
        self.k.over(vectors)

    def row(self, i: int) -> np.ndarray:
        return self.sign[i] * self.sign[self.active] * self.k[self.at[i]][self.inside]

    def products(self, alpha: np.ndarray, others: np.ndarray, block: int = 1024) -> np.ndarray:
        """Q alpha at other variables, by blocks of the kernel of them with the support."""
        support = np.flatnonzero(alpha)
        weights, z = (alpha * self.sign)[support], self.k.z[self.at[support]]
        out = np.zeros(len(others))
        for i in range(0, len(others), block):
            part = others[i : i + block]
            out[i : i + block] = self.sign[part] * self.k.times(self.k.z[self.at[part]], z, weights)
        return out


def shrinkable(value: np.ndarray, up: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Variables at a bound that no pair would move from it: they can only go up and lie below all that can go down, or the
    other way round."""
    if not up.any() or not low.any():
        return np.zeros(len(value), bool)
    return (low & ~up & (value > value[up].max())) | (up & ~low & (value < value[low].min()))


def minimize(q: Signed, linear: np.ndarray, y: np.ndarray, upper: np.ndarray, alpha: np.ndarray, by_label: bool = False, tolerance: float = TOLERANCE, rounds: int = 10_000_000, shrink: bool = True) -> tuple[np.ndarray, float, float]:
    """(alpha, rho, r) of min 1/2 a'Qa + linear'a with y'a kept and 0 <= a <= upper, by pairs of largest gain.

    by_label keeps the sums of both labels (nu forms); r is then their common offset. With shrink, variables that seem
    settled at a bound leave the active ones now and then, so that rows get shorter; when the active ones are done, the
    gradient of the others is made again from the support, in blocks, and all are active once more, until none is violated.
    That pays where few of the rows are kept, so it waits for SPARSE times as many variables as rows that are kept."""
    alpha = alpha.astype(np.float64).copy()
    gradient = linear.astype(np.float64).copy()
    for i in np.flatnonzero(alpha):
        gradient += alpha[i] * q.row(int(i))
    every = np.arange(len(y))
    active, positive = every, y > 0
    shrink = shrink and len(y) > SPARSE * q.k.most
    period = min(len(y), 1000)
    wait = period

    def reactivate() -> None:
        nonlocal active
        others = np.setdiff1d(every, active, assume_unique=True)
        gradient[others] = linear[others] + q.products(alpha, others)
        active = every
        q.activate(active)

    for _ in range(rounds):
        a, up_to, ya, pos = alpha[active], upper[active], y[active], positive[active]
        up = np.where(pos, a < up_to, a > 0)
        low = np.where(pos, a > 0, a < up_to)
        value = -ya * gradient[active]
        groups = (pos, ~pos) if by_label else (np.ones(len(active), bool),)
        wait -= 1
        if shrink and not wait:
            wait = period
            gone = np.zeros(len(active), bool)
            for g in groups:
                gone |= g & shrinkable(value, up & g, low & g)
            if gone.any() and not gone.all():
                active = active[~gone]
                q.activate(active)
                continue
        best = None
        for group in groups:
            can_up, can_low = up & group, low & group
            if not can_up.any() or not can_low.any():
                continue
            i = int(np.flatnonzero(can_up)[np.argmax(value[can_up])])
            if value[i] - value[can_low].min() < tolerance:
                continue
            row = q.row(int(active[i]))
            gain = value[i] - value
            curve = np.maximum(q.diagonal[active[i]] + q.diagonal[active] - 2 * ya[i] * ya * row, TAU)
            drop = np.where(can_low & (gain > 0), gain * gain / curve, -1.0)
            j = int(np.argmax(drop))
            if best is None or drop[j] > best[0]:
                best = (drop[j], i, j, row, gain[j] / curve[j])
        if best is None:
            if len(active) == len(every):
                break
            reactivate()
            wait = period
            continue
        _, i, j, row, step = best
        most_i = up_to[i] - a[i] if ya[i] > 0 else a[i]
        most_j = a[j] if ya[j] > 0 else up_to[j] - a[j]
        step = min(step, most_i, most_j)
        di, dj = ya[i] * step, -ya[j] * step
        alpha[active[i]] = min(max(a[i] + di, 0.0), up_to[i])
        alpha[active[j]] = min(max(a[j] + dj, 0.0), up_to[j])
        gradient[active] += di * row + dj * q.row(int(active[j]))
    if len(active) < len(every):
        reactivate()

    if by_label:
        r1, r2 = (offset(alpha, gradient, y, upper, part, True) for part in (positive, ~positive))
        return alpha, (r1 - r2) / 2, (r1 + r2) / 2
    return alpha, offset(alpha, gradient, y, upper, np.ones(len(y), bool)), 0.0


def offset(alpha: np.ndarray, gradient: np.ndarray, y: np.ndarray, upper: np.ndarray, part: np.ndarray, by_label: bool = False) -> float:
    """rho of a solution: the mean over free variables of a part, or the middle of what those at bounds allow."""
    g = (y * gradient)[part] if not by_label else gradient[part]
    free = (alpha > 0) & (alpha < upper)
    if free[part].any():
        return float(g[free[part]].mean())
    at_upper, yp = (alpha >= upper)[part], y[part]
    lowest = g[at_upper == (yp < 0)] if not by_label else g[~at_upper]
    highest = g[at_upper == (yp > 0)] if not by_label else g[at_upper]
    ends = [x for x in (lowest.min() if len(lowest) else None, highest.max() if len(highest) else None) if x is not None]
    return float(sum(ends) / max(1, len(ends)))


def violation(alpha: np.ndarray, gradient: np.ndarray, y: np.ndarray, upper: np.ndarray) -> float:
    """What the pair that violates optimality most violates it by; minimize() ends below its tolerance."""
    value = -y * gradient
    up, low = np.where(y > 0, alpha < upper, alpha > 0), np.where(y > 0, alpha > 0, alpha < upper)
    return float(value[up].max() - value[low].min()) if up.any() and low.any() else 0.0


@np.errstate(divide="ignore", invalid="ignore", over="ignore")  # what isn't finite ends it
def minimize_linear(z: np.ndarray, at: np.ndarray, sign: np.ndarray, linear: np.ndarray, cost: float, tolerance: float = TOLERANCE) -> tuple[np.ndarray, float] | None:
    """(alpha, rho) of minimize()'s problem for a linear kernel, variable i being vector at[i] of z with sign[i], all of them
    bounded by cost; None if minimize()'s own measure of optimality is not reached.

    A primal-dual interior point method (predictor and corrector): each step solves for the weights and rho alone, a system
    as wide as the features, after one pass over the rows, and the number of steps hardly grows with the rows. What ends
    nearer to a bound than to a multiplier of zero is set to it."""
    n, d = len(at), z.shape[1]

    def spread(v: np.ndarray) -> np.ndarray:
        return np.bincount(at, v, len(z))

    def up_to_end(v: np.ndarray, dv: np.ndarray) -> float:
        falls = dv < 0
        return min(1.0, float((v[falls] / -dv[falls]).min())) if falls.any() else 1.0

    a = np.full(n, cost / 2)
    a *= np.where(sign > 0, min(1.0, (sign < 0).sum() / max(1, (sign > 0).sum())), min(1.0, (sign > 0).sum() / max(1, (sign < 0).sum())))
    w, rho = z.T @ spread(sign * a), 0.0
    size = 1.0 + float(np.abs(linear).max())
    u, v = np.full(n, size), np.full(n, size)
    for _ in range(INTERIOR_STEPS):
        room = np.maximum(cost - a, 1e-300)
        off = sign * (z @ w)[at] + linear - rho * sign - u + v
        off_w, off_s = w - z.T @ spread(sign * a), float(sign @ a)
        mu = float(u @ a + v @ room) / (2 * n)
        if mu < 1e-15 * size * cost and max(np.abs(off).max(), np.abs(off_w).max(), abs(off_s)) < 1e-7 * size:
            break
        inverse = 1.0 / (u / a + v / room)
        by_row = spread(inverse)
        system = np.empty((d + 1, d + 1))
        system[:d, :d] = (z * by_row[:, None]).T @ z + np.eye(d)
        system[:d, d] = system[d, :d] = -(z.T @ by_row)
        system[d, d] = by_row.sum()

        def step(cu: np.ndarray, cv: np.ndarray):
            """Newton's step with these products of multipliers and distances from the bounds left to lose."""
            r = off + cu / a - cv / room
            right = np.r_[-(z.T @ spread(sign * inverse * r)) - off_w, float((sign * inverse) @ r) - off_s]
            found = np.linalg.solve(system, right)
            dw, drho = found[:d], float(found[d])
            da = inverse * (-r - sign * (z @ dw)[at] + sign * drho)
            return dw, drho, da, (-cu - u * da) / a, (-cv + v * da) / room

        try:
            _, _, da, du, dv = step(u * a, v * room)
            reach, reach_dual = min(up_to_end(a, da), up_to_end(room, -da)), min(up_to_end(u, du), up_to_end(v, dv))
            ahead = float((u + reach_dual * du) @ (a + reach * da) + (v + reach_dual * dv) @ (room - reach * da)) / (2 * n)
            goal = mu * (ahead / mu) ** 3
            dw, drho, da, du, dv = step(u * a + du * da - goal, v * room - dv * da - goal)
        except np.linalg.LinAlgError:
            return None
        size_step = 0.995 * min(up_to_end(a, da), up_to_end(room, -da), up_to_end(u, du), up_to_end(v, dv))
        if not np.isfinite(size_step) or not np.isfinite(dw).all():
            return None
        a, w, rho, u, v = a + size_step * da, w + size_step * dw, rho + size_step * drho, u + size_step * du, v + size_step * dv
    upper = np.full(n, cost)
    low, high = a * size < u * cost, (cost - a) * size < v * cost
    a[low], a[high] = 0.0, cost
    free = (a > 0) & (a < cost)
    if free.any():
        a[free] = np.clip(a[free] - sign[free] * float(sign @ a) / free.sum(), 0.0, cost)
    gradient = sign * (z @ (z.T @ spread(sign * a)))[at] + linear
    if abs(float(sign @ a)) > 1e-6 * cost or violation(a, gradient, sign, upper) >= tolerance:
        return None
    return a, offset(a, gradient, sign, upper, np.ones(n, bool))


@dataclass(frozen=True)
class Svm:
    """Decision value: sum of coefficients times kernel to the support vectors, less rho. mass: the sum of the absolute
    coefficients of a support that was folded into fewer vectors."""

    scaler: Scaler
    support: np.ndarray
    coefficients: np.ndarray
    rho: float
    kernel: Kernel
    gamma: float
    c0: float
    mass: float | None = None

    def decide(self, x: np.ndarray) -> np.ndarray:
        if not len(self.support):
            return np.full(len(x), -self.rho)
        z = self.scaler(np.asarray(x, np.float64))
        if self.kernel is Kernel.LINEAR:
            return z @ self._folded[0] - self.rho
        if self.kernel is Kernel.QUADRATIC and len(self.support) > self.support.shape[1]:
            single, pairs = self._folded
            return ((z @ pairs) * z).sum(axis=1) + z @ single + self.c0**2 * self.coefficients.sum() - self.rho
        return kernel_times(z, self.support, self.coefficients, self.kernel, self.gamma, self.c0) - self.rho

    @cached_property
    def _folded(self) -> tuple[np.ndarray, np.ndarray | None]:
        """Weights of scaled features and of pairs of them, so that scoring doesn't grow with the support."""
        single = self.coefficients @ self.support
        if self.kernel is Kernel.LINEAR:
            return single, None
        return 2 * self.gamma * self.c0 * single, self.gamma**2 * (self.support.T * self.coefficients) @ self.support

    def linear_weights(self) -> tuple[np.ndarray, float]:
        """(weights, bias) of unscaled features of a linear machine."""
        if self.kernel is not Kernel.LINEAR:
            raise ValueError("only a linear machine has linear weights")
        w = self.coefficients @ self.support
        span = self.scaler.high - self.scaler.low
        factor = np.where(span > 0, 2 / np.where(span > 0, span, 1), 0.0)
        middle = self.scaler.low + span / 2
        return w * factor, -float((w * factor) @ middle) - self.rho

    def quadratic_weights(self) -> tuple[np.ndarray, np.ndarray, float]:
        """(pair weights, single weights, bias) of unscaled features of a quadratic machine; symmetric pairs."""
        if self.kernel is not Kernel.QUADRATIC:
            raise ValueError("only a quadratic machine has pair weights")
        span = self.scaler.high - self.scaler.low
        factor = np.where(span > 0, 2 / np.where(span > 0, span, 1), 0.0)
        middle = self.scaler.low + span / 2
        u = self.support * factor  # gamma * (u.x - u.middle) + c0, squared
        shift = self.c0 - self.gamma * (u @ middle)
        pairs = self.gamma**2 * np.einsum("i,ij,ik->jk", self.coefficients, u, u)
        single = 2 * self.gamma * (self.coefficients * shift) @ u
        return pairs, single, float(self.coefficients @ shift**2) - self.rho


def train_svm(x: np.ndarray, y: np.ndarray, svm_type: SvmType = SvmType.C_SVC, kernel: Kernel = Kernel.LINEAR, cost: float = 1.0, nu: float = 0.5, p: float = 0.995, c0: float = 0.0, gamma: float | None = None, shrink: bool = True) -> Svm:
    """x: samples by features; y: 1 or -1. gamma is 1 / features unless stated. One-class machines see positives alone."""
    return solved(x, y, svm_type, kernel, cost, nu, p, c0, gamma, shrink)[0]


def solved(x: np.ndarray, y: np.ndarray, svm_type: SvmType, kernel: Kernel, cost: float, nu: float, p: float, c0: float, gamma: float | None, shrink: bool = True, scaler: Scaler | None = None) -> tuple[Svm, np.ndarray]:
    """train_svm()'s machine and the places of its support vectors; features are scaled as given, or by their ranges."""
    x, y = np.asarray(x, np.float64), np.asarray(y, np.float64)
    gamma = 1.0 / x.shape[1] if gamma is None else gamma
    inner = scaler is None  # cascades, which give theirs, want as few support vectors as can be
    scaler = scaler or Scaler.fit(x)
    if svm_type is SvmType.ONE_CLASS:
        x, y = x[y > 0], y[y > 0]
    z, n = scaler(x), len(x)
    k = KernelRows(z, kernel, gamma, c0)
    one, own = np.ones(n), np.arange(n)
    interior = None
    if inner and kernel is Kernel.LINEAR and n >= INTERIOR_ROWS and n > 4 * x.shape[1]:
        if svm_type is SvmType.C_SVC:
            interior = minimize_linear(z, own, y, -one, cost)
        elif svm_type is SvmType.EPSILON_SVR:
            interior = minimize_linear(z, np.r_[own, own], np.r_[one, -one], np.r_[p - y, p + y], cost)
    if interior:
        a, rho = interior
        coefficients = a * y if svm_type is SvmType.C_SVC else a[:n] - a[n:]
    elif svm_type is SvmType.C_SVC:
        a, rho, _ = minimize(Signed(k, y, own), -one, y, np.full(n, cost), np.zeros(n), shrink=shrink)
        coefficients = a * y
    elif svm_type is SvmType.NU_SVC:
        start = np.zeros(n)
        for sign in (1, -1):
            left = nu * n / 2
            for i in np.flatnonzero(y == sign):
                start[i] = min(1.0, left)
                left -= start[i]
        a, rho, r = minimize(Signed(k, y, own), np.zeros(n), y, one, start, by_label=True, shrink=shrink)
        coefficients, rho = a * y / r, rho / r
    elif svm_type is SvmType.ONE_CLASS:
        start, left = np.zeros(n), nu * n
        for i in range(n):
            start[i] = min(1.0, left)
            left -= start[i]
        coefficients, rho, _ = minimize(Signed(k, one, own), np.zeros(n), one, one, start, shrink=shrink)
    else:  # regression: each sample twice, for errors over and under
        sign = np.r_[one, -one]
        q = Signed(k, sign, np.r_[own, own])
        if svm_type is SvmType.EPSILON_SVR:
            a, rho, _ = minimize(q, np.r_[p - y, p + y], sign, np.full(2 * n, cost), np.zeros(2 * n), shrink=shrink)
        else:
            start, left = np.zeros(n), cost * nu * n / 2
            for i in range(n):
                start[i] = min(cost, left)
                left -= start[i]
            a, rho, _ = minimize(q, np.r_[-y, y], sign, np.full(2 * n, cost), np.r_[start, start], by_label=True, shrink=shrink)
        coefficients = a[:n] - a[n:]
    used = np.flatnonzero(coefficients)
    return Svm(scaler, z[used], coefficients[used], rho, kernel, gamma, c0), used


@dataclass(frozen=True)
class Vote:
    """One machine per pair of classes; the first class by order of appearance wins among equal votes."""

    classes: tuple[float, ...]
    machines: tuple[Svm, ...]

    @staticmethod
    def train(x: np.ndarray, labels: np.ndarray, **options) -> Vote | None:
        classes = tuple(dict.fromkeys(labels.tolist()))
        machines = []
        for a, b in combinations(classes, 2):
            part = (labels == a) | (labels == b)
            machines.append(train_svm(x[part], np.where(labels[part] == a, 1.0, -1.0), **options))
        return Vote(classes, tuple(machines)) if classes else None

    @staticmethod
    def train_distributed(spark, x: np.ndarray, labels: np.ndarray, **options) -> Vote | None:
        """The same vote, a task a pair of classes; the training set is broadcast and must fit a task."""
        import pickle

        from strandline.session import ship_package

        classes = tuple(dict.fromkeys(labels.tolist()))
        pairs = list(combinations(classes, 2))
        if not pairs:
            return Vote(classes, ()) if classes else None
        ship_package(spark)
        data = spark.sparkContext.broadcast((x, labels, pairs, options))

        def one(i: int) -> tuple[int, bytes]:
            from strandline.models.svm import train_svm

            x, labels, pairs, options = data.value
            a, b = pairs[i]
            part = (labels == a) | (labels == b)
            return i, pickle.dumps(train_svm(x[part], np.where(labels[part] == a, 1.0, -1.0), **options))

        found = dict(spark.sparkContext.parallelize(range(len(pairs)), len(pairs)).map(one).collect())
        return Vote(classes, tuple(pickle.loads(found[i]) for i in range(len(pairs))))

    def choose(self, x: np.ndarray) -> np.ndarray:
        votes = np.zeros((len(x), len(self.classes)), np.int64)
        for (a, b), machine in zip(combinations(range(len(self.classes)), 2), self.machines):
            first = machine.decide(x) > 0
            votes[:, a] += first
            votes[:, b] += ~first
        return np.array(self.classes)[votes.argmax(axis=1)] if len(x) else np.zeros(0)
