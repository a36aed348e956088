"""Support vector machines of all rows of a table, which no machine holds.

Rows are dealt to chunks of bounded size, each a row of one table: scaled vectors and labels as bytes.

Linear machines are solved in their weights, by the interior point method of svm.minimize_linear(). A step solves a system
as wide as the features; what it needs are sums and minima over the rows. A row's own state follows from the steps so far,
which are few and short, so tasks go through them again instead of storing it.

Machines of other kernels are solved by working sets (Joachims, 1999). Each chunk is solved alone for a start, and the
gradient that this makes at all rows is worked out by blocks of the support. From then on each round takes the variables
that most violate optimality, some of each chunk and the worst pair of all, solves for them with the others held, and
brings the gradient of all rows up to date. It ends when no pair violates optimality by the tolerance of one machine's
solver. All pairs of rows meet, so work grows with their square, memory with chunks and blocks alone; the machine's support
is all that the driver holds of the rows, and that only of kernels which don't fold into features.

All groups (the pairs of a vote, the motifs of a model) are solved at the same time.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.config import Kernel, Settings, SvmType
from strandline.models.svm import INTERIOR_STEPS, TOLERANCE, KernelRows, Scaler, Signed, Svm, Vote, kernel_times, minimize
from strandline.session import Successive, materialize, ship_package

#: Samples of a chunk.
CHUNK = 2048
#: Variables of a working set.
WORKING = 1024
#: Samples of the support that are sent to all tasks at once.
SENT_ROWS = 1 << 14
#: At which complementarity, as a share of a problem's scale, the first look is taken at whether the optimum is reached.
EARLY = 1e-6
#: To which violation a chunk is solved alone.
ROUGH = 0.1

NU_KINDS = (SvmType.NU_SVC, SvmType.NU_SVR)
REGRESSION = (SvmType.EPSILON_SVR, SvmType.NU_SVR)


@dataclass
class Told:
    """A group: numbers of its samples by sign, the largest label, the ranges of its features, and how far it has come."""

    n: int
    positive: int
    negative: int
    largest: float
    low: np.ndarray
    high: np.ndarray
    first: np.ndarray | None = None
    path: list[tuple] = field(default_factory=list)
    missing: np.ndarray | None = None  # of the constraints' sums, once variables are set to their bounds
    free: np.ndarray | None = None  # how many variables of each constraint are not
    weights: np.ndarray | None = None

    def sums(self, s: Settings) -> np.ndarray:
        """What the variables of each constraint add up to."""
        if s.svm_type is SvmType.NU_SVC:
            return np.minimum(s.nu * self.n / 2, [self.positive, self.negative])
        if s.svm_type is SvmType.NU_SVR:
            return np.full(2, s.cost * s.nu * self.n / 2)
        return np.array([s.nu * self.n if s.svm_type is SvmType.ONE_CLASS else 0.0])

    def variables(self, s: Settings) -> np.ndarray:
        """How many variables have a positive and a negative sign."""
        if s.svm_type in REGRESSION:
            return np.array([self.n, self.n])
        return np.array([self.n, 0] if s.svm_type is SvmType.ONE_CLASS else [self.positive, self.negative])

    def even(self, s: Settings) -> np.ndarray:
        """By sign, the value of variables that all share the sum of their constraint."""
        return np.minimum(upper(s), np.broadcast_to(self.sums(s), 2) / np.maximum(1, self.variables(s)))


def upper(s: Settings) -> float:
    return 1.0 if s.svm_type in (SvmType.NU_SVC, SvmType.ONE_CLASS) else s.cost


def variables(y: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sign, linear term, sample) of the variables of samples; regression has two a sample."""
    one, own = np.ones(len(y)), np.arange(len(y))
    if s.svm_type in REGRESSION:
        p = s.p if s.svm_type is SvmType.EPSILON_SVR else 0.0
        return np.r_[one, -one], np.r_[p - y, p + y], np.r_[own, own]
    if s.svm_type is SvmType.C_SVC:
        return y, -one, own
    return (one if s.svm_type is SvmType.ONE_CLASS else y), 0 * one, own


def gamma_of(s: Settings, width: int) -> float:
    return 1.0 / width if s.gamma is None else s.gamma


def train_all_rows(samples: DataFrame, s: Settings, group: Sequence[str]) -> dict[tuple, Svm]:
    """Machines by group of samples (group, id, features, y: 1 or -1, or a number for regression), those of train_svm() on all
    samples of the group. C-SVC groups of one sign have a machine without support that decides for it."""
    spark, group = samples.sparkSession, list(group)
    ship_package(spark)
    rows = samples.select(*group, F.col("id"), "features", F.col("y").cast("double").alias("y"))
    told = _told(rows, group)
    out: dict[tuple, Svm] = {}
    for key, t in told.items():
        if s.svm_type is SvmType.C_SVC and not (t.positive and t.negative):
            empty = np.zeros((0, len(t.low)))
            out[key] = Svm(Scaler(t.low, t.high), empty, np.zeros(0), 1.0 if t.negative else -1.0, s.kernel, gamma_of(s, len(t.low)), s.c0)
    told = {k: t for k, t in told.items() if k not in out}
    if s.svm_type is SvmType.ONE_CLASS:
        rows = rows.where("y > 0")
        for t in told.values():
            t.n, t.negative = t.positive, 0
        told = {k: t for k, t in told.items() if t.n}
    if not told:
        return out
    chunks = _chunks(rows, told, group)
    open_ = dict(told)
    if s.kernel is Kernel.LINEAR:
        found = _interior(chunks, told, s, group)
        out |= found
        open_ = {k: t for k, t in told.items() if k not in found}
    if open_:
        out |= _decomposed(chunks, open_, s, group)
    return out


def train_votes(samples: DataFrame, s: Settings, group: Sequence[str], label: str, order: Sequence[str], id: str) -> dict[tuple, Vote]:
    """Votes by group of samples (group, label, id, features and the columns of order, which tells the classes' first rows): a
    machine of all rows for each pair of classes."""
    group = list(group)
    firsts = samples.groupBy(*group, F.col(label).cast("double").alias("c")).agg(F.min(F.struct(*order)).alias("first")).orderBy(*group, "first").collect()  # a row a group and class
    classes: dict[tuple, list[float]] = {}
    for r in firsts:
        classes.setdefault(tuple(r[x] for x in group), []).append(r["c"])
    table = [(*k, c, i, y) for k, cs in classes.items() for i, pair in enumerate(combinations(cs, 2)) for c, y in zip(pair, (1.0, -1.0))]
    found: dict[tuple, Svm] = {}
    if table:
        kinds = ", ".join(f"{x} {samples.schema[x].dataType.simpleString()}" for x in group)
        named = F.broadcast(samples.sparkSession.createDataFrame(table, ", ".join([*([kinds] if kinds else []), "c double, pair int, y double"])))
        each = samples.select(*group, F.col(label).cast("double").alias("c"), F.col(id).alias("id"), "features")
        found = train_all_rows(each.join(named, [*group, "c"]), s, [*group, "pair"])
    return {k: Vote(tuple(cs), tuple(found[*k, i] for i in range(len(cs) * (len(cs) - 1) // 2))) for k, cs in classes.items()}


def _told(rows: DataFrame, group: list[str]) -> dict[tuple, Told]:
    """A row a group, and one a group and feature."""
    counts = rows.groupBy(*group).agg(F.count("*").alias("n"), F.count_if(F.col("y") > 0).alias("positive"), F.max(F.abs("y")).alias("largest")).collect()
    each = rows.select(*group, F.posexplode("features").alias("i", "v")).groupBy(*group, "i").agg(F.min("v").alias("l"), F.max("v").alias("h")).collect()
    ends: dict[tuple, dict[int, tuple]] = {}
    for r in each:
        ends.setdefault(tuple(r[c] for c in group), {})[r["i"]] = (r["l"], r["h"])
    out = {}
    for r in counts:
        key = tuple(r[c] for c in group)
        low, high = (np.array([ends[key][i][side] for i in sorted(ends[key])], np.float64) for side in (0, 1))
        out[key] = Told(r["n"], r["positive"], r["n"] - r["positive"], r["largest"], low, high)
    return dict(sorted(out.items(), key=lambda x: str(x[0])))


def _names(rows: DataFrame, group: list[str]) -> str:
    return ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in group)


def _chunks(rows: DataFrame, told: dict[tuple, Told], group: list[str]) -> DataFrame:
    """group, chunk, zs, ys of each chunk, written; a task reads neighbouring chunks, so those of few groups."""
    spark = rows.sparkSession
    parts = spark.createDataFrame([(*k, -(-t.n // CHUNK)) for k, t in told.items()], f"{_names(rows, group)}, parts long")  # a row a group
    ranges = spark.sparkContext.broadcast({k: (t.low, t.high) for k, t in told.items()})
    dealt = rows.join(F.broadcast(parts), group).withColumn("chunk", F.pmod(F.xxhash64("id"), "parts"))

    def pack(key, df: pd.DataFrame) -> pd.DataFrame:
        from strandline.models.svm import Scaler

        df = df.sort_values("id")
        z = Scaler(*ranges.value[tuple(key[:-1])])(np.array(df["features"].tolist(), np.float64))
        return pd.DataFrame([[*key, z.tobytes(), df["y"].to_numpy(np.float64).tobytes()]], columns=[*group, "chunk", "zs", "ys"])

    packed = dealt.groupBy(*group, "chunk").applyInPandas(pack, f"{_names(rows, group)}, chunk long, zs binary, ys binary")
    return materialize(_ranged(packed, told, group), "chunks")


def _ranged(chunks: DataFrame, told: dict[tuple, Told], group: list[str]) -> DataFrame:
    total = sum(-(-t.n // CHUNK) for t in told.values())
    return chunks.repartitionByRange(max(1, min(total, 8 * chunks.sparkSession.sparkContext.defaultParallelism)), *group, "chunk")


def _vectors(data: bytes, width: int) -> np.ndarray:
    return np.frombuffer(data, np.float64).reshape(-1, width)


# ---- linear machines: in their weights ----


@np.errstate(divide="ignore", invalid="ignore", over="ignore")  # what isn't finite ends it
def _state(z: np.ndarray, y: np.ndarray, t: Told, s: Settings) -> dict:
    """The variables of a chunk after the steps so far. A step not yet taken has None as its corrector or its size."""
    sign, linear, at = variables(y, s)
    nu = s.svm_type in NU_KINDS
    factor = np.ones(len(sign)) if nu else sign
    place = (sign < 0).astype(np.int64) if nu else np.zeros(len(sign), np.int64)
    cost, size = upper(s), 1.0 + t.largest + s.p
    if s.svm_type in (*NU_KINDS, SvmType.ONE_CLASS):
        a = np.clip(t.even(s), 1e-3 * cost, (1 - 1e-3) * cost)[(sign < 0).astype(int)]
    else:
        have = np.maximum(1, t.variables(s))
        a = (cost / 2 * np.minimum(1.0, have[::-1] / have))[(sign < 0).astype(int)]
    u, v = np.full(len(a), size), np.full(len(a), size)
    out = {"sign": sign, "linear": linear, "at": at, "factor": factor, "place": place, "cost": cost, "size": size, "k": 2 if nu else 1}
    if t.first is None:
        return out | {"a": a}
    directions = z @ np.stack([t.first, *[d for step in t.path for d in (step[0], step[3]) if d is not None]], axis=1)
    zw, lam, i = directions[:, 0].copy(), np.zeros(out["k"]), 1
    for _, dlam, goal, dw, dlam2, length in [*t.path, (None,) * 6]:
        room = np.maximum(cost - a, 1e-300)
        off = sign * zw[at] + linear - factor * lam[place] - u + v
        inverse = 1.0 / (u / a + v / room)
        now = out | {"a": a, "u": u, "v": v, "room": room, "off": off, "inverse": inverse, "lam": lam}
        if dlam is None:
            return now
        da = inverse * (-(off + u - v) - sign * directions[at, i] + factor * dlam[place])
        du, dv = -u - u * da / a, -v + v * da / room
        i += 1
        now |= {"da": da, "du": du, "dv": dv}
        if dw is None:
            return now
        cu, cv = u * a + du * da - goal, v * room - dv * da - goal
        da = inverse * (-(off + cu / a - cv / room) - sign * directions[at, i] + factor * dlam2[place])
        du, dv = (-cu - u * da) / a, (-cv + v * da) / room
        if length is None:
            return now | {"da": da, "du": du, "dv": dv}
        a, u, v = a + length * da, u + length * du, v + length * dv
        zw, lam, i = zw + length * directions[:, i], lam + length * dlam2, i + 1
    raise AssertionError


def _by(place: np.ndarray, values: np.ndarray, k: int) -> np.ndarray:
    return np.bincount(place, values, k)


def _end(x: np.ndarray, dx: np.ndarray) -> float:
    falls = dx < 0
    return min(1.0, float((x[falls] / -dx[falls]).min())) if falls.any() else 1.0


def _sums_of(z: np.ndarray, y: np.ndarray, t: Told, s: Settings, what: str) -> tuple[list[np.ndarray], np.ndarray]:
    """(what is added up, what the least is taken of) of a chunk."""
    x = _state(z, y, t, s)
    sign, at, factor, place, k, a = x["sign"], x["at"], x["factor"], x["place"], x["k"], x["a"]

    def spread(values: np.ndarray) -> np.ndarray:
        return np.bincount(at, values, len(z))

    if what == "first":
        return [z.T @ spread(sign * a)], np.zeros(0)
    if what in ("rounded", "weights", "ends"):
        return _ending(z, x, s, t, what, spread)
    u, v, room, off, inverse = x["u"], x["v"], x["room"], x["off"], x["inverse"]
    if what == "system":
        by_row = spread(inverse)
        cross = np.stack([z.T @ spread(sign * factor * inverse * (place == i)) for i in range(k)], axis=1)
        r = off + u - v
        right = z.T @ spread(sign * inverse * r)
        sums = [(z * by_row[:, None]).T @ z, cross, _by(place, factor * factor * inverse, k), z.T @ spread(sign * a), _by(place, factor * a, k), np.array([u @ a + v @ room, 2.0 * len(a)]), right, _by(place, factor * inverse * r, k)]
        return sums, np.array([-np.abs(off).max()])
    da, du, dv = x["da"], x["du"], x["dv"]
    ends = np.array([min(_end(a, da), _end(room, -da)), min(_end(u, du), _end(v, dv))])
    if what == "corrected":
        return [], ends
    products = np.array([u @ a + v @ room, u @ da - v @ da, du @ a + dv @ room, du @ da - dv @ da])
    r0, r1 = off + (u * a + du * da) / a - (v * room - dv * da) / room, -1 / a + 1 / room  # the corrector's, and what the goal adds to it
    sums = [products]
    for r in (r0, r1):
        sums += [z.T @ spread(sign * inverse * r), _by(place, factor * inverse * r, k)]
    return sums, ends


def _ending(z: np.ndarray, x: dict, s: Settings, t: Told, what: str, spread) -> tuple[list[np.ndarray], np.ndarray]:
    """As svm.minimize_linear() ends: variables nearer to a bound than to a multiplier of zero are set to it, the free ones
    make up for it; then the weights, then what offsets and violations follow from."""
    a, sign, place, k, cost, size = x["a"].copy(), x["sign"], x["place"], x["k"], x["cost"], x["size"]
    low, high = a * size < x["u"] * cost, (cost - a) * size < x["v"] * cost
    a[low], a[high] = 0.0, cost
    free = (a > 0) & (a < cost)
    if what == "rounded":
        return [_by(place, x["factor"] * a, k), _by(place, free.astype(float), k)], np.zeros(0)
    a[free] = np.clip(a[free] - (x["factor"] * (t.missing / np.maximum(1, t.free))[place])[free], 0.0, cost)
    if what == "weights":
        return [z.T @ spread(sign * a), np.array([a.sum()]), _by(place, x["factor"] * a, k)], np.zeros(0)
    return ends_of(a, sign * (z @ t.weights)[x["at"]] + x["linear"], sign, cost, s)


def ends_of(a: np.ndarray, gradient: np.ndarray, sign: np.ndarray, cost: float, s: Settings) -> tuple[list[np.ndarray], np.ndarray]:
    """By label where its sums are kept, else for all: (number and sum of the free variables' offsets; least and, negated,
    greatest offset that variables at bounds allow, and the same of what can go up and down)."""
    nu, sums, least = s.svm_type in NU_KINDS, [], []
    for part in (sign > 0, sign < 0) if nu else (np.ones(len(sign), bool),):
        own, g, y = a[part], gradient[part], sign[part]
        plain = g if nu else y * g
        free, at_upper = (own > 0) & (own < cost), own >= cost
        sums.append(np.array([free.sum(), plain[free].sum()]))
        lowest = plain[~at_upper if nu else at_upper == (y < 0)]
        highest = plain[at_upper if nu else at_upper == (y > 0)]
        up, down = np.where(y > 0, own < cost, own > 0), np.where(y > 0, own > 0, own < cost)
        for values in (lowest, -highest, y[up] * g[up], -y[down] * g[down]):
            least.append(values.min() if len(values) else np.inf)
    return sums, np.array(least)


def offsets(sums: list[np.ndarray], least: np.ndarray) -> tuple[float, float, float]:
    """(rho, r, violation) from ends_of() of all."""
    rho, violation = [], 0.0
    for i, (n, total) in enumerate(sums):
        low, high, up, down = least[4 * i : 4 * i + 4]
        ends = [x for x in (low, -high) if np.isfinite(x)]
        rho.append(total / n if n else float(sum(ends) / max(1, len(ends))))
        if np.isfinite(up) and np.isfinite(down):
            violation = max(violation, -up - down)
    return (rho[0], 0.0, violation) if len(rho) == 1 else ((rho[0] - rho[1]) / 2, (rho[0] + rho[1]) / 2, violation)


def _summed(chunks: DataFrame, told: dict[tuple, Told], s: Settings, group: list[str], what: str) -> dict[tuple, tuple[list[np.ndarray], np.ndarray]]:
    """_sums_of() of all chunks by group: a task sends a row a group."""
    shared = chunks.sparkSession.sparkContext.broadcast(told)

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from strandline.models.whole import _added, _sums_of, _vectors

        held: dict[tuple, tuple] = {}
        for df in frames:
            for row in df.itertuples(index=False):
                key = tuple(row[: len(group)])
                if key in shared.value:
                    t = shared.value[key]
                    found = _sums_of(_vectors(row.zs, len(t.low)), np.frombuffer(row.ys), t, s, what)
                    held[key] = _added(held[key], found) if key in held else found
        yield pd.DataFrame({"key": [pickle.dumps(k) for k in held], "sums": [pickle.dumps(v) for v in held.values()]})

    out: dict[tuple, tuple] = {}
    for r in chunks.mapInPandas(work, "key binary, sums binary").collect():
        key, found = pickle.loads(r["key"]), pickle.loads(r["sums"])
        out[key] = _added(out[key], found) if key in out else found
    shared.destroy()
    return out


def _added(a: tuple, b: tuple) -> tuple:
    return [x + y for x, y in zip(a[0], b[0])], np.minimum(a[1], b[1])


def _interior(chunks: DataFrame, told: dict[tuple, Told], s: Settings, group: list[str]) -> dict[tuple, Svm]:
    """Machines of the groups whose optimum was reached, by the measure of the solver by pairs."""
    for k, (sums, _) in _summed(chunks, told, s, group, "first").items():
        told[k].first = sums[0]
    open_, out = dict(told), {}
    weights, wait = {k: t.first for k, t in told.items()}, {k: EARLY * (1.0 + t.largest + s.p) * upper(s) for k, t in told.items()}
    for _ in range(INTERIOR_STEPS):
        if not open_:
            break
        systems, mu, near = {}, {}, {}
        for k, (sums, least) in _summed(chunks, open_, s, group, "system").items():
            inner, cross, own, za, fa, (gap, many), right, right_s = sums
            t, width = open_[k], len(za)
            off_w, off_s = weights[k] - za, fa - t.sums(s)
            mu[k] = gap / many
            if mu[k] < wait[k]:
                near[k], wait[k] = t, mu[k] / 10
            m = np.block([[inner + np.eye(width), -cross], [-cross.T, np.diag(np.where(own > 0, own, 1.0))]])
            systems[k] = (m, off_w, off_s, right, right_s)
        out |= _ended(chunks, near, s, group)
        for k in list(open_):
            if k in out or wait[k] < 1e-16 or not _stepped(open_[k], systems[k][:3], *systems[k][3:], None):
                del open_[k]
        if not open_:
            break
        for k, (sums, ends) in _summed(chunks, open_, s, group, "affine").items():
            products, b0, s0, b1, s1 = sums
            ahead = float(products @ [1.0, ends[0], ends[1], ends[0] * ends[1]]) / (products[0] / mu[k])
            goal = mu[k] * (max(0.0, ahead) / mu[k]) ** 3
            if not _stepped(open_[k], systems[k][:3], b0 + goal * b1, s0 + goal * s1, goal):
                del open_[k]
        for k, (_, ends) in (_summed(chunks, open_, s, group, "corrected") if open_ else {}).items():
            t, length = open_[k], 0.995 * float(ends.min())
            if not np.isfinite(length) or length < 1e-12:
                del open_[k]
                continue
            t.path[-1] = (*t.path[-1][:5], length)
            weights[k] = weights[k] + length * t.path[-1][3]
    return out


def _stepped(t: Told, system: tuple, right: np.ndarray, right_s: np.ndarray, goal: float | None) -> bool:
    """Add the predictor, or its corrector, to a group's path; whether there is one."""
    m, off_w, off_s = system
    try:
        found = np.linalg.solve(m, np.r_[-right - off_w, right_s - off_s])
    except np.linalg.LinAlgError:
        return False
    dw, dlam = found[: len(right)], found[len(right) :]
    if goal is None:
        t.path.append((dw, dlam, None, None, None, None))
    else:
        t.path[-1] = (*t.path[-1][:2], goal, dw, dlam, None)
    return bool(np.isfinite(found).all())


def _ended(chunks: DataFrame, told: dict[tuple, Told], s: Settings, group: list[str]) -> dict[tuple, Svm]:
    out: dict[tuple, Svm] = {}
    if not told:
        return out
    for k, (sums, _) in _summed(chunks, told, s, group, "rounded").items():
        told[k].missing, told[k].free = sums[0] - told[k].sums(s), sums[1]
    mass = {}
    for k, (sums, _) in _summed(chunks, told, s, group, "weights").items():
        t = told[k]
        t.weights = sums[0]
        mass[k] = (float(sums[1][0]), bool(np.abs(sums[2] - t.sums(s)).max() <= 1e-6 * upper(s) * max(1.0, np.sqrt(t.n))))
    for k, (sums, least) in _summed(chunks, told, s, group, "ends").items():
        t = told[k]
        rho, r, violation = offsets(sums, least)
        if violation >= TOLERANCE or not mass[k][1]:
            continue
        by = r if s.svm_type is SvmType.NU_SVC else 1.0
        out[k] = Svm(Scaler(t.low, t.high), t.weights[None, :] / by, np.ones(1), rho / by, s.kernel, gamma_of(s, len(t.low)), s.c0, mass[k][0] / by)
    return out



# ---- other kernels: by working sets ----


def _decomposed(chunks: DataFrame, told: dict[tuple, Told], s: Settings, group: list[str]) -> dict[tuple, Svm]:
    spark, ddl = chunks.sparkSession, _names(chunks, group)
    state = Successive(spark, "machine-state")
    ddl = f"{ddl}, chunk long, zs binary, ys binary, alphas binary, gradients binary, worst binary"

    def over(df: DataFrame, sent: dict, starting: bool = False) -> DataFrame:
        """Chunks after what was sent, written; worst: what the next round may choose from."""
        shared = spark.sparkContext.broadcast((told, sent))

        def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            from strandline.models.whole import _chunk_after, _chunk_alone

            told, sent = shared.value
            for df in frames:
                out = []
                for row in df.itertuples(index=False):
                    key = tuple(row[: len(group)])
                    if key in told:
                        out.append([*key, row.chunk, row.zs, row.ys, *(_chunk_alone(row, told[key], s) if starting else _chunk_after(row, told[key], s, sent.get(key)))])
                if out:
                    yield pd.DataFrame(out, columns=[*group, "chunk", "zs", "ys", "alphas", "gradients", "worst"])

        out = state.put(df.mapInPandas(work, ddl))
        shared.destroy()
        return out

    now = over(chunks, {}, starting=True)
    sizes = {(*k, p): -(-t.n // max(1, -(-t.n // CHUNK))) for k, t in told.items() for p in range(-(-t.n // CHUNK))}
    run: list[tuple] = []
    each = list(sizes)
    while each:
        run, rows = [], 0
        while each and (not run or rows + sizes[each[0]] <= SENT_ROWS):
            rows += sizes[each[0]]
            run.append(each.pop(0))
        now = over(now, _support(now, run, told, s, group))
    open_ = dict(told)
    while open_:
        sent = {}
        for key, violation, change in _solved(now, open_, s, group):
            if violation < TOLERANCE:
                del open_[key]
            else:
                sent[key] = change
        if sent:
            now = over(now, sent)
    return _machines(now, told, s, group)


def _chunk_alone(row, t: Told, s: Settings) -> tuple[bytes, bytes, bytes | None]:
    """(alphas, gradients, worst) of a chunk that was solved by itself; gradients as if the variables were 0."""
    z, y = _vectors(row.zs, len(t.low)), np.frombuffer(row.ys)
    sign, linear, at = variables(y, s)
    a = np.zeros(len(sign)) if s.svm_type in (SvmType.C_SVC, SvmType.EPSILON_SVR) else t.even(s)[(sign < 0).astype(int)]
    q = Signed(KernelRows(z, s.kernel, gamma_of(s, len(t.low)), s.c0), sign, at)
    a, _, _ = minimize(q, linear, sign, np.full(len(a), upper(s)), a, s.svm_type in NU_KINDS, ROUGH, 8 * len(a))
    return a.tobytes(), linear.tobytes(), None


def _chunk_after(row, t: Told, s: Settings, sent: tuple | None) -> tuple[bytes, bytes, bytes | None]:
    """(alphas, gradients, worst) once others' support, or a working set's changes, have come in."""
    if sent is None:
        return row.alphas, row.gradients, row.worst
    support, weights, changed = sent
    z, y = _vectors(row.zs, len(t.low)), np.frombuffer(row.ys)
    sign, _, at = variables(y, s)
    a, g = np.frombuffer(row.alphas).copy(), np.frombuffer(row.gradients).copy()
    if len(support):
        g += sign * kernel_times(z, support, weights, s.kernel, gamma_of(s, len(t.low)), s.c0)[at]
    if row.chunk in changed:
        place, value = changed[row.chunk]
        a[place] = value
    return a.tobytes(), g.tobytes(), pickle.dumps(_worst(row.chunk, z, sign, at, a, g, t, s))


def _worst(part: int, z: np.ndarray, sign: np.ndarray, at: np.ndarray, a: np.ndarray, g: np.ndarray, t: Told, s: Settings) -> tuple:
    """Variables of a chunk that most violate optimality, at both ends, by label where its sums are kept."""
    value, cost, nu = -sign * g, upper(s), s.svm_type in NU_KINDS
    up, low = np.where(sign > 0, a < cost, a > 0), np.where(sign > 0, a > 0, a < cost)
    most = int(min(WORKING // 2, 8 + 2 * (WORKING // 2) // max(1, -(-t.n // CHUNK))))
    chosen = []
    for own in (sign > 0, sign < 0) if nu else (np.ones(len(a), bool),):
        for can, order in ((up & own, -value), (low & own, value)):
            i = np.flatnonzero(can)
            chosen.append(i[np.argpartition(order[i], most)[:most]] if len(i) > most else i)
    i = np.unique(np.concatenate(chosen))
    return np.full(len(i), part), i, z[at[i]], sign[i], a[i], g[i]


def _solved(now: DataFrame, told: dict[tuple, Told], s: Settings, group: list[str]) -> Iterator[tuple]:
    """(key, violation, change) of each group: a task a group solves for its working set."""
    shared = now.sparkSession.sparkContext.broadcast(told)

    def work(key, df: pd.DataFrame) -> pd.DataFrame:
        from strandline.models.whole import _working_set

        key = tuple(key)
        found = _working_set([pickle.loads(x) for x in df.sort_values("chunk")["worst"]], shared.value[key], s) if key in shared.value else None
        return pd.DataFrame({"key": [pickle.dumps(key)], "change": [pickle.dumps(found)]})

    rows = now.select(*group, "chunk", "worst").groupBy(*group).applyInPandas(work, "key binary, change binary").collect()
    shared.destroy()
    for r in rows:
        found = pickle.loads(r["change"])
        if found is not None:
            yield (pickle.loads(r["key"]), *found)


def _working_set(found: list[tuple], t: Told, s: Settings) -> tuple[float, tuple | None]:
    """The violation of the worst pair; and the working set solved with the others held: (samples, weights, by chunk the new
    values)."""
    part, place, z, sign, a, g = (np.concatenate(x) for x in zip(*found))
    value, cost, nu = -sign * g, upper(s), s.svm_type in NU_KINDS
    up, low = np.where(sign > 0, a < cost, a > 0), np.where(sign > 0, a > 0, a < cost)
    chosen, violation = [], 0.0
    labels = (sign > 0, sign < 0) if nu else (np.ones(len(a), bool),)
    for own in labels:
        can_up, can_low = np.flatnonzero(up & own), np.flatnonzero(low & own)
        if len(can_up) and len(can_low):
            violation = max(violation, float(value[can_up].max() - value[can_low].min()))
            chosen += [can_up[np.argsort(-value[can_up])][: WORKING // 2 // len(labels)], can_low[np.argsort(value[can_low])][: WORKING // 2 // len(labels)]]
    if violation < TOLERANCE:
        return violation, None
    w = np.unique(np.concatenate(chosen))
    z, sign, before, g = z[w], sign[w], a[w], g[w]
    gamma, own = gamma_of(s, len(t.low)), np.arange(len(w))
    linear = g - sign * kernel_times(z, z, before * sign, s.kernel, gamma, s.c0)
    q = Signed(KernelRows(z, s.kernel, gamma, s.c0), sign, own)
    after, _, _ = minimize(q, linear, sign, np.full(len(w), cost), before, nu, max(TOLERANCE / 2, ROUGH * violation), 8 * len(w), shrink=False)
    moved = after != before
    changed = {int(p): (place[w][part[w] == p], after[part[w] == p]) for p in np.unique(part[w])}
    return violation, (z[moved], ((after - before) * sign)[moved], changed)


def _support(now: DataFrame, run: list[tuple], told: dict[tuple, Told], s: Settings, group: list[str]) -> dict[tuple, tuple]:
    """What chunks give all others: their support and its weights."""
    wanted: dict[tuple, set[int]] = {}
    for *key, p in run:
        wanted.setdefault(tuple(key), set()).add(p)
    out: dict[tuple, list] = {}
    for key, part, z, weights in _weighed(now, {k: (told[k], parts) for k, parts in wanted.items()}, s, group):
        out.setdefault(key, []).append((part, z, weights))
    every = {k: sorted(v, key=lambda x: x[0]) for k, v in out.items()}
    return {k: (np.concatenate([z for _, z, _ in v]), np.concatenate([w for *_, w in v]), {}) for k, v in every.items()}


def _weighed(now: DataFrame, wanted: dict[tuple, tuple], s: Settings, group: list[str]) -> list[tuple]:
    """(key, part, support, weights) of chunks; wanted: a group's Told, and its chunks or None for all."""
    shared = now.sparkSession.sparkContext.broadcast(wanted)

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from strandline.models.whole import _vectors, variables

        for df in frames:
            out = []
            for row in df.itertuples(index=False):
                key = tuple(row[: len(group)])
                t, parts = shared.value.get(key, (None, ()))
                if t is None or (parts is not None and row.chunk not in parts):
                    continue
                z, y = _vectors(row.zs, len(t.low)), np.frombuffer(row.ys)
                sign, _, at = variables(y, s)
                weights = np.bincount(at, np.frombuffer(row.alphas) * sign, len(z))
                used = np.flatnonzero(weights)
                out.append((pickle.dumps(key), row.chunk, z[used].tobytes(), weights[used].tobytes()))
            yield pd.DataFrame(out, columns=["key", "part", "z", "weights"])

    rows = now.select(*group, "chunk", "zs", "ys", "alphas").mapInPandas(work, "key binary, part long, z binary, weights binary").collect()
    shared.destroy()
    keyed = [(pickle.loads(r["key"]), r["part"], r["z"], np.frombuffer(r["weights"])) for r in rows]
    return [(k, p, _vectors(z, len(wanted[k][0].low)), w) for k, p, z, w in keyed]


def _machines(now: DataFrame, told: dict[tuple, Told], s: Settings, group: list[str]) -> dict[tuple, Svm]:
    """Machines from what variables have come to. A quadratic kernel's support is folded into twice as many vectors as there
    are features, others' is gathered."""
    shared = now.sparkSession.sparkContext.broadcast(told)

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from strandline.models.whole import _vectors, ends_of, upper, variables

        for df in frames:
            out = []
            for row in df.itertuples(index=False):
                key = tuple(row[: len(group)])
                t, a, g = shared.value[key], np.frombuffer(row.alphas), np.frombuffer(row.gradients)
                z = _vectors(row.zs, len(t.low))
                sign, _, at = variables(np.frombuffer(row.ys), s)
                sums, least = ends_of(a, g, sign, upper(s), s)
                weights = np.bincount(at, a * sign, len(z))
                if s.kernel is Kernel.QUADRATIC:
                    sums += [(z * weights[:, None]).T @ z, z.T @ weights, np.array([weights.sum(), np.abs(weights).sum()])]
                out.append((pickle.dumps(key), row.chunk, pickle.dumps((sums, least))))
            yield pd.DataFrame(out, columns=["key", "part", "sums"])

    totals: dict[tuple, tuple] = {}
    for r in sorted(now.select(*group, "chunk", "zs", "ys", "alphas", "gradients").mapInPandas(work, "key binary, part long, sums binary").collect(), key=lambda r: r["part"]):
        key, found = pickle.loads(r["key"]), pickle.loads(r["sums"])
        totals[key] = _added(totals[key], found) if key in totals else found
    shared.destroy()
    gathered: dict[tuple, list] = {}
    if s.kernel is not Kernel.QUADRATIC:
        for key, part, z, weights in sorted(_weighed(now, {k: (t, None) for k, t in told.items()}, s, group), key=lambda x: x[1]):
            gathered.setdefault(key, []).append((z, weights))
    out: dict[tuple, Svm] = {}
    ends = 2 if s.svm_type in NU_KINDS else 1
    for key, t in told.items():
        sums, least = totals[key]
        rho, r, _ = offsets(sums[:ends], least)
        by, gamma = (r if s.svm_type is SvmType.NU_SVC else 1.0), gamma_of(s, len(t.low))
        if s.kernel is Kernel.QUADRATIC:
            support, weights, lost = folded_quadratic(sums[ends], sums[ends + 1], float(sums[ends + 2][0]), gamma, s.c0)
            out[key] = Svm(Scaler(t.low, t.high), support, weights / by, (rho - lost) / by, s.kernel, gamma, s.c0, float(sums[ends + 2][1]) / by)
        else:
            parts = gathered.pop(key)
            out[key] = Svm(Scaler(t.low, t.high), np.concatenate([z for z, _ in parts]), np.concatenate([w for _, w in parts]) / by, rho / by, s.kernel, gamma, s.c0)
    return out


def folded_quadratic(pairs: np.ndarray, single: np.ndarray, total: float, gamma: float, c0: float) -> tuple[np.ndarray, np.ndarray, float]:
    """(vectors, weights, rest) with the decision values, less the rest, of weighted vectors v whose sums of w v v', w v and w
    are given: the eigenvectors of the first, both ways."""
    values, axes = np.linalg.eigh((pairs + pairs.T) / 2)
    along = axes.T @ single
    weights = np.r_[(values + along) / 2, (values - along) / 2]
    return np.r_[axes.T, -axes.T], weights, c0 * c0 * (total - weights.sum())
