import numpy as np
import pytest

from strandline.config import CoreMode, Kernel, Settings, SvmType, WeightMode
from strandline.models import forest, linear, logodds, svm, vector
from strandline.models.sequence import FeatureModel, Hierarchical, PairLogOdds, PairSum
from strandline.operators.features import Feature
from strandline.operators import intervals
from strandline.operators.intervals import best_of_overlapping, core_predictions, merge, window_cores
from strandline.sources.background import generate_iid
from strandline.sources.motifs import MotifSet


def blobs(n=120, d=5, gap=1.2, seed=0):
    rng = np.random.default_rng(seed)
    y = np.where(rng.random(n) < 0.5, 1.0, -1.0)
    return rng.normal(0, 1, (n, d)) + gap * y[:, None] * np.r_[1, 0.5, np.zeros(d - 2)], y


@pytest.mark.parametrize("kernel", list(Kernel))
def test_c_svc_meets_its_conditions(kernel):
    x, y = blobs()
    m = svm.train_svm(x, y, SvmType.C_SVC, kernel, cost=0.7, c0=1.0)
    z = m.scaler(x)
    k = svm.kernel_matrix(z, z, kernel, m.gamma, m.c0)
    a = np.zeros(len(y))
    for s, c in zip(m.support, m.coefficients):
        a[np.flatnonzero((z == s).all(axis=1))[0]] += c
    a = a * y
    assert abs(a @ y) < 1e-9 and a.min() > -1e-12 and a.max() < 0.7 + 1e-12
    margin = y * (k @ (a * y) - m.rho)
    assert np.allclose(margin, y * m.decide(x))
    assert (margin[a < 1e-9] > 1 - 3e-3).all()
    assert (margin[a > 0.7 - 1e-9] < 1 + 3e-3).all()
    inner = (a > 1e-9) & (a < 0.7 - 1e-9)
    assert np.allclose(margin[inner], 1, atol=3e-3)
    assert (np.sign(m.decide(x)) == y).mean() > 0.85


def test_kernel_rows_on_demand(monkeypatch):
    x, y = blobs()
    whole = svm.train_svm(x, y, SvmType.C_SVC, Kernel.RBF).decide(x)
    monkeypatch.setattr(svm, "CACHE", 1)
    rows = svm.KernelRows(x, Kernel.CUBIC, 0.3, 1.0, 1)
    assert rows.most == 2 and np.allclose([rows[i] for i in range(len(x))], svm.kernel_matrix(x, x, Kernel.CUBIC, 0.3, 1.0)) and len(rows.kept) == 2
    assert np.allclose(rows.diagonal(), np.diag(svm.kernel_matrix(x, x, Kernel.CUBIC, 0.3, 1.0)))
    assert np.allclose(svm.train_svm(x, y, SvmType.C_SVC, Kernel.RBF).decide(x), whole)


def test_training_rows_are_bounded(spark):
    rows = spark.range(3000).selectExpr("id", "CASE WHEN id < 2900 THEN 'hot' ELSE 'rare' END AS motif")
    few = vector.sampled(rows, 200, "id", "motif").collect()
    assert sum(r.motif == "hot" for r in few) == 200 and sum(r.motif == "rare" for r in few) == 100
    one = sorted(r.id for r in vector.sampled(rows, 500, "id").collect())
    assert len(one) == 500 and one == sorted(r.id for r in vector.sampled(rows.repartition(7), 500, "id").collect())
    assert 1200 < np.mean(one) < 1800 and vector.sampled(rows, 5000, "id").count() == 3000


def test_other_machines():
    x, y = blobs(gap=1.5)
    nu = svm.train_svm(x, y, SvmType.NU_SVC, nu=0.3)
    assert (np.sign(nu.decide(x)) == y).mean() > 0.9
    one = svm.train_svm(x, y, SvmType.ONE_CLASS, Kernel.RBF, nu=0.2)
    assert 0.6 < (one.decide(x[y > 0]) > 0).mean() < 0.95
    eps = svm.train_svm(x, y, SvmType.EPSILON_SVR, cost=1.0, p=0.1)
    nur = svm.train_svm(x, y, SvmType.NU_SVR, cost=1.0, nu=0.5)
    for m in (eps, nur):
        assert np.corrcoef(m.decide(x), y)[0, 1] > 0.8
    # nu bounds: the share of margin errors is at most nu, of support vectors at least
    assert len(nu.coefficients) / len(y) >= 0.3 - 0.05
    line = np.linspace(-1, 1, 60)[:, None]
    fit = svm.train_svm(line, 0.5 * line[:, 0], SvmType.EPSILON_SVR, cost=10, p=0.05)
    assert np.abs(fit.decide(line) - 0.5 * line[:, 0]).max() < 0.06


def test_weights_in_unscaled_space():
    x, y = blobs()
    x = np.c_[x * [1, 10, 3, 1, 1] + 5, np.full(len(x), 3.0)]
    m = svm.train_svm(x, y, SvmType.C_SVC)
    w, b = m.linear_weights()
    assert np.allclose(x @ w + b, m.decide(x)) and w[-1] == 0
    q = svm.train_svm(x, y, SvmType.C_SVC, Kernel.QUADRATIC, c0=0.5)
    pairs, single, bias = q.quadratic_weights()
    assert np.allclose(np.einsum("ij,jk,ik->i", x, pairs, x) + x @ single + bias, q.decide(x))
    assert (svm.Scaler.fit(x)(x).min(axis=0)[:-1] == pytest.approx(-1)) and svm.Scaler.fit(x)(x)[:, -1].any() == 0


def test_votes():
    rng = np.random.default_rng(1)
    labels = rng.choice([2.0, 1.0, 7.0], 150)
    x = np.c_[labels == 1, labels == 7] * 3.0 + rng.normal(0, 0.3, (150, 2))
    v = svm.Vote.train(x, labels, svm_type=SvmType.C_SVC)
    assert v.classes == tuple(dict.fromkeys(labels.tolist()))
    assert (v.choose(x) == labels).mean() > 0.97
    one = svm.Vote.train(x[:3], np.array([5.0, 5.0, 5.0]), svm_type=SvmType.C_SVC)
    assert (one.choose(x) == 5.0).all() and svm.Vote.train(x[:0], labels[:0]) is None


def test_forest(spark):
    x, y = blobs(300, gap=1.0)
    a = forest.train_forest(x, y > 0, trees=30, seed=4)
    b = forest.train_forest_distributed(spark, x, y > 0, trees=30, seed=4)
    assert np.array_equal(a.decide(x), b.decide(x)) and a.oob_error == pytest.approx(b.oob_error)
    assert ((a.decide(x) > 0) == (y > 0)).mean() > 0.9 and a.oob_error < 0.25
    assert max(len(t.feature) for t in forest.train_forest(x, y > 0, trees=3, depth=1).trees) <= 3
    with pytest.raises(ValueError):
        forest.train_forest(x, np.ones(300, bool))
    assert forest.hellinger(np.array([5]), np.array([0]), 5, 5)[0] == pytest.approx(np.sqrt(2))


def test_linear_machines():
    x, y = blobs(gap=2.5)
    for m in (linear.train_lda(x, y > 0), linear.train_perceptron(x, y > 0, 500)):
        assert ((m.decide(x) > 0) == (y > 0)).mean() > 0.95


def test_log_odds_zero_rules():
    sums = [(0.0, 3.0), (2.0, 3.0)]
    w = {m: logodds.weigh(sums, 4, 6, m) for m in WeightMode}
    assert w[WeightMode.PREDICTOR][0] == pytest.approx(np.log(1 / 4) - np.log(4 / 6))
    assert w[WeightMode.PREDICTOR][1] == pytest.approx(np.log(2 / 4) - np.log(3 / 6))
    assert w[WeightMode.ZERO][0] == 0
    assert w[WeightMode.CONSTANT][0] == pytest.approx(np.log(1e-8 / 4) - np.log((3 + 1e-8) / 6))
    assert w[WeightMode.PPV] == pytest.approx([0, 0.5]) and w[WeightMode.BIPPV] == pytest.approx([-1, 0])


@pytest.fixture(scope="module")
def corpus(spark):
    """Positives hold planted pairs of motifs in random sequences."""
    seqs = generate_iid(spark, 60, 700, seed=5)
    rows = []
    rng = np.random.default_rng(3)
    for r in seqs.orderBy("seq_id").collect():
        s = r.seq
        positive = r.seq_id % 2 == 0
        if positive:
            for at in rng.integers(20, 640, 6):
                s = s[:at] + "GAGAGGCCATC" + s[at + 11 :]
        rows.append((r.seq_id, s, len(s), 1.0 if positive else -1.0, "full" if r.seq_id % 4 < 2 else "win"))
    return spark.createDataFrame(rows, "seq_id long, seq string, len int, class_value double, train_mode string")


def motifs():
    m = MotifSet()
    m.add_iupac("GAF", "GAGAG")
    m.add_iupac("PS", "GCCAT")
    return m


def area(rows):
    pos, neg = [r.score for r in rows if r.flag], [r.score for r in rows if not r.flag]
    return np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])


FEATURES = (Feature("nOcc"), Feature("nPair", 60), Feature("GC"), Feature("MDP"))


@pytest.mark.parametrize(
    "model",
    [
        PairSum(motifs()),
        PairLogOdds(motifs()),
        FeatureModel(motifs(), features=FEATURES[:2]),
        FeatureModel(motifs(), features=FEATURES[:2], kind="logodds"),
        FeatureModel(motifs(), Settings(p=0.1), features=FEATURES, kind="svm"),
        FeatureModel(motifs(), Settings(trees=20), features=FEATURES, kind="forest"),
        FeatureModel(motifs(), features=FEATURES[:2], kind="lda"),
        FeatureModel(motifs(), Settings(perceptron_rounds=300), features=FEATURES[:2], kind="perceptron"),
        Hierarchical(motifs(), Settings(svm_type=SvmType.C_SVC)),
        Hierarchical(motifs(), Settings(trees=15), kind="forest"),
    ],
    ids=lambda m: f"{type(m).__name__}-{getattr(m, 'kind', '')}",
)
def test_models_tell_planted_sequences(spark, corpus, model):
    if not isinstance(model, PairSum) or isinstance(model, PairLogOdds):
        if getattr(model, "kind", "") != "sum":
            with pytest.raises(ValueError):
                model.score_windows(corpus)
    fitted = model.fit(corpus)
    rows = fitted.validation_table(corpus).collect()
    assert len(rows) == 60 and area(rows) > 0.9
    plain = isinstance(fitted, PairSum) and not isinstance(fitted, PairLogOdds)
    if plain or (isinstance(fitted, FeatureModel) and fitted.kind in ("sum", "forest", "lda", "perceptron")):
        with pytest.raises(ValueError):
            fitted.weight_table()
    else:
        assert all(np.isfinite(w) for _, w in fitted.weight_table())


def test_description(spark, corpus):
    rows = {r.item: r.value for r in PairSum(motifs()).describe(corpus).collect()}
    assert rows["setting window_size"] == "500" and rows["sequences of class 1.0"] == "30" and "GAGAG" in rows["motif GAF"]


def test_sequences_without_windows_score_zero(spark):
    df = spark.createDataFrame([(1, "A" * 400), (2, "GAGAGGCCAT")], "seq_id long, seq string")
    out = {r.seq_id: r.score for r in PairSum(motifs()).score_sequences(df).collect()}
    assert out[1] == 0 and out[2] == pytest.approx(3 * 1000 / 10)


def test_merging(spark, monkeypatch):
    df = spark.createDataFrame([("c", 0, 500, 1.0), ("c", 600, 1100, 2.0), ("c", 1300, 1800, 3.0), ("d", 5, 6, 1.0)], "chrom string, start long, end long, score double")
    show = lambda x: sorted((r.chrom, r.start, r.end, r.score) for r in x.collect())
    once = merge(df, 100)
    assert show(once) == [("c", 0, 1100, 2.0), ("c", 1300, 1800, 3.0), ("d", 5, 6, 1.0)]
    assert show(merge(once, 100)) == show(once)
    assert len(show(merge(df))) == 4
    rng = np.random.default_rng(0)
    rows = [("x", int(s), int(s + n), float(v)) for s, n, v in zip(rng.integers(0, 3000, 200), rng.integers(1, 60, 200), rng.random(200))]
    want: list = []
    for c, s, e, v in sorted(rows, key=lambda r: r[1:]):
        if want and s <= want[-1][2] + 7:
            want[-1] = (c, want[-1][1], max(want[-1][2], e), max(want[-1][3], v))
        else:
            want.append((c, s, e, v))
    assert show(merge(spark.createDataFrame(rows, df.schema), 7)) == want
    monkeypatch.setattr(intervals, "STRETCH", 100)
    spread = spark.createDataFrame([*rows, (None, 1, 2, 0.5), ("x", None, 2, 0.5)], df.schema)
    assert show(merge(spread, 7, spread=True)) == want and merge(df.where("false"), spread=True).count() == 0


def test_best_of_overlapping(spark, monkeypatch):
    rows = [("c", 0, 500, 0, 500, 1.0), ("c", 100, 600, 100, 600, 3.0), ("c", 200, 700, 200, 700, 2.0), ("c", 701, 1200, 701, 1200, 0.5), ("c", 1300, 1800, 1300, 1800, 0.4)]
    df = spark.createDataFrame(rows, "chrom string, win_start long, win_end long, start long, end long, score double")
    assert sorted((r.start, r.end, r.score) for r in best_of_overlapping(df).collect()) == [(100, 600, 3.0), (701, 1200, 0.5), (1300, 1800, 0.4)]
    monkeypatch.setattr(intervals, "STRETCH", 300)
    rng = np.random.default_rng(2)
    starts = np.unique(rng.integers(0, 9000, 60) * 10)
    rows = [("c", int(w), int(w) + 500, int(w) + int(a), int(w) + 300 + int(a), float(rng.integers(0, 6))) for w in starts for a in range(0, 200, 100) if rng.random() < 0.8]
    want, last = [], None
    for w in sorted({r[1] for r in rows}):
        own = [r for r in rows if r[1] == w]
        if last is None or w > last:
            want.append([])
        want[-1] += own
        last = w + 500
    best = [min(run, key=lambda r: (-r[5], r[1], r[3])) for run in want]
    got = best_of_overlapping(spark.createDataFrame(rows, df.schema)).collect()
    assert sorted((r.start, r.end, r.score) for r in got) == sorted(r[3:] for r in best)


def plain_cores(hits, win_end, threshold, mode, size, reach=250):
    """By definition, hit by hit."""
    site = lambda h: ((h[0] + h[1]) // 2 - reach, (h[0] + h[1]) // 2 + reach)
    hits = sorted(hits)
    if mode is CoreMode.CONTINUOUS:
        line = sorted(hits, key=lambda h: (sum(site(h)) // 2, h))
        found = []
        for i, a in enumerate(line[:-1]):
            low = max(site(a)[0], 0)
            for b in line[i:]:
                if any(site(c)[1] > site(a)[0] + size for c in line[i : line.index(b) + 1]):
                    continue
                high = min(site(b)[1], win_end)
                if high - low >= 2 * reach:
                    weight = sum(h[2] for h in hits if h[0] >= low and h[1] <= high)
                    found.append((weight / (high - low), low, high, weight))
        return [max(found, key=lambda f: f[0])[1:]] if found else []
    strong = []
    for a in hits:
        low, high = site(a)
        inside = [h for h in hits if h[0] >= low]
        ends = [i for i, h in enumerate(inside) if h[1] > high]
        weight = sum(h[2] for h in inside[: ends[0] if ends else len(inside)])
        if weight >= threshold:
            strong.append((max(low, 0), min(high, win_end), weight))
    if mode is CoreMode.MOTIFS_STRONG:
        return strong
    joined = []
    for low, high, weight in strong or [(*site(h), h[2]) for h in hits]:
        if joined and low < joined[-1][1]:
            joined[-1] = (joined[-1][0], max(joined[-1][1], high), max(joined[-1][2], weight))
        else:
            joined.append((low, high, weight))
    return [x for x in joined if x[2] >= threshold] or joined


@pytest.mark.parametrize("mode", [CoreMode.MOTIFS, CoreMode.MOTIFS_STRONG, CoreMode.CONTINUOUS])
def test_cores_by_definition(mode):
    rng = np.random.default_rng(7)
    for _ in range(150):
        n, length = int(rng.integers(0, 12)), int(rng.choice([500, 1500, 4000]))
        starts = rng.integers(0, length - 12, n)
        hits = list(dict.fromkeys((int(s), int(s + rng.choice([5, 8, 11])), float(rng.integers(-1, 4))) for s in starts))
        threshold = float(rng.choice([0, 1, 3, 6]))
        assert window_cores(hits, 0, length, threshold, mode, 1500) == plain_cores(hits, length, threshold, mode, 1500)


def test_cores(spark):
    hits = [(1000, 1005, 2.0), (1100, 1105, 2.0), (1900, 1905, 1.0)]
    strong = window_cores(hits, 900, 2400, 3.0, CoreMode.MOTIFS_STRONG, 1500)
    assert strong == [(752, 1252, 4.0), (852, 1352, 4.0)]
    assert window_cores(hits, 900, 2400, 3.0, CoreMode.MOTIFS, 1500) == [(752, 1352, 4.0)]
    assert window_cores(hits, 900, 2400, 9.0, CoreMode.MOTIFS, 1500) == [(752, 1352, 2.0), (1652, 2152, 1.0)]
    assert window_cores(hits, 900, 2400, 0.0, CoreMode.CONTINUOUS, 1500) == [(752, 1252, 4.0)]
    assert window_cores(hits[:1], 900, 2400, 0.0, CoreMode.CONTINUOUS, 1500) == [] == window_cores([], 0, 500, 0.0, CoreMode.CONTINUOUS, 500)
    h = spark.createDataFrame([(1, 0, s, e, w) for s, e, w in hits], "seq_id long, win long, start long, end long, weight double")
    w = spark.createDataFrame([(1, 0, 900, 1500, 5.0), (1, 1, 900, 1500, 1.0)], "seq_id long, win long, win_start long, win_len long, score double")
    assert [(r.win, r.start, r.end, r.score) for r in core_predictions(h, w, 3.0, CoreMode.MOTIFS, 1500).collect()] == [(0, 752, 1352, 4.0)]


def test_settings():
    assert Settings().window_size == 500 and Settings().svm_type is SvmType.EPSILON_SVR
    with pytest.raises(ValueError):
        Settings(window_step=500)
