from collections import Counter, defaultdict

import pytest

from strandline.llm import mixing
from strandline.session import read_table


def water_fill(sizes, weights=(3, 1, 2)):
    total = 1.5 * sum(sizes.values())
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    capped, target = set(), {}
    while True:
        left = total - sum(2 * sizes[s] for s in capped)
        w = sum(weight[s] for s in sizes if s not in capped)
        target = {s: 2.0 * sizes[s] if s in capped else left * weight[s] / w for s in sizes}
        over = {s for s in sizes if s not in capped and target[s] > 2 * sizes[s]}
        if not over:
            return target
        capped |= over


def words(text):
    return len([w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if w])


@pytest.mark.parametrize("extra", [[], [(None, "null id a", None), (None, "null id b", None), (7_000_001, None, "src1"), (7_000_002, "", "lone"), (7_000_003, "same words", "src1"), (7_000_003, "same words", "src1"), (7_000_004, "w " * 30000, "long"), (7_000_005, "x\x1cy z", "é"), (7_000_006, "a b", "\U0001f600")]])
def test_mix_against_brute_force(spark, sf, extra):
    rows = [(r.doc_id, r.text, r.source) for r in read_table(spark, sf, "documents").collect()] + extra
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, size int, target int")
    out = mixing.mix(docs).collect()
    assert Counter((r.doc_id, r.source, r.size) for r in out) == Counter((d, s, words(t)) for d, t, s in rows)
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += words(t)
    target, taken = water_fill(sizes), Counter()
    for r in out:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(target[r.source], abs=1e-6)
        assert 0 <= r.taken <= 2 * r.size
        assert r.taken == r.passes * r.size + r.part_words + r.head_words
        assert r.part_from + r.part_words <= r.size and r.head_words <= r.size
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - target[s]) <= max(40, 0.01 * target[s]), s
    again = mixing.mix(docs.repartition(7)).collect()
    key = lambda r: (str(r.doc_id), r.size, r.taken)
    assert sorted(map(key, out)) == sorted(map(key, again))


def test_quotas_are_the_highest_quotients(spark):
    weights = {"a": 53.0, "b": 24.0, "c": 23.0, "d": 0.0, "e": 24.0, "f": 0.4}
    for seats in (0, 1, 2, 7, 10, 101):
        df = spark.createDataFrame([(1, k, v, seats) for k, v in weights.items()], "g int, p string, w double, n long")
        got = {r.p: r.q for r in mixing.sainte_lague(df, ["g"], "p", "w", "n", "q").collect()}
        best = sorted(((-v / (2 * k + 1), p) for p, v in weights.items() if v for k in range(seats)))[:seats]
        want = Counter(p for _, p in best)
        assert got == {p: want[p] for p in weights}, seats


def test_mix_runs_no_python_and_takes_an_empty_table(spark, sf):
    plan = mixing.mix(read_table(spark, sf, "documents"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    assert mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_quotas_of_many_parties(spark):
    rng = __import__("random").Random(8)
    weights = {f"{i:03}": float(rng.choice([0, 1, 2, 3, 50, 1000])) for i in range(400)}
    for seats in (3, 150, 1777):
        df = spark.createDataFrame([(1, k, v, seats) for k, v in weights.items()], "g int, p string, w double, n long")
        got = {r.p: r.q for r in mixing.sainte_lague(df, ["g"], "p", "w", "n", "q").collect()}
        best = sorted(((-v / (2 * k + 1), p) for p, v in weights.items() if v for k in range(seats)))[:seats]
        want = Counter(p for _, p in best)
        assert got == {p: want[p] for p in weights}, seats


@pytest.mark.parametrize("longest", [1, 3])
def test_short_documents_meet_their_targets(spark, longest):
    rows = [(i, " ".join(["w"] * (1 + i % longest)), f"s{i % 3 % 2}") for i in range(1800)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    taken, target = Counter(), {}
    for r in out:
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 2 * r.size
    for s, t in target.items():
        assert abs(taken[s] - t) <= 0.01 * t, (s, taken[s], t)
