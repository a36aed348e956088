import math
import random

import pytest

from strandline.operators import metrics
from strandline.operators.ordered import running
from pyspark.sql import functions as F


def frame(spark, rows):
    return spark.createDataFrame([(i, float(s), f) for i, (s, f) in enumerate(rows)], "k long, score double, flag boolean")


def plain_roc(rows, x):
    p, n = sum(f for _, f in rows), sum(not f for _, f in rows)
    order = sorted(enumerate(rows), key=lambda r: (-r[1][0], r[0]))
    tp = fp = 0
    total = last_t = last_f = 0.0
    for _, (_, flag) in order:
        tp, fp = tp + flag, fp + (not flag)
        t, f = tp / p, fp / n
        if f >= x:
            t = last_t + (t - last_t) * (x - last_f) / (f - last_f)
            return total + (x - last_f) * (t + last_t) / 2
        total += (f - last_f) * (t + last_t) / 2
        last_t, last_f = t, f
    return total


def plain_prc(rows, x):
    p = sum(f for _, f in rows)
    order = sorted(enumerate(rows), key=lambda r: (-r[1][0], r[0]))
    tp = total = last_r = last_p = 0.0
    for k, (_, (_, flag)) in enumerate(order):
        tp += flag
        r, q = tp / p, tp / (k + 1)
        if r >= x:
            q = last_p + (q - last_p) * (x - last_r) / (r - last_r)
            return total + (x - last_r) * (q + last_p) / 2
        total += (r - last_r) * (q + last_p) / 2
        last_r, last_p = r, q
    return total


def plain_threshold(rows, wanted):
    order = sorted(enumerate(rows), key=lambda r: (r[1][0], r[0]))
    p, n = sum(f for _, f in rows), len(rows)
    gone, before = 0, (0.0, -1.0)
    for k, (_, (s, f)) in enumerate(order):
        q = (p - gone) / (n - k)
        if q >= wanted or k == n - 1:
            return before[0] if q == before[1] else before[0] + (wanted - before[1]) * (s - before[0]) / (q - before[1])
        before, gone = (s, q), gone + f


@pytest.mark.parametrize("seed", range(3))
def test_areas_and_thresholds(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice([1, 2, 2.5, 3, rng.random() * 4]), rng.random() < 0.4) for _ in range(120)] + [(5, True), (0, False)]
    df = frame(spark, rows)
    for x in (0.1, 0.5, 1.0):
        assert metrics.roc_area(df, x, "k").first().area == pytest.approx(plain_roc(rows, x))
        assert metrics.prc_area(df, x, "k").first().area == pytest.approx(plain_prc(rows, x))
    for wanted in (0.1, 0.5, 0.8, 1.0, 1.5):
        assert metrics.calibrate_precision(df, wanted, "k").first().threshold == pytest.approx(plain_threshold(rows, wanted))


def test_small_cases(spark):
    rows = [(3, True), (2, False), (1, True)]
    assert metrics.roc_area(frame(spark, rows), 1.0, "k").first().area == pytest.approx(0.5)
    c = metrics.confusion(frame(spark, rows), 2.0).first()
    assert (c.tp, c.fp, c.tn, c.fn, c.accuracy, c.ppv) == (1, 1, 0, 1, pytest.approx(1 / 3), 0.5)
    assert math.isnan(metrics.confusion(frame(spark, rows), 9.0).first().ppv)
    assert math.isnan(metrics.roc_area(frame(spark, [(1, True)]), 0.5, "k").first().area)


def test_running_sums_over_many_ranges(spark):
    rng = random.Random(0)
    rows = [(rng.choice([0, 1, 2, 3, 4.5]) + (rng.random() if rng.random() < 0.5 else 0), rng.random() < 0.5) for _ in range(3000)]
    out = running(frame(spark, rows).repartition(5), [F.asc("score"), F.asc("k")], {"n": F.col("flag").cast("long")}).collect()
    total = 0
    for place, (i, (s, f)) in enumerate(sorted(enumerate(rows), key=lambda r: (r[1][0], r[0])), 1):
        total += f
        rows[i] = (s, f, place, total)
    assert {(r.k, r.place, r.n) for r in out} == {(i, r[2], r[3]) for i, r in enumerate(rows)}


def test_quantile_and_votes(spark):
    scores = spark.createDataFrame([(float(i),) for i in range(100)], "score double")
    assert metrics.quantile_threshold(scores, 0.01).first().threshold == 89.0
    votes = spark.createDataFrame([(1, 0), (1, 2), (1, 2), (2, 1), (2, 0)], "seq_id long, class_order int")
    assert {r.seq_id: r.class_order for r in metrics.majority_vote(votes).collect()} == {1: 2, 2: 0}
