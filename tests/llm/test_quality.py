import re
from collections import Counter
from fractions import Fraction
from math import comb

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandline.llm import quality
from strandline.session import read_table


def plain_stats(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    inside = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines), dup, len(inside)


@given(st.text(alphabet="ab \n\t\x0b\x1cé#*", max_size=60))
@settings(max_examples=300, deadline=None)
def test_stats(text):
    assert quality.text_stats(text.encode()) == plain_stats(text)


def test_binomial_tail_is_exact():
    for k, n, p in [(0, 50, 0.01), (3, 400, 0.004), (40, 1000, 0.05), (5, 5, 0.2)]:
        q = Fraction(p)
        want = sum(comb(n, i) * q**i * (1 - q) ** (n - i) for i in range(k + 1))
        assert quality.binomial_tail(k, n, p) == pytest.approx(float(want), rel=1e-9)


def test_strictest_stops_at_the_first_failure():
    assert quality.strictest([0, 1, 400, 0], 10000, 0.01, 0.01) == 1
    assert quality.strictest([200], 10000, 0.01, 0.01) == -1
    assert quality.strictest([0], 100, 0.01, 0.01) == -1


def test_rules_against_brute_force(spark):
    good = " ".join(f"word{i} thing{i % 7}" for i in range(60))
    junk = " ".join(f"w{i}### t{i}***" for i in range(60))
    rows = [(i, good + f" {i}", "en") for i in range(3000)] + [(10_000 + i, junk + f" {i}", "en") for i in range(50)]
    rows += [(20_000 + i, junk + f" {i}", "fr") for i in range(5)] + [(1, None, None), (None, "", "en"), (None, good, None), (5, good, "en"), (5, good, "en"), (6, "long " * 40000, "en")]
    docs = spark.createDataFrame([(*r, 0, True) for r in rows], "doc_id long, text string, lang string, n_words int, kept boolean")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(2900)] + [(10_000, 0, 0), (7, 0, 0), (None, 1, 0), (8, None, 0)], "doc_id long, quality int, toxic int")
    out = quality.quality_rules(docs, labels).collect()
    assert Counter((r.doc_id, *[r[c] for c in quality.STATS]) for r in out) == Counter((d, *plain_stats(t)) for d, t, _ in rows if t != "long " * 40000) + Counter({(6, 40000, 160000, 0, 1, 0, 40000): 1})
    for r in out:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed and not r.failed_rules)
    by = {r.doc_id: r for r in out}
    assert all(by[i].kept for i in range(3000) if i not in (1, 5, 6))
    assert not any(by[10_000 + i].kept for i in range(50)) and by[10_000].failed_rules == ["symbols"]
    assert all(by[20_000 + i].kept for i in range(5))  # too few labels to certify a cutoff
    assert all(r.kept for r in quality.quality_rules(docs, labels.where("false")).collect() if not r.base_failed)
    assert quality.quality_rules(docs.where("false"), labels).count() == 0


def test_false_rejection_of_unseen_documents(spark):
    """Cutoffs fitted on half of the labels, judged on the other half: those of four languages are certified, the share of
    good documents that they reject is within what chance adds to the risk, and most bad ones go."""
    sf = "/root/testdata/sf0.1"
    docs, labels = read_table(spark, sf, "documents"), read_table(spark, sf, "labels")
    measured = quality.stats(docs)
    everywhere = quality.fit_thresholds(measured, labels)
    assert len(everywhere) >= 3 and all("symbols" in c for c in everywhere.values())
    half = labels.where("doc_id % 2 = 0")
    cutoffs = quality.fit_thresholds(measured, half, delta=0.2)
    assert len(cutoffs) >= 2
    unseen = quality.verdicts(measured, cutoffs).where("NOT base_failed").join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    for s in cutoffs:
        good, bad = ([r.kept for r in unseen if r.stratum == s and (r.quality == 1) == g] for g in (True, False))
        rejected = len(good) - sum(good)
        assert quality.binomial_tail(rejected - 1, len(good), quality.RISK) < 0.999 if rejected else True
        assert sum(bad) <= 0.3 * len(bad)


def test_coverage_by_simulation():
    """The true false rejection, known from the distribution, is over the risk in at most delta of the draws."""
    rng = np.random.default_rng(5)
    cuts = list(quality.CUTOFFS.values())
    path = quality.plain_path()
    limits = np.array(list(quality.limits_of(path).values()))

    def draw(n):
        return np.column_stack([rng.gamma(0.4, 0.06, n), rng.gamma(0.3, 0.08, n), rng.gamma(0.5, 0.07, n), rng.normal(6, 1.5, n), -rng.normal(5, 0.6, n)])

    def shares(x):
        return [float((x > limits[:, j]).any(axis=1).mean()) for j in range(len(path))]

    true = shares(draw(60_000))
    over = tight = 0
    for _ in range(200):
        counts = [round(s * 800) for s in shares(draw(800))]
        last = quality.strictest(counts, 800, 0.02, 0.05)
        over += last >= 0 and true[last] > 0.02
        tight += last >= 0
    assert tight > 100 and over <= 200 * 0.05 + 8 and len(cuts) == 5


def test_paths_prefer_rules_that_tell_bad_from_good():
    rng = np.random.default_rng(1)
    good = np.arange(400) < 300
    scored = np.column_stack([np.where(good, 0, 0.3), rng.random(400) * 0.05, rng.random(400) * 0.1, np.full(400, 5.0), np.full(400, -5.0)])
    path = quality.choose_path(scored, good)
    assert sorted(path) == sorted(quality.plain_path()) and path[0][0] == "symbols"
    assert [c for r, c in path if r == "repeats"] == quality.CUTOFFS["repeats"]
    assert quality.certified([0, 0, 900], 1000, path, 0.02, 0.01) == dict(path[:2])


def test_copies_count_once_and_malformed_text_is_read(spark):
    base = " ".join(f"word{i} thing{i % 7}" for i in range(60))
    docs = spark.createDataFrame([(i, base, "en") for i in range(500)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(500)], "doc_id long, quality int")
    assert quality.fit_thresholds(quality.stats(docs), labels) == {}  # one text, whatever its copies
    assert quality.text_stats(b"\xff\xfe ok") == (2, 4, 0, 1, 0, 0)
