import math
import random

import numpy as np
import pytest

from strandline.config import Distance, Settings
from strandline.functions.sequences import PI
from strandline.operators import local
from strandline.operators.features import Feature, Windows, empty_value, feature_values, fill, instantiate, used_motifs, vectors
from strandline.operators.pairs import pair_counts
from strandline.operators.scan import scan
from strandline.sources.motifs import MotifSet

SIZE, STEP = 120, 40


def setup(spark, seed=0):
    rng = random.Random(seed)
    seqs = [(i, "".join(rng.choice("ACGT") for _ in range(n))) for i, n in enumerate((60, 81, 200, 333))]
    motifs = MotifSet()
    for name, pattern in (("a", "GA"), ("b", "TCN"), ("c", "AT")):
        motifs.add_iupac(name, pattern)
    df = spark.createDataFrame([(i, s, len(s)) for i, s in seqs], "seq_id long, seq string, len long")
    return df, motifs, Windows(df, scan(df, motifs), SIZE, STEP, motifs.max_len)


def contents(w):
    """Occurrences by window: (motif, reverse, start, end), and each window's start and length."""
    place = {(r.seq_id, r.win): (r.win_start, r.win_len) for r in w.windows.collect()}
    inside = {k: [] for k in place}
    for r in w.occ.collect():
        for (s, i), (a, n) in place.items():
            if s == r.seq_id and r.start >= a and r.end <= a + n:
                inside[s, i].append((r.motif_id, r.reverse, r.start, r.end))
    return place, inside


def center(o):
    return (o[2] + o[3]) / 2


def gap(x, y):
    return max(y[2] - x[3], x[2] - y[3], 0)


def value(i, occ, n, seq):
    f, size = i.feature, SIZE
    A, B = [o for o in occ if o[0] == i.a], [o for o in occ if o[0] == i.b]
    if f.type == "GC":
        return sum(c in "GC" for c in seq) / n
    if f.type == "nOcc":
        return len(A) / n
    pairs = [(x, y) for k, x in enumerate(A) for y in A[k + 1 :]] if i.a == i.b else [(x, y) for x in A for y in B]
    if f.type == "nPair":
        return sum(gap(x, y) <= f.distance for x, y in pairs) / n
    if f.type == "nOccPair":
        return sum(any(y != x and abs(center(x) - center(y)) <= f.distance for y in B) for x in A) / n
    if f.type == "nPair2D":
        total = 0
        for x, y in pairs:
            d = center(y) - center(x)
            if abs(d) <= f.distance:
                ph = abs(d) / f.period if i.a == i.b else (-d if x[1] else d) / f.period
                total += (math.sin if i.axis else math.cos)(ph * PI * 2)
        return total / n
    if f.type == "nPairDH":
        return sum(math.cos((center(y) - center(x) + (5.25 if x[1] != y[1] else 0)) / 10.5 * PI * 2) + 1 for x, y in pairs if abs(center(y) - center(x)) <= f.distance) / n / 2
    if f.type == "PEDI":
        return sum((math.cos((abs(center(y) - center(x)) + f.phase) / f.period * PI * 2) + 1) / 2 for x in A for y in B if abs(center(y) - center(x)) + f.phase <= f.distance) / n
    others = (lambda x: [y for y in occ if y != x]) if f.type in ("MDPA", "MDDA") else (lambda x: [y for y in B if y != x])
    each = []
    for x in A:
        if f.type in ("MDP", "MDPA"):
            d = [abs(center(x) - center(y)) for y in others(x)]
            if d and min(d) < size:
                each.append(min(d))
        else:
            d = [gap(x, y) for y in others(x) if gap(x, y) <= size]
            if d:
                each.append(sum(d) / len(d) if f.type == "MDM" else max(d))
    return sum(each) / len(each) if each else size


def test_all_features_against_brute_force(spark):
    df, motifs, w = setup(spark)
    features = [Feature("nOcc"), Feature("GC"), Feature("nPair", 12), Feature("nOccPair", 9), Feature("nPair2D", 20, 10), Feature("nPairDH", 20), Feature("PEDI", 20, 10, 1), Feature("MDPA"), Feature("MDP"), Feature("MDM"), Feature("MDDA"), Feature("MDD")]
    instances = instantiate(features, motifs)
    assert len(instances) == 3 + 1 + 6 + 9 + 12 + 6 + 6 + 3 + 9 + 9 + 3 + 9
    place, inside = contents(w)
    seqs = {r.seq_id: r.seq for r in df.collect()}
    got = {(r.seq_id, r.win): r.features for r in vectors(w, feature_values(w, instances), instances).collect()}
    assert set(got) == set(place)
    for key, (a, n) in place.items():
        for i in instances:
            want = value(i, inside[key], n, seqs[key[0]][a : a + n])
            # sines of two motifs are signed from the instance's first motif to its second
            assert got[key][i.feature_id] == pytest.approx(want, abs=1e-9), (key, i)
    filled = fill(w, feature_values(w, instances), instances).collect()
    assert len(filled) == len(place) * len(instances)
    assert all(r.value == pytest.approx(got[r.seq_id, r.win][r.feature_id]) for r in filled)
    assert empty_value(instances[0], SIZE) == 0 and empty_value(instances[-1], SIZE) == SIZE


def test_names_and_pruning(spark):
    _, motifs, _ = setup(spark)
    instances = instantiate([Feature("nPair", 60, a=0, b=1), Feature("nPair2D", 60, 10, a=0, b=0)], motifs)
    assert [i.name(motifs) for i in instances] == ["nPair(60)  a, b", "nPair2D(60, 10, X)  a, a", "nPair2D(60, 10, Y)  a, a"]
    assert [m.motif_id for m in used_motifs(instances, motifs)] == [0, 1]
    assert len(used_motifs(instantiate([Feature("MDPA", a=0)], motifs), motifs)) == 3


@pytest.mark.parametrize("settings", [Settings(pair_cutoff=15, window_size=SIZE, window_step=STEP), Settings(pair_cutoff=15, pairs_can_overlap=False, window_size=SIZE, window_step=STEP), Settings(pair_cutoff=15, distance=Distance.BETWEEN, homo_pairs=False, window_size=SIZE, window_step=STEP)])
def test_pair_counts(spark, settings):
    _, motifs, w = setup(spark, 3)
    _, inside = contents(w)

    def ok(x, y):
        d = max(y[2] - x[3], x[2] - y[3]) if settings.distance is Distance.BETWEEN else abs(center(x) - center(y))
        return 0 <= d <= 15 and (settings.pairs_can_overlap or x[3] < y[2] or y[3] < x[2])

    want = {}
    for key, occ in inside.items():
        for a in range(3):
            for b in range(a, 3):
                if a == b and not settings.homo_pairs:
                    continue
                A, B = [o for o in occ if o[0] == a], [o for o in occ if o[0] == b]
                n = sum(ok(x, y) for k, x in enumerate(A) for y in (A[k:] if a == b else B))
                if n:
                    want[(*key, a, b)] = n
    assert {(r.seq_id, r.win, r.a, r.b): r.n for r in pair_counts(w.occ, settings, motifs.max_len).collect()} == want


def test_local_features(spark):
    df, motifs, w = setup(spark, 5)
    seqs = {r.seq_id: r.seq for r in df.collect()}
    place, inside = contents(w)
    out = local.local_vectors(w.occurrences, w.seqs, w.occ, motifs, SIZE, STEP).collect()
    assert len(local.local_names(motifs)) == 3 + 1 + 16
    assert len(out) == sum(map(len, inside.values()))
    pairs = local.dinucleotide_names()
    for r in out:
        a, n = place[r.seq_id, r.win]
        me = (r.motif_id, r.reverse, r.start, r.end)
        near = [sum(o != me and o[0] == m and abs(center(o) - center(me)) < 250 for o in inside[r.seq_id, r.win]) for m in range(3)]
        middle = r.start + (r.end - r.start) // 2
        lo, hi = max(middle - 250, a), min(middle + 251, a + n)
        text = seqs[r.seq_id][lo:hi]
        counts = np.zeros(16)
        for i in range(len(text) - 1):
            counts[pairs.index(text[i : i + 2])] += 1
            counts[pairs.index(text[i : i + 2].translate(str.maketrans("ACGT", "TGCA"))[::-1])] += 1
        assert r.features == pytest.approx([*near, sum(c in "GC" for c in text) / len(text), *(counts / (len(text) - 1))])


def test_other_symbols_break_dinucleotides():
    share, profile = local.composition(np.frombuffer(b"ACGTNACGT", np.uint8), np.array([4]), np.array([5]), np.array([0]), np.array([9]))
    assert share[0] == pytest.approx(4 / 9) and profile[0].sum() == pytest.approx(2 * 6 / 8)


def test_slices_of_long_sequences_give_the_same(spark, monkeypatch):
    _, _, w = setup(spark, 5)
    show = lambda: sorted((r.seq_id, r.win, r.motif_id, r.reverse, r.start, r.gc, tuple(r.dnt)) for r in local.local_composition(w.occurrences, w.seqs, SIZE, STEP).collect())
    whole = show()
    monkeypatch.setattr(local, "SLICE", 37)
    assert show() == whole != []
