import random

import numpy as np
import pytest

from strandline.functions.iupac import CODES, pattern_regex, reverse_complement
from strandline.operators import scan, windows
from strandline.sources.motifs import MotifSet


def brute(seq, pattern, mismatches, automaton=True):
    out = []
    for i in range(len(seq) - len(pattern) + 1):
        part = seq[i : i + len(pattern)]
        if automaton and any(c not in "ACGT" for c in part):
            continue
        if sum(c not in CODES[p] for c, p in zip(part, pattern)) <= mismatches:
            out.append(i)
    return out


def motif(pattern, mismatches=0):
    out = MotifSet()
    out.add_iupac("m", pattern, mismatches)
    return out


def hits(spark, seq, motifs, **options):
    df = spark.createDataFrame([(1, seq, len(seq))], "seq_id long, seq string, len int")
    return sorted((r.start, r.reverse) for r in scan.scan(df, motifs, **options).collect())


def test_overlapping_strands_palindromes(spark):
    assert hits(spark, "GAGAGAG", motif("GAGAG")) == [(0, False), (2, False)]
    assert hits(spark, "CTCTCNGAGAG", motif("GAGAG")) == [(0, True), (6, False)]
    assert hits(spark, "TTGAATTCA", motif("GAATTC")) == [(2, False), (2, True)]


def test_other_symbols_reset_the_automaton(spark):
    g10 = motif("GAGAGAGAGA", 1)
    assert hits(spark, "GAGNGAGAGA", g10) == []
    assert (0, False) in hits(spark, "GAGNGAGAGA", g10, automaton=False)
    assert (0, False) in hits(spark, "GAGCGAGAGA", g10)
    assert hits(spark, "NNN", motif("NN")) == []


@pytest.mark.parametrize("seed", range(4))
def test_random_scans(spark, seed):
    rng = random.Random(seed)
    seqs = [(i, "".join(rng.choice("ACGTACGTACGTNx") for _ in range(rng.choice([0, 1, 5, 40, 300])))) for i in range(40)]
    motifs = MotifSet()
    for i in range(6):
        motifs.add_iupac(f"m{i}", "".join(rng.choice(list(CODES)) for _ in range(rng.randint(2, 7))), rng.randint(0, 2))
    df = spark.createDataFrame([*seqs, (99, None)], "seq_id long, seq string").repartition(3)
    for automaton in (True, False):
        got = sorted((r.seq_id, r.motif_id, r.reverse, r.start, r.end, r.seq_len) for r in scan.scan(df, motifs, automaton).collect())
        want = []
        for i, s in seqs:
            for m in motifs:
                for r in (False, True):
                    want += [(i, m.motif_id, r, a, a + len(m), len(s)) for a in brute(s, reverse_complement(m.pattern) if r else m.pattern, m.mismatches, automaton)]
        assert got == sorted(want)
    regex = sorted((r.seq_id, r.motif_id, r.reverse, r.start, r.end, r.seq_len) for r in scan.scan_regex(df.where("seq is not null"), motifs).collect())
    assert regex == sorted((r.seq_id, r.motif_id, r.reverse, r.start, r.end, r.seq_len) for r in scan.scan(df, motifs).collect())
    counts = {(r.seq_id, r.motif_id, r.reverse): r.n for r in scan.count_hits(df.where("seq is not null"), motifs).where("n > 0").collect()}
    assert sum(counts.values()) == len(regex)


def test_reverse_complement_mirrors_scans(spark):
    rng = random.Random(9)
    seq = "".join(rng.choice("ACGT") for _ in range(400))
    m = motif("GARN", 1)
    mirrored = sorted((len(seq) - 4 - s, not r) for s, r in hits(spark, seq, m))
    assert hits(spark, reverse_complement(seq), m) == mirrored


def test_pwm(spark):
    rng = random.Random(2)
    seq = "".join(rng.choice("ACGTN") for _ in range(200))
    rows = [[rng.uniform(-2, 2) for _ in range(5)] for _ in range(4)]
    motifs = MotifSet()
    motifs.add_pwm("w", rows, 0.5)
    df = spark.createDataFrame([(1, seq), (2, "AC"), (3, seq[:9])], "seq_id long, seq string")
    got = sorted((r.seq_id, r.reverse, r.start, round(r.score, 9)) for r in scan.scan(df, motifs).collect())
    want = []
    for i, s in ((1, seq), (3, seq[:9])):
        for a in range(len(s) - 4):
            forward = sum(rows["ACGT".index(c)][j] if c in "ACGT" else 0 for j, c in enumerate(s[a : a + 5]))
            back = sum(rows[3 - "ACGT".index(c)][4 - j] if c in "ACGT" else 0 for j, c in enumerate(s[a : a + 5]))
            want += [(i, r, a, round(v, 9)) for r, v in ((False, forward), (True, back)) if v >= 0.5]
    assert got == sorted(want)


def test_patterns():
    assert reverse_complement("GARN") == "NYTC"
    assert pattern_regex("GA") == "GA"
    with pytest.raises(ValueError):
        motif("GAX")
    with pytest.raises(ValueError):
        motif("GA", -1)


def test_duplicates_and_kmers():
    m = MotifSet()
    assert m.add_iupac("a", "GAGAG") and not m.add_iupac("b", "CTCTC", 2) and len(m) == 1
    assert m.add_iupac("b", "CTCTC", allow_duplicates=True)
    k = MotifSet()
    assert k.add_kmers(1) == 2 and [x.pattern for x in k] == ["A", "C"]
    assert MotifSet().add_kmers(3, allow_duplicates=True) == 64 and MotifSet().add_kmers(3) == 32
    r = MotifSet()
    r.add_random(30, 3, seed=1)
    assert len({min(x.pattern, reverse_complement(x.pattern)) for x in r}) == 30


@pytest.mark.parametrize("length,want", [(399, 1), (400, 0), (401, 1), (500, 1), (501, 2), (0, 0), (2999, 26)])
def test_window_numbers(spark, length, want):
    df = spark.createDataFrame([(1, length)], "seq_id long, len long")
    out = windows.sliding(df, 500, 100).orderBy("win").collect()
    assert len(out) == want
    assert all(r.win_start == r.win * 100 and r.win_len == min(500, length - r.win_start) for r in out)


def test_windows_of_occurrences(spark):
    rng = np.random.default_rng(0)
    rows = [(i, int(n), int(s), int(s + k)) for i, (n, s, k) in enumerate((int(rng.integers(1, 2500)), int(rng.integers(0, 2400)), int(rng.integers(1, 60))) for _ in range(400)) if s + k <= n]
    df = spark.createDataFrame(rows, "seq_id long, seq_len long, start long, end long")
    got = {(r.seq_id, r.win) for r in windows.occurrences_in_windows(df, 500, 100).collect()}
    cut = windows.sliding(df.select("seq_id", "seq_len"), 500, 100, length="seq_len").collect()
    place = {r[0]: r for r in rows}
    assert got == {(w.seq_id, w.win) for w in cut if place[w.seq_id][2] >= w.win_start and place[w.seq_id][3] <= w.win_start + w.win_len}
    with pytest.raises(ValueError):
        windows.sliding(df, 100, 100, length="seq_len")


@pytest.mark.parametrize("size", [7, 50, 1000])
def test_pieces_of_any_size_give_the_same_hits(spark, monkeypatch, size):
    rng = np.random.default_rng(4)
    rows = [(i, "".join(rng.choice(list("ACGTN"), p=[0.3, 0.2, 0.3, 0.18, 0.02], size=n))) for i, n in enumerate([0, 3, 60, 333, 1200])]
    wanted = MotifSet()
    for name, pattern, misses in (("a", "GAG", 0), ("b", "RNNGAGAGANC", 2), ("c", "ACAGT", 1), ("d", "GATC", 0), ("e", "GATTACAGATTACA", 5)):
        wanted.add_iupac(name, pattern, misses)
    wanted.add_pwm("w", [[1, 0, -1], [0, 1, 0], [0, 0, 1], [-1, 0, 0]], 1.0)
    want = []
    for i, s in rows:
        text = np.frombuffer(s.encode(), np.uint8)
        for m in wanted:
            for r in (False, True):
                if m.kind == "iupac":
                    want += [(i, m.motif_id, r, int(x)) for x in scan.iupac_hits(text, scan.reverse_complement(m.pattern) if r else m.pattern, m.mismatches)]
                else:
                    want += [(i, m.motif_id, r, int(x)) for x in np.flatnonzero(scan.pwm_scores(text, m.pwm, r) >= 1.0)]
    monkeypatch.setattr(scan.pieces, "__defaults__", (size,))
    found = []
    for text, row, first, begin, owned, held in scan.pieces([s.encode() for _, s in rows], wanted.max_len - 1):
        for m, r, at, _ in scan._motif_hits(text, list(wanted), True):
            stretch = np.searchsorted(first, at, side="right") - 1
            start = at - first[stretch] + begin[stretch]
            inside = (start < owned[stretch]) & (start + len(m) <= held[stretch])
            found += [(int(row[k]), m.motif_id, r, int(x)) for k, x in zip(stretch[inside], start[inside])]
    assert sorted(found) == sorted(want)
    monkeypatch.undo()
    got = scan.scan(spark.createDataFrame(rows, "seq_id long, seq string"), wanted).collect()
    assert sorted((r.seq_id, r.motif_id, r.reverse, r.start) for r in got) == sorted(want)
