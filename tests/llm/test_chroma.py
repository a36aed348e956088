import io
import wave
from collections import Counter, defaultdict

import numpy as np
import pytest

from strandline.llm import chroma


def wav(samples, rate):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.clip(samples, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def test_pitch_classes():
    t = np.arange(3 * 11025) / 11025
    for hz, pitch in ((440.0, 0), (880.0, 0), (261.63, 3), (493.88, 2)):
        image = chroma.chroma(np.sin(2 * np.pi * hz * t), 11025)
        assert (image.argmax(axis=1) == pitch).all()
        assert np.allclose(np.linalg.norm(image, axis=1), 1)
    assert not chroma.chroma(np.zeros(40_000), 11025).any()


def test_filters_against_plain_sums():
    rng = np.random.default_rng(0)
    image = rng.random((40, 12))
    integral = chroma.integral_image(image)
    n = len(image) - chroma.WIDTH + 1
    for kind, y, h, w in chroma.FILTERS:
        got = chroma.filter_values(integral, n, kind, y, h, w)
        for t in (0, 7, n - 1):
            r = image[t : t + w, y : y + h]
            part = {
                1: r[:, h // 2 :].sum(),
                2: r[w // 2 :].sum(),
                3: r[: w // 2, h // 2 :].sum() + r[w // 2 :, : h // 2].sum(),
                4: r[:, h // 3 : h - h // 3].sum(),
                5: r[w // 3 : w - w // 3].sum(),
            }.get(kind)
            want = np.log1p(r.sum()) - np.log1p(chroma.MEAN * h * w) if kind == 0 else np.log1p(part) - np.log1p(r.sum() - part)
            assert got[t] == pytest.approx(want)


def recordings():
    rng = np.random.default_rng(7)
    out, vectors = [], rng.normal(0, 0.125, (30, 160))
    for i, v in enumerate(vectors):
        samples, rate = chroma.melody(list(v), 11025)
        out.append((i * 10, wav(samples * 0.5, rate)))
        if i % 3 == 0:  # a later cut with noise, and an exact copy
            hop = chroma.FRAME // chroma.OVERLAP
            cut = samples[20 * hop :] * 0.4 + rng.normal(0, 0.003, len(samples) - 20 * hop)
            out.append((i * 10 + 3, wav(cut, rate)))
            out.append((i * 10 + 7, wav(samples * 0.5, rate)))
    return out + [(901, None), (902, b""), (903, b"no audio"), (904, wav(np.zeros(500), 11025)), (905, wav(np.zeros(60_000), 11025)), (None, out[0][1]), (0, out[0][1])]


def test_alignment_against_brute_force(spark):
    rows = recordings()
    out = chroma.align_all(spark.createDataFrame([(*r, "x", 1) for r in rows], "id long, wav binary, digest string, class_id int"), "id", "wav").collect()
    prints = [chroma.fingerprint(*chroma.decode_wav(w)) for _, w in rows]
    members = defaultdict(list)
    for (i, _), p in zip(rows, prints):
        if len(p):
            members[p.tobytes()].append(i)
    classes = {p: (min(x for x in ids if x is not None), any(x is not None and x % 20 == 0 for x in ids)) for p, ids in members.items()}
    assert Counter((str(r.rec_id), r.n_prints, r.class_id) for r in out) == Counter((str(i), len(p), classes.get(p.tobytes(), (None,))[0]) for (i, _), p in zip(rows, prints))

    def errors(a, b):
        """Best offset by shared runs, and the differing bits at it."""
        hits = Counter(j - i for i in range(len(a) - 1) for j in range(len(b) - 1) if (a[i : i + 2] == b[j : j + 2]).all())
        if not hits:
            return None
        offset = max(hits, key=lambda o: (hits[o], -abs(o), o))
        x, y = a[max(0, -offset) :], b[max(0, offset) :]
        n = min(len(x), len(y))
        return np.bitwise_count(x[:n] ^ y[:n]).sum() / (32 * n), offset

    want = {}
    arrays = {c: np.frombuffer(p, np.uint32) for p, (c, _) in classes.items()}
    for p, (c, asks) in classes.items():
        if asks:
            found = [(e[0], m, e[1]) for m, b in arrays.items() if m != c and (e := errors(arrays[c], b)) and e[0] <= chroma.MAX_ERROR]
            want[c] = (len(found), *(min(found) if found else (None, None, None)))
    for r in out:
        if r.class_id in want:
            n, e, m, o = want[r.class_id]
            assert (r.n_links, r.best_class, r.best_offset) == (n, m, o) and (e is None or r.best_errors == pytest.approx(e))
        else:
            assert r.n_links is None and r.best_class is None
    by = {r.rec_id: r for r in out}
    cuts = [i for i in range(0, 300, 60)]
    assert all(by[i].n_links >= 1 and by[i].best_class == i + 3 and by[i].best_offset == -20 for i in cuts)


def test_melodies_and_empty_table(spark):
    assert len(chroma.fingerprint(*chroma.melody(None))) == 0
    assert len(chroma.fingerprint(*chroma.melody([None, float("nan"), 0.1] * 30))) > 0
    assert chroma.align_all(spark.createDataFrame([], "id long, v array<float>"), "id", "v", chroma.melody).count() == 0


def test_noisy_copies_without_shared_runs_are_aligned(spark):
    rng = np.random.default_rng(3)
    clean = rng.integers(0, 2**32, (20, 60), dtype=np.uint64).astype(np.uint32)
    noise = [np.packbits(rng.random((60, 32)) < e, axis=1).view("<u4").ravel() for e in (0.05, 0.1, 0.15, 0.2) * 5]
    noisy = [(c ^ x)[k:] for k, (c, x) in enumerate(zip(clean, noise))]
    rows = [(i, p.view(np.int32).tolist()) for i, p in enumerate(clean)] + [(100 + i, p.view(np.int32).tolist()) for i, p in enumerate(noisy)]
    df = spark.createDataFrame(rows, "class_id long, prints array<int>")
    got = {(r.query, r.match, r.offset) for r in chroma.align(df.where("class_id < 100"), df).collect()}
    assert got == {(i, 100 + i, -i) for i in range(20)}


@pytest.mark.parametrize("lengths", [(0, 1, 23, 24, 25, 30, 60, 90), (24,), (42,), (5, 500)])
def test_all_offsets_of_all_pairs_against_brute_force(lengths):
    rng = np.random.default_rng(11)
    base = rng.integers(0, 2**32, 600, dtype=np.uint64).astype(np.uint32)

    def some(k):
        for _ in range(k):
            n, at = int(rng.choice(lengths)), int(rng.integers(0, 50))
            noise = np.packbits(rng.random((n, 32)) < rng.choice([0, 0.1, 0.24, 0.25, 0.26]), axis=1).view("<u4").ravel()
            yield base[at : at + n] ^ noise.astype(np.uint32)

    queries, classes = list(some(12)), list(some(30))
    for error in (0.25, 0.4, 0.6):
        want = []
        for i, q in enumerate(queries):
            for j, c in enumerate(classes):
                for o in range(1 - len(q), len(c)):
                    x, y = q[max(0, -o) :], c[max(0, o) :]
                    n = min(len(x), len(y))
                    if n >= 24 and (d := int(np.bitwise_count(x[:n] ^ y[:n]).sum())) <= error * 32 * n:
                        want.append((i, j, o, n, d))
        assert sorted(chroma.passing_offsets(queries, classes, error, 24)) == want


def test_offsets_of_a_pair_share_their_products():
    """The work of a pair: a product of spectra, not a product for each of its offsets."""
    rng = np.random.default_rng(5)
    rows, size = rng.integers(0, 2**32, (8, 42), dtype=np.uint64).astype("<u4"), np.full(8, 42)
    found = list(chroma.agreements(rows, size, rows, size, 24))
    assert len(found) == 2 and sorted(o for x in found for o in x[2].tolist()) == list(range(-18, 19))
    at = {o: s for _, _, offsets, scores in found for o, s in zip(offsets.tolist(), scores)}
    assert np.allclose(np.diag(at[0]), 32 * 42, atol=0.1)
