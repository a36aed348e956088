import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandline.llm import infill


def brute(doc_id, text, seed="1", rate=90, spm_rate=20):
    text = text or ""
    n = len(text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return (doc_id, n, "plain", None, None, text)
    p, m, s = text[:a], text[a:b], text[b:]
    if h[3] % 100 < spm_rate:
        return (doc_id, n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}")
    return (doc_id, n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def key(row):
    return (row[0] is not None, row[0] or 0, row[5])


def test_against_slices_of_strings(spark):
    pieces = ["", "a", "é", "漢字", "😀😀", "plain words here", "<P", "<", "x<S>y", "<M>", "<P<P>", "line\nline\n", "́combining", "\u0000nul", " \t "]
    rows = [(i, pieces[i % len(pieces)] * (i % 4)) for i in range(400)] + [(None, "no id"), (7000, None), (7001, ""), (7002, "long é " * 400_000), (5, "twice"), (5, "twice")]
    docs = spark.createDataFrame([(a, b, "x", 1) for a, b in rows], "doc_id long, text string, output string, form long").repartition(5)
    out = infill.restored(infill.transform(docs)).collect()
    assert out[0].asDict().keys() == {"doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "restored"}
    want = sorted((brute(*r) for r in rows), key=key)
    assert sorted((tuple(r)[:6] for r in out), key=key) == want
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.restored) for r in out) == sorted((a is not None, a or 0, b or "") for a, b in rows)
    assert {r.form for r in out} == {"plain", "psm", "spm"}


def test_empty_table(spark):
    assert infill.restored(infill.transform(spark.createDataFrame([], "doc_id long, text string"))).count() == 0


def test_malformed_bytes_come_back(spark):
    raw = [bytes([0x80, 0x80, 0x41]), b"\xff\xfe abc \xc3", b"\xe4\xbd", b"\xf0\x9f\x98 tail" * 50]
    docs = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(raw)], "doc_id long, text binary").selectExpr("doc_id", "cast(text as string) as text")
    out = infill.restored(infill.transform(docs, rate=100)).selectExpr("doc_id", "form", "n", "cast(restored as binary) as b").collect()
    assert {r.doc_id: bytes(r.b) for r in out} == dict(enumerate(raw))
    assert all(r.form != "plain" for r in out)


@given(st.lists(st.text(alphabet="aé漢😀 \n<P>", max_size=12), min_size=1, max_size=12), st.sampled_from(["character", "word", "line"]), st.randoms())
@settings(max_examples=200, deadline=None)
def test_units_of_all_rows_at_once(texts, units, rnd):
    data = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(d) for d in data])]).astype(np.int64)
    draws = [np.array([rnd.randrange(1 << 32) for _ in texts]) for _ in range(2)]
    n, counts, cuts = infill.unit_cuts(np.frombuffer(b"".join(data), np.uint8), offsets, infill.UNITS[units], draws)
    for i, t in enumerate(texts):
        if units == "character":
            parts = list(t)
        elif units == "line":
            parts = [x + "\n" for x in t.split("\n")]
            parts[-1] = parts[-1][:-1]
            parts = [x for x in parts if x]
        else:
            parts, last = [], " "
            for c in t:
                if not parts or (last.isspace() and not c.isspace()):
                    parts.append("")
                parts[-1] += c
                last = c
        assert n[i] == len(parts)
        for c, at in zip(counts, cuts):
            assert at[i] - offsets[i] == len("".join(parts[: c[i]]).encode())


def test_forms_in_other_marks_and_units(spark):
    marks = infill.Marks("[pre]", "[suf]", "[mid]")
    docs = spark.createDataFrame([(i, f"one two\nthree {i} é") for i in range(300)], "doc_id long, text string")
    out = infill.transform(docs, units="word", rate=100, spm_rate=50, marks=marks)
    rows = infill.restored(out, marks=marks).collect()
    assert all(r.restored == f"one two\nthree {r.doc_id} é" and r.n == 5 for r in rows)
    assert 100 < sum(r.form == "spm" for r in rows) < 200


def test_marks_that_could_be_misread_are_refused():
    for bad in (("<P>", "<P>", "<M>"), ("<<", "<S>", "<M>"), ("<P", "<P>", "<M>"), ("", "<S>", "<M>")):
        with pytest.raises(ValueError):
            infill.Marks(*bad)
