import zlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from strandline.llm import bytebpe, vector_packing
from strandline.llm.vector_packing import Example, Limits, VectorPacker
from strandline.session import read_table


def check(rows, limits):
    """rows: (example, start, length, loss, sequence, offset); gapless, within the limits, and nothing to pad."""
    sequences, examples = defaultdict(list), defaultdict(list)
    for e, start, length, loss, sequence, offset in rows:
        sequences[sequence].append((offset, length, loss))
        examples[e].append((start, length))
    for parts in sequences.values():
        at = 0
        for offset, length, _ in sorted(parts):
            assert offset == at
            at += length
        assert at == limits.tokens or (at < limits.tokens and at & (at - 1) == 0)
        assert len(parts) <= limits.segments
        assert sum(p[2] for p in parts) <= limits.loss
    return sequences, examples


def covered(parts):
    at = 0
    for start, length in sorted(parts):
        assert start == at
        at += length
    return at


@st.composite
def spans(draw):
    n = draw(st.integers(1, 60))
    cuts = sorted(draw(st.lists(st.integers(0, n), max_size=6)))
    return n, [(a, b) for a, b in zip(cuts[::2], cuts[1::2])]


@given(st.lists(spans(), max_size=40), st.integers(1, 5), st.integers(0, 24), st.integers(1, 4))
@settings(max_examples=200, deadline=None)
def test_limits_hold_and_every_token_has_one_place(examples, segments, loss, cells):
    limits, packer = Limits(24, segments, loss), VectorPacker(Limits(24, segments, loss))
    made = [Example(i, np.arange(n, dtype="<u4"), s) for i, (n, s) in enumerate(examples)]
    rows, sequence = [], 0
    step = -(-len(made) // cells) or 1
    parts = [made[i : i + step] for i in range(0, len(made), step)] + [[]]
    for part in parts:
        packer.add(part)
        for placed in packer.sequences(part == []):
            offset = 0
            for i, at, n in placed:
                e = packer.examples[i]
                bearing = {t for a, b in e.spans for t in range(a, b)}
                rows.append((e.key, at, n, sum(t in bearing for t in range(at + 1, at + n)), sequence, offset))
                offset += n
            sequence += 1
    _, found = check(rows, limits)
    assert {e: covered(p) for e, p in found.items()} == {i: n for i, (n, _) in enumerate(examples)}


def test_dot_product_prefers_what_the_room_is_for():
    """Room for many tokens and little loss: the prompt-heavy example goes first, whatever its place."""
    packer = VectorPacker(Limits(100, 10, 30))
    packer.add([Example("answers", np.zeros(40, "<u4"), [(0, 40)]), Example("prompt", np.zeros(60, "<u4"), [(50, 60)]), Example("short", np.zeros(25, "<u4"), [(5, 20)])])
    first = next(packer.sequences(False))
    assert [packer.examples[i].key for i, _, _ in first[:2]] == ["prompt", "short"]


def test_documents_of_a_table(spark, sf):
    tokenizer = Tokenizer.from_file(bytebpe.tokenizer_path())
    rows = [(r.doc_id, r.text) for r in read_table(spark, sf, "documents").collect()]
    rows += [(9001, None), (9002, ""), (9003, "lorem Ipsum, " * 30000), (9004, "a <|endoftext|> b  \n\n é　漢"), (9005, "tiny")] + [(10000 + i, "x") for i in range(500)]
    docs = spark.createDataFrame([(a, b, "x", 0) for a, b in rows], "doc_id long, text string, ids string, offset long").repartition(3)
    out = vector_packing.pack_documents(docs).collect()
    want = {k: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for k, t in rows}
    for r in out:
        ids = want[r.doc_id]
        assert r.doc_tokens == len(ids) and r.loss_tokens == r.length - 1
        assert bytes(r.ids) == ids[r.start : r.start + r.length].tobytes() and r.ids_crc32 == zlib.crc32(r.ids)
    sequences, found = check([(r.doc_id, r.start, r.length, r.loss_tokens, r.sequence_id, r.offset) for r in out], Limits())
    assert {k: covered(p) for k, p in found.items()} == {k: len(v) for k, v in want.items()}
    full = sum(sum(p[1] for p in parts) == 2048 for parts in sequences.values())
    assert full >= len(sequences) - 3 * 14
    again = vector_packing.pack_documents(docs).select("doc_id", "start", "sequence_id", "offset").collect()
    assert sorted(again) == sorted((r.doc_id, r.start, r.sequence_id, r.offset) for r in out)


def test_examples_with_spans_nulls_repeats_and_malformed_text(spark):
    ids = np.arange(3000, dtype="<u4").tobytes()
    rows = [("a", ids, [(100, 2900)]), ("a", ids, [(100, 2900)]), (None, ids[:400], None), ("empty", b"", None), ("null", None, None), ("none", ids[:40], [])]
    table = spark.createDataFrame([(k, None if i is None else bytearray(i), s, 1) for k, i, s in rows], "id string, ids binary, loss array<struct<start:long,end:long>>, length int").coalesce(1)
    limits = Limits(1024, 8, 700)
    out = vector_packing.pack_examples(table, limits=limits).collect()
    check([(r.id, r.start, r.length, r.loss_tokens, r.sequence_id, r.offset) for r in out], limits)
    assert sum(r.length for r in out) == 3000 + 3000 + 100 + 10 and {r.id for r in out} == {"a", None, "none"}
    assert vector_packing.pack_examples(table.limit(0)).count() == 0
    broken = spark.createDataFrame([(1, bytearray(b"\xff\xfe abc \xc3"))], "doc_id long, text binary").selectExpr("doc_id", "cast(text as string) text")
    assert vector_packing.pack_documents(broken).count() >= 1
