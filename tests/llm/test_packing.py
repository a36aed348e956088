import itertools
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from strandline.llm import packing
from strandline.session import read_table


def brute_optimum(items, capacity):
    best = len(items)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(items):
            best = len(rooms)
            return
        for r in set(rooms):
            if r >= items[i]:
                rest = list(rooms)
                rest.remove(r)
                go(i + 1, [*rest, r - items[i]])
        go(i + 1, [*rooms, capacity - items[i]])

    go(0, [])
    return best


@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
@settings(max_examples=150, deadline=None)
def test_reduction_keeps_the_optimum(items):
    counts = {s: items.count(s) for s in items}
    fixed, rest = packing.dominance_reduction(dict(counts), 20)
    left = sorted((s for s, n in rest.items() for _ in range(n)), reverse=True)
    assert sorted(left + [s for m, n in fixed for s in m * n]) == sorted(items)
    assert all(sum(m) <= 20 for m, _ in fixed)
    optimum = brute_optimum(sorted(items, reverse=True), 20)
    assert sum(n for _, n in fixed) + brute_optimum(left, 20) == optimum
    plan = packing.plan_packing(dict(counts), 20)
    assert optimum <= plan.sequences <= optimum + 1


def test_plan_on_many_lengths():
    rng = np.random.default_rng(5)
    sizes = np.minimum(4096, rng.lognormal(6, 1.2, 50000).astype(int) + 1)
    counts = dict(zip(*(x.tolist() for x in np.unique(sizes, return_counts=True))))
    plan = packing.plan_packing(dict(counts))
    assert plan.sequences <= -(-int(sizes.sum()) // 4096) + 2
    length = np.repeat(list(counts), list(counts.values()))
    rank = np.concatenate([np.arange(n) for n in counts.values()])
    check_packed(*plan.slots(length, rank), length, 4096)


def check_packed(sequence, offset, length, capacity):
    order = np.lexsort((offset, sequence))
    s, o, n = sequence[order], offset[order], length[order]
    starts = np.r_[True, s[1:] != s[:-1]]
    assert (o[starts] == 0).all()
    assert (o[1:][~starts[1:]] == (o + n)[:-1][~starts[1:]]).all()
    assert (o + n <= capacity).all()


@pytest.fixture(scope="module")
def reference_ids():
    return Tokenizer.from_file(packing.tokenizer_path())


def test_word_cache_gives_the_tokenizers_ids(reference_ids):
    cache = packing.WordCache(packing.tokenizer_path())
    texts = ["", " ", "Don't stop; l'Été ÀÖØöøÿ ß naïve!", "a<|endoftext|>b <|startoftext|>", "x y z　w", "é ́a İI 漢字 12ab", "###$$$ &&& *** a.b,c", "tab\tnew\nline\x1cfs\x85nel", "ﬁ Ⅷ ½ µ ª", "😀 word😀", "﻿bom ​zero"]
    for t in texts:
        assert cache.encode(t.encode()) == np.array(reference_ids.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes(), t


def test_packed_documents(spark, sf, reference_ids):
    rows = [(r.doc_id, r.text) for r in read_table(spark, sf, "documents").collect()]
    long = " ".join(itertools.islice(itertools.cycle(["lorem", "ipsum,", "Dolor"]), 9000))
    rows += [(9001, None), (9002, ""), (None, "no id"), (9003, long), (9004, "twice"), (9004, "twice")]
    docs = spark.createDataFrame([(a, b, "x", "y") for a, b in rows], "doc_id long, text string, length string, cell string")
    out = packing.pack_documents(docs, keep_ids=True).toPandas()
    assert list(out.columns) == ["doc_id", "piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset"]
    check_packed(out.sequence_id.to_numpy(), out.offset.to_numpy(), out.length.to_numpy(), 4096)
    want = []
    for doc_id, text in rows:
        ids = [*reference_ids.encode(text or "", add_special_tokens=False).ids, 1]
        for piece, at in enumerate(range(0, len(ids), 4096)):
            part = np.array(ids[at : at + 4096], dtype="<u4").tobytes()
            want.append((-1 if doc_id is None else doc_id, piece, at, len(part) // 4, zlib.crc32(part)))
    got = out.fillna({"doc_id": -1})[["doc_id", "piece", "start", "length", "ids_crc32"]].astype(int).itertuples(index=False, name=None)
    assert sorted(got) == sorted(want)
    assert out.sequence_id.nunique() <= -(-int(out.length.sum()) // 4096) + 1


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack_documents(docs).count() == 0
