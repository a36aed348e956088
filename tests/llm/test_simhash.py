from collections import defaultdict

import numpy as np
import pytest
import xxhash

from strandline.llm import simhash
from strandline.llm.graph import connected_components
from strandline.session import read_table


def plain_fingerprint(text, k=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", low) if w]
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), 42) for i in range(max(1, len(words) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(nodes, linked):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in linked:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 6])
def test_cells_give_the_components_of_all_links(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2**63, 12, dtype=np.uint64)
    values = np.unique(np.array([int(rng.choice(base)) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 7), replace=False)) for _ in range(400)], dtype=np.uint64))
    group = np.sort(rng.integers(0, 9, len(values)))
    a, b = simhash.spanning_edges(values, group, radius, list(range(64)))
    linked = [(i, j) for i in range(len(values)) for j in range(i) if group[i] == group[j] and int(values[i] ^ values[j]).bit_count() <= radius]
    at = {int(v): i for i, v in enumerate(values)}
    got = [(at[int(x)], at[int(y)]) for x, y in zip(a, b)]
    assert components(range(len(values)), got) == components(range(len(values)), linked)
    assert len(got) < len(values)


def test_links_lose_none(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 6, dtype=np.uint64)
    values = {int(rng.choice(base)) ^ sum(1 << int(b) for b in rng.choice(24, rng.integers(0, 5), replace=False)) for _ in range(700)}
    values |= {int(v) for v in rng.integers(0, 2**63, 300, dtype=np.uint64)}
    values = sorted(values)
    nodes = spark.createDataFrame([(v - 2**64 if v >= 2**63 else v,) for v in values], "fp long")
    at = {v: i for i, v in enumerate(values)}
    got = [(at[r.a % 2**64], at[r.b % 2**64]) for r in simhash.links(nodes, 2, cell=40, batch_rows=100).collect()]
    linked = [(i, j) for i in range(len(values)) for j in range(i) if (values[i] ^ values[j]).bit_count() <= 2]
    assert components(range(len(values)), got) == components(range(len(values)), linked)


def test_components(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(500, i) for i in range(501, 530)] + [(7, 7), (None, 3), (529, 9), (9, 529)]
    out = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "x long, y long"), "x", "y").collect()}
    assert out == {**{i: 100 for i in range(100, 141)}, **{i: 9 for i in [9, *range(500, 530)]}}


def test_near_duplicates_against_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in read_table(spark, sf, "documents").collect()]
    rows += [(90001, None), (90002, ""), (90003, " \n"), (90004, "One"), (90005, "one"), (90006, "ÉCOLE A"), (None, "only null id here"), (None, "One"), (90007, "word " * 50000), (90007, "word " * 50000)]
    docs = spark.createDataFrame([(a, b, 0, "x") for a, b in rows], "doc_id long, text string, fp int, component_id string")
    fps = [plain_fingerprint(t) for _, t in rows]
    distinct = sorted(set(fps))
    comp = components(distinct, [(a, b) for i, a in enumerate(distinct) for b in distinct[:i] if (a ^ b).bit_count() <= 2])
    least = defaultdict(list)
    for (d, _), f in zip(rows, fps):
        if d is not None:
            least[comp[f]].append(d)
    want = sorted((str(d), f"{f:016x}", min(least[comp[f]], default=None)) for (d, _), f in zip(rows, fps))
    out = simhash.near_duplicates(docs)
    got = sorted((str(r.doc_id), r.h, r.component_id) for r in out.select("*", simhash.fingerprint_hex(out.fp).alias("h")).collect())
    assert got == want


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
