import hashlib

import pytest
from pyspark.sql import functions as F

from strandline.llm import merkle

DDL = "doc_id long, source string, lang string, n_chars long, text string"


def H(*parts):
    return hashlib.sha256("".join(parts).encode("utf-8", "surrogateescape")).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def brute(rows, fanout):
    """(doc_id, leaf, subroot, root, siblings in order) of all rows."""
    leaves = [(r[1], r[0], H(*map(field, r))) for r in rows]

    def tree(level):
        levels = [level]
        while len(levels[-1]) > 1:
            below = levels[-1]
            levels.append([H(*below[i : i + fanout]) for i in range(0, len(below), fanout)])
        return levels

    def siblings(levels, i):
        out = []
        for level in levels[:-1]:
            first = i // fanout * fanout
            out += [d for j, d in enumerate(level[first : first + fanout], first) if j != i]
            i //= fanout
        return out

    names = sorted({x[0] for x in leaves}, key=lambda s: (s is not None, (s or "").encode()))
    groups = {s: sorted((x for x in leaves if x[0] == s), key=lambda x: (x[1] is not None, x[1] or 0, x[2])) for s in names}
    trees = {s: tree([x[2] for x in g]) for s, g in groups.items()}
    top = tree([trees[s][-1][0] for s in names])
    return [(x[1], x[2], trees[s][-1][0], top[-1][0], H(*siblings(trees[s], i), *siblings(top, j))) for j, s in enumerate(names) for i, x in enumerate(groups[s])]


def sources(counts):
    rows, n = [], 0
    for name, count in counts.items():
        for i in range(count):
            rows.append((n * 7919 % 100003, name, "en" if i % 3 else None, i if i % 4 else None, f"Text {n} É" * (i % 5) if i % 11 else None))
            n += 1
    return rows


SHAPES = {
    "a hot source, lone leaves and runs of one": ({None: 3, "a": 1, "b": 17, "É": 16, "hot": 700, "z": 257, "Z": 33}, 16, 4),
    "many sources": ({f"s{i}": 1 + i % 3 for i in range(70)}, 4, 2),
    "deep trees of pairs": ({"x": 65, "y": 130, "": 1}, 2, 2),
    "one source": ({"only": 40}, 16, 4),
    "one leaf": ({"only": 1}, 16, 4),
}


@pytest.mark.parametrize("name", SHAPES)
def test_against_a_tree_built_by_hand(spark, name):
    counts, fanout, high = SHAPES[name]
    rows = sources(counts)
    table = spark.createDataFrame([(*r, "clash", 1) for r in rows], f"{DDL}, tree string, idx long").repartition(5)
    m = merkle.build(table, fanout=fanout, block_levels=high)
    out = merkle.proofs(m).withColumn("proof", merkle.proof_digest(F.col("path"))).withColumn("folded", merkle.folded(F.col("leaf"), F.col("path"))).collect()
    got = sorted((r.doc_id, r.leaf, r.subroot, m.root, r.proof) for r in out)
    assert got == sorted(brute(rows, fanout))
    assert all(r.folded == m.root for r in out)


def test_paths_without_a_broadcast_are_the_same(spark, monkeypatch):
    rows = sources({"a": 70, "b": 5})
    monkeypatch.setattr(merkle, "BROADCAST_BLOCKS", 0)
    m = merkle.build(spark.createDataFrame(rows, DDL), fanout=4, block_levels=2)
    out = merkle.proofs(m).select("doc_id", "leaf", "subroot", merkle.proof_digest(F.col("path"))).collect()
    assert sorted(map(tuple, out)) == sorted((a, b, c, e) for a, b, c, _, e in brute(rows, 4))


def test_proofs_of_some_leaves_and_tampering(spark):
    rows = sources({"a": 300, "b": 20, None: 2})
    docs = spark.createDataFrame(rows, DDL)
    m = merkle.build(docs, carry={"claimed": merkle.leaf_digest([F.concat(F.col(c), F.lit("!")) if c == "text" else F.col(c) for c in merkle.FIELDS])})
    asked = m.leaves.where("idx % 50 = 3 OR source = 'b'")
    out = merkle.proofs(m, asked).withColumn("ok", merkle.folded(F.col("leaf"), F.col("path")) == m.root).withColumn("bad", merkle.folded(F.col("claimed"), F.col("path")) == m.root).collect()
    assert len(out) == 6 + 20
    assert all(r.ok for r in out)
    assert {r.bad for r in out if r.claimed != r.leaf} == {False}
    assert any(r.claimed == r.leaf for r in out)


def test_ties_repeats_nulls_long_and_malformed_texts(spark):
    rows = [(1, "s", "en", 3, "abc"), (1, "s", "en", 3, "abc"), (1, "s", "en", 3, "abd"), (None, "s", None, None, None), (None, None, None, None, ""), (2, "s", "en", 1, "x" * 3_000_000)] + [(5, "t", None, 1, "same")] * 40
    m = merkle.build(spark.createDataFrame(rows, DDL))
    out = merkle.proofs(m).withColumn("proof", merkle.proof_digest(F.col("path"))).collect()
    order = lambda x: tuple((v is not None, v or 0) if not isinstance(v, str) else (True, v) for v in x)
    assert sorted(((r.doc_id, r.leaf, r.subroot, m.root, r.proof) for r in out), key=order) == sorted(brute(rows, 16), key=order)
    raw = spark.createDataFrame([(1, bytearray(b"\xff\xc3"))], "doc_id long, t binary").selectExpr("doc_id", "'s' source", "'en' lang", "2L n_chars", "cast(t as string) text")
    want = hashlib.sha256(b"1:11:s2:en1:22:\xff\xc3").hexdigest()
    assert merkle.build(raw).root == want


def test_empty_table_and_clashing_names(spark):
    empty = spark.createDataFrame([], DDL)
    m = merkle.build(empty)
    assert m.root is None and merkle.proofs(m).count() == 0 and m.nodes.count() == 0
    with pytest.raises(ValueError):
        merkle.build(empty, carry={"idx": F.lit(1)})
