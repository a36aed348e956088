import json
import random
from collections import Counter

import pytest
from tokenizers import Tokenizer

from strandline.llm import packing, queries, rollup
from strandline.session import read_table


def shown(df):
    return {(r.source, r.lang, r.tokenizer): (r.docs, r.tokens) for r in df.collect()}


def test_random_changes_replays_and_compaction(spark, tmp_path):
    rng = random.Random(1)
    store = rollup.TokenRollup(spark, f"file://{tmp_path}/r")
    assert store.totals().count() == 0 and not store.compact()
    live, docs, tokens = {}, Counter(), Counter()
    sent = []
    for b in range(6):
        new = [(rng.choice(["a", "b", None]), rng.choice(["en", None]), rng.choice(["t1", "t2"]), rng.choice([0, 5, 9, None])) for _ in range(30)]
        gone = rng.sample(sorted(live, key=str), min(10, len(live)))
        for row in gone:
            del live[row]
        rows = [(*r[:3], 1, r[3]) for r in new] + [(*r[1:4], -1, r[4]) for r in gone]
        for i, r in enumerate(new):
            live[(f"{b}-{i}", *r)] = 1
        changes = spark.createDataFrame(rows, "source string, lang string, v string, sign int, n long")
        from pyspark.sql import functions as F

        parts = [rollup.signed(changes.where(f"sign = {s}"), s, F.col("v"), "n") for s in (1, -1)]
        sent.append((f"batch-{b}", parts[0].unionByName(parts[1])))
        assert store.commit(*sent[-1])
        assert not store.commit(*sent[rng.randrange(len(sent))])
        if b in (2, 4):
            assert store.compact()
        docs, tokens = Counter(), Counter()
        for _, s, lang, v, n in live:
            docs[s, lang, v] += 1
            tokens[s, lang, v] += n or 0
        assert shown(store.totals()) == {k: (docs[k], tokens[k]) for k in docs if docs[k] or tokens[k]}
    assert store.batches() == [f"batch-{b}" for b in range(6)]
    assert not any(store.commit(*x) for x in sent)


def test_two_writers(spark, tmp_path):
    a, b = (rollup.TokenRollup(spark, str(tmp_path / "r")) for _ in range(2))
    rows = spark.createDataFrame([("s", "en", 4, 7)], "source string, lang string, n_tokens long, new long")
    log, stale = b.log, [[], []]
    b._versions, real = lambda: [] if stale else real(), b._versions
    assert a.commit("one", rollup.inserted(rows, "v"))
    b.log = lambda: stale.pop() if stale else log()  # reads the log twice before a's entry is there
    assert b.commit("two", rollup.revised(rows, "v", "n_tokens", "new"))
    assert shown(a.totals()) == {("s", "en", "v"): (1, 7)}


class Killed(Exception):
    pass


@pytest.mark.parametrize("point", ["_write_temporary", "_rename", "_publish"])
def test_a_writer_that_dies_leaves_the_rollup_usable(spark, tmp_path, monkeypatch, point):
    rows = spark.createDataFrame([("s", "en", 4)], "source string, lang string, n_tokens long")
    store = rollup.TokenRollup(spark, str(tmp_path / "r"))
    assert store.commit("zero", rollup.inserted(rows, "v"))
    dying = rollup.TokenRollup(spark, str(tmp_path / "r"))

    def die(*_):
        raise Killed

    monkeypatch.setattr(dying, point, die)
    with pytest.raises(Killed):
        dying.commit("one", rollup.inserted(rows, "v"))
    with pytest.raises(Killed):
        dying.compact()
    assert shown(store.totals()) == {("s", "en", "v"): (1, 4)}
    assert store.commit("one", rollup.inserted(rows, "v")) and not store.commit("one", rollup.inserted(rows, "v"))
    assert store.compact() and store.commit("two", rollup.inserted(rows, "v"))
    assert shown(store.totals()) == {("s", "en", "v"): (3, 12)}
    assert store.vacuum() == 0 and store.vacuum(-1) > 0 and store.vacuum(-1) == 0
    assert shown(store.totals()) == {("s", "en", "v"): (3, 12)} and store.batches() == ["zero", "one", "two"]


def test_a_torn_entry_is_void(spark, tmp_path):
    rows = spark.createDataFrame([("s", "en", 4)], "source string, lang string, n_tokens long")
    store = rollup.TokenRollup(spark, str(tmp_path / "r"))
    store.commit("zero", rollup.inserted(rows, "v"))
    for n, text in ((1, ""), (2, '{"batches": ["x"]')):  # as a writer without the temporary name would leave them
        (tmp_path / "r" / "log" / f"{n:012d}.json").write_text(text)
    assert store.commit("one", rollup.inserted(rows, "v")) and store.compact()
    (tmp_path / "r" / "log" / "compacted").unlink()
    assert shown(store.totals()) == {("s", "en", "v"): (2, 8)} and store.batches() == ["zero", "one"]


def test_a_taken_number_is_refused(spark, tmp_path):
    store = rollup.TokenRollup(spark, str(tmp_path / "r"))
    for rename in (store._rename, store._rename_once):
        target = f"{rename.__name__}.json"
        assert rename(store._write_temporary({"n": 1}), target) and not rename(store._write_temporary({"n": 2}), target)
        assert json.loads(store._read(f"log/{target}")) == {"n": 1}
    with pytest.raises(ValueError):
        rollup.check_scheme("s3a")


def test_clashing_names_repeats_and_nulls(spark, tmp_path):
    store = rollup.TokenRollup(spark, str(tmp_path / "r"))
    rows = spark.createDataFrame([("s", None, 4, "x", "y"), ("s", None, 4, "x", "y"), (None, None, None, None, None)], "source string, lang string, n_tokens long, docs string, tokens string")
    store.commit("b", rollup.inserted(rows, "v"))
    store.commit("none", rollup.inserted(rows.where("false"), "v"))
    assert shown(store.totals()) == {("s", None, "v"): (2, 8), (None, None, "v"): (1, 0)}


@pytest.mark.parametrize("extra", [True, False])
def test_query_against_brute_force(spark, sf, tmp_path, extra):
    rows = [(r.doc_id, r.text, r.source, r.lang, r.n_chars) for r in read_table(spark, sf, "documents").collect()] if extra else []
    if extra:
        rows += [(90001, None, "s", "en", None), (90002, "", None, None, 0), (None, "null id", "s", "en", 7), (90003, "null id", "s", "en", 7), (90004, "r r", "s", "en", 3), (90004, "r r", "s", "en", 3), (90005, "w " * 60_000, "long", "en", 120_000)]
    spark.createDataFrame([(*r, 5, "x") for r in rows], "doc_id long, text string, source string, lang string, n_chars long, docs int, digest string").write.parquet(f"{tmp_path}/documents.parquet")
    first = {}
    for d, t, *_ in rows:
        if t is not None and d is not None:
            first[t] = min(d, first.get(t, d))
    many = Counter(t for _, t, *_ in rows)
    want: dict = {}
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    for d, t, s, lang, _ in rows:
        if t is not None and many[t] > 1 and d != first.get(t):
            continue
        for v, n in ((packing.TOKENIZER, len(tokenizer.encode(t or "", add_special_tokens=False).ids)), ("words-1", len((t or "").encode().split()))):
            a = want.setdefault((s, lang, v), [0, 0])
            a[0] += 1
            a[1] += n
    assert shown(queries.op1_token_rollup(spark, str(tmp_path))) == {k: tuple(v) for k, v in want.items()}
