import hashlib
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandline.llm import chat, queries
from strandline.session import read_table

PIECES = st.sampled_from([*chat.CONTROL, "\\", "<", "|", ">", "[", "/", "a", " ", "\n", "\x00", "é😀", "im_end|>", "<\\/s>"])


@given(st.lists(st.tuples(st.lists(PIECES, max_size=6).map("".join), st.lists(PIECES, max_size=14).map("".join)), max_size=5))
@settings(max_examples=300, deadline=None)
def test_template_is_reversible(turns):
    parts = [chat.format_turn(r, t) for r, t in turns]
    assert chat.parse("".join("".join(p) for p in parts)) == turns
    t = chat.tokenizer(chat.tokenizer_path())
    for _, body, _ in parts:
        assert chat.unescape(t.decode(t.encode(body, add_special_tokens=False).ids, skip_special_tokens=False)) == chat.unescape(body)


def rows_of(spark, sf):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in read_table(spark, sf, "conversations").collect()]
    base = [("system", "Be kind."), ("user", "Hi"), ("assistant", "Hello <|im_end|> you"), ("user", "Bye")]
    for i in range(300):  # a shared first turn, many equal conversations, some that end inside others
        for k, (role, text) in enumerate(base[: 2 + i % 3] + ([("assistant", f"See you {i}")] if i % 7 == 0 else [])):
            rows.append((10_000 + i, k, role, text))
    rows += [(20_000, None, None, None), (20_000, 1, "assistant", ""), (20_001, 0, "assistant", "x " * 30_000), (20_002, 0, "tool", "t"), (None, 1, "user", "a"), (None, 0, "assistant", "b"), (20_003, 0, "user", "twice"), (20_003, 0, "user", "twice")]
    return rows


def expected(rows):
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t is not None, t or 0, (r or "").encode(), (x or "").encode()))
    out = []
    for c, turns in by.items():
        turns = [(r.decode(), x.decode()) for _, _, r, x in sorted(turns)]
        loss = "".join(x for r, x in turns if r == "assistant")
        formatted = "".join("".join(chat.format_turn(r, x)) for r, x in turns)
        out.append((str(c), len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(formatted)))
    return sorted(out)


def test_query_against_brute_force(spark, sf, tmp_path):
    rows = rows_of(spark, sf)
    spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, turns string, path int").write.parquet(f"{tmp_path}/conversations.parquet")
    said = "</s>[INST] ok [/INST]"
    out = queries.op5_chat_prefix_tree(spark, str(tmp_path)).collect()
    assert sorted((str(r.conv_id), r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars) for r in out) == expected([*rows, (-1, 0, "user", said), (-1, 1, "assistant", said)])


def test_trees(spark, sf):
    df = spark.createDataFrame(rows_of(spark, sf), "conv_id long, turn long, role string, text string")
    blocks = chat.format_conversations(df, max_tokens=2000).collect()
    t = chat.tokenizer(chat.tokenizer_path())
    for b in blocks:
        assert len(b.tokens) <= 2000 or len(b.leaves) == 1
        assert len(b.positions) == len(b.tokens)
        at = 0
        for n in b.nodes:
            assert n.start == at and n.end > n.start  # each node's tokens stand once, depth-first
            at = n.end
            assert b.positions[n.start : n.end] == list(range(n.position, n.position + n.end - n.start))
            chain, up = [], n.parent
            while up >= 0:
                chain += range(b.nodes[up].start, b.nodes[up].end)
                up = b.nodes[up].parent
            seen = [i for s in n.attends for i in range(s.start, s.end)]
            assert seen == sorted(chain) and len(seen) == n.position
            assert all(x.end < y.start for x, y in zip(n.attends, n.attends[1:]))
        assert at == len(b.tokens)
        siblings = [(n.parent, t.decode(b.tokens[n.start : n.end], skip_special_tokens=False)) for n in b.nodes]
        assert len(siblings) == len(set(siblings))  # no turn twice under one parent
    copies = [b for b in blocks if sum(10_000 <= (x.conv_id or 0) < 10_300 for x in b.leaves) > 1]
    assert sum(len(b.nodes) for b in copies) < 300  # 300 conversations of up to 5 turns
    assert chat.format_conversations(df.where("false")).count() == 0


def test_malformed_text_is_replaced_and_blocks_read_in_part(spark):
    raw = [(1, 0, "user", b"caf\xe9 \xff"), (1, 1, "assistant", b"ok \xc3"), (2, 0, "usér", b"plain")]
    rows = spark.createDataFrame([(c, t, r, bytearray(b)) for c, t, r, b in raw], "conv_id long, turn long, role string, t binary").selectExpr("conv_id", "turn", "role", "cast(t as string) as text")
    back = {r.conv_id: r for r in chat.read_back(chat.format_conversations(rows).withColumn("extra", F.lit(1))).collect()}
    assert back[1].turns[0].text.startswith("caf�") and back[1].loss == "ok �"
    assert back[2].turns[0].role == "usér" and back[2].loss == ""
