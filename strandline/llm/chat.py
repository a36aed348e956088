"""Chat formatting over a prefix tree.

Conversations are formatted turn by turn; those that share initial turns share nodes of a tree. Sorting conversations by
their path of turn digests is a depth-first order, so tasks walk ranges of that order and pack whole subtrees into
blocks of at most `max_tokens` tokens (a longer conversation gets a block of its own; turns shared by two blocks stand
in both, as no attention crosses blocks). In a block each node's tokens stand once; positions go on from the parent's,
and the attention intervals of a node are its ancestors' token ranges, merged where they adjoin.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.graph import written
from strandline.session import map_arrow, ship_package

#: Fixed control strings of common chat templates; those of this one first.
START, MIDDLE, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
CONTROL = [START, MIDDLE, END, "<|endoftext|>", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
TOKENIZER = "byte_bpe_50k.json"
MAX_TOKENS = 8192
MAX_LEAVES = 4096
_CONTROL = re.compile("|".join(map(re.escape, CONTROL)) + r"|\\")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(re.escape(START) + "(.*?)" + re.escape(MIDDLE) + "(.*?)" + re.escape(END) + "\n", re.DOTALL)


def escape(text: str) -> str:
    """A backslash is doubled; a control string gets one after its first character, and so is none any more."""
    return _CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def format_turn(role: str, text: str) -> tuple[str, str, str]:
    """(before, body, after) of one turn: the body alone is the text."""
    return f"{START}{escape(role)}{MIDDLE}", escape(text), f"{END}\n"


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at {at}: {formatted[at : at + 40]!r}")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


_TOKENIZERS: dict = {}
_MARKS: dict[str, list[int]] = {}


def tokenizer(path: str):
    """Byte-level tokenizer for which special strings in a text are ordinary text."""
    if path not in _TOKENIZERS:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        _TOKENIZERS[path] = t
    return _TOKENIZERS[path]


_INTERVALS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_NODES = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("parent", pa.int32()), ("position", pa.int32()), ("loss_start", pa.int32()), ("loss_end", pa.int32()), ("attends", _INTERVALS)]))
_LEAVES = pa.list_(pa.struct([("conv_id", pa.int64()), ("node", pa.int32())]))
BLOCKS = pa.schema([("tokens", pa.list_(pa.int32())), ("positions", pa.list_(pa.int32())), ("nodes", _NODES), ("leaves", _LEAVES)])
BLOCKS_DDL = (
    "tokens array<int>, positions array<int>, nodes array<struct<start:int,end:int,parent:int,position:int,loss_start:int,loss_end:int,attends:array<struct<start:int,end:int>>>>, leaves array<struct<conv_id:bigint,node:int>>"
)


class Block:
    """A tree of turns in depth-first order, as it grows."""

    def __init__(self, path: str, roles: frozenset[str]):
        self.tokenizer, self.roles = tokenizer(path), roles
        self.tokens: list[int] = []
        self.positions: list[int] = []
        self.nodes: list[dict] = []
        self.leaves: list[dict] = []
        self.stack: list[tuple[bytes, int]] = []  # (digest, node) from the root to the last node

    def encode(self, turns: list[tuple[str, str]]) -> list[list[list[int]]]:
        """Ids of what stands before, in and after each turn's text; marks of up to 1000 roles are encoded once."""
        parts = [format_turn(role, text) for role, text in turns]
        bodies = self.tokenizer.encode_batch([p[1] for p in parts], add_special_tokens=False)
        return [[self.mark(head), body.ids, self.mark(tail)] for (head, _, tail), body in zip(parts, bodies)]

    def mark(self, text: str) -> list[int]:
        ids = _MARKS.get(text)
        if ids is None:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            if len(_MARKS) < 1000:
                _MARKS[text] = ids
        return ids

    def shared(self, digests: list[bytes]) -> int:
        n = 0
        while n < min(len(digests), len(self.stack)) and self.stack[n][0] == digests[n]:
            n += 1
        return n

    def add(self, conv_id: int | None, digests: list[bytes], turns: list[tuple[str, str]], encoded: list[list[list[int]]]) -> None:
        """encoded: of the turns that aren't shared with the stack."""
        n = len(digests) - len(encoded)
        del self.stack[n:]
        for digest, (role, _), (head, body, tail) in zip(digests[n:], turns[n:], encoded):
            parent = self.stack[-1][1] if self.stack else -1
            above = self.nodes[parent] if self.stack else None
            position = above["position"] + above["end"] - above["start"] if above else 0
            start = len(self.tokens)
            attends = [dict(x) for x in above["attends"]] if above else []
            if above:
                if attends and attends[-1]["end"] == above["start"]:
                    attends[-1]["end"] = above["end"]
                else:
                    attends.append({"start": above["start"], "end": above["end"]})
            size = len(head) + len(body) + len(tail)
            loss = (start + len(head), start + len(head) + len(body)) if role in self.roles else (start, start)
            self.tokens += head + body + tail
            self.positions += range(position, position + size)
            self.stack.append((digest, len(self.nodes)))
            self.nodes.append({"start": start, "end": start + size, "parent": parent, "position": position, "loss_start": loss[0], "loss_end": loss[1], "attends": attends})
        self.leaves.append({"conv_id": conv_id, "node": self.stack[-1][1]})


def turn_digests(turns: list[tuple[str, str]]) -> list[bytes]:
    """A digest of each turn and all before it."""
    out, chain = [], b""
    for role, text in turns:
        r = role.encode("utf-8", "surrogatepass")
        chain = hashlib.sha256(chain + len(r).to_bytes(8, "big") + r + text.encode("utf-8", "surrogatepass")).digest()[:16]
        out.append(chain)
    return out


def format_conversations(rows: DataFrame, max_tokens: int = MAX_TOKENS, loss_roles: tuple[str, ...] = ("assistant",), path: str | None = None) -> DataFrame:
    """Blocks (BLOCKS_DDL) of all conversations of rows (conv_id, turn, role, text; others are not read).

    Turns are ordered by turn (nulls first), then role and text; repeated rows are turns of their own; null roles and
    texts are empty; rows with a null conv_id are one conversation. A conversation is held whole by one task, as its
    sequence is; conversations with equal turns share all nodes and have a leaf each. Malformed UTF-8 is read with replacement
    characters, other columns are not read. An empty table has no blocks. Turns are gathered and digested once and
    written, as ranging them by path reads them twice."""
    ship_package(rows.sparkSession)
    path = path or tokenizer_path()
    roles = frozenset(loss_roles)
    empty = F.lit("")
    turn = F.struct(F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.make_valid_utf8(F.col(c).cast("string")), empty).alias(c) for c in ("role", "text")])
    whole = rows.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from strandline.llm.chat import turn_digests

        for b in batches:
            digests = [b"".join(turn_digests([(t["role"], t["text"]) for t in x])) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(digests, pa.binary())], names=["conv_id", "turns", "path"])

    turns_ddl = "turns array<struct<turn:bigint,role:string,text:string>>"
    digested = written(map_arrow(whole, paths, f"conv_id long, {turns_ddl}, path binary"), "conversations", rows.count())  # a row is a turn at least
    sorted_ = digested.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from strandline.llm.chat import BLOCKS, MAX_LEAVES, Block

        def out(block: Block) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"tokens": block.tokens, "positions": block.positions, "nodes": block.nodes, "leaves": block.leaves}], schema=BLOCKS)

        block = Block(path, roles)
        for b in batches:
            for conv_id, turns, joined in zip(*(c.to_pylist() for c in b.columns)):
                turns = [(t["role"], t["text"]) for t in turns]
                digests = [joined[i : i + 16] for i in range(0, len(joined), 16)]
                n = block.shared(digests)
                encoded = block.encode(turns[n:])
                if block.leaves and (len(block.leaves) >= MAX_LEAVES or len(block.tokens) + sum(len(p) for t in encoded for p in t) > max_tokens):
                    yield out(block)
                    block = Block(path, roles)
                    encoded = block.encode(turns[:n]) + encoded
                block.add(conv_id, digests, turns, encoded)
        if block.leaves:
            yield out(block)

    return map_arrow(sorted_, pack, BLOCKS_DDL)


def read_back(blocks: DataFrame, path: str | None = None) -> DataFrame:
    """One row per leaf of the blocks: conv_id, formatted, turns (role, text), loss (all text under the loss mask,
    unescaped), read from tokens, attention intervals and loss ranges alone. A leaf reads the nodes whose tokens it attends to,
    found by their starts. Null conv_ids and repeated leaves stay, blocks without leaves have no rows, very long
    conversations are read whole, further columns are not read, and no blocks give no rows."""
    ship_package(blocks.sparkSession)
    path = path or tokenizer_path()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from strandline.llm.chat import parse, tokenizer, unescape

        decode = tokenizer(path).decode
        kinds = [pa.int64(), pa.string(), pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])), pa.string()]
        for b in batches:
            rows = []
            for ids, nodes, leaves in zip(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist()):
                tokens, known, said = ids.values.to_numpy().tolist(), {}, {}
                starts = [x["start"] for x in nodes]  # ascending, as nodes stand depth first
                for leaf in leaves:
                    node = nodes[leaf["node"]]
                    if leaf["node"] not in known:
                        spans = [*node["attends"], node]
                        formatted = decode([t for s in spans for t in tokens[s["start"] : s["end"]]], skip_special_tokens=False)
                        inside = [i for s in spans for i in range(bisect_left(starts, s["start"]), bisect_left(starts, s["end"]))]
                        for i in inside:
                            if i not in said:
                                said[i] = unescape(decode(tokens[nodes[i]["loss_start"] : nodes[i]["loss_end"]], skip_special_tokens=False))
                        loss = "".join(said[i] for i in inside)
                        known[leaf["node"]] = (formatted, [{"role": r, "text": t} for r, t in parse(formatted)], loss)
                    rows.append((leaf["conv_id"], *known[leaf["node"]]))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["conv_id", "formatted", "turns", "loss"])

    return map_arrow(blocks.select("tokens", "nodes", "leaves"), read, "conv_id long, formatted string, turns array<struct<role:string,text:string>>, loss string")


def _marks(column: str) -> str:
    """DuckDB: code points of a column when escaped."""
    return f"(length({column}) + len(regexp_extract_all({column}, '{_CONTROL.pattern}')))"


#: The digests of op5's query in DuckDB's SQL, over the table conversations and the added conversation -1.
ORACLE = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum({len(START + MIDDLE + END) + 1} + {_marks("role")} + {_marks("text")})::BIGINT AS formatted_chars
FROM rows GROUP BY conv_id
"""
