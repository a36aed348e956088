"""Vector bin packing of training examples by the dot-product heuristic.

A sequence has limits on tokens, on segments and on loss-bearing tokens. It is filled greedily with the example whose
demands have the largest dot product with the room left, each dimension divided by its limit and weighted by its mean
demand (Panigrahy et al., 2011). Where no whole example fits, one is cut so that the sequence is full; the rest of it
stays an example. A sequence that the other limits end before it is full gives back what is beyond the largest power of
two in it, as such lengths need no padding. So nothing is padded.

Each task packs the rows that it reads, some thousand at a time, and carries what is left to the next ones: no shuffle,
no order between tasks, and no row that waits for another partition. A task ends with at most a dozen short sequences.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from strandline.llm.bytebpe import loaded, tokenizer_path
from strandline.session import map_arrow

END_ID = 1
#: Examples and tokens that are packed together; one longer example is taken as it is.
CELL_EXAMPLES = 4096
CELL_TOKENS = 1 << 21
#: Of the longest examples, how many are tried as the one to cut.
CUT_TRIES = 16


@dataclass(frozen=True)
class Limits:
    tokens: int = 2048
    segments: int = 64
    loss: int = 2047

    def __post_init__(self):
        if min(self.tokens, self.segments) < 1 or self.loss < 0:
            raise ValueError("a sequence holds a token and a segment at least")


class Example:
    """Ids, and ascending spans of loss-bearing tokens. The first token of a piece has nothing before it to be predicted
    from and bears none."""

    __slots__ = ("key", "ids", "spans")

    def __init__(self, key, ids: np.ndarray, spans: list[tuple[int, int]]):
        self.key, self.ids, self.spans = key, ids, spans

    def loss(self, start: int, end: int) -> int:
        return sum(max(0, min(b, end) - max(a, start + 1)) for a, b in self.spans)

    def longest(self, start: int, limit: int, loss: int) -> int:
        """Tokens of the longest piece from start on within both limits; 1 at least."""
        lo, hi = 1, min(limit, len(self.ids) - start)
        while lo < hi:
            middle = (lo + hi + 1) // 2
            lo, hi = (middle, hi) if self.loss(start, start + middle) <= loss else (lo, middle - 1)
        return lo


class VectorPacker:
    """Examples that wait, as columns: start, length and loss of what is left of each."""

    def __init__(self, limits: Limits):
        self.limits, self.examples = limits, []
        self.start, self.length, self.loss = (np.zeros(0, np.int64) for _ in range(3))
        self.tokens = 0

    def add(self, examples: list[Example]) -> None:
        left = np.flatnonzero(self.length)
        self.examples = [self.examples[i] for i in left] + examples
        sizes = np.array([len(e.ids) for e in examples], np.int64)
        loss = np.array([e.loss(0, len(e.ids)) for e in examples], np.int64)
        new = (np.zeros(len(examples), np.int64), sizes, loss)
        self.start, self.length, self.loss = (np.concatenate([x[left], y]) for x, y in zip((self.start, self.length, self.loss), new))
        self.tokens += int(sizes.sum())

    def _move(self, i: int, by: int) -> None:
        """What is left of an example begins `by` tokens later (earlier, if negative)."""
        e = self.examples[i]
        self.start[i] += by
        self.length[i] -= by
        self.loss[i] = e.loss(int(self.start[i]), len(e.ids))
        self.tokens -= by

    def _cut(self, room: int, loss: int, empty: bool) -> tuple[int, int] | None:
        """(example, tokens) of a piece that fills the room; at the start of a sequence, one that fills it as far as the
        limit on loss allows. Long examples are preferred, so that what is left of them is long too."""
        longest = np.argsort(-self.length, kind="stable")[:CUT_TRIES].tolist()
        for i in longest:
            at = int(self.start[i])
            if self.length[i] >= room and self.examples[i].loss(at, at + room) <= loss:
                return i, room
        return (longest[0], self.examples[longest[0]].longest(int(self.start[longest[0]]), room, loss)) if empty else None

    def sequence(self, weights: np.ndarray) -> list[tuple[int, int, int]]:
        """The next sequence: (example, start, length)."""
        cap, placed = self.limits, []
        room, segments, loss = cap.tokens, cap.segments, cap.loss
        while room and segments and self.tokens:
            fits = (self.length > 0) & (self.length <= room) & (self.loss <= loss)
            # each piece is one segment, so that dimension adds the same to all and decides only through the limit
            score = np.where(fits, self.length * (weights[0] * room) + self.loss * (weights[1] * loss), -1.0)
            i = int(np.argmax(score))
            choice = (i, int(self.length[i])) if score[i] >= 0 else self._cut(room, loss, not placed)
            if choice is None:
                break
            i, n = choice
            at = int(self.start[i])
            loss -= self.examples[i].loss(at, at + n)
            placed.append((i, at, n))
            self._move(i, n)
            room, segments = room - n, segments - 1
        return self._trimmed(placed, cap.tokens - room)

    def _trimmed(self, placed: list[tuple[int, int, int]], used: int) -> list[tuple[int, int, int]]:
        excess = used - (used if used == self.limits.tokens else 1 << used.bit_length() - 1)
        while excess:
            i, at, n = placed.pop()
            back = min(n, excess)
            self._move(i, -back)
            excess -= back
            if back < n:
                placed.append((i, at, n - back))
        return placed

    def sequences(self, last: bool) -> Iterator[list[tuple[int, int, int]]]:
        """Sequences of what waits; unless it is the last time, less than a sequence's tokens stay."""
        n = max(1, int(np.count_nonzero(self.length)))
        limits = np.array([self.limits.tokens, max(1, self.limits.loss)], float)
        weights = np.array([self.length.sum(), self.loss.sum()]) / n / limits**3  # mean demand / limit, times 1 / limit**2
        while self.tokens >= (1 if last else self.limits.tokens):
            yield self.sequence(weights)


PIECES_DDL = "start long, length long, ids_crc32 long, doc_tokens long, loss_tokens long, sequence_id long, offset long, ids binary"


def packed(batches: Iterator[list[Example]], limits: Limits, partition: int, key_type: pa.DataType, key: str) -> Iterator[pa.RecordBatch]:
    """Rows of the pieces of all examples of a task; sequence ids hold the partition, so that they are distinct."""
    packer, sequence = VectorPacker(limits), partition << 40

    def flush(last: bool) -> pa.RecordBatch:
        nonlocal sequence
        out: list[list] = [[] for _ in range(9)]
        for placed in packer.sequences(last):
            offset = 0
            for i, at, n in placed:
                e = packer.examples[i]
                ids = e.ids[at : at + n].tobytes()
                for column, value in zip(out, (e.key, at, n, zlib.crc32(ids), len(e.ids), e.loss(at, at + n), sequence, offset, ids)):
                    column.append(value)
                offset += n
            sequence += 1
        arrays = [pa.array(out[0], key_type), *[pa.array(c, pa.int64()) for c in out[1:8]], pa.array(out[8], pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, names=[key, "start", "length", "ids_crc32", "doc_tokens", "loss_tokens", "sequence_id", "offset", "ids"])

    waiting, tokens = [], 0
    for examples in batches:
        for e in examples:
            if not len(e.ids):
                continue
            waiting.append(e)
            tokens += len(e.ids)
            if len(waiting) >= CELL_EXAMPLES or tokens >= CELL_TOKENS:
                packer.add(waiting)
                waiting, tokens = [], 0
                yield flush(False)
    packer.add(waiting)
    yield flush(True)


def _packed(source: DataFrame, key: str, limits: Limits, examples) -> DataFrame:
    """The sequences of a table; examples(batch) gives a batch's."""
    field = source.schema[key].dataType
    kind = to_arrow_type(field)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from strandline.llm.vector_packing import packed

        yield from packed(map(examples, batches), limits, TaskContext.get().partitionId(), kind, key)

    return map_arrow(source, work, f"`{key}` {field.simpleString()}, {PIECES_DDL}")


def pack_examples(rows: DataFrame, key: str = "id", limits: Limits = Limits()) -> DataFrame:
    """One row per piece of the examples of rows (key; ids, binary of little-endian unsigned 32-bit numbers; loss, an array of
    struct<start,end>, ascending spans of loss-bearing tokens, null: all): key, start, length, ids_crc32, doc_tokens (of the
    whole example), loss_tokens, sequence_id, offset, ids.

    Null and empty ids have no pieces; an example beyond a limit is cut. Repeated rows and null keys are examples of their
    own; other columns are not read; an empty table gives an empty one. The same files give the same sequences."""
    spans = F.transform("loss", lambda s: F.struct(s["start"].cast("long").alias("start"), s["end"].cast("long").alias("end")))
    source = rows.select(F.col(key), F.col("ids").cast("binary").alias("ids"), spans.alias("loss"))

    def examples(batch: pa.RecordBatch) -> list[Example]:
        from strandline.llm.vector_packing import Example

        out = []
        for k, ids, loss in zip(*(c.to_pylist() for c in batch.columns)):
            ids = np.frombuffer(ids or b"", "<u4")
            out.append(Example(k, ids, [(0, len(ids))] if loss is None else [(s["start"], s["end"]) for s in loss]))
        return out

    return _packed(source, key, limits, examples)


def pack_documents(docs: DataFrame, limits: Limits = Limits(), path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """pack_examples() of documents (doc_id, text; others are not read): the text's ids, then end_id; all of them bear loss.
    Null and empty texts are the end id alone; malformed UTF-8 is read with replacement characters; very long texts are cut."""
    path = path or tokenizer_path()

    def examples(batch: pa.RecordBatch) -> list[Example]:
        from strandline.llm.vector_packing import Example, loaded

        encode, out = loaded(path).encode, []
        for k, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            ids = np.append(encode(text.as_py() or b""), np.array([end_id], "<u4"))
            out.append(Example(k, ids, [(0, len(ids))]))
        return out

    return _packed(docs.select(F.col("doc_id"), F.col("text").cast("binary").alias("text")), "doc_id", limits, examples)
