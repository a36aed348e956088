"""Fill-in-middle transformation: whole Arrow batches of UTF-8 bytes are cut at once.

A table of 256 entries gives each byte's class, a mask over (class before, class here) says where a unit begins, sums of
that mask reset at each document number the units, and one sorted search finds the byte of every cut of every row. Cuts
and forms are drawn in the JVM from a digest of the row's id, so they need neither order nor state and survive reruns.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.session import map_arrow

#: Bytes of text that are cut together; a longer text is cut alone.
SLAB_BYTES = 1 << 23


@dataclass(frozen=True)
class Units:
    """What is counted: class_of has a class for each byte, begins[a, b] is set if a unit begins at a byte of class b after
    one of class a. A document's first byte always begins one."""

    class_of: np.ndarray
    begins: np.ndarray


def _units(groups: dict[int, bytes], pairs: list[tuple[int, int]]) -> Units:
    class_of, begins = np.zeros(256, np.uint8), np.zeros((4, 4), bool)
    for k, members in groups.items():
        class_of[list(members)] = k
    for a, b in pairs:
        begins[a, b] = True
    return Units(class_of, begins)


_CONTINUED, _SPACE = bytes(range(0x80, 0xC0)), b" \t\n\v\f\r"
UNITS = {
    "character": _units({1: _CONTINUED}, [(0, 0), (1, 0)]),  # a code point begins at any byte but a continuation
    "word": _units({1: _SPACE}, [(1, 0)]),  # a word and the white space after it
    "line": _units({1: b"\n"}, [(1, 0), (1, 1)]),  # a line with its end
}


@dataclass(frozen=True)
class Marks:
    """The strings before the parts. Each must begin with a byte that none of them holds elsewhere, so that no mark can
    begin inside a text or another mark and the first one found is the right one."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self):
        all_ = [m.encode() for m in (self.prefix, self.suffix, self.middle)]
        if len(set(all_)) < 3 or not all(all_) or any(m[0] in x[1:] for m in all_ for x in all_) or any(a != b and a.startswith(b) for a in all_ for b in all_):
            raise ValueError("marks must be distinct, none a beginning of another, and their first bytes must not recur in them")


def find_all(data: np.ndarray, word: bytes) -> np.ndarray:
    """Places of word in data."""
    if len(data) < len(word):
        return np.zeros(0, np.int64)
    at = np.flatnonzero(data[: len(data) - len(word) + 1] == word[0])
    for i, b in enumerate(word[1:], 1):
        at = at[data[at + i] == b]
    return at


def first_in_rows(at: np.ndarray, offsets: np.ndarray, size: int) -> np.ndarray:
    """The first of the ascending places at that lies whole within each row, else -1."""
    found = np.searchsorted(at, offsets[:-1])
    place = np.append(at, np.iinfo(np.int64).max // 2)[found]
    return np.where(place + size <= offsets[1:], place, -1)


def unit_cuts(data: np.ndarray, offsets: np.ndarray, units: Units, draws: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """For rows laid end to end: units of each row, then for the smaller and the larger of the two draws modulo
    (units + 1) the number of units before the cut and the byte of the cut."""
    begins = np.zeros(len(data), bool)
    if len(data):
        kinds = units.class_of[data]
        begins[1:] = units.begins[kinds[:-1], kinds[1:]]
        begins[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    running = np.cumsum(begins, dtype=np.int64 if len(data) >= 1 << 31 else np.int32)
    upto = np.concatenate([[0], running])[offsets].astype(np.int64)  # units before each row, as sums go on over rows
    n = np.diff(upto)
    a, b = (d % (n + 1) for d in draws)
    counts = [np.minimum(a, b), np.maximum(a, b)]
    bytes_ = [np.minimum(np.searchsorted(running, upto[:-1] + c + 1), offsets[1:]) for c in counts]
    return n, counts, bytes_


def _rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets from 0) of a binary column; nulls are empty."""
    column = column.fill_null(b"").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _slabs(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """batch in slices of about SLAB_BYTES of a column."""
    at = 0
    _, offsets = _rows(batch.column(column))
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLAB_BYTES, side="right")) - 1)
        yield batch.slice(at, end - at)
        at = end


FORMS = ("plain", "psm", "spm")


def draws(key: Column, seed: str) -> list[Column]:
    """Four numbers below 2**32 from the sha256 of seed:key; a null key counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def transform(docs: DataFrame, key: str = "doc_id", units: str = "character", seed: str = "1", rate: int = 90, spm_rate: int = 20, marks: Marks = Marks()) -> DataFrame:
    """One row per row of docs (key, text; others are not read): key, n (units of the text), form, prefix_chars and
    middle_chars (units, null if plain) and output, a string.

    `rate` of 100 texts are cut, `spm_rate` of 100 of those have the suffix first. Null and empty texts, and texts that
    hold a mark, are plain; malformed UTF-8 stays byte by byte, a stray continuation byte counting with what is before it.
    Very long texts are cut alone, in about 6 bytes of memory a byte. Rows with equal keys and texts get equal rows, a
    null key draws as an empty one, an empty table gives an empty one."""
    kinds, strings = UNITS[units], [m.encode() for m in (marks.prefix, marks.suffix, marks.middle)]
    h = draws(F.col(key), seed)
    rows = docs.select(F.col(key).alias("key"), F.col("text").cast("binary").alias("text"), *[d.alias(f"h{i}") for i, d in enumerate(h)])
    key_type = docs.schema[key].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from strandline.llm.infill import assemble

        for batch in batches:
            for part in _slabs(batch, 1):
                yield assemble(part, kinds, strings, rate, spm_rate)

    out = map_arrow(rows, cut, f"key {key_type}, n long, form string, prefix_chars long, middle_chars long, output binary")
    return out.withColumn("output", F.col("output").cast("string")).withColumnRenamed("key", key)


def assemble(batch: pa.RecordBatch, units: Units, marks: list[bytes], rate: int, spm_rate: int) -> pa.RecordBatch:
    """The rows of transform() for a batch (key, text, h0 to h3)."""
    data, offsets = _rows(batch.column(1))
    h = [batch.column(2 + i).to_numpy(zero_copy_only=False) for i in range(4)]
    n, (first, second), (left, right) = unit_cuts(data, offsets, units, h[:2])
    plain = (np.diff(offsets) == 0) | (h[2] % 100 >= rate)
    for m in marks:
        plain |= first_in_rows(find_all(data, m), offsets, len(m)) >= 0
    form = np.where(plain, 0, np.where(h[3] % 100 < spm_rate, 2, 1))
    view, parts, sizes = memoryview(data).cast("B") if len(data) else memoryview(b""), [], np.zeros(len(n) + 1, np.int64)
    p, s, m = marks
    for kind, a, x, y, b in zip(form.tolist(), offsets[:-1].tolist(), left.tolist(), right.tolist(), offsets[1:].tolist()):
        if kind == 0:
            parts.append(view[a:b])
        elif kind == 1:
            parts += (p, view[a:x], s, view[y:b], m, view[x:y])
        else:
            parts += (s, view[y:b], p, view[a:x], m, view[x:y])
    sizes[1:] = np.cumsum(np.diff(offsets) + np.where(plain, 0, sum(map(len, marks))))
    output = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(sizes), pa.py_buffer(b"".join(parts))]).cast(pa.binary())
    nulls = lambda x: pa.array(x, pa.int64(), mask=plain)
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(np.array(FORMS)[form], pa.string()), nulls(first), nulls(second - first), output], names=["key", "n", "form", "prefix_chars", "middle_chars", "output"])


def restored(cut: DataFrame, name: str = "restored", marks: Marks = Marks()) -> DataFrame:
    """cut, rows of transform(), with the text made again from output and form alone, as column name, in place of a column
    that has that name. Other columns stay; an output without its marks is an error."""
    strings = [m.encode() for m in (marks.prefix, marks.suffix, marks.middle)]
    rest = [c for c in cut.columns if c != name]
    rows = cut.select(*[F.col(c) for c in rest if c != "output"], F.col("output").cast("binary").alias("output"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields]

    def undo(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from strandline.llm.infill import rebuild

        for batch in batches:
            at, form = batch.schema.get_field_index("output"), batch.schema.get_field_index("form")
            for part in _slabs(batch, at):
                text = rebuild(part.column(at), part.column(form), strings)
                yield pa.RecordBatch.from_arrays([*part.columns, text], names=[*part.schema.names, "_text"])

    out = map_arrow(rows, undo, ", ".join([*fields, "_text binary"]))
    return out.select(*[(F.col(c).cast("string") if c == "output" else F.col(c)).alias(c) for c in rest], F.col("_text").cast("string").alias(name))


def rebuild(output: pa.Array, form: pa.Array, marks: list[bytes]) -> pa.Array:
    """Texts from outputs: the first place of each mark in each row, found for all rows at once."""
    data, offsets = _rows(output)
    kind = np.array([FORMS.index(f) for f in form.to_pylist()], np.int64)
    p, s, m = (first_in_rows(find_all(data, x), offsets, len(x)) for x in marks)
    if ((kind > 0) & ((p < 0) | (s < 0) | (m < 0))).any():
        raise ValueError("an output lacks a mark of its form")
    view, parts = memoryview(data).cast("B") if len(data) else memoryview(b""), []
    lp, ls, lm = map(len, marks)
    for k, a, b, i, j, e in zip(kind.tolist(), offsets[:-1].tolist(), offsets[1:].tolist(), p.tolist(), s.tolist(), m.tolist()):
        if k == 0:
            parts.append(view[a:b])
        elif k == 1:
            parts += (view[i + lp : j], view[e + lm : b], view[j + ls : e])
        else:
            parts += (view[i + lp : e], view[e + lm : b], view[j + ls : i])
    sizes = np.concatenate([[0], np.cumsum(np.diff(offsets) - np.where(kind > 0, lp + ls + lm, 0))])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(kind), [None, pa.py_buffer(sizes), pa.py_buffer(b"".join(parts))]).cast(pa.binary())


ORACLE = r"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, ''))::BIGINT AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS d FROM documents),
drawn AS (SELECT *, ('0x' || substr(d, 1, 8))::BIGINT AS h1, ('0x' || substr(d, 9, 8))::BIGINT AS h2, ('0x' || substr(d, 17, 8))::BIGINT AS h3, ('0x' || substr(d, 25, 8))::BIGINT AS h4 FROM texts),
cuts AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
parts AS (SELECT *, substr(t, 1, a) AS p, substr(t, a + 1, b - a) AS m, substr(t, b + 1) AS s FROM cuts)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM parts
"""
