"""Best-fit packing with Martello-Toth dominance reduction.

Documents are tokenized, ended by one id and cut into pieces of at most `capacity` tokens only where they are longer.
Packing needs no more than the number of pieces of each length (at most `capacity` numbers), so the driver solves it
on that histogram: sets of up to three lengths that provably dominate all other sets with the same longest member
are fixed for as many sequences as their counts allow, the rest is placed best-fit decreasing. The plan is a table of
(length, rank interval) -> (sequence, offset); each piece finds its slot by its rank within its length. Ranks are
dealt over about sqrt(n) cells for a length of n pieces, so a length that holds most rows is no hot key.
"""

from __future__ import annotations

import bisect
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.session import map_arrow, materialize, release_memory, ship_package

CAPACITY = 4096
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
#: Entries of a worker's word cache before it starts anew.
CACHE_ENTRIES = 1 << 18

#: Letters that lower-case one to one and are stable under NFC, then marks that the tokenizer keeps in one run.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?)\"#$%*&|<>-]*)")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _ids(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class WordCache(dict):
    """Word (UTF-8) -> little-endian unsigned 32-bit ids. Words split at ASCII white space are independent for this
    tokenizer: its normalizer composes nothing across white space and its pre-tokenizer drops it."""

    def __init__(self, path: str, entries: int = CACHE_ENTRIES):
        self.entries = entries
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.runs: dict[str, bytes] = {}
        # direct calls to the model need its byte alphabet, and hold only for this kind of tokenizer
        self.direct = type(self.tokenizer.pre_tokenizer).__name__ == "Sequence" and getattr(self.model, "end_of_word_suffix", None) == "</w>"
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.alphabet = {c: level.pre_tokenize_str(c)[0][0] for c in map(chr, range(33, 256)) if not c.isspace() and c.isprintable()}

    def run(self, s: str) -> bytes:
        ids = self.runs.get(s)
        if ids is None:
            if len(self.runs) >= self.entries:
                self.runs.clear()
            mapped = s if s.isascii() else "".join(map(self.alphabet.__getitem__, s))
            ids = self.runs[s] = _ids([t.id for t in self.model.tokenize(mapped)])
        return ids

    def __missing__(self, word: bytes) -> bytes:
        s = word.decode("utf-8", "replace")
        m = _PLAIN.fullmatch(s) if self.direct else None
        if m:
            ids = self.run(m[1].lower()) + (self.run(m[2]) if m[2] else b"")
        else:
            ids = _ids(self.tokenizer.encode(s, add_special_tokens=False).ids)
        if len(word) <= 64:
            if len(self) >= self.entries:
                self.clear()
            self[word] = ids
        return ids

    def encode(self, text: bytes | None) -> bytes:
        return b"".join(map(self.__getitem__, (text or b"").split()))  # bytes split at ASCII white space alone


_CACHES: dict[str, WordCache] = {}


def word_cache(path: str, entries: int = CACHE_ENTRIES) -> WordCache:
    """The worker's cache of a tokenizer; it stays for later tasks."""
    if path not in _CACHES:
        _CACHES[path] = WordCache(path)
    _CACHES[path].entries = entries
    return _CACHES[path]


PIECES = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("piece", T.IntegerType(), False), T.StructField("start", T.LongType(), False), T.StructField("length", T.LongType(), False), T.StructField("ids_crc32", T.LongType(), False)])


def tokenized_pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, end_id: int = END_ID, keep_ids: bool = False, cache_entries: int = CACHE_ENTRIES) -> DataFrame:
    """One row per piece of each document: doc_id, piece, start, length, ids_crc32 and, if asked for, the ids themselves
    (binary, little-endian unsigned 32-bit). A null text is an empty one: the end id alone. Repeated rows give repeated pieces."""
    ship_package(docs.sparkSession)
    path = path or tokenizer_path()
    schema = T.StructType(PIECES.fields + ([T.StructField("ids", T.BinaryType())] if keep_ids else []))
    end = np.array([end_id], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from strandline.llm.packing import word_cache

        cache, width = word_cache(path, cache_entries), 4 * capacity
        for batch in batches:
            out: list[list] = [[] for _ in schema.fields]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = cache.encode(text.as_py()) + end
                for piece, at in enumerate(range(0, len(ids), width)):
                    part = ids[at : at + width]
                    row = (doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part), part)
                    for column, value in zip(out, row):
                        column.append(value)
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=schema.names)

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")), cut, schema)


def token_counts(docs: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """docs without text, with the number of the text's tokens as column name, in place of a column that has that name; null
    texts have none, and an empty table gives an empty one."""
    ship_package(docs.sparkSession)
    path = path or tokenizer_path()

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        from strandline.llm.packing import word_cache

        encode = word_cache(path).encode
        out = pd.Series([len(encode(t)) // 4 for t in texts], dtype="int64")
        release_memory()
        return out

    return docs.withColumn(name, count(F.col("text").cast("binary"))).drop("text")


# ---- the plan, on the histogram of lengths ----


class Histogram:
    """Counts by size, with the sizes in ascending order."""

    def __init__(self, counts: dict[int, int]):
        self.counts = {s: n for s, n in counts.items() if n > 0}
        self.sizes = sorted(self.counts)

    def take(self, size: int, n: int) -> None:
        self.counts[size] -= n
        if not self.counts[size]:
            del self.counts[size]
            self.sizes.pop(bisect.bisect_left(self.sizes, size))

    def largest(self, limit: int) -> int:
        """Largest size of at most limit, else 0."""
        at = bisect.bisect_right(self.sizes, limit)
        return self.sizes[at - 1] if at else 0

    def smallest(self, n: int) -> list[int]:
        out: list[int] = []
        for s in self.sizes:
            out += [s] * min(self.counts[s], n - len(out))
            if len(out) >= n:
                break
        return out


def dominating_set(h: Histogram, j: int, capacity: int) -> tuple[int, ...] | None:
    """Sizes besides j of a set with j, of at most three, that dominates every feasible set with j; None if none is proved.

    A set dominates another if the other's members can be grouped so that each group fits in the place of a member of the
    first (Martello and Toth, 1990)."""
    h.take(j, 1)
    try:
        room = capacity - j
        k = h.largest(room)
        if not k:
            return ()
        if k == room:
            return (k,)
        low = h.smallest(3)
        if len(low) < 2 or low[0] + low[1] > room:  # one more at most
            return (k,)
        pair = best_pair(h, room)
        if len(low) < 3 or sum(low) > room:  # two more at most
            if k >= pair:
                return (k,)
            h.take(k, 1)
            b = h.largest(room - k)
            h.counts[k] = h.counts.get(k, 0) + 1
            if h.counts[k] == 1:
                bisect.insort(h.sizes, k)
            if not b:
                return None
            # {x, y}, x >= y: x <= k always; it is dominated if y <= b, or if both fit in the place of k
            for y in h.sizes[bisect.bisect_right(h.sizes, b) :]:
                if 2 * y > room:
                    break
                x = h.largest(room - y)
                if x < y or (x == y and h.counts[y] < 2):
                    continue
                if x + y > k:
                    return None
            return (k, b)
        return None
    finally:
        h.counts[j] = h.counts.get(j, 0) + 1
        if h.counts[j] == 1:
            bisect.insort(h.sizes, j)


def best_pair(h: Histogram, room: int) -> int:
    """Largest sum of two of at most room."""
    lo, hi, best = 0, len(h.sizes) - 1, 0
    while lo <= hi:
        a, b = h.sizes[lo], h.sizes[hi]
        if a + b <= room:
            if lo != hi or h.counts[a] > 1:
                best = max(best, a + b)
            lo += 1
        else:
            hi -= 1
    return best


def dominance_reduction(counts: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """(sets fixed and how often, counts that remain). Conditions hold for all sets with equal sizes, so a set is fixed
    as often as its counts allow at once; passes over the sizes, the largest first, go on until one fixes nothing."""
    h, fixed, found = Histogram(counts), [], True
    while found:
        found = False
        for j in sorted(h.sizes, reverse=True):
            while h.counts.get(j):
                others = dominating_set(h, j, capacity)
                if others is None:
                    break
                members = (j, *others)
                times = min(h.counts[s] // members.count(s) for s in set(members))
                for s in members:
                    h.take(s, times)
                fixed.append((members, times))
                found = True
    return fixed, dict(h.counts)


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Patterns [(size, how many), ...] and how many sequences have each."""
    done: list[tuple[list[tuple[int, int]], int]] = []
    open_: dict[int, list[tuple[list[tuple[int, int]], int]]] = {}
    rooms: list[int] = []
    least = min(counts, default=0)

    def put(room: int, pattern: list[tuple[int, int]], n: int) -> None:
        if room < least:
            done.append((pattern, n))
        else:
            if room not in open_:
                open_[room] = []
                bisect.insort(rooms, room)
            open_[room].append((pattern, n))

    for size in sorted(counts, reverse=True):
        n = counts[size]
        while n:
            at = bisect.bisect_left(rooms, size)
            if at == len(rooms):
                each = capacity // size
                if full := n // each:
                    put(capacity - each * size, [(size, each)], full)
                if n % each:
                    put(capacity - n % each * size, [(size, n % each)], 1)
                break
            room = rooms[at]
            pattern, m = open_[room].pop()
            if not open_[room]:
                del open_[room]
                rooms.pop(at)
            each = min(room // size, n)
            times = min(n // each, m)
            if times < m:
                put(room, pattern, m - times)
            put(room - each * size, [*pattern, (size, each)], times)
            n -= each * times
    return done + [x for xs in open_.values() for x in xs]


@dataclass(frozen=True)
class Plan:
    """Runs of ranks by length; sorted by key = length << 50 | first rank."""

    key: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    each: np.ndarray
    sequences: int
    fixed: int

    def slots(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.key, (length << 50) | rank, side="right") - 1
        i = rank - (self.key[at] & ((1 << 50) - 1))
        return self.sequence[at] + i // self.each[at], self.offset[at] + i % self.each[at] * length


def plan_packing(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """The packing of so many pieces of each length."""
    fixed, rest = dominance_reduction(counts, capacity)
    patterns = [([(s, members.count(s)) for s in dict.fromkeys(members)], n) for members, n in fixed] + best_fit_decreasing(rest, capacity)
    rank, rows, sequence = dict.fromkeys(counts, 0), [], 0
    for pattern, n in patterns:
        offset = 0
        for size, each in pattern:
            rows.append((size << 50 | rank[size], sequence, offset, each))
            rank[size] += n * each
            offset += size * each
        sequence += n
    assert rank == counts, "every piece has one slot"
    rows.sort()
    table = np.array(rows, dtype=np.int64).reshape(-1, 4)
    return Plan(*(np.ascontiguousarray(table[:, i]) for i in range(4)), sequence, sum(n for _, n in fixed))


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (doc_id, piece, length, ...) with sequence_id and offset. Columns stay; pieces are read three times, so
    give a written table. Repeated rows each get a slot of their own. An empty table gives an empty one."""
    spark = pieces.sparkSession
    ship_package(spark)
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    plan = plan_packing(counts, capacity)
    cells = spark.createDataFrame([(s, max(1, round(n**0.5))) for s, n in counts.items()], "length long, cells long")
    dealt = pieces.join(F.broadcast(cells), "length").withColumn("cell", F.pmod(F.xxhash64("doc_id", "piece"), "cells")).drop("cells")
    sizes = dealt.groupBy("length", "cell").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "cell").orderBy("doc_id", "piece")
    ranked = dealt.withColumn("rank", F.row_number().over(within)).join(sizes, ["length", "cell"]).withColumn("rank", F.col("base") + F.col("rank") - 1)
    shared = spark.sparkContext.broadcast(plan)

    @F.pandas_udf("sequence_id long, offset long")
    def slot(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        sequence, offset = shared.value.slots(length.to_numpy(np.int64), rank.to_numpy(np.int64))
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    return ranked.withColumn("slot", slot("length", "rank")).select(*[c for c in pieces.columns], "slot.sequence_id", "slot.offset")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, keep_ids: bool = False, cache_entries: int = CACHE_ENTRIES) -> DataFrame:
    """Tokenize, cut and pack: doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset.

    Null or empty texts become the end id alone, very long ones many pieces; null and repeated doc_ids keep all rows;
    only doc_id and text are read, so further columns of any name do no harm."""
    return pack(materialize(tokenized_pieces(docs, capacity, path, keep_ids=keep_ids, cache_entries=cache_entries), "pieces"), capacity)
