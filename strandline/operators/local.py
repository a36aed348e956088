"""Features around each occurrence, inside its window: neighbours, GC content and dinucleotides within 250 bases."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.config import LOCAL_FEATURES
from strandline.functions.iupac import BASES, reverse_complement
from strandline.operators import pairs as P
from strandline.operators.windows import as_stretches
from strandline.session import join_large, map_arrow
from strandline.sources.motifs import MotifSet

REACH = 250
#: Bases of a sequence that one row holds.
SLICE = 1 << 16
#: Bases whose running counts are held at once.
TEXT = 1 << 18
#: Occurrences that leave a task at once.
ITEMS = 1 << 14


def dinucleotide_names() -> list[str]:
    """The 16 pairs of bases, in alphabetical order."""
    return [a + b for a in BASES for b in BASES]


def strand_sums(counts: np.ndarray) -> np.ndarray:
    """Counts by dinucleotide (last axis) of both strands: each plus its reverse complement's."""
    names = dinucleotide_names()
    return counts + counts[..., [names.index(reverse_complement(n)) for n in names]]


def local_composition(placed: DataFrame, seqs: DataFrame, size: int, step: int) -> DataFrame:
    """placed (occurrences by window) with gc and dnt (array of 16): of the bases from the occurrence's middle - 250 to
    + 250, cut at the window's ends. Each adjacent pair of bases counts for itself and its reverse complement, per
    adjacent place of the stretch; other symbols break pairs and count in the length.

    Occurrences meet the bases of their slice of the sequence in one row: those of SLICE bases, and what a stretch that
    begins there can reach beyond. So bases aren't copied by occurrence, and a row doesn't grow with the sequence. Sequences
    may come in stretches with an overlap of 2 * REACH + 1 bases or more."""
    columns = [c for c in placed.columns if c not in ("seq_id", "seq_len")]
    first = F.greatest(F.col("start") + F.expr("(end - start) div 2") - REACH, F.lit(0))
    sliced = placed.withColumn("_slice", F.floor(first / SLICE))
    rows = sliced.groupBy("seq_id", "seq_len", "_slice").agg(F.collect_list(F.struct(*columns)).alias("rows"))
    each = F.explode(F.sequence(F.expr(f"begin div {SLICE}"), F.expr(f"(begin + owned - 1) div {SLICE}")))
    parts = as_stretches(seqs).where("owned > 0").select("seq_id", "begin", "seq", each.alias("_slice")).withColumn("from", F.greatest(F.col("_slice") * SLICE, "begin"))
    bases = F.expr(f"substring(seq, int(from - begin) + 1, int((_slice + 1) * {SLICE} - from) + {2 * REACH + 1})")
    slices = parts.select("seq_id", "_slice", F.struct("from", bases.alias("seq")).alias("part")).groupBy("seq_id", "_slice").agg(F.sort_array(F.collect_list("part")).alias("parts"))
    met = join_large(rows, slices, ["seq_id", "_slice"]).select("seq_id", "seq_len", "parts", "rows")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in placed.schema if f.name in columns)
    out = f"seq_id long, seq_len long, {fields}, gc double, dnt array<double>"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from strandline.operators.local import batch_composition, list_rows, some_rows

        for b in some_rows(batches, 3):
            row, items = list_rows(b.column(3))
            part_row, parts = list_rows(b.column(2))
            seq_id, seq_len = (b.column(i).to_numpy() for i in (0, 1))
            column = {c: items.field(c) for c in columns}
            start, end, win = (column[c].to_numpy(zero_copy_only=False) for c in ("start", "end", "win"))
            low, high = win * step, np.minimum(win * step + size, seq_len[row])
            gc, dnt = batch_composition(part_row, parts.field("from").to_numpy(), parts.field("seq"), row, start, end, low, high)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, 16 * len(row) + 1, 16, dtype=np.int32)), pa.array(dnt.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(seq_id[row]), pa.array(seq_len[row]), *column.values(), pa.array(gc), lists], names=["seq_id", "seq_len", *columns, "gc", "dnt"])

    return map_arrow(met, work, out)


def some_rows(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Batches cut into runs of rows whose lists in a column hold about ITEMS items together."""
    for b in batches:
        run = np.cumsum(np.diff(b.column(column).offsets.to_numpy())) // ITEMS
        heads = np.flatnonzero(np.r_[True, run[1:] != run[:-1]]) if len(b) else ()
        for first, last in zip(heads, [*heads[1:], len(b)]):
            yield b.slice(first, last - first)


def list_rows(lists: pa.ListArray) -> tuple[np.ndarray, pa.StructArray]:
    """The row of each item of lists, and all items."""
    return np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy())), lists.flatten()


def batch_composition(part_row: np.ndarray, begin: np.ndarray, seqs: pa.BinaryArray, row: np.ndarray, start: np.ndarray, end: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """composition() of the occurrences of many rows, each on the part of its row that holds its first base; parts (their
    row, their place in the sequence, their bases) come by row and place. About TEXT bases are laid end to end at once."""
    _, offsets, values = seqs.buffers()
    offset = np.frombuffer(offsets, np.int32)[seqs.offset : seqs.offset + len(seqs) + 1].astype(np.int64)
    text = np.frombuffer(values, np.uint8)
    span = max(int(begin.max(initial=0)), int(end.max(initial=0))) + 1
    first = np.maximum(start + (end - start) // 2 - REACH, 0)
    part = np.searchsorted(part_row * span + begin, row * span + first, side="right") - 1
    gc, dnt = np.zeros(len(row)), np.zeros((len(row), 16))
    found = np.flatnonzero((part >= 0) & (part_row[part] == row))
    found = found[np.argsort(part[found], kind="stable")]
    last = 0
    while last < len(found):
        a = part[found[last]]
        b = max(a + 1, int(np.searchsorted(offset, offset[a] + TEXT, side="right")) - 1)
        upto = int(np.searchsorted(part[found], b))
        own = found[last:upto]
        at = begin[part[own]] - offset[part[own]] + offset[a]
        gc[own], dnt[own] = composition(text[offset[a] : offset[b]], start[own] - at, end[own] - at, low[own] - at, high[own] - at)
        last = upto
    return gc, dnt


def composition(text: np.ndarray, start: np.ndarray, end: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """GC share and dinucleotide profile of stretches of text by running sums."""
    code = np.full(256, 4, np.int8)
    for i, c in enumerate(BASES):
        code[ord(c)] = i
    c = code[text]
    middle = start + (end - start) // 2
    a, b = np.maximum(middle - REACH, low), np.minimum(middle + REACH + 1, high)
    gc = np.r_[0, np.cumsum((text == ord("G")) | (text == ord("C")))]
    n = np.maximum(b - a, 0)
    share = np.where(n > 0, (gc[b] - gc[a]) / np.maximum(n, 1), 0.0)
    pair = np.where((c[:-1] < 4) & (c[1:] < 4), c[:-1] * 4 + c[1:], -1)
    last = np.maximum(b - 1, a)
    counts = np.empty((len(a), 16))
    for k in range(16):
        sums = np.r_[0, np.cumsum(pair == k)]
        counts[:, k] = sums[last] - sums[a]
    return share, strand_sums(counts) / np.maximum(n - 1, 1)[:, None]


def local_neighbours(placed: DataFrame, pairs: DataFrame, motifs: MotifSet) -> DataFrame:
    """placed with near (array: for each motif, the other occurrences in the window whose centre is less than 250 away).
    pairs: occurrence_pairs by window, of at least that reach, or ordered_pairs, which are counted where they meet."""
    close = pairs.where(P.pair_centers() < REACH)
    met = ["bucket"] if "bucket" in pairs.columns else []
    close = close if met else P.both_orders(close)
    counts = close.groupBy("seq_id", *met, "win", F.col("a_motif_id").alias("motif_id"), F.col("a_reverse").alias("reverse"), F.col("a_start").alias("start")).agg(*[F.count_if(F.col("b_motif_id") == m.motif_id).alias(f"n{m.motif_id}") for m in motifs]).drop(*met)
    joined = join_large(placed, counts, ["seq_id", "win", "motif_id", "reverse", "start"], "left")
    return joined.withColumn("near", F.array(*[F.coalesce(f"n{m.motif_id}", F.lit(0)).cast("double") for m in motifs])).drop(*[f"n{m.motif_id}" for m in motifs])


def local_names(motifs: MotifSet, features: tuple[str, ...] = LOCAL_FEATURES) -> list[str]:
    names = {"nOcc": [f"nOcc({m.name}, {REACH})" for m in motifs], "GC": ["GC"], "DNT": [f"DNT({d}, {REACH})" for d in dinucleotide_names()]}
    return [n for f in LOCAL_FEATURES if f in features for n in names[f]]


def local_vectors(placed: DataFrame, seqs: DataFrame, occ: DataFrame, motifs: MotifSet, size: int, step: int, features: tuple[str, ...] = LOCAL_FEATURES) -> DataFrame:
    """placed with features: neighbours, GC, dinucleotides, those that are asked for, in the order of local_names()."""
    out = placed
    if "nOcc" in features:
        pairs = P.pairs_in_windows(P.ordered_pairs(occ, REACH + motifs.max_len), size, step)
        out = local_neighbours(out, pairs, motifs)
    if "GC" in features or "DNT" in features:
        out = local_composition(out, seqs, size, step)
    columns = {"nOcc": F.col("near") if "near" in out.columns else None, "GC": F.array("gc") if "gc" in out.columns else None, "DNT": F.col("dnt") if "dnt" in out.columns else None}
    return out.withColumn("features", F.concat(*[columns[f] for f in LOCAL_FEATURES if f in features])).drop("near", "gc", "dnt")
