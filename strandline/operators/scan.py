"""Motif scans on both strands.

One pass over the sequences finds all motifs. Sequences are laid end to end in pieces of about a million bases, longer
ones cut into pieces that overlap by a motif's length, so memory is bounded beyond the sequence itself. A piece becomes
numbers of its words of up to 8 bases, once for each length; a table of all words says which motifs match there, with
mismatches or without, and what is longer is compared on from there. Results are exact; nothing is sampled or capped.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions.iupac import BASES, CODES, pattern_regex, reverse_complement
from strandline.operators.windows import as_stretches
from strandline.session import map_arrow, ship_package
from strandline.sources.motifs import Motif, MotifSet

OCCURRENCES = "seq_id long, seq_len long, motif_id int, reverse boolean, start long, end long, score double"
_BIT = np.zeros(256, np.uint8)
_CODE = np.full(256, 4, np.uint8)
for _i, _c in enumerate(BASES):
    _BIT[ord(_c)], _CODE[ord(_c)] = 1 << _i, _i
_SETS = {c: sum(1 << BASES.index(b) for b in s) for c, s in CODES.items()}


def iupac_hits(text: np.ndarray, pattern: str, mismatches: int, automaton: bool = True) -> np.ndarray:
    """Starts of forward matches of a pattern in bytes. With automaton semantics no match spans a symbol but A, C, G, T;
    without, such a symbol is one mismatch. Matches may overlap."""
    bits, k = _BIT[text], len(pattern)
    n = len(text) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    if not mismatches:
        ok = np.ones(n, bool)
        for j, c in enumerate(pattern):
            ok &= (bits[j : j + n] & _SETS[c]) != 0
        return np.flatnonzero(ok)
    misses = np.zeros(n, np.uint16)
    for j, c in enumerate(pattern):
        misses += (bits[j : j + n] & _SETS[c]) == 0
    ok = misses <= mismatches
    if automaton:
        other = np.r_[0, np.cumsum(bits == 0)]
        ok &= other[k : k + n] == other[:n]
    return np.flatnonzero(ok)


def pwm_scores(text: np.ndarray, rows: tuple[tuple[float, ...], ...], reverse: bool = False) -> np.ndarray:
    """Scores of a matrix at each start that it fits; other symbols add 0."""
    table = np.vstack([np.array(rows, dtype=np.float64), np.zeros(len(rows[0]))])
    if reverse:  # complement of the base, columns from the end
        table = np.vstack([table[3::-1, ::-1], table[4:]])
    codes = _CODE[text]
    n = len(text) - table.shape[1] + 1
    if n <= 0:
        return np.zeros(0)
    out = np.zeros(n)
    for j in range(table.shape[1]):
        out += table[codes[j : j + n], j]
    return out


#: Bases of a piece, and of the words that a table lists.
PIECE, WORD = 1 << 20, 8


class Words:
    """Base-4 numbers of the words at each place of a text, first base highest, and whether they are of bases alone."""

    def __init__(self, text: np.ndarray):
        self.text = text
        code = _CODE[text]
        other = code > 3
        self.before = np.cumsum(other, dtype=np.int32) if other.any() else None  # other symbols up to a place
        self.known = {1: (code & 3).astype(np.uint16)}

    def numbers(self, k: int) -> np.ndarray:
        if k not in self.known:
            half = k // 2
            a, b = self.numbers(half), self.numbers(k - half)
            n = max(0, len(self.text) - k + 1)
            self.known[k] = (a[:n] << np.uint16(2 * (k - half))) | b[half : half + n]
        return self.known[k]

    def pure(self, k: int) -> np.ndarray | None:
        """None: all words are."""
        if self.before is None:
            return None
        n = max(0, len(self.text) - k + 1)
        return self.before[k - 1 : k - 1 + n] == np.r_[np.int32(0), self.before[: max(0, n - 1)]][:n]


@lru_cache(256)
def word_table(patterns: tuple[tuple[str, int], ...]) -> np.ndarray:
    """For each word as long as the patterns, the bits of the (pattern, mismatches) that match it; 32 patterns at most."""
    k = len(patterns[0][0])
    word = np.arange(4**k, dtype=np.uint32)
    table = np.zeros(4**k, np.uint32)
    for bit, (pattern, mismatches) in enumerate(patterns):
        misses = np.zeros(4**k, np.uint8)
        for j, c in enumerate(pattern):
            misses += (_SETS[c] >> (word >> np.uint32(2 * (k - 1 - j)) & np.uint32(3)) & 1) == 0
        table |= (misses <= mismatches).astype(np.uint32) << np.uint32(bit)
    return table


def pattern_hits(words: Words, patterns: list[tuple[str, int]]) -> list[np.ndarray]:
    """Starts of the forward matches of each (pattern, mismatches), none of which spans a symbol but A, C, G, T."""
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(patterns)
    by_length: dict[int, list[int]] = {}
    for i, (pattern, _) in enumerate(patterns):
        by_length.setdefault(min(len(pattern), WORD), []).append(i)
    for k, own in by_length.items():
        if len(words.text) < k:
            continue
        for some in (own[i : i + 32] for i in range(0, len(own), 32)):
            table = word_table(tuple((patterns[i][0][:k], patterns[i][1]) for i in some))
            marks = table[words.numbers(k)]
            pure = words.pure(k)
            at = np.flatnonzero(marks if pure is None else marks * pure)
            marks = marks[at]
            for bit, i in enumerate(some):
                hit = at[(marks >> np.uint32(bit) & np.uint32(1)).astype(bool)]
                pattern, mismatches = patterns[i]
                out[i] = hit if len(pattern) == k else _longer(words.text, hit, pattern, mismatches)
    return out


def _longer(text: np.ndarray, at: np.ndarray, pattern: str, mismatches: int) -> np.ndarray:
    """Of the starts `at`, those where the whole pattern matches."""
    at = at[at + len(pattern) <= len(text)]
    misses, pure = np.zeros(len(at), np.uint16), np.ones(len(at), bool)
    for j, c in enumerate(pattern):
        bits = _BIT[text[at + j]]
        misses += (bits & _SETS[c]) == 0
        pure &= bits != 0
    return at[pure & (misses <= mismatches)]


def _motif_hits(text: np.ndarray, motifs: list[Motif], automaton: bool) -> Iterator[tuple[Motif, bool, np.ndarray, np.ndarray | None]]:
    strands = [(m, reverse) for m in motifs for reverse in (False, True)]
    listed = [(m, r) for m, r in strands if m.kind == "iupac" and (automaton or not m.mismatches)]
    found = pattern_hits(Words(text), [(reverse_complement(m.pattern) if r else m.pattern, m.mismatches) for m, r in listed]) if listed else []
    for (m, r), at in zip(listed, found):
        yield m, r, at, None
    for m, r in strands:
        if m.kind == "pwm":
            scores = pwm_scores(text, m.pwm, r)
            at = np.flatnonzero(scores >= m.threshold)
            yield m, r, at, scores[at]
        elif not automaton and m.mismatches:
            yield m, r, iupac_hits(text, reverse_complement(m.pattern) if r else m.pattern, m.mismatches, False), None


def pieces(parts: list[bytes], overlap: int, size: int = PIECE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts of about `size` symbols with a zero after each stretch, and by stretch: its row, first place in the text, first
    place in the row, the places of the row that it owns, and those that it holds (`overlap` more)."""
    held: list[tuple[int, int, int, int]] = []
    total = 0

    def made():
        text = np.frombuffer(b"\x00".join(parts[row][a:c] for row, a, _, c in held), np.uint8)
        row, a, b, c = (np.array(x, np.int64) for x in zip(*held))
        return text, row, np.r_[0, np.cumsum(c - a + 1)[:-1]], a, b, c

    for row, part in enumerate(parts):
        for a in range(0, len(part), size):
            b = min(a + size, len(part))
            held.append((row, a, b, min(b + overlap, len(part))))
            total += held[-1][3] - a
            if total >= size:
                yield made()
                held, total = [], 0
    if held:
        yield made()


def _occurrences(source: DataFrame, motifs: MotifSet, automaton: bool) -> DataFrame:
    """OCCURRENCES of source (seq_id, seq_len, begin, owned, seq in bytes): stretches of sequences whose first `owned` bases
    own the hits that begin there."""
    wanted = list(motifs)
    names = [f.split()[0] for f in OCCURRENCES.split(", ")]
    overlap = max(0, motifs.max_len - 1)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from strandline.operators.scan import _motif_hits, pieces

        for batch in batches:
            ids, length, place, mine = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            parts = [b or b"" for b in batch.column(4).to_pylist()]
            for text, row, first, begin, owned, held in pieces(parts, overlap):
                columns: list[list[np.ndarray]] = [[] for _ in names]
                for motif, reverse, at, scores in _motif_hits(text, wanted, automaton):
                    stretch = np.searchsorted(first, at, side="right") - 1
                    start = at - first[stretch] + begin[stretch]
                    inside = (start < owned[stretch]) & (start + len(motif) <= held[stretch]) & (start < mine[row[stretch]])
                    r, start = row[stretch[inside]], start[inside]
                    n = len(r)
                    start = start + place[r]
                    for column, value in zip(columns, (ids[r], length[r], np.full(n, motif.motif_id, np.int32), np.full(n, reverse), start, start + len(motif), np.ones(n) if scores is None else scores[inside])):
                        column.append(value)
                if any(map(len, columns[0])):
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], names=names)

    return map_arrow(source, work, OCCURRENCES)


def scan(seqs: DataFrame, motifs: MotifSet, automaton: bool = True) -> DataFrame:
    """All occurrences (OCCURRENCES) of all motifs in seqs (seq_id, seq); ends are exclusive, positions forward, the score
    of a pattern is 1. A palindrome has one row a strand. Null and empty sequences have none."""
    return _occurrences(as_stretches(seqs), motifs, automaton)


def scan_stretches(stretches: DataFrame, motifs: MotifSet, automaton: bool = True) -> DataFrame:
    """scan() of sequences that come in stretches (seq_id, len, begin, owned, seq), as read_stretches gives them with an
    overlap of max_len - 1 bases or more: no task holds a whole sequence."""
    return _occurrences(as_stretches(stretches), motifs, automaton)


def scan_regex(seqs: DataFrame, motifs: MotifSet) -> DataFrame:
    """The same rows for patterns, by the JVM's regular expressions alone: split before each match, then add up lengths.
    Overlapping matches count; the x keeps a match at the start from being lost. It shows that scan() is right; its work
    grows with the square of a sequence's hits, so scan() is the one to use on long sequences."""
    parts = []
    for m in motifs:
        for reverse in (False, True):
            regex = pattern_regex(reverse_complement(m.pattern) if reverse else m.pattern, m.mismatches)
            pieces = F.transform(F.split(F.concat(F.lit("x"), "seq"), f"(?={regex})", -1), F.length)
            parts.append(F.struct(F.lit(m.motif_id).alias("motif_id"), F.lit(reverse).alias("reverse"), F.lit(len(m)).alias("k"), pieces.alias("pieces")))
    each = seqs.select("seq_id", F.length("seq").cast("long").alias("seq_len"), F.explode(F.array(*parts)).alias("p"))
    # running sums without a shuffle: an aggregate over the array of piece lengths, turned into starts
    sums = F.aggregate(F.col("p.pieces"), F.struct(F.lit(-1).cast("long").alias("at"), F.array().cast("array<bigint>").alias("starts")), lambda a, n: F.struct((a["at"] + n).cast("bigint").alias("at"), F.concat(a["starts"], F.array((a["at"] + n).cast("bigint"))).alias("starts")), lambda a: a["starts"])
    hits = each.select("seq_id", "seq_len", "p.motif_id", "p.reverse", "p.k", F.explode(F.slice(sums, F.lit(1), F.size("p.pieces") - 1)).alias("start"))
    return hits.select("seq_id", "seq_len", "motif_id", "reverse", "start", (F.col("start") + F.col("k")).alias("end"), F.lit(1.0).alias("score"))


def count_hits(seqs: DataFrame, motifs: MotifSet) -> DataFrame:
    """seq_id, motif_id, reverse, n for patterns, counted in the JVM without listing positions."""
    counts = [F.struct(F.lit(m.motif_id).alias("motif_id"), F.lit(r).alias("reverse"), F.regexp_count("seq", F.lit(f"(?={pattern_regex(reverse_complement(m.pattern) if r else m.pattern, m.mismatches)})")).cast("long").alias("n")) for m in motifs for r in (False, True)]
    return seqs.select("seq_id", F.explode(F.array(*counts)).alias("c")).select("seq_id", "c.*")


def kmer_counts(seqs: DataFrame, k: int) -> DataFrame:
    """kmer, n over all sequences, windows with other symbols than A, C, G, T left out; counts are summed in each batch
    before they are shuffled."""
    ship_package(seqs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from strandline.operators.scan import rolling_codes

        for b in batches:
            total = np.zeros(4**k, np.int64)
            for seq in b.column(0).to_pylist():
                codes = rolling_codes(np.frombuffer(seq or b"", np.uint8), k)
                total += np.bincount(codes[codes >= 0], minlength=4**k)
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([kmer_text(int(c), k) for c in at], pa.string()), pa.array(total[at])], names=["kmer", "n"])

    return seqs.select(F.col("seq").cast("binary")).mapInArrow(work, "kmer string, n long").groupBy("kmer").agg(F.sum("n").alias("n"))


def rolling_codes(text: np.ndarray, k: int) -> np.ndarray:
    """Base-4 code of each window of k bases, first base highest; -1 where another symbol is inside."""
    codes = _CODE[text].astype(np.int64)
    n = len(text) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    out = np.zeros(n, np.int64)
    for j in range(k):
        out = out * 4 + codes[j : j + n]
    other = np.r_[0, np.cumsum(codes == 4)]
    return np.where(other[k : k + n] == other[:n], out, -1)


def kmer_text(code: int, k: int) -> str:
    return "".join(BASES[code >> 2 * (k - 1 - j) & 3] for j in range(k))
