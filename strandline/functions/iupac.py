"""Ambiguity codes, complements and patterns of nucleotides."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.session import map_arrow

#: The bases that each code stands for.
CODES = {"A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT"}
#: Complements of codes, position by position.
PLAIN, COMPLEMENT = "ACGTRYKMBVDH", "TGCAYRMKVBHD"
BASES = "ACGT"
#: Letters a-z in turn as bases, for tables that hold text and no sequences.
LETTERS = "abcdefghijklmnopqrstuvwxyz"


def reverse_complement(pattern: str) -> str:
    return pattern.translate(str.maketrans(PLAIN, COMPLEMENT))[::-1]


def reverse_complement_column(seq: Column) -> Column:
    return F.reverse(F.translate(seq, PLAIN, COMPLEMENT))


def sequence_of_text(text: Column) -> Column:
    """A base for each letter a-z of the lower-cased text, others left out."""
    return F.translate(F.regexp_replace(F.lower(text), "[^a-z]", ""), LETTERS, "".join(BASES[i % 4] for i in range(26)))


def sequences_of_texts(texts: DataFrame) -> DataFrame:
    """seq_id, seq, len of each row of texts (id, text) that has a letter: a base for each of A-Z and a-z, others left out.
    One table lookup a byte, where the expression above takes a regular expression and a translation of each character."""
    table = np.zeros(256, np.uint8)
    for i, c in enumerate(LETTERS):
        table[ord(c)] = table[ord(c.upper())] = ord(BASES[i % 4])
    ident, text = texts.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            coded = [table[np.frombuffer(t.as_py() or b"", np.uint8)] for t in b.column(1)]
            seqs = pa.array([c[c > 0].tobytes().decode("ascii") for c in coded], pa.string())
            out = pa.RecordBatch.from_arrays([b.column(0), seqs, pc.cast(pc.binary_length(seqs), pa.int64())], names=["seq_id", "seq", "len"])
            yield out.filter(pc.greater(out.column(2), 0))

    return map_arrow(texts.select(F.col(ident).cast("long").alias("seq_id"), F.col(text).cast("binary").alias("text")), work, "seq_id long, seq string, len long")


def check_pattern(pattern: str) -> str:
    if not pattern or any(c not in CODES for c in pattern):
        raise ValueError(f"{pattern!r} is no IUPAC pattern")
    return pattern


def pattern_regex(pattern: str, mismatches: int = 0) -> str:
    """Regular expression of a pattern with up to so many mismatches; bases alone match, other symbols never do."""
    sets = [f"[{CODES[c]}]" if len(CODES[c]) > 1 else c for c in check_pattern(pattern)]
    if not mismatches:
        return "".join(sets)
    places = combinations(range(len(sets)), min(mismatches, len(sets)))
    return "(?:" + "|".join("".join("[ACGT]" if i in free else s for i, s in enumerate(sets)) for free in map(set, places)) + ")"
