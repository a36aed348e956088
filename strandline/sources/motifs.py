"""Motif sets: ambiguity patterns with mismatches, k-mers, random patterns, weight matrices."""

from __future__ import annotations

import random
import xml.etree.ElementTree as ET
from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.iupac import BASES, CODES, check_pattern, reverse_complement

SCHEMA = "motif_id int, name string, kind string, len int, pattern string, mismatches int, pwm array<array<double>>, threshold double"
#: Random patterns draw bases four times as often as each other ambiguity code.
RANDOM_LETTERS = BASES * 4 + "".join(c for c in CODES if c not in BASES)


@dataclass(frozen=True)
class Motif:
    motif_id: int
    name: str
    pattern: str = ""
    mismatches: int = 0
    pwm: tuple[tuple[float, ...], ...] | None = None  # rows A, C, G, T
    threshold: float = 0.0

    @property
    def kind(self) -> str:
        return "iupac" if self.pwm is None else "pwm"

    def __len__(self) -> int:
        return len(self.pattern) if self.pwm is None else len(self.pwm[0])


def _text(spark: SparkSession, path: str) -> str:
    return "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())


class MotifSet:
    """Motifs in the order added; a motif's id is its place."""

    def __init__(self, motifs: Iterable[Motif] = ()):
        self.motifs: list[Motif] = list(motifs)

    def __iter__(self):
        return iter(self.motifs)

    def __len__(self) -> int:
        return len(self.motifs)

    def __getitem__(self, i: int) -> Motif:
        return self.motifs[i]

    @property
    def max_len(self) -> int:
        return max(map(len, self.motifs), default=0)

    def ids(self, name: str) -> int:
        return next(m.motif_id for m in self.motifs if m.name == name)

    def add_iupac(self, name: str, pattern: str, mismatches: int = 0, allow_duplicates: bool = False) -> bool:
        """False, and nothing added, for a pattern equal to one that is there or to its reverse complement; names and
        mismatches play no part in that."""
        check_pattern(pattern)
        if mismatches < 0:
            raise ValueError("mismatches can't be negative")
        if not allow_duplicates:
            known = {m.pattern for m in self.motifs if m.kind == "iupac"}
            if pattern in known or reverse_complement(pattern) in known:
                return False
        self.motifs.append(Motif(len(self.motifs), name, pattern, mismatches))
        return True

    def add_kmers(self, k: int, allow_duplicates: bool = False) -> int:
        """All patterns of k bases, the first position varying fastest; reverse complements of earlier ones are left out."""
        known = {m.pattern for m in self.motifs if m.kind == "iupac"}
        before = len(self.motifs)
        for i in range(4**k):
            pattern = "".join(BASES[i >> 2 * j & 3] for j in range(k))
            if allow_duplicates or (pattern not in known and reverse_complement(pattern) not in known):
                known.add(pattern)
                self.motifs.append(Motif(len(self.motifs), pattern, pattern))
        return len(self.motifs) - before

    def add_random(self, n: int, length: int, seed: int = 0) -> None:
        """n new random patterns."""
        rng, added = random.Random(seed), 0
        while added < n:
            pattern = "".join(rng.choice(RANDOM_LETTERS) for _ in range(length))
            added += self.add_iupac(pattern, pattern)

    def add_xml(self, spark: SparkSession, path: str) -> int:
        """Children of the root `motifs`, of any tag, with the attributes name, seq and misses; others are skipped."""
        root = ET.fromstring(_text(spark, path))
        if root.tag != "motifs":
            raise ValueError("the root element must be motifs")
        return sum(self.add_iupac(c.attrib["name"], c.attrib["seq"], int(c.attrib["misses"])) for c in root if {"name", "seq", "misses"} <= set(c.attrib))

    def add_pwm_table(self, spark: SparkSession, path: str, threshold: float = 0.0) -> int:
        """Matrices of `>name` and four lines `base | weights`, tab separated; empty fields are skipped. All four bases
        and equal widths are required."""
        added = 0
        for record in _text(spark, path).split(">")[1:]:
            lines = [x for x in record.splitlines() if x.strip()]
            rows: dict[str, tuple[float, ...]] = {}
            for line in lines[1:]:
                base, _, weights = line.partition("|")
                rows[base.strip()] = tuple(float(x) for x in weights.split("\t") if x.strip())
            if set(rows) != set(BASES) or len({len(r) for r in rows.values()}) != 1:
                raise ValueError(f"matrix {lines[0]!r} needs four rows of one width")
            self.motifs.append(Motif(len(self.motifs), lines[0].strip(), pwm=tuple(rows[b] for b in BASES), threshold=threshold))
            added += 1
        return added

    def add_pwm(self, name: str, rows: Iterable[Iterable[float]], threshold: float = 0.0) -> None:
        self.motifs.append(Motif(len(self.motifs), name, pwm=tuple(map(tuple, rows)), threshold=threshold))

    def with_threshold(self, threshold: float) -> MotifSet:
        """All matrices with one threshold."""
        return MotifSet(m if m.kind == "iupac" else replace(m, threshold=threshold) for m in self.motifs)

    def only(self, ids: Iterable[int]) -> MotifSet:
        """The motifs that are used; they keep their ids, so that scans skip the others."""
        keep = set(ids)
        return MotifSet(m for m in self.motifs if m.motif_id in keep)

    def to_df(self, spark: SparkSession) -> DataFrame:
        rows = [(m.motif_id, m.name, m.kind, len(m), m.pattern or None, m.mismatches, [list(r) for r in m.pwm] if m.pwm else None, m.threshold) for m in self.motifs]
        return spark.createDataFrame(rows, SCHEMA)


def distinct_patterns(patterns: DataFrame) -> DataFrame:
    """The first of each set of patterns equal up to reverse complement. patterns: motif_id, pattern."""
    from strandline.functions.iupac import reverse_complement_column

    canonical = F.least("pattern", reverse_complement_column(F.col("pattern")))
    return patterns.groupBy(canonical.alias("canonical")).agg(F.min_by("pattern", "motif_id").alias("pattern"), F.min("motif_id").alias("motif_id")).select("motif_id", "pattern")


def kmers(spark: SparkSession, k: int) -> DataFrame:
    """motif_id, pattern of all k-mers, the first position varying fastest."""
    letters = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: F.substring(F.lit(BASES), F.floor(F.col("id") / F.pow(F.lit(4), j)).bitwiseAND(F.lit(3)).cast("int") + 1, F.lit(1)))
    return spark.range(4**k).select(F.col("id").cast("int").alias("motif_id"), F.array_join(letters, "").alias("pattern"))
