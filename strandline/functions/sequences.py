"""Column expressions on sequences and on pairs of occurrences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The literal that periodic features use.
PI = 3.141592654


def gc_content(seq: Column) -> Column:
    """Share of G and C; other symbols count in the length, and an empty sequence has 0."""
    n = F.length(seq)
    return F.when(n > 0, (n - F.length(F.translate(seq, "GC", ""))) / n).otherwise(F.lit(0.0))


def center(start: Column, end: Column) -> Column:
    return start + (end - start) / F.lit(2.0)


def center_distance(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return F.abs(center(s2, e2) - center(s1, e1))


def between_distance(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Bases between two occurrences, negative where they overlap."""
    return F.greatest(s2 - e1, s1 - e2)


def gap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return F.greatest(s2 - e1, s1 - e2, F.lit(0))


def overlapping(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Occurrences that only touch count as overlapping."""
    return ~((e1 < s2) | (e2 < s1))
