"""Fragments of DuckDB SQL that define the operators independently of the Spark plans: comparisons base by base."""

from __future__ import annotations

from strandline.functions.iupac import BASES, CODES, LETTERS, reverse_complement
from strandline.sources.motifs import MotifSet

SEQS = f"""seqs AS (
  SELECT doc_id AS seq_id, translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), '{LETTERS}', '{"".join(BASES[i % 4] for i in range(26))}') AS seq FROM documents WHERE text IS NOT NULL),
lens AS (SELECT seq_id, seq, length(seq)::BIGINT AS len FROM seqs WHERE length(seq) > 0),
bases AS (SELECT seq_id, len, unnest(string_split(seq, '')) AS c, unnest(range(len)) AS pos FROM lens)"""


def words(n: int) -> str:
    """km: the n bases from each position on, fewer at the end."""
    leads = " || ".join(f"coalesce(lead(c, {i}) OVER w, '')" for i in range(1, n))
    return f"km AS (SELECT seq_id, len, pos, c || {leads} AS k FROM bases WINDOW w AS (PARTITION BY seq_id ORDER BY pos))"


def matches(pattern: str, mismatches: int) -> str:
    n = len(pattern)
    hit = " + ".join(f"(k[{i + 1}] IN ({', '.join(repr(b) for b in CODES[c])}))::INT" for i, c in enumerate(pattern))
    return f"length(k) >= {n} AND {hit} >= {n - mismatches}"


def occurrences(motifs: MotifSet) -> str:
    """All of SEQS, km and occ (seq_id, len, m, r, s, e) of patterns on both strands; bases alone are in the tables."""
    parts = []
    for m in motifs:
        for r in (False, True):
            pattern = reverse_complement(m.pattern) if r else m.pattern
            parts.append(f"SELECT seq_id, len, {m.motif_id} AS m, {str(r).lower()} AS r, pos AS s, pos + {len(m)} AS e FROM km WHERE {matches(pattern, m.mismatches)}")
    return SEQS + ",\n" + words(motifs.max_len) + ",\nocc AS (" + "\n  UNION ALL ".join(parts) + ")"


def n_windows(length: str, size: int, step: int) -> str:
    return f"(CASE WHEN {length} < {size - step} THEN 1 WHEN {length} = {size - step} THEN 0 ELSE ceil(({length} - {size - step}) / {step}.0)::BIGINT END)"


def windows(size: int = 500, step: int = 100) -> str:
    """win (seq_id, i, ws, wl, len)."""
    return f"win AS (SELECT seq_id, len, i, i * {step} AS ws, least(i * {step} + {size}, len) - i * {step} AS wl FROM (SELECT seq_id, len, unnest(range({n_windows('len', size, step)})) AS i FROM lens))"


#: ow: occurrences by the window that holds them, by plain containment.
IN_WINDOWS = "ow AS (SELECT o.*, w.i, w.ws, w.wl FROM occ o JOIN win w ON o.seq_id = w.seq_id AND o.s >= w.ws AND o.e <= w.ws + w.wl)"

#: Distances of occurrences x and y.
CENTERS = "abs((y.s + (y.e - y.s) / 2.0) - (x.s + (x.e - x.s) / 2.0))"
SIGNED = "((y.s + (y.e - y.s) / 2.0) - (x.s + (x.e - x.s) / 2.0))"
GAP = "greatest(y.s - x.e, x.s - y.e, 0)"
BETWEEN = "greatest(y.s - x.e, x.s - y.e)"
OTHER = "(x.s, x.m, x.r) != (y.s, y.m, y.r)"
LATER = "(y.s > x.s OR (y.s = x.s AND y.r > x.r))"
SAME_WINDOW = "x.seq_id = y.seq_id AND x.i = y.i"


def located(motifs: MotifSet, size: int = 500, step: int = 100) -> str:
    return "WITH " + occurrences(motifs) + ",\n" + windows(size, step) + ",\n" + IN_WINDOWS
