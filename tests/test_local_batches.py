"""Local composition over batches of many sequences."""

import numpy as np
import pyarrow as pa
import pytest

from strandline.operators import local


@pytest.mark.parametrize("text", [1, 1000, 1 << 18])
def test_rows_of_a_batch_are_those_of_single_sequences(monkeypatch, text):
    """Rows of one or more parts, some after other rows' bytes in the same buffer, give what each gives alone."""
    monkeypatch.setattr(local, "TEXT", text)
    rng = np.random.default_rng(5)
    part_row, begin, seqs, hits, wanted = [], [], [], [], []
    for r in range(40):
        n = int(rng.choice([40, 900, 3000]))
        seq, at = rng.choice(np.frombuffer(b"ACGTN", np.uint8), n), 131_172 * (r % 2)
        start = np.sort(rng.integers(0, n - 6, int(rng.integers(0, 20)))) + at
        low = np.maximum(0, -(-(start + 6 - 500) // 100)) * 100
        cuts = [0] if r % 3 else [0, n // 2]
        part = np.searchsorted(np.array(cuts) + at, np.maximum(start + 3 - local.REACH, 0), side="right") - 1
        for i, (a, b) in enumerate(zip(cuts, [*cuts[1:], n])):
            part_row, begin, seqs = [*part_row, r], [*begin, at + a], [*seqs, seq[a : b + 2 * local.REACH + 1].tobytes()]
        for s, l, p in zip(start, low, part):
            hits.append((r, s, s + 6, l, min(l + 500, n + at)))
            if p < 0:
                wanted.append([0.0] * 17)
                continue
            o = at + cuts[p]
            one = local.composition(np.frombuffer(seqs[len(seqs) - len(cuts) + p], np.uint8), *(np.array([x - o]) for x in hits[-1][1:]))
            wanted.append([*one[0], *one[1][0]])
    parts = pa.concat_arrays([pa.array([b"before"]), pa.array(seqs, pa.binary())])[1:]
    gc, dnt = local.batch_composition(np.array(part_row), np.array(begin), parts, *np.array(hits).T)
    assert np.array_equal(np.c_[gc, dnt], np.array(wanted))


def test_a_batch_leaves_in_few_pieces(monkeypatch):
    """One piece a run of rows, not one a sequence; none of many more occurrences than asked for."""
    monkeypatch.setattr(local, "ITEMS", 10)
    batch = pa.RecordBatch.from_arrays([pa.array([[0] * 3] * 50 + [[0] * 40] + [[]])], names=["rows"])
    out = list(local.some_rows(iter([batch, batch.slice(0, 0)]), 0))
    assert sum(map(len, out)) == 52 and 10 < len(out) < 20
    assert all(len(local.list_rows(b.column(0))[0]) <= 12 for b in out if max(map(len, b.column(0))) < 40)
