"""No table that grows with the input is broadcast, whatever size Spark takes it for."""

import pytest
from pyspark.sql import functions as F

from strandline.models.sequence import PairSum
from strandline.operators import intervals, local, pairs, scan
from strandline.operators.features import Feature, Windows, feature_values, instantiate, vectors
from strandline.plans.motif_queries import PAIRED


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def placed(spark):
    seqs = spark.createDataFrame([(1, "GAGAGTGTGATCGATC" * 20, 320)], "seq_id long, seq string, len long")
    w = Windows(seqs, scan.scan(seqs, PAIRED), 100, 50, PAIRED.max_len)
    w.stored()
    return w


def test_pairs_of_occurrences_are_not_broadcast(placed):
    assert "Broadcast" not in _plan(pairs.occurrence_pairs(placed.occ, 60))


def test_vectors_broadcast_names_alone(placed):
    instances = instantiate([Feature("MDDA")], PAIRED)
    found = _plan(vectors(placed, feature_values(placed, instances), instances))
    assert found.count("BroadcastHashJoin") == 1  # the instances


def test_neighbours_and_composition_are_not_broadcast(placed):
    near = local.local_neighbours(placed.occurrences, placed.pairs(local.REACH), PAIRED)
    assert "Broadcast" not in _plan(near)
    assert "Broadcast" not in _plan(local.local_composition(placed.occurrences, placed.seqs, 100, 50))


def test_scores_and_cores_are_not_broadcast(placed):
    assert "Broadcast" not in _plan(PairSum(PAIRED).scored(placed))
    rows = placed.windows.select("seq_id", "win_start", (F.col("win_start") + F.col("win_len")).alias("win_end"), F.col("win_start").alias("start"), (F.col("win_start") + F.col("win_len")).alias("end"), F.lit(1.0).alias("score"))
    assert "Broadcast" not in _plan(intervals.best_of_overlapping(rows, "seq_id"))


def test_neighbours_are_summed_up_where_they_meet(placed):
    """The distances of an occurrence are not shuffled: only sums by window are."""
    for kind in ("MDM", "MDP", "MDDA"):
        plan = _plan(feature_values(placed, instantiate([Feature(kind)], PAIRED)))
        assert not any("Exchange hashpartitioning" in line and "a_start" in line for line in plan.splitlines())


def test_tasks_that_sum_up_neighbours_grow_with_the_occurrences(placed, monkeypatch):
    """Spark would join tasks by the bytes that they read, and each would spill the sums of all its occurrences."""
    from strandline.operators import features

    monkeypatch.setattr(features, "SUMMED", 5)
    w = Windows(placed.seqs, placed.occ, 100, 50, PAIRED.max_len)
    n = -(-w.occ.count() // 5)
    assert n > 12 and w.tasks() == n
    plan = _plan(w.ordered(60))
    assert plan.count("Exchange") == plan.count("hashpartitioning(seq_id") == plan.count("REPARTITION_BY_NUM") == 2 and f", {n})" in plan


def test_local_neighbours_are_counted_where_they_meet(placed):
    """Pairs are not dealt again, and give the counts that pairs told in both orders give."""
    show = lambda pairs: sorted((r.seq_id, r.win, r.motif_id, r.reverse, r.start, tuple(r.near)) for r in local.local_neighbours(placed.occurrences, pairs, PAIRED).collect())
    assert show(placed.ordered(local.REACH)) == show(placed.pairs(local.REACH))
    counted = _plan(local.local_neighbours(placed.occurrences, placed.ordered(local.REACH), PAIRED))
    assert counted.count("Exchange") < _plan(local.local_neighbours(placed.occurrences, placed.pairs(local.REACH), PAIRED)).count("Exchange")


def test_readers_and_scans_give_memory_back(spark, monkeypatch):
    from strandline.functions import iupac
    from strandline.session import map_arrow

    names = []
    for module in (iupac, scan):
        monkeypatch.setattr(module, "map_arrow", lambda df, work, schema, m=module: names.append(m.__name__) or map_arrow(df, work, schema))
    texts = spark.createDataFrame([(1, "G" * 9), (2, None)], "id long, text string")
    seqs = iupac.sequences_of_texts(texts)
    scan.scan(seqs, PAIRED).collect()
    assert [r.len for r in seqs.collect()] == [9] and len(names) == 2
