"""Feature specifications, their instances over a motif set, and feature values by window."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.sequences import PI
from strandline.operators import pairs as P
from strandline.operators.windows import occurrences_in_windows, sliding, window_gc, window_length
from strandline.session import join_large, materialize
from strandline.sources.motifs import MotifSet

#: How many motifs an instance names: none, one, all ordered pairs, pairs with y <= x.
KINDS = {"nOcc": 1, "GC": 0, "nPair": "reflexive", "nOccPair": 2, "nPair2D": "reflexive", "nPairDH": "reflexive", "PEDI": "reflexive", "MDPA": 1, "MDP": 2, "MDM": 2, "MDDA": 1, "MDD": 2}

#: Occurrences whose neighbours a task sums up: each has a sum for every window that holds it and every motif, all of which
#: the task keeps in memory.
SUMMED = 50_000


@dataclass(frozen=True)
class Feature:
    """type and parameters: distance (nPair, nOccPair, nPair2D, nPairDH, PEDI), period (nPair2D, PEDI), phase (PEDI);
    motifs that are None mean all. cosines: both instances of nPair2D are cosines, as in models whose second axis never
    was a sine; their names stay."""

    type: str
    distance: float = 0
    period: float = 1
    phase: float = 0
    a: int | None = None
    b: int | None = None
    cosines: bool = False


@dataclass(frozen=True)
class Instance:
    feature_id: int
    feature: Feature
    a: int | None
    b: int | None
    axis: int = 0

    def name(self, motifs: MotifSet) -> str:
        f = self.feature
        params = {"nPair": (f.distance,), "nOccPair": (f.distance,), "nPairDH": (f.distance,), "nPair2D": (f.distance, f.period, "XY"[self.axis]), "PEDI": (f.distance, f.period, f.phase)}.get(f.type, ())
        label = {m.motif_id: m.name for m in motifs}
        text = f.type + ("(" + ", ".join(f"{p:g}" if not isinstance(p, str) else p for p in params) + ")" if params else "")
        return text + "".join(f"{'  ' if i == 0 else ', '}{label[m]}" for i, m in enumerate(x for x in (self.a, self.b) if x is not None))


def instantiate(features: list[Feature], motifs: MotifSet) -> list[Instance]:
    """One instance per motif, ordered pair, or pair with y <= x, as the type asks; nPair2D has a cosine and a sine."""
    ids, out = [m.motif_id for m in motifs], []
    for f in features:
        kind = KINDS[f.type]
        xs = ids if f.a is None else [f.a]
        for axis in (0, 1) if f.type == "nPair2D" else (0,):
            if kind == 0:
                named = [(None, None)]
            elif kind == 1:
                named = [(x, None) for x in xs]
            else:
                named = [(x, y) for x in xs for y in (ids if f.b is None else [f.b]) if kind == 2 or f.a is not None or f.b is not None or y <= x]
            out += [Instance(len(out) + i, f, x, y, axis) for i, (x, y) in enumerate(named)]
    return out


def used_motifs(instances: list[Instance], motifs: MotifSet) -> MotifSet:
    """Motifs that a scan is needed for."""
    if any(i.feature.type in ("MDPA", "MDDA") for i in instances):
        return motifs
    return motifs.only({m for i in instances for m in (i.a, i.b) if m is not None})


@dataclass
class Windows:
    """Sequences cut into windows, with what is found in them."""

    seqs: DataFrame  # seq_id, seq, len
    occ: DataFrame
    size: int
    step: int
    max_len: int
    limit: int | None = None  # of distances to neighbours; the window's size unless stated
    known: dict = field(default_factory=dict)

    def once(self, key, make):
        if key not in self.known:
            self.known[key] = make()
        return self.known[key]

    def __post_init__(self) -> None:
        self.limit = self.size if self.limit is None else self.limit

    def stored(self) -> DataFrame:
        """The occurrences, written once and read by all that use them more than once: a scan is the dearest step."""
        if "stored" not in self.known:
            self.occ = self.known["stored"] = materialize(self.occ, "occurrences")
        return self.occ

    @property
    def lengths(self) -> DataFrame:
        """seq_id, len of each sequence, written once: bases are not read again for their number."""
        return self.once("lengths", lambda: materialize(self.seqs.select("seq_id", "len"), "lengths"))

    @property
    def windows(self) -> DataFrame:
        return self.once("windows", lambda: sliding(self.lengths, self.size, self.step))

    @property
    def occurrences(self) -> DataFrame:
        return self.once("occ", lambda: occurrences_in_windows(self.occ, self.size, self.step))

    def pairs(self, reach: float) -> DataFrame:
        """Unordered pairs of different occurrences, by window."""
        reach = min(self.size, int(reach) + self.max_len)
        return self.once(("pairs", reach), lambda: P.pairs_in_windows(P.occurrence_pairs(self.stored(), reach), self.size, self.step))

    def ordered(self, reach: float) -> DataFrame:
        """Ordered pairs of different occurrences, by window and by the first one's bucket, over as many tasks as keep what
        they sum up in memory."""
        reach = min(self.size, int(reach) + self.max_len)
        return self.once(("ordered", reach), lambda: P.pairs_in_windows(P.ordered_pairs(self.stored(), reach, self.tasks()), self.size, self.step))

    def tasks(self) -> int:
        """Tasks that sum up SUMMED occurrences each, as many as there are cores at least; the files of the stored ones tell
        their number."""
        return self.once("tasks", lambda: max(self.occ.sparkSession.sparkContext.defaultParallelism, -(-self.stored().count() // SUMMED)))


def _named(df: DataFrame, instances: list[Instance], a: Column, b: Column | None, reflexive: bool) -> DataFrame:
    """Rows with the feature_id of the instances that name their motifs, in either order if reflexive: an equi-join with a
    broadcast table of a few rows an instance."""
    rows = [(i.feature_id, i.a, i.b, i.axis) for i in instances]
    if b is not None and reflexive:
        rows = [(*r, min(r[1:3]), max(r[1:3])) for r in rows]
        a, b = F.least(a, b), F.greatest(a, b)
    else:
        rows = [(*r, *r[1:3]) for r in rows]
    table = F.broadcast(df.sparkSession.createDataFrame(rows, "feature_id int, fa int, fb int, axis int, _x int, _y int"))
    on = a == F.col("_x") if b is None else (a == F.col("_x")) & (b == F.col("_y"))
    return df.join(table, on).drop("_x", "_y")


def _sum(df: DataFrame, value: Column) -> DataFrame:
    return df.groupBy("seq_id", "win", "feature_id").agg(F.sum(value).cast("double").alias("v"), F.first("seq_len").alias("seq_len"))


def _counts(w: Windows, instances: list[Instance]) -> DataFrame:
    return _sum(_named(w.occurrences, instances, F.col("motif_id"), None, False), F.lit(1))


def _n_pair(w: Windows, instances: list[Instance]) -> DataFrame:
    d = instances[0].feature.distance
    near = w.pairs(d).where(P.pair_gap() <= int(d))
    return _sum(_named(near, instances, F.col("a_motif_id"), F.col("b_motif_id"), True), F.lit(1))


def _n_occ_pair(w: Windows, instances: list[Instance]) -> DataFrame:
    d = instances[0].feature.distance
    near = P.both_orders(w.pairs(d).where(P.pair_centers() <= int(d)))
    once = near.select("seq_id", "seq_len", "win", "a_motif_id", "a_reverse", "a_start", "b_motif_id").distinct()
    return _sum(_named(once, instances, F.col("a_motif_id"), F.col("b_motif_id"), False), F.lit(1))


def _oriented(df: DataFrame) -> tuple[Column, Column]:
    """Signed distance and strand as the instance names the motifs: from fa's occurrence to fb's."""
    forward = F.col("a_motif_id") == F.col("fa")
    return F.when(forward, P.signed_centers()).otherwise(-P.signed_centers()), F.when(forward, F.col("a_reverse")).otherwise(F.col("b_reverse"))


def _n_pair_2d(w: Windows, instances: list[Instance]) -> DataFrame:
    f = instances[0].feature
    near = _named(w.pairs(f.distance).where(P.pair_centers() <= int(f.distance)), instances, F.col("a_motif_id"), F.col("b_motif_id"), True)
    signed, reverse = _oriented(near)
    same = F.col("fa") == F.col("fb")
    phase = F.when(same, P.pair_centers()).otherwise(F.when(reverse, -signed).otherwise(signed)) / F.lit(float(f.period)) * F.lit(PI) * F.lit(2.0)
    sine = F.lit(False) if f.cosines else F.col("axis") == 1
    return _sum(near, F.when(sine, F.sin(phase)).otherwise(F.cos(phase)))


def _n_pair_dh(w: Windows, instances: list[Instance]) -> DataFrame:
    """The shift of opposite strands is half a turn, so the sign of the distance plays no part."""
    f = instances[0].feature
    near = _named(w.pairs(f.distance).where(P.pair_centers() <= int(f.distance)), instances, F.col("a_motif_id"), F.col("b_motif_id"), True)
    shift = F.when(F.col("a_reverse") != F.col("b_reverse"), F.lit(5.25)).otherwise(F.lit(0.0))
    return _sum(near, (F.cos((P.pair_centers() + shift) / F.lit(10.5) * F.lit(PI) * F.lit(2.0)) + 1.0) / 2.0)


def _pedi(w: Windows, instances: list[Instance]) -> DataFrame:
    """Ordered pairs, each occurrence with itself too; the phase is added to the distance before the cutoff."""
    f = instances[0].feature
    alone = P.pairs_in_windows(P.self_pairs(w.stored()), w.size, w.step).withColumn("times", F.lit(1))
    both = w.pairs(max(0, f.distance - f.phase)).withColumn("times", F.when(F.col("a_motif_id") == F.col("b_motif_id"), 2).otherwise(1)).unionByName(alone)
    d = P.pair_centers() + F.lit(float(f.phase))
    near = _named(both.where(d <= int(f.distance)), instances, F.col("a_motif_id"), F.col("b_motif_id"), True)
    return _sum(near, F.col("times") * (F.cos(d / F.lit(float(f.period)) * F.lit(PI) * F.lit(2.0)) + 1.0) / 2.0)


def _neighbours(w: Windows, instances: list[Instance]) -> DataFrame:
    """Mean over an occurrence's least (MDP, MDPA), mean (MDM) or largest (MDD, MDDA) distance to the others."""
    kind = instances[0].feature.type
    ordered = w.ordered(w.limit)
    distance = P.pair_centers() if kind in ("MDP", "MDPA") else P.pair_gap()
    any_ = kind in ("MDPA", "MDDA")
    named = _named(ordered, instances, F.col("a_motif_id"), None if any_ else F.col("b_motif_id"), False)
    inner = {"MDP": F.min, "MDPA": F.min, "MDM": F.avg, "MDD": F.max, "MDDA": F.max}[kind](distance)
    each = named.where(distance < w.limit if kind in ("MDP", "MDPA") else distance <= w.limit).groupBy("seq_id", "bucket", "win", "feature_id", "a_motif_id", "a_reverse", "a_start").agg(inner.alias("d"))
    return each.groupBy("seq_id", "win", "feature_id").agg(F.avg("d").alias("v"))


def _gc(w: Windows, instances: list[Instance]) -> DataFrame:
    return window_gc(w.seqs, w.size, w.step).select("seq_id", "win", F.lit(instances[0].feature_id).alias("feature_id"), F.col("gc").alias("v"))


_VALUES = {"nOcc": _counts, "nPair": _n_pair, "nOccPair": _n_occ_pair, "nPair2D": _n_pair_2d, "nPairDH": _n_pair_dh, "PEDI": _pedi, "MDPA": _neighbours, "MDP": _neighbours, "MDM": _neighbours, "MDDA": _neighbours, "MDD": _neighbours, "GC": _gc}
_PER_BASE = frozenset(("nOcc", "nPair", "nOccPair", "nPair2D", "nPairDH", "PEDI"))


def feature_values(w: Windows, instances: list[Instance]) -> DataFrame:
    """seq_id, win, feature_id, value of what was found: counts and sums per base of the window, distances as they are.
    Windows without anything to count have no row; see fill()."""
    parts, features = [], dict.fromkeys(i.feature for i in instances)
    if sum(f.type != "GC" for f in features) > 1:
        w.stored()
    for f in features:
        own = [i for i in instances if i.feature == f]
        found = _VALUES[f.type](w, own)
        if f.type in _PER_BASE:
            length = window_length(F.col("win"), F.col("seq_len"), w.size, w.step)
            found = found.select("seq_id", "win", "feature_id", (F.col("v") / length).alias("value"))
        else:
            found = found.select("seq_id", "win", "feature_id", F.col("v").alias("value"))
        parts.append(found)
    return reduce(DataFrame.unionByName, parts)


def empty_value(i: Instance, size: int) -> float:
    """A distance without a pair is the window's size, any other feature 0."""
    return float(size) if i.feature.type[:2] == "MD" else 0.0


def fill(w: Windows, values: DataFrame, instances: list[Instance]) -> DataFrame:
    """A row for each window and instance."""
    table = values.sparkSession.createDataFrame([(i.feature_id, empty_value(i, w.limit)) for i in instances], "feature_id int, none double")
    every = w.windows.select("seq_id", "win").crossJoin(F.broadcast(table))  # a few rows an instance
    return join_large(every, values, ["seq_id", "win", "feature_id"], "left").select("seq_id", "win", "feature_id", F.coalesce("value", "none").alias("value"))


def vectors(w: Windows, values: DataFrame, instances: list[Instance]) -> DataFrame:
    """seq_id, win, features: dense vectors in the instances' order. Values meet in a map, so windows times instances
    rows are never made."""
    found = values.groupBy("seq_id", "win").agg(F.map_from_entries(F.collect_list(F.struct("feature_id", "value"))).alias("found"))
    dense = F.array(*[F.coalesce(F.element_at("found", F.lit(i.feature_id)), F.lit(empty_value(i, w.limit))) for i in instances])
    return join_large(w.windows, found, ["seq_id", "win"], "left").select("seq_id", "win", "win_len", dense.alias("features"))
