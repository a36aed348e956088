"""Sequence classifiers: windows in, a score a window out. Fitting gathers training vectors or weights, which are small,
on the driver; scoring stays distributed."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.config import Kernel, Settings, SvmType
from strandline.models import logodds, vector
from strandline.models.binned_forest import train_forest_all_rows
from strandline.models.forest import train_forest
from strandline.models.svm import Svm, Vote
from strandline.models.whole import train_votes
from strandline.operators import local
from strandline.operators.features import Feature, Windows, empty_value, feature_values, instantiate, used_motifs, vectors
from strandline.operators.pairs import pair_counts
from strandline.operators.scan import scan
from strandline.operators.windows import n_windows
from strandline.session import join_large, materialize, ship_package
from strandline.sources.motifs import MotifSet


#: Windows of a sequence that are cut at once.
PIECES = 4096


def with_len(seqs: DataFrame) -> DataFrame:
    return seqs if "len" in seqs.columns else seqs.withColumn("len", F.length("seq"))


def training_pieces(seqs: DataFrame, settings: Settings) -> DataFrame:
    """Each training window as a sequence of its own, at most one window long when it is scanned: seq_id, seq, len,
    class_value. Full sequences stay whole. Windows are cut in one pass, without a join."""
    s = settings
    ship_package(seqs.sparkSession)
    full = F.col("train_mode") == "full"
    n = F.when(full, (F.col("len") > 0).cast("long")).when(F.col("train_mode") == "win", n_windows(F.col("len"), s.window_size, s.train_step)).otherwise(0)
    step = F.when(full, 0).otherwise(s.train_step).cast("long")
    size = F.when(full, F.col("len")).otherwise(s.window_size).cast("long")
    chosen = seqs.select("seq_id", F.col("seq").cast("binary").alias("seq"), F.col("class_value").cast("double").alias("class_value"), n.cast("long").alias("n"), step.alias("step"), size.alias("size"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for seq_id, seq, value, n, step, size in zip(*(c.to_pylist() for c in batch.columns)):
                for first in range(0, n, PIECES):
                    wins = range(first, min(n, first + PIECES))
                    cut = [seq[i * step : i * step + size].decode() for i in wins]
                    yield pa.RecordBatch.from_arrays([pa.array([seq_id] * len(cut)), pa.array(wins, pa.int64()), pa.array(cut, pa.string()), pa.array([value] * len(cut), pa.float64())], names=["seq_id", "win", "seq", "class_value"])

    kind = seqs.schema["seq_id"].dataType.simpleString()
    piece = chosen.where("n > 0").mapInArrow(work, f"seq_id {kind}, win long, seq string, class_value double")
    return piece.select(F.xxhash64("seq_id", "win", "class_value").alias("seq_id"), "seq", F.length("seq").alias("len"), "class_value")


def machine_weights(machine: Svm, names: list[str]) -> list[tuple[str, float]]:
    """Weights of a linear or quadratic machine in unscaled features; none of other kernels."""
    if machine.kernel is Kernel.LINEAR:
        weights, bias = machine.linear_weights()
        return [*zip(names, weights.tolist()), ("bias", bias)]
    if machine.kernel is Kernel.QUADRATIC:
        pairs, single, bias = machine.quadratic_weights()
        both = [(f"{a} x {b}", float(pairs[i, j] * (1 if i == j else 2))) for i, a in enumerate(names) for j, b in enumerate(names) if j <= i]
        return [*both, *zip(names, single.tolist()), ("bias", bias)]
    return []


@dataclass
class SequenceModel:
    """Fit on (seq_id, seq, class_value, train_mode), score windows of (seq_id, seq)."""

    motifs: MotifSet
    settings: Settings = field(default_factory=Settings)
    positives: frozenset[float] = frozenset({1.0})

    def windows(self, seqs: DataFrame, motifs: MotifSet | None = None) -> Windows:
        s = self.settings
        seqs = with_len(seqs)
        return Windows(seqs, scan(seqs, motifs or self.motifs, s.automaton), s.window_size, s.window_step, self.motifs.max_len)

    def windows_of_stretches(self, stretches: DataFrame, motifs: MotifSet | None = None) -> Windows:
        """windows() of sequences that come in stretches with an overlap of reach() or more: no task holds a sequence."""
        s = self.settings
        lengths = materialize(stretches.where("begin = 0").select("seq_id", "len"), "lengths")
        return Windows(stretches, scan(stretches, motifs or self.motifs, s.automaton), s.window_size, s.window_step, self.motifs.max_len, known={"lengths": lengths})

    def reach(self) -> int:
        """Bases beyond a place that scoring may look at."""
        return max(self.motifs.max_len, self.settings.window_size, 2 * local.REACH + 1)

    def whole(self, pieces: DataFrame, motifs: MotifSet | None = None) -> Windows:
        """Pieces as one window each, whatever their length."""
        longest = pieces.agg(F.max("len")).first()[0] or 1
        return Windows(pieces, scan(pieces, motifs or self.motifs, self.settings.automaton), int(longest) + 2, int(longest) + 1, self.motifs.max_len, self.settings.window_size)

    def flag(self) -> Column:
        return F.col("class_value").isin(*self.positives)

    def scan_motifs(self) -> MotifSet:
        """Motifs that scoring needs."""
        return self.motifs

    def scored(self, w: Windows) -> DataFrame:
        """seq_id, win, win_start, win_len, score of the windows of w."""
        raise NotImplementedError

    def score_windows(self, seqs: DataFrame) -> DataFrame:
        """seq_id, win, win_start, win_len, score, the threshold not taken away."""
        return self.scored(self.windows(seqs, self.scan_motifs()))

    def score_sequences(self, seqs: DataFrame) -> DataFrame:
        """seq_id, score: the highest of a sequence's windows; 0 without any."""
        w = self.windows(seqs, self.scan_motifs())
        best = self.scored(w).groupBy("seq_id").agg(F.max("score").alias("score"))
        return join_large(w.lengths.select("seq_id"), best, "seq_id", "left").select("seq_id", F.coalesce("score", F.lit(0.0)).alias("score"))

    def validation_table(self, seqs: DataFrame) -> DataFrame:
        """seq_id, score, flag of sequences that have a class_value."""
        return join_large(self.score_sequences(seqs), seqs.select("seq_id", self.flag().alias("flag")), "seq_id")

    def with_threshold(self, threshold: float) -> SequenceModel:
        return replace(self, settings=replace(self.settings, threshold=threshold))

    def weight_table(self) -> list[tuple[str, float]]:
        raise ValueError("this model has no weights to export")

    def feature_rows(self) -> list[tuple[str, str]]:
        return []

    def describe(self, seqs: DataFrame) -> DataFrame:
        """item, value of the settings, the motifs, the windows, the features and the numbers of sequences by class."""
        rows = [(f"setting {k}", str(getattr(v, "value", v))) for k, v in vars(self.settings).items()]
        rows += [(f"motif {m.name}", f"{m.pattern or 'matrix'} ({m.mismatches} mismatches)" if m.kind == "iupac" else f"matrix of {len(m)}, threshold {m.threshold:g}") for m in self.motifs]
        rows += [("windows", f"{self.settings.window_size} bases, a step of {self.settings.window_step}, {self.settings.train_step} in training"), *self.feature_rows()]
        counts = seqs.groupBy(F.concat(F.lit("sequences of class "), F.col("class_value").cast("string")).alias("item")).agg(F.count("*").cast("string").alias("value"))
        return seqs.sparkSession.createDataFrame(rows, "item string, value string").unionByName(counts)


@dataclass
class PairSum(SequenceModel):
    """Sum of pair counts per 1000 bases; nothing to train."""

    def fit(self, seqs: DataFrame) -> PairSum:
        return self

    def pair_values(self, w: Windows) -> DataFrame:
        found = pair_counts(w.stored(), self.settings, self.motifs.max_len)
        return found.withColumn("value", F.col("n") * 1000 / F.col("win_len"))

    def scored(self, w: Windows) -> DataFrame:
        # one division of the whole number of pairs: sums of rounded shares depend on their order, and so do ties when rounded
        counts = pair_counts(w.stored(), self.settings, self.motifs.max_len)
        total = counts.groupBy("seq_id", "win").agg((F.sum("n") * 1000 / F.first("win_len")).alias("s"))
        return join_large(w.windows, total, ["seq_id", "win"], "left").select("seq_id", "win", "win_start", "win_len", F.coalesce("s", F.lit(0.0)).alias("score"))


@dataclass
class PairLogOdds(PairSum):
    """Pair counts per 1000 bases, weighed by log-odds."""

    table: list[tuple[int, int, float]] | None = None

    def pairs(self) -> list[tuple[int, int]]:
        ids = [m.motif_id for m in self.motifs]
        return [(a, b) for i, a in enumerate(ids) for b in ids[i:]]

    def fit(self, seqs: DataFrame) -> PairLogOdds:
        pieces = materialize(training_pieces(with_len(seqs), self.settings), "training-windows")
        w = self.whole(pieces)
        own = replace(self.settings, window_size=w.size, window_step=w.step)
        counted = join_large(pair_counts(w.stored(), own, self.motifs.max_len), pieces.select("seq_id", "len", self.flag().alias("flag")), "seq_id")
        sums = counted.groupBy("a", "b", "flag").agg(F.sum(F.col("n") * 1000 / F.col("len")).alias("v")).collect()  # two rows a pair
        n = {r["flag"]: r["count"] for r in pieces.groupBy(self.flag().alias("flag")).count().collect()}
        total = {(r["a"], r["b"], r["flag"]): r["v"] for r in sums}
        pairs = self.pairs()
        found = logodds.weigh([(total.get((*p, True), 0.0), total.get((*p, False), 0.0)) for p in pairs], n.get(True, 0), n.get(False, 0), self.settings.weight_mode, self.settings.beta)
        return replace(self, table=[(*p, x) for p, x in zip(pairs, found)])

    def scored(self, w: Windows) -> DataFrame:
        if self.table is None:
            raise ValueError("fit the model first")
        found = self.pair_values(w)
        table = F.broadcast(w.seqs.sparkSession.createDataFrame(self.table, "a int, b int, weight double"))  # a row a pair of motifs
        total = found.join(table, ["a", "b"]).groupBy("seq_id", "win").agg(F.sum(F.col("value") * F.col("weight")).alias("s"))
        return join_large(w.windows, total, ["seq_id", "win"], "left").select("seq_id", "win", "win_start", "win_len", F.coalesce("s", F.lit(0.0)).alias("score"))

    def weight_table(self) -> list[tuple[str, float]]:
        name = {m.motif_id: m.name for m in self.motifs}
        return [(f"{name[a]}, {name[b]}", w) for a, b, w in self.table or []]


@dataclass
class FeatureModel(SequenceModel):
    """A vector classifier on features of windows. kind: sum, logodds, svm, forest, lda or perceptron."""

    features: tuple[Feature, ...] = ()
    kind: str = "sum"
    machine: object = None

    @property
    def instances(self):
        return instantiate(list(self.features), self.motifs)

    def feature_rows(self) -> list[tuple[str, str]]:
        return [(f"feature {i.feature_id}", i.name(self.motifs)) for i in self.instances]

    def vectors(self, w: Windows) -> DataFrame:
        return vectors(w, feature_values(w, self.instances), self.instances)

    def fit(self, seqs: DataFrame) -> FeatureModel:
        if self.kind == "sum":
            return self
        s = self.settings
        pieces = materialize(training_pieces(with_len(seqs), s), "training-windows")
        w = self.whole(pieces, used_motifs(self.instances, self.motifs))
        values = feature_values(w, self.instances)
        if self.kind == "logodds":
            labelled = join_large(values, pieces.select("seq_id", self.flag().alias("flag")), "seq_id")
            sums = {(r["feature_id"], r["flag"]): r["v"] for r in labelled.groupBy("feature_id", "flag").agg(F.sum("value").alias("v")).collect()}
            n = {r["flag"]: r["count"] for r in pieces.groupBy(self.flag().alias("flag")).count().collect()}
            found = logodds.weigh([(sums.get((i.feature_id, True), 0.0), sums.get((i.feature_id, False), 0.0)) for i in self.instances], n.get(True, 0), n.get(False, 0), s.weight_mode, s.beta)
            return replace(self, machine=found)
        rows = materialize(join_large(vectors(w, values, self.instances), pieces.select("seq_id", self.flag().alias("flag")), "seq_id"), "training-vectors")
        return replace(self, machine=vector.fit(rows, self.kind, s, "seq_id"))

    def scan_motifs(self) -> MotifSet:
        return used_motifs(self.instances, self.motifs)

    def scored(self, w: Windows) -> DataFrame:
        if self.kind != "sum" and self.machine is None:
            raise ValueError("fit the model first")
        spark = w.seqs.sparkSession
        if self.kind in ("sum", "logodds"):
            weight = self.machine or [1.0] * len(self.instances)
            table = F.broadcast(spark.createDataFrame([(i.feature_id, float(x), float(x) * empty_value(i, w.limit)) for i, x in zip(self.instances, weight)], "feature_id int, weight double, none double"))
            base = float(sum(x * empty_value(i, w.limit) for i, x in zip(self.instances, weight)))  # of a window without any value
            total = feature_values(w, self.instances).join(table, "feature_id").groupBy("seq_id", "win").agg(F.sum(F.col("value") * F.col("weight") - F.col("none")).alias("s"))
            return join_large(w.windows, total, ["seq_id", "win"], "left").select("seq_id", "win", "win_start", "win_len", (F.coalesce("s", F.lit(0.0)) + base).alias("score"))
        ship_package(spark)
        shared = spark.sparkContext.broadcast(self.machine)

        @F.pandas_udf("double")
        def decide(features: pd.Series) -> pd.Series:
            return pd.Series(shared.value.decide(np.array(features.tolist(), dtype=np.float64)) if len(features) else [], dtype="float64")

        starts = w.windows.select("seq_id", "win", "win_start")
        return join_large(self.vectors(w), starts, ["seq_id", "win"]).select("seq_id", "win", "win_start", "win_len", decide("features").alias("score"))


    def weight_table(self) -> list[tuple[str, float]]:
        """Weights by feature name of log-odds, and of linear and quadratic machines in unscaled features."""
        names = [i.name(self.motifs) for i in self.instances]
        if self.kind == "logodds":
            return list(zip(names, self.machine or []))
        if self.kind == "svm" and self.machine.kernel in (Kernel.LINEAR, Kernel.QUADRATIC):
            return machine_weights(self.machine, names)
        raise ValueError("this model has no weights to export")


@dataclass
class Hierarchical(SequenceModel):
    """Each occurrence is classed by the bases and motifs around it, by a machine of its motif; windows are scored by
    log-odds of positive occurrences per 1000 bases. kind: svm (one-versus-one votes) or forest."""

    kind: str = "svm"
    machines: dict[int, object] | None = None
    weight: dict[int, float] | None = None

    def feature_rows(self) -> list[tuple[str, str]]:
        return [(f"local feature {i}", n) for i, n in enumerate(local.local_names(self.motifs, self.settings.local_features))]

    def local(self, w: Windows) -> DataFrame:
        w.stored()
        return local.local_vectors(w.occurrences, w.seqs, w.occ, self.motifs, w.size, w.step, self.settings.local_features)

    def _train(self, samples: DataFrame) -> dict[int, object]:
        """Machines by motif. One of at most Settings.training_rows samples is trained by a task; of more, forests grow and
        votes are trained over all rows."""
        import pickle

        s, kind, positives = self.settings, self.kind, self.positives
        svm_type = s.svm_type if s.svm_type in (SvmType.C_SVC, SvmType.NU_SVC) else SvmType.C_SVC

        def train(df: pd.DataFrame) -> pd.DataFrame:
            df = df.sort_values(["seq_id", "start", "reverse"])
            x, labels = np.array(df["features"].tolist(), dtype=np.float64), df["class_value"].to_numpy(np.float64)
            if kind == "svm":
                machine = Vote.train(x, labels, svm_type=svm_type, kernel=s.kernel, cost=s.cost, nu=s.nu, c0=s.c0, gamma=s.gamma)
            else:
                y = np.isin(labels, list(positives))
                machine = train_forest(x, y, s.trees, s.depth, s.seed) if 0 < y.sum() < len(y) else bool(y.all())
            return pd.DataFrame({"motif_id": [int(df["motif_id"].iloc[0])], "machine": [pickle.dumps(machine)]})

        keyed = samples.withColumn("_key", F.xxhash64("seq_id", "start", "reverse"))
        many = [r["motif_id"] for r in samples.groupBy("motif_id").count().collect() if r["count"] > s.training_rows]  # a row a motif
        few = keyed.where(~F.col("motif_id").isin(many)).drop("_key")
        rows = few.groupBy("motif_id").applyInPandas(train, "motif_id int, machine binary").collect()
        out = {r["motif_id"]: pickle.loads(r["machine"]) for r in rows}
        if many and kind == "svm":
            own = keyed.where(F.col("motif_id").isin(many))
            out |= {m: vote for (m,), vote in train_votes(own, replace(s, svm_type=svm_type), ["motif_id"], "class_value", ["seq_id", "start", "reverse"], "_key").items()}
        for m in many if kind == "forest" else ():
            own = keyed.where(F.col("motif_id") == m).withColumn("flag", F.col("class_value").isin(*positives))
            flags = [r["flag"] for r in own.select("flag").distinct().collect()]
            out[m] = train_forest_all_rows(own, "_key", "flag", s.trees, s.depth, s.seed) if len(flags) > 1 else flags[0]
        return out

    def classed(self, placed: DataFrame) -> DataFrame:
        """placed occurrences with positive."""
        ship_package(placed.sparkSession)
        shared = placed.sparkSession.sparkContext.broadcast((self.machines, tuple(self.positives)))

        @F.pandas_udf("boolean")
        def positive(motif: pd.Series, features: pd.Series) -> pd.Series:
            machines, positives = shared.value
            x = np.array(features.tolist(), dtype=np.float64)
            out = np.zeros(len(motif), bool)
            for m in motif.unique():
                at = (motif == m).to_numpy()
                machine = machines.get(int(m))
                if isinstance(machine, bool):
                    out[at] = machine
                elif machine is not None:
                    out[at] = np.isin(machine.choose(x[at]), positives) if hasattr(machine, "choose") else machine.decide(x[at]) > 0
            return pd.Series(out)

        return placed.withColumn("positive", positive("motif_id", "features")).drop("features")

    def fit(self, seqs: DataFrame) -> Hierarchical:
        ship_package(seqs.sparkSession)
        pieces = materialize(training_pieces(with_len(seqs), self.settings), "training-windows")
        w = self.whole(pieces)
        samples = materialize(join_large(self.local(w), pieces.select("seq_id", "class_value", "len"), "seq_id"), "samples")
        model = replace(self, machines=self._train(samples))
        counts = model.classed(samples).where("positive").groupBy("motif_id", self.flag().alias("flag")).agg(F.sum(F.lit(1000.0) / F.col("len")).alias("v")).collect()
        n = {r["flag"]: r["count"] for r in pieces.groupBy(self.flag().alias("flag")).count().collect()}
        total = {(r["motif_id"], r["flag"]): r["v"] for r in counts}
        ids = [m.motif_id for m in self.motifs]
        found = logodds.weigh([(total.get((m, True), 0.0), total.get((m, False), 0.0)) for m in ids], n.get(True, 0), n.get(False, 0), self.settings.weight_mode, self.settings.beta)
        return replace(model, weight=dict(zip(ids, found)))

    def positive_occurrences(self, w: Windows) -> DataFrame:
        """Positive occurrences by window with their motif's weight."""
        if self.machines is None or self.weight is None:
            raise ValueError("fit the model first")
        table = F.broadcast(w.seqs.sparkSession.createDataFrame(list(self.weight.items()), "motif_id int, weight double"))  # a row a motif
        return w.once("positive", lambda: materialize(self.classed(self.local(w)).where("positive").join(table, "motif_id"), "positive-occurrences"))

    def scored(self, w: Windows) -> DataFrame:
        total = self.positive_occurrences(w).groupBy("seq_id", "win").agg(F.sum("weight").alias("s"))
        return join_large(w.windows, total, ["seq_id", "win"], "left").select("seq_id", "win", "win_start", "win_len", (F.coalesce("s", F.lit(0.0)) * 1000 / F.col("win_len")).alias("score"))

    def weight_table(self) -> list[tuple[str, float]]:
        """Weights by motif; then, for votes, those of each boundary between two classes in unscaled local features, where
        its kernel has such weights."""
        name = {m.motif_id: m.name for m in self.motifs}
        rows = [(name[m], w) for m, w in (self.weight or {}).items()]
        features = local.local_names(self.motifs, self.settings.local_features)
        for m, machine in (self.machines or {}).items():
            if isinstance(machine, Vote):
                for (a, b), one in zip(combinations(machine.classes, 2), machine.machines):
                    rows += [(f"{name[m]}: {a:g} against {b:g}: {n}", w) for n, w in machine_weights(one, features)]
        return rows


