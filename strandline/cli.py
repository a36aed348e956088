"""Command line: `python -m strandline OPTIONS`. Options act in the order given where order matters (motifs, features).

Every source, motif kind, feature, classifier, kernel, weight mode and output has an option; see --help."""

from __future__ import annotations

import argparse
from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline import sinks
from strandline.config import LOCAL_FEATURES, CoreMode, Distance, Kernel, Settings, SvmType, WeightMode
from strandline.models.sequence import FeatureModel, Hierarchical, PairLogOdds, PairSum, SequenceModel
from strandline.operators import intervals, metrics, scan, windows
from strandline.operators.features import Feature, Windows
from strandline.session import materialize
from strandline.sources import background
from strandline.sources.byteranges import read_stretches, records
from strandline.sources.fasta import Classes, read_fasta
from strandline.sources.motifs import MotifSet
from strandline.sources.readers import read_sequences

ROLES = ("train", "validate", "calibrate")
MODELS = ("pair-sum", "pair-logodds", "sum", "logodds", "svm", "forest", "lda", "perceptron", "hierarchical-svm", "hierarchical-forest")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="strandline", description=__doc__)
    many = {"action": "append", "default": []}
    p.add_argument("--seed", type=int, default=0)
    p.add_argument("--format", default="fasta", help="of the sequences that train, calibrate and validate: fasta, or a reader that was registered")
    p.add_argument("--class", dest="classes", nargs=3, metavar=("NAME", "VALUE", "FLAG"), help="FLAG is + or -", **many)
    p.add_argument("--motif-iupac", nargs=3, metavar=("NAME", "PATTERN", "MISMATCHES"), **many)
    p.add_argument("--motif-xml", **many)
    p.add_argument("--motif-pwm", **many)
    p.add_argument("--motif-kmer", type=int, **many)
    p.add_argument("--motif-random", nargs=2, type=int, metavar=("N", "LENGTH"), **many)
    p.add_argument("--pwm-threshold", type=float)
    p.add_argument("--pwm-calibrate", type=float, metavar="PER_KB", help="threshold from a million independent bases")
    p.add_argument("--no-automaton", action="store_true")
    p.add_argument("--distance", choices=[d.value for d in Distance], default="centers")
    p.add_argument("--no-overlap", action="store_true")
    p.add_argument("--no-homo", action="store_true")
    p.add_argument("--no-hetero", action="store_true")
    p.add_argument("--feature", nargs="+", metavar="TYPE", help="TYPE [DISTANCE [PERIOD [PHASE]]]", **many)
    p.add_argument("--both-cosines", action="store_true", help="nPair2D without its sine, as older models have it")
    p.add_argument("--model", choices=MODELS, default="hierarchical-svm")
    p.add_argument("--weights", choices=[m.value for m in WeightMode], default="predictor")
    p.add_argument("--beta", type=float, default=1e-8)
    p.add_argument("--kernel", choices=[k.value for k in Kernel], default="linear")
    p.add_argument("--svm-type", choices=[t.value for t in SvmType], default="epsilon_svr")
    for name, default in (("cost", 1.0), ("nu", 0.5), ("p", 0.995), ("c0", 0.0), ("threshold", 0.0)):
        p.add_argument(f"--{name}", type=float, default=default)
    for name, default in (("window-size", 500), ("window-step", 100), ("train-step", 250), ("trees", 500), ("depth", 0), ("background-order", 4)):
        p.add_argument(f"--{name}", type=int, default=default)
    for role in ROLES:
        tail = ("CLASS", "MODE") if role == "train" else ("CLASS",)
        p.add_argument(f"--{role}-fasta", nargs=1 + len(tail), metavar=("PATH", *tail), **many)
        p.add_argument(f"--{role}-iid", nargs=3 + len(tail), metavar=("MODEL_PATH", "N", "LENGTH", *tail), **many)
        p.add_argument(f"--{role}-markov", nargs=3 + len(tail), metavar=("MODEL_PATH", "N", "LENGTH", *tail), **many)
    p.add_argument("--calibrate-precision", type=float)
    p.add_argument("--no-validate", action="store_true")
    p.add_argument("--score-table", metavar="OUT")
    p.add_argument("--score", nargs=2, metavar=("FASTA", "OUT"), help="track of all windows' scores")
    p.add_argument("--core", nargs=2, metavar=("FASTA", "OUT"), help="best window of eight sizes")
    p.add_argument("--genome", metavar="FASTA")
    p.add_argument("--gff", metavar="OUT")
    p.add_argument("--wig", metavar="OUT")
    p.add_argument("--core-mode", choices=[m.value for m in CoreMode], default="none")
    p.add_argument("--core-max", action="store_true")
    p.add_argument("--gamma", type=float, help="of kernels; 1 / features unless stated")
    p.add_argument("--local-feature", choices=LOCAL_FEATURES, help="of hierarchical models; all unless stated", **many)
    p.add_argument("--training-rows", type=int, default=50_000, help="most labelled rows that a machine trains on")
    p.add_argument("--export", metavar="OUT", help="weights of the model")
    p.add_argument("--auto", nargs=2, metavar=("FASTA", "GENOME"), help="assisted: thirds of FASTA train, calibrate and validate against Markov backgrounds")
    p.add_argument("--auto-ratio", type=int, default=100, help="negatives per positive of assisted validation")
    return p


def settings_of(a: argparse.Namespace) -> Settings:
    return Settings(
        seed=a.seed, automaton=not a.no_automaton, validate=not a.no_validate, window_size=a.window_size, window_step=a.window_step, train_step=a.train_step, homo_pairs=not a.no_homo, hetero_pairs=not a.no_hetero, pairs_can_overlap=not a.no_overlap,
        distance=Distance(a.distance), kernel=Kernel(a.kernel), svm_type=SvmType(a.svm_type), c0=a.c0, cost=a.cost, nu=a.nu, p=a.p, threshold=a.threshold, trees=a.trees, depth=a.depth, weight_mode=WeightMode(a.weights), beta=a.beta,
        wanted_precision=-1.0 if a.calibrate_precision is None else a.calibrate_precision, background_order=a.background_order, core_mode=CoreMode(a.core_mode), core_max=a.core_max,
        gamma=a.gamma, local_features=tuple(a.local_feature) or LOCAL_FEATURES, training_rows=a.training_rows,
    )


def motifs_of(spark: SparkSession, a: argparse.Namespace) -> MotifSet:
    m = MotifSet()
    for name, pattern, mismatches in a.motif_iupac:
        m.add_iupac(name, pattern, int(mismatches))
    for path in a.motif_xml:
        m.add_xml(spark, path)
    for k in a.motif_kmer:
        m.add_kmers(k)
    for n, length in a.motif_random:
        m.add_random(n, length, a.seed)
    for path in a.motif_pwm:
        m.add_pwm_table(spark, path)
    if a.pwm_threshold is not None:
        m = m.with_threshold(a.pwm_threshold)
    if a.pwm_calibrate is not None:
        m = MotifSet(x if x.kind == "iupac" else replace(x, threshold=calibrate_pwm(spark, x, a.pwm_calibrate, a.seed)) for x in m)
    return m


def calibrate_pwm(spark: SparkSession, motif, per_kb: float, seed: int) -> float:
    """The score of which so many per 1000 bases of a million independent ones are hits, on both strands. Starts at which
    a matrix is cut off by the end count with the bases that are there."""
    seqs = background.generate_iid(spark, 100, 10_000, seed=seed, stream="calibrate matrices")
    one = MotifSet([replace(motif, threshold=-1e300)])
    past = seqs.withColumn("seq", F.concat("seq", F.repeat(F.lit("."), F.lit(len(motif) - 1))))  # other symbols add nothing
    scores = scan.scan(past, one)
    return metrics.quantile_threshold(scores, per_kb, 1000).first()["threshold"]  # of a thousand kb


def sequences_of(spark: SparkSession, a: argparse.Namespace, role: str, classes: Classes) -> DataFrame | None:
    """Sequences of a role, with ids of their own, class_value and train_mode."""
    parts = []
    for kind in ("fasta", "iid", "markov"):
        for values in getattr(a, f"{role}_{kind}"):
            path, *rest = values
            mode = rest.pop() if role == "train" else "full"
            value = classes.value(rest.pop())
            seqs = read_sequences(spark, path, "error" if kind == "fasta" else "drop", a.format)
            if kind == "fasta" and a.auto and path == a.auto[0]:  # a part of its own for each role
                seqs = seqs.where(F.pmod(F.xxhash64("name"), F.lit(len(ROLES))) == ROLES.index(role))
            if kind != "fasta":
                stream = f"{role} {len(parts)}"
                n, length = map(int, rest)
                if kind == "iid":
                    seqs = background.generate_iid(spark, n, length, {r["base"]: r["p"] for r in background.train_iid(seqs).collect()}, a.seed, stream)
                else:
                    seqs = background.generate_markov(spark, background.train_markov(seqs, a.background_order), n, length, a.seed, stream)
            parts.append(seqs.select(F.xxhash64(F.lit(len(parts)), "seq_id").alias("seq_id"), "name", "seq", F.length("seq").alias("len"), F.lit(float(value)).alias("class_value"), F.lit(mode).alias("train_mode")))
    out = None
    for part in parts:
        out = part if out is None else out.unionByName(part)
    return out


def model_of(a: argparse.Namespace, motifs: MotifSet, settings: Settings, positives: frozenset[float]) -> SequenceModel:
    features = tuple(Feature(f[0], *map(float, f[1:]), cosines=a.both_cosines) for f in a.feature) or (Feature("nOcc"),)
    base = {"motifs": motifs, "settings": settings, "positives": positives}
    if a.model == "pair-sum":
        return PairSum(**base)
    if a.model == "pair-logodds":
        return PairLogOdds(**base)
    if a.model.startswith("hierarchical"):
        return Hierarchical(**base, kind=a.model.partition("-")[2])
    return FeatureModel(**base, features=features, kind=a.model)


def predict_genome(spark: SparkSession, model: SequenceModel, path: str, gff: str | None, wig: str | None) -> DataFrame:
    """Merged predictions of a genome; a chromosome's name is its header up to the first space. Chromosomes are read in
    stretches, so they may be longer than a row."""
    s = model.settings
    stretches = read_stretches(spark, path, overlap=model.reach())
    names = materialize(records(stretches).select("seq_id", F.split_part("name", F.lit(" "), F.lit(1)).alias("chrom")), "chromosomes")
    w = model.windows_of_stretches(stretches, model.scan_motifs())
    scored = track = materialize(model.scored(w), "scores")
    slack = s.window_step if s.core_mode is CoreMode.NONE else 0
    if s.core_mode is CoreMode.NONE or not isinstance(model, Hierarchical):
        found = intervals.predicted_windows(scored, s.threshold)
        placed = found.withColumns({"win_start": F.col("start"), "win_end": F.col("end")})
    else:
        hits = model.positive_occurrences(w)
        cores = intervals.core_predictions(hits.select("seq_id", "win", "start", "end", "weight"), scored, s.threshold, s.core_mode, s.window_size, numbered=True)
        cores = materialize(intervals.gated_cores(cores, s.threshold), "cores")
        placed = cores.where("kept").join(scored.select("seq_id", "win", "win_start", (F.col("win_start") + F.col("win_len")).alias("win_end")), ["seq_id", "win"])
        track = intervals.core_track(scored, cores, sinks.NONE_PREDICTED)
    placed = placed.join(names, "seq_id")
    merged = intervals.merge(intervals.best_of_overlapping(placed) if s.core_max else placed.select("chrom", "start", "end", "score"), slack, spread=True)
    if gff:
        sinks.write_lines(sinks.gff_rows(merged), gff)
    if wig:
        threshold = s.threshold if track is scored else None  # a core's score is shown whatever it is
        rows = sinks.wig_rows(track.join(names, "seq_id"), s.window_step, s.window_size, threshold)
        sinks.write_lines(rows, wig, ["chrom", "place"])
    return merged


def core_sequences(model: SequenceModel, seqs: DataFrame) -> DataFrame:
    """The best window of eight sizes of each sequence; motifs are scanned once for all sizes."""
    parts, once = [], model.windows(seqs, model.scan_motifs())
    known = {"stored": once.stored(), "lengths": once.lengths}
    for size in windows.CORE_SIZES:
        own = replace(model, settings=replace(model.settings, window_size=size, window_step=windows.CORE_STEP))
        scores = own.scored(Windows(once.seqs, once.occ, size, windows.CORE_STEP, once.max_len, known=dict(known)))
        parts.append(scores.withColumn("size", F.lit(size)).withColumn("score", F.col("score") - model.settings.threshold))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return windows.best_core(every).join(seqs.select("seq_id", "name"), "seq_id")


def run(spark: SparkSession, argv: Sequence[str]) -> SequenceModel:
    """Train, calibrate, validate and predict as the options say; the fitted model is returned."""
    a = parser().parse_args(argv)
    classes = Classes()
    for name, value, flag in a.classes or [("positive", "1", "+"), ("negative", "-1", "-")]:
        classes.register(float(value), name, flag == "+")
    if a.auto:
        a = assisted(spark, a)
    settings, motifs = settings_of(a), motifs_of(spark, a)
    model = model_of(a, motifs, settings, frozenset(v for v, _, flag in classes.rows if flag))
    train = sequences_of(spark, a, "train", classes)
    if train is not None:
        model = model.fit(train)
    calibrate = sequences_of(spark, a, "calibrate", classes)
    if calibrate is not None and settings.wanted_precision > 0:
        found = metrics.calibrate_precision(model.validation_table(calibrate), settings.wanted_precision, "seq_id").first()["threshold"]
        model = model.with_threshold(found)
        print(f"threshold {found}")
    validate = sequences_of(spark, a, "validate", classes)
    if validate is not None and settings.validate:
        table = model.validation_table(validate)
        print(metrics.confusion(table, model.settings.threshold).first().asDict())
        print({f"{n} {x}": f(table, x, "seq_id").first()["area"] for n, f in (("ROC", metrics.roc_area), ("PRC", metrics.prc_area)) for x in (0.1, 0.5, 1.0)})
        if a.score_table:
            sinks.write_lines(sinks.score_table(table), a.score_table)
    if a.export:
        rows = model.weight_table()
        sinks.write_lines(spark.createDataFrame([(f"{n}\t{w}",) for n, w in rows], "line string"), a.export)
    if a.score:
        seqs = read_fasta(spark, a.score[0])
        scored = model.score_windows(seqs).join(seqs.select("seq_id", "name"), "seq_id")
        sinks.write_lines(sinks.wig_scores(scored, settings.window_size, settings.window_step), a.score[1], ["name", "place"])
    if a.core:
        sinks.write_lines(sinks.core_table(core_sequences(model, read_fasta(spark, a.core[0]))), a.core[1])
    if a.genome:
        predict_genome(spark, model, a.genome, a.gff, a.wig)
    return model


def assisted(spark: SparkSession, a: argparse.Namespace) -> argparse.Namespace:
    """Options of assisted training: a third of the positives, by name, for each of training, calibration and validation,
    as many Markov sequences of their length to train against and a hundred times as many to calibrate and to validate
    against, each role's its own, 80 % precision."""
    path, genome = a.auto
    positives = read_fasta(spark, path)
    n, length = positives.agg(F.count("*"), F.max("len")).first()
    a.train_fasta = [*a.train_fasta, [path, "+", "full"]]
    a.train_markov = [*a.train_markov, [genome, str(n), str(length), "-", "full"]]
    for role in ("calibrate", "validate"):
        setattr(a, f"{role}_fasta", [*getattr(a, f"{role}_fasta"), [path, "+"]])
        setattr(a, f"{role}_markov", [*getattr(a, f"{role}_markov"), [genome, str(a.auto_ratio * n), str(length), "-"]])
    a.calibrate_precision = 0.8 if a.calibrate_precision is None else a.calibrate_precision
    a.genome = a.genome or genome
    return a
