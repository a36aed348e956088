"""Queries of scans, windows, features and background models over documents read as bases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.config import Distance, Settings
from strandline.functions.iupac import reverse_complement_column, sequences_of_texts
from strandline.operators import local, metrics, pairs, scan, windows
from strandline.operators.features import Feature, Windows, feature_values, fill, instantiate, used_motifs
from strandline.plans import sqltext as S
from strandline.session import join_large, read_table, spread
from strandline.sources import background
from strandline.sources.fasta import alias_value
from strandline.sources.motifs import MotifSet, distinct_patterns, kmers

SIZE, STEP = 500, 100
QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def motif_set(*rows: tuple[str, str, int]) -> MotifSet:
    out = MotifSet()
    for name, pattern, mismatches in rows:
        out.add_iupac(name, pattern, mismatches)
    return out


EXACT = motif_set(("GAF", "GAGAG", 0), ("Z", "YGAGYG", 0), ("CG", "GTGT", 0), ("PAL", "GATC", 0))
FUZZY = motif_set(("G8", "GAGAGAGA", 1), ("EN", "GSNMACGC", 1))
#: Of the pair features: few enough that the plain SQL ends.
PAIRED = motif_set(("Z", "YGAGYG", 0), ("CG", "GTGTN", 0), ("PAL", "GATC", 0))
PWM = (("W", ((1.0, -1.0, 0.5, -2.0, 1.0), (-1.0, 1.5, -0.5, 1.0, -1.0), (0.5, -1.0, 1.5, -1.0, 0.25), (-1.5, 0.25, -1.0, 1.25, -0.5))),)
PWM_THRESHOLD = 4.25


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return register


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq_id, seq, len of documents: a base a letter."""
    docs = spread(read_table(spark, sf_dir, "documents").select("doc_id", "text").where(F.col("text").isNotNull()))
    return sequences_of_texts(docs)


def placed(spark: SparkSession, sf_dir: str, motifs: MotifSet, size: int = SIZE, step: int = STEP) -> Windows:
    seqs = sequences(spark, sf_dir)
    return Windows(seqs, scan.scan(seqs, motifs), size, step, motifs.max_len)


_OCC = "SELECT seq_id, m AS motif_id, r AS reverse, s AS start_pos, e AS end_pos FROM occ"


def _occurrence_rows(occ: DataFrame) -> DataFrame:
    return occ.select("seq_id", "motif_id", "reverse", F.col("start").alias("start_pos"), F.col("end").alias("end_pos"))


@query("scan_iupac_exact", "WITH " + S.occurrences(EXACT) + " " + _OCC + " WHERE NOT r")
def scan_iupac_exact(spark, sf_dir):
    return _occurrence_rows(scan.scan(sequences(spark, sf_dir), EXACT)).where("NOT reverse")


@query("scan_iupac_both_strands", "WITH " + S.occurrences(EXACT) + " " + _OCC)
def scan_iupac_both_strands(spark, sf_dir):
    return _occurrence_rows(scan.scan(sequences(spark, sf_dir), EXACT))


@query("scan_iupac_regex", "WITH " + S.occurrences(EXACT.only([0, 1])) + " " + _OCC)
def scan_iupac_regex(spark, sf_dir):
    return _occurrence_rows(scan.scan_regex(sequences(spark, sf_dir), EXACT.only([0, 1])))


@query("scan_iupac_one_mismatch", "WITH " + S.occurrences(FUZZY) + " " + _OCC)
def scan_iupac_one_mismatch(spark, sf_dir):
    return _occurrence_rows(scan.scan(sequences(spark, sf_dir), FUZZY))


_BROKEN = S.SEQS.replace("length(seq)::BIGINT AS len FROM seqs WHERE", "length(seq)::BIGINT AS len FROM (SELECT seq_id, regexp_replace(seq, 'ACA', 'ANA', 'g') AS seq FROM seqs) WHERE")


@query("scan_iupac_n_reset", "WITH " + S.occurrences(FUZZY).replace(S.SEQS, _BROKEN) + f" {_OCC} WHERE NOT EXISTS (SELECT 1 FROM km WHERE km.seq_id = occ.seq_id AND km.pos BETWEEN occ.s AND occ.e - 1 AND km.k[1] = 'N')")
def scan_iupac_n_reset(spark, sf_dir):
    """N in a sequence ends all matches that have begun."""
    seqs = sequences(spark, sf_dir).withColumn("seq", F.regexp_replace("seq", "ACA", "ANA"))
    return _occurrence_rows(scan.scan(seqs, FUZZY))


@query("scan_iupac_naive", "WITH " + S.occurrences(FUZZY).replace(S.SEQS, _BROKEN) + " " + _OCC)
def scan_iupac_naive(spark, sf_dir):
    """N in a sequence is a mismatch like others."""
    seqs = sequences(spark, sf_dir).withColumn("seq", F.regexp_replace("seq", "ACA", "ANA"))
    return _occurrence_rows(scan.scan(seqs, FUZZY, automaton=False))


@query("hit_counts", "WITH " + S.occurrences(EXACT) + " SELECT seq_id, m AS motif_id, r AS reverse, count(*) AS n FROM occ GROUP BY ALL")
def hit_counts(spark, sf_dir):
    return scan.count_hits(sequences(spark, sf_dir), EXACT).where("n > 0")


def pwm_set() -> MotifSet:
    out = MotifSet()
    for name, rows in PWM:
        out.add_pwm(name, rows)
    return out.with_threshold(PWM_THRESHOLD)


def _pwm_sql(reverse: bool) -> str:
    rows = PWM[0][1]
    n = len(rows[0])
    cell = lambda j, b: rows[3 - b][n - 1 - j] if reverse else rows[b][j]
    return " + ".join(f"CASE k[{j + 1}] " + " ".join(f"WHEN '{c}' THEN {cell(j, b)}" for b, c in enumerate("ACGT")) + " ELSE 0 END" for j in range(n))


def _pwm_oracle(strands: tuple[bool, ...]) -> str:
    parts = [f"SELECT seq_id, {str(r).lower()} AS reverse, pos AS start_pos, ({_pwm_sql(r)})::DOUBLE AS score FROM km WHERE length(k) >= 5" for r in strands]
    return f"WITH {S.SEQS},\n{S.words(5)} SELECT * FROM (" + " UNION ALL ".join(parts) + f") WHERE score >= {PWM_THRESHOLD}"


def _pwm(spark, sf_dir):
    return scan.scan(sequences(spark, sf_dir), pwm_set()).select("seq_id", "reverse", F.col("start").alias("start_pos"), "score")


@query("scan_pwm_forward", _pwm_oracle((False,)))
def scan_pwm_forward(spark, sf_dir):
    return _pwm(spark, sf_dir).where("NOT reverse")


@query("scan_pwm_both", _pwm_oracle((False, True)))
def scan_pwm_both(spark, sf_dir):
    return _pwm(spark, sf_dir)


@query("pwm_quantile_threshold", f"WITH {S.SEQS},\n{S.words(5)} SELECT score AS threshold FROM (SELECT ({_pwm_sql(False)})::DOUBLE AS score FROM km WHERE length(k) >= 5 UNION ALL SELECT ({_pwm_sql(True)})::DOUBLE FROM km WHERE length(k) >= 5) ORDER BY score DESC LIMIT 1 OFFSET 2000")
def pwm_quantile_threshold(spark, sf_dir):
    every = scan.scan(sequences(spark, sf_dir), pwm_set().with_threshold(-1e9))
    return metrics.quantile_threshold(every, 2.0)


@query("revcomp", f"WITH {S.SEQS} SELECT seq_id, md5(reverse(translate(seq, 'ACGT', 'TGCA'))) AS rc_md5 FROM lens")
def revcomp(spark, sf_dir):
    return sequences(spark, sf_dir).select("seq_id", F.md5(reverse_complement_column(F.col("seq"))).alias("rc_md5"))


_KMERS = "SELECT i::INT AS motif_id, 'ACGT'[(i % 4) + 1] || 'ACGT'[(i // 4 % 4) + 1] || 'ACGT'[(i // 16 % 4) + 1] || 'ACGT'[(i // 64 % 4) + 1] AS pattern FROM range(256) t(i)"


@query("kmer_generate", f"WITH {S.SEQS},\n{S.words(4)}, p AS ({_KMERS}), c AS (SELECT k, count(*) AS n FROM km WHERE length(k) = 4 GROUP BY k) SELECT motif_id, pattern, coalesce(n, 0)::BIGINT AS n FROM p LEFT JOIN c ON k = pattern")
def kmer_generate(spark, sf_dir):
    """All patterns of four bases, with how often the sequences hold them."""
    counts = scan.kmer_counts(sequences(spark, sf_dir), 4)
    patterns = kmers(spark, 4)
    return patterns.join(counts, patterns["pattern"] == counts["kmer"], "left").select("motif_id", "pattern", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query(
    "motif_dedupe_rc",
    f"WITH {S.SEQS}, p AS (SELECT seq_id AS motif_id, substr(seq, 1, 4) AS pattern FROM lens WHERE len >= 4) SELECT motif_id, pattern FROM p QUALIFY row_number() OVER (PARTITION BY least(pattern, reverse(translate(pattern, 'ACGT', 'TGCA'))) ORDER BY motif_id) = 1",
)
def motif_dedupe_rc(spark, sf_dir):
    """Of the first four bases of each sequence, those that no earlier sequence has on either strand."""
    return distinct_patterns(sequences(spark, sf_dir).where("len >= 4").select(F.col("seq_id").alias("motif_id"), F.substring("seq", 1, 4).alias("pattern")))


@query("kmer_spectrum", f"WITH {S.SEQS},\n{S.words(4)} SELECT k AS kmer, count(*) AS n FROM km WHERE length(k) = 4 GROUP BY 1")
def kmer_spectrum(spark, sf_dir):
    return scan.kmer_counts(sequences(spark, sf_dir), 4)


_WINDOWS = f"WITH {S.SEQS},\n{S.windows()} "


@query("window_sliding", _WINDOWS + "SELECT seq_id, i AS win, ws AS win_start, wl AS win_len FROM win")
def window_sliding(spark, sf_dir):
    return windows.sliding(sequences(spark, sf_dir), SIZE, STEP)


@query("window_edge_lengths", f"SELECT len, {S.n_windows('len', SIZE, STEP)}::BIGINT AS n FROM (SELECT (l_orderkey % 1200 + 1)::BIGINT AS len FROM lineitem GROUP BY 1)")
def window_edge_lengths(spark, sf_dir):
    lengths = read_table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 1200 + 1).cast("long").alias("len")).distinct()
    return lengths.select("len", windows.n_windows(F.col("len"), SIZE, STEP).alias("n"))


@query(
    "window_train_modes",
    f"WITH {S.SEQS},\n{S.windows(500, 250)} SELECT win.seq_id, i AS win, ws AS win_start, wl AS win_len FROM win JOIN labels ON doc_id = win.seq_id WHERE quality = 0 UNION ALL SELECT lens.seq_id, 0, 0, len FROM lens JOIN labels ON doc_id = seq_id WHERE quality = 1",
)
def window_train_modes(spark, sf_dir):
    labels = read_table(spark, sf_dir, "labels").select(F.col("doc_id").alias("seq_id"), F.when(F.col("quality") == 1, "full").otherwise("win").alias("train_mode"))
    return windows.training_windows(join_large(sequences(spark, sf_dir), labels, "seq_id"), SIZE, 250)


@query("window_gc", f"WITH {S.SEQS},\n{S.windows()} SELECT w.seq_id, w.i AS win, round(avg((c IN ('G', 'C'))::INT), 9) AS gc FROM win w JOIN bases b ON b.seq_id = w.seq_id AND b.pos >= ws AND b.pos < ws + wl GROUP BY ALL")
def window_gc(spark, sf_dir):
    return windows.window_gc(sequences(spark, sf_dir), SIZE, STEP).withColumn("gc", F.round("gc", 9))


@query("occ_per_window", S.located(EXACT) + " SELECT seq_id, i AS win, m AS motif_id, count(*) AS n FROM ow GROUP BY ALL")
def occ_per_window(spark, sf_dir):
    return placed(spark, sf_dir, EXACT).occurrences.groupBy("seq_id", "win", "motif_id").agg(F.count("*").alias("n"))


def _feature(name: str, features: list[Feature], sql: str, motifs: MotifSet = PAIRED, filled: bool = False) -> None:
    """A query of the values of features, named by their motifs, rounded; its SQL has seq_id, win, a, b, axis, value."""

    def run(spark, sf_dir):
        instances = instantiate(features, motifs)
        w = placed(spark, sf_dir, used_motifs(instances, motifs))
        w.max_len = motifs.max_len
        values = feature_values(w, instances)
        if filled:
            values = fill(w, values, instances)
        names = spark.createDataFrame([(i.feature_id, -1 if i.a is None else i.a, -1 if i.b is None else i.b, i.axis) for i in instances], "feature_id int, a int, b int, axis int")
        return values.join(F.broadcast(names), "feature_id").select("seq_id", "win", "a", "b", "axis", (F.round("value", 6) + F.lit(0.0)).alias("value"))  # no negative zeros

    query(name, S.located(motifs) + " " + sql)(run)


_feature("feat_nocc", [Feature("nOcc")], "SELECT seq_id, i AS win, m AS a, -1 AS b, 0 AS axis, round(count(*) / max(wl), 6) AS value FROM ow GROUP BY seq_id, i, m", EXACT)
_feature(
    "feat_nocc_filled",
    [Feature("nOcc")],
    "SELECT win.seq_id, win.i AS win, t.m AS a, -1 AS b, 0 AS axis, round(count(ow.s) / max(win.wl), 6) AS value FROM win CROSS JOIN (SELECT unnest([0, 1, 2]) AS m) t LEFT JOIN ow ON ow.seq_id = win.seq_id AND ow.i = win.i AND ow.m = t.m GROUP BY win.seq_id, win.i, t.m",
    filled=True,
)


def _pair_sql(value: str, near: str, axis: str = "0") -> str:
    """Pairs with m_y <= m_x: unordered ones of one motif, all of two."""
    return f"SELECT x.seq_id, x.i AS win, x.m AS a, y.m AS b, {axis} AS axis, round(sum({value}) / max(x.wl), 6) + 0.0::DOUBLE AS value FROM ow x JOIN ow y ON {S.SAME_WINDOW} AND y.m <= x.m AND {S.OTHER} WHERE (y.m < x.m OR {S.LATER}) AND {near} GROUP BY x.seq_id, x.i, x.m, y.m"


_TURN = "* 3.141592654 * 2.0"
_feature("feat_npair", [Feature("nPair", 60)], _pair_sql("1", f"{S.GAP} <= 60"))
_feature("feat_noccpair_semi", [Feature("nOccPair", 60)], f"SELECT x.seq_id, x.i AS win, x.m AS a, t.m AS b, 0 AS axis, round(count(*) / max(x.wl), 6) AS value FROM ow x CROSS JOIN (SELECT unnest([0, 1, 2]) AS m) t WHERE EXISTS (SELECT 1 FROM ow y WHERE {S.SAME_WINDOW} AND y.m = t.m AND {S.OTHER} AND {S.CENTERS} <= 60) GROUP BY x.seq_id, x.i, x.m, t.m")
_PHASE = f"(CASE WHEN x.m = y.m THEN {S.CENTERS} WHEN x.r THEN -{S.SIGNED} ELSE {S.SIGNED} END / 10.0 {_TURN})"
_feature("feat_npair2d", [Feature("nPair2D", 60, 10)], _pair_sql(f"cos({_PHASE})", f"{S.CENTERS} <= 60") + " UNION ALL " + _pair_sql(f"sin({_PHASE})", f"{S.CENTERS} <= 60", "1"))
_feature("feat_npair2d_cosines", [Feature("nPair2D", 60, 10, cosines=True)], _pair_sql(f"cos({_PHASE})", f"{S.CENTERS} <= 60") + " UNION ALL " + _pair_sql(f"cos({_PHASE})", f"{S.CENTERS} <= 60", "1"))
_feature("feat_npairdh", [Feature("nPairDH", 60)], _pair_sql(f"(cos(({S.CENTERS} + CASE WHEN x.r != y.r THEN 5.25 ELSE 0 END) / 10.5 {_TURN}) + 1.0) / 2.0", f"{S.CENTERS} <= 60"))
_feature(
    "feat_pedi",
    [Feature("PEDI", 60, 10, 2)],
    f"SELECT x.seq_id, x.i AS win, x.m AS a, y.m AS b, 0 AS axis, round(sum((cos(({S.CENTERS} + 2) / 10.0 {_TURN}) + 1.0) / 2.0) / max(x.wl), 6) AS value FROM ow x JOIN ow y ON {S.SAME_WINDOW} AND y.m <= x.m WHERE {S.CENTERS} + 2 <= 60 GROUP BY x.seq_id, x.i, x.m, y.m",
)


def _neighbour_sql(inner: str, distance: str, near: str, any_: bool) -> str:
    b = "(-1 + 0 * y.m)" if any_ else "y.m"
    each = f"SELECT x.seq_id, x.i, x.m, {b} AS b, {inner}({distance}) AS d FROM ow x JOIN ow y ON {S.SAME_WINDOW} AND {S.OTHER} WHERE {near} GROUP BY x.seq_id, x.i, x.m, x.s, x.r, {b}"
    return f"SELECT seq_id, i AS win, m AS a, b, 0 AS axis, round(avg(d), 6) AS value FROM ({each}) GROUP BY seq_id, i, m, b"


_feature("feat_mdp", [Feature("MDP")], _neighbour_sql("min", S.CENTERS, f"{S.CENTERS} < 500", False))
_feature("feat_mdpa", [Feature("MDPA")], _neighbour_sql("min", S.CENTERS, f"{S.CENTERS} < 500", True))
_feature("feat_mdm", [Feature("MDM")], _neighbour_sql("avg", S.GAP, f"{S.GAP} <= 500", False))
_feature("feat_mdd", [Feature("MDD")], _neighbour_sql("max", S.GAP, f"{S.GAP} <= 500", False))
_feature("feat_mdda", [Feature("MDDA")], _neighbour_sql("max", S.GAP, f"{S.GAP} <= 500", True))
_feature("feat_gc", [Feature("GC")], "SELECT w.seq_id, w.i AS win, -1 AS a, -1 AS b, 0 AS axis, round(avg((c IN ('G', 'C'))::INT), 6) AS value FROM win w JOIN bases b ON b.seq_id = w.seq_id AND b.pos >= ws AND b.pos < ws + wl GROUP BY w.seq_id, w.i")


@query(
    "feature_instantiate",
    S.located(PAIRED)
    + ", n AS (SELECT unnest(['Z', 'CG', 'PAL']) AS name, unnest([0, 1, 2]) AS x), v AS (SELECT m AS a, -1 AS b, seq_id, i FROM ow UNION SELECT x.m, y.m, x.seq_id, x.i FROM ow x JOIN ow y ON "
    + f"{S.SAME_WINDOW} AND y.m <= x.m AND {S.OTHER} WHERE (y.m < x.m OR {S.LATER}) AND {S.GAP} <= 60), c AS (SELECT a, b, count(*) AS n FROM v GROUP BY ALL),"
    + " f AS (SELECT 'nOcc  ' || name AS feature, x AS a, -1 AS b FROM n UNION ALL SELECT 'nPair(60)  ' || p.name || ', ' || q.name, p.x, q.x FROM n p JOIN n q ON q.x <= p.x) SELECT feature, coalesce(c.n, 0)::BIGINT AS n_windows FROM f LEFT JOIN c ON c.a = f.a AND c.b = f.b",
)
def feature_instantiate(spark, sf_dir):
    """The features that come of a specification, with the windows in which they are found."""
    instances = instantiate([Feature("nOcc"), Feature("nPair", 60)], PAIRED)
    found = feature_values(placed(spark, sf_dir, PAIRED), instances).where("value != 0").groupBy("feature_id").agg(F.count("*").alias("n"))
    names = spark.createDataFrame([(i.feature_id, i.name(PAIRED)) for i in instances], "feature_id int, feature string")
    return names.join(found, "feature_id", "left").select("feature", F.coalesce("n", F.lit(0)).cast("long").alias("n_windows"))


def _pair_count_sql(near: str) -> str:
    return S.located(PAIRED) + f" SELECT x.seq_id, x.i AS win, x.m AS a, y.m AS b, count(*) AS n FROM ow x JOIN ow y ON {S.SAME_WINDOW} AND x.m <= y.m WHERE (x.m < y.m OR {S.LATER} OR NOT {S.OTHER}) AND {near} GROUP BY ALL"


def _pair_counts(spark, sf_dir, settings: Settings):
    return pairs.pair_counts(placed(spark, sf_dir, PAIRED).stored(), settings, PAIRED.max_len).drop("win_len")


@query("pair_predictor_counts", _pair_count_sql(f"{S.CENTERS} <= 219"))
def pair_predictor_counts(spark, sf_dir):
    return _pair_counts(spark, sf_dir, Settings())


@query("pair_nonoverlap", _pair_count_sql(f"{S.CENTERS} <= 219 AND (x.e < y.s OR y.e < x.s)"))
def pair_nonoverlap(spark, sf_dir):
    return _pair_counts(spark, sf_dir, Settings(pairs_can_overlap=False))


@query("pair_distance_between", _pair_count_sql(f"{S.BETWEEN} BETWEEN 0 AND 219"))
def pair_distance_between(spark, sf_dir):
    return _pair_counts(spark, sf_dir, Settings(distance=Distance.BETWEEN))


@query("local_nocc", S.located(PAIRED) + f" SELECT x.seq_id, x.i AS win, x.m AS motif_id, x.r AS reverse, x.s AS start_pos, y.m AS near_id, count(*) AS n FROM ow x JOIN ow y ON {S.SAME_WINDOW} AND {S.OTHER} AND {S.CENTERS} < 250 GROUP BY ALL")
def local_nocc(spark, sf_dir):
    w = placed(spark, sf_dir, PAIRED)
    w.stored()
    near = local.local_neighbours(w.occurrences, w.ordered(local.REACH), PAIRED)
    each = near.select("seq_id", "win", "motif_id", "reverse", F.col("start").alias("start_pos"), F.posexplode("near").alias("near_id", "n"))
    return each.where("n > 0").withColumn("n", F.col("n").cast("long"))


_LOCAL = S.located(motif_set(("Z", "YGAGYG", 0))) + ", region AS (SELECT seq_id, i, s, r, greatest(s + (e - s) // 2 - 250, ws) AS a, least(s + (e - s) // 2 + 251, ws + wl) AS b FROM ow)"


def _composition(spark, sf_dir):
    motifs = motif_set(("Z", "YGAGYG", 0))
    w = placed(spark, sf_dir, motifs)
    return local.local_composition(w.occurrences, w.seqs, SIZE, STEP).select("seq_id", "win", F.col("start").alias("start_pos"), "reverse", "gc", "dnt")


@query("local_gc", _LOCAL + " SELECT x.seq_id, i AS win, s AS start_pos, r AS reverse, round(avg((c IN ('G', 'C'))::INT), 9) AS gc FROM region x JOIN bases t ON t.seq_id = x.seq_id AND pos >= a AND pos < b GROUP BY ALL")
def local_gc(spark, sf_dir):
    return _composition(spark, sf_dir).drop("dnt").withColumn("gc", F.round("gc", 9))


@query(
    "local_dnt",
    _LOCAL + ", two AS (SELECT seq_id, len, pos, c || lead(c) OVER (PARTITION BY seq_id ORDER BY pos) AS d FROM bases), counted AS (SELECT x.seq_id, i, s, r, d, count(*) / max(b - a - 1) AS v FROM region x JOIN two t ON t.seq_id = x.seq_id AND pos >= a AND pos < b - 1 GROUP BY ALL), both_strands AS (SELECT * FROM counted UNION ALL SELECT seq_id, i, s, r, reverse(translate(d, 'ACGT', 'TGCA')), v FROM counted) SELECT seq_id, i AS win, s AS start_pos, r AS reverse, d AS dinucleotide, round(sum(v), 9) AS share FROM both_strands GROUP BY ALL",
)
def local_dnt(spark, sf_dir):
    names = F.array(*map(F.lit, local.dinucleotide_names()))
    each = _composition(spark, sf_dir).select("seq_id", "win", "start_pos", "reverse", F.explode(F.arrays_zip(names.alias("d"), F.col("dnt"))).alias("x"))
    return each.select("seq_id", "win", "start_pos", "reverse", F.col("x.d").alias("dinucleotide"), F.round("x.dnt", 9).alias("share")).where("share > 0")


@query("iid_train", f"WITH {S.SEQS} SELECT c AS base, count(*) AS n, round(count(*) / (sum(count(*)) OVER ()), 9) AS p FROM bases GROUP BY c")
def iid_train(spark, sf_dir):
    return background.train_iid(sequences(spark, sf_dir)).withColumn("p", F.round("p", 9))


def _markov_sql(add_rc: bool) -> str:
    both = " UNION ALL SELECT reverse(translate(k, 'ACGT', 'TGCA')) FROM counted" if add_rc else ""
    contexts = " || ".join(f"'ACGT'[(i // {4**j} % 4) + 1]" for j in range(4))
    cells = ", ".join(f"count(*) FILTER (k[5] = '{b}') + 1 AS n{b}" for b in "ACGT")
    return f"WITH {S.SEQS},\n{S.words(5)}, counted AS (SELECT k FROM km WHERE length(k) = 5 AND pos > 0), every AS (SELECT k FROM counted{both}), c AS (SELECT {contexts} AS context FROM range(256) t(i)) SELECT context, {cells}, count(k) + 4 AS total FROM c LEFT JOIN every ON k[1:4] = context GROUP BY context"


@query("markov_train", _markov_sql(False))
def markov_train(spark, sf_dir):
    return background.train_markov(sequences(spark, sf_dir), 4, add_rc=False)


@query("markov_train_rc", _markov_sql(True))
def markov_train_rc(spark, sf_dir):
    return background.train_markov(sequences(spark, sf_dir), 4)


@query("iid_generate")
def iid_generate(spark, sf_dir):
    p = {r["base"]: r["p"] for r in background.train_iid(sequences(spark, sf_dir)).collect()}
    return background.generate_iid(spark, 50, 1000, p, seed=7)


@query("markov_generate")
def markov_generate(spark, sf_dir):
    return background.generate_markov(spark, background.train_markov(sequences(spark, sf_dir), 4), 50, 1000, seed=7)


RANDOM = MotifSet()
RANDOM.add_random(12, 5, seed=3)


@query("random_motifs", "WITH " + S.occurrences(RANDOM) + ", p AS (SELECT unnest(" + repr([m.motif_id for m in RANDOM]) + ") AS motif_id, unnest(" + repr([m.pattern for m in RANDOM]) + ") AS pattern) SELECT motif_id::INT AS motif_id, pattern, count(m)::BIGINT AS n FROM p LEFT JOIN occ ON m = motif_id GROUP BY ALL")
def random_motifs(spark, sf_dir):
    """Patterns drawn at random, with how often the sequences hold them on both strands."""
    found = scan.scan(sequences(spark, sf_dir), RANDOM).groupBy("motif_id").agg(F.count("*").alias("n"))
    return RANDOM.to_df(spark).join(found, "motif_id", "left").select("motif_id", "pattern", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query("class_alias_lookup", "SELECT o_orderkey, CASE a WHEN 'N' THEN 0 WHEN '+' THEN 1 WHEN '-' THEN -1 WHEN '++' THEN 2 WHEN '--' THEN -2 ELSE TRY_CAST(a AS DOUBLE) END::DOUBLE AS class_value FROM (SELECT o_orderkey, ['N', '+', '-', '++', '--', '3.5', 'x'][(o_orderkey % 7 + 1)::INT] AS a FROM orders)")
def class_alias_lookup(spark, sf_dir):
    names = F.array(*map(F.lit, ("N", "+", "-", "++", "--", "3.5", "x")))
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", F.element_at(names, (F.col("o_orderkey") % 7 + 1).cast("int")).alias("a"))
    return orders.select("o_orderkey", alias_value(F.col("a")).alias("class_value"))
