"""Queries of models, metrics, intervals and sinks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline import sinks
from strandline.config import CoreMode, Kernel, Settings, SvmType, WeightMode
from strandline.models import logodds, vector
from strandline.models.binned_forest import train_forest_all_rows
from strandline.models.forest import Forest, Tree
from strandline.models.moments import class_moments, train_perceptron_all_rows
from strandline.models.sequence import FeatureModel, Hierarchical, PairLogOdds, PairSum
from strandline.models.svm import Scaler, Svm
from strandline.operators import intervals, metrics, windows
from strandline.operators.features import Feature, feature_values, instantiate
from strandline.operators.scan import scan, scan_stretches
from strandline.plans import sqltext as S
from strandline.plans.motif_queries import EXACT, PAIRED, SIZE, STEP, motif_set, placed, sequences
from strandline.session import join_large, materialize, read_table, scratch_folder
from strandline.sources.byteranges import flat_stretches, read_stretches, records
from strandline.sources.fasta import Classes, clone_rows, read_fasta, total_length, with_class
from strandline.sources.motifs import MotifSet

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
#: Rare enough on the encoded texts that machines train on whole tables.
RARE = motif_set(("G8", "GAGAGAGA", 1), ("GC6", "GCCATG", 0))


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return register


def labelled(spark, sf_dir) -> DataFrame:
    """Sequences with the class of their quality label, to train on whole."""
    labels = read_table(spark, sf_dir, "labels").select(F.col("doc_id").alias("seq_id"), F.when(F.col("quality") == 1, 1.0).otherwise(-1.0).alias("class_value"))
    return join_large(sequences(spark, sf_dir), labels, "seq_id").withColumn("train_mode", F.lit("full"))


def vectors(spark, sf_dir) -> DataFrame:
    return read_table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("features"), (F.col("label") < 5).alias("flag"), F.col("label").cast("double").alias("label"))


def scored(spark, sf_dir) -> DataFrame:
    """Scores with ties, flags and a key."""
    e = read_table(spark, sf_dir, "events")
    return e.select("event_id", F.round("value", 1).alias("score"), (F.col("event_type") == "click").alias("flag"))


_SCORED = "WITH t AS (SELECT event_id, round(value, 1) AS score, event_type = 'click' AS flag FROM events), n AS (SELECT count(*) FILTER (flag) AS p, count(*) FILTER (NOT flag) AS n, count(*) AS total FROM t)"


@query("minmax_scale", "WITH v AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, unnest(range(len(embedding))) AS i FROM embeddings) SELECT vec_id, i::INT AS i, round(CASE WHEN max(v) OVER w > min(v) OVER w THEN (v - min(v) OVER w - (max(v) OVER w - min(v) OVER w) / 2) * 2 / (max(v) OVER w - min(v) OVER w) ELSE 0 END, 6) + 0.0::DOUBLE AS scaled FROM v WINDOW w AS (PARTITION BY i)")
def minmax_scale(spark, sf_dir):
    return vector.min_max(vectors(spark, sf_dir)).select("vec_id", F.posexplode("scaled").alias("i", "s")).select("vec_id", "i", (F.round("s", 6) + F.lit(0.0)).alias("scaled"))


_SAMPLES = "samples AS (SELECT win.seq_id, win.i, t.m AS feature_id, quality = 1 AS flag, count(ow.s) / max(win.wl) AS value FROM win JOIN labels ON doc_id = win.seq_id CROSS JOIN (SELECT unnest([0, 1, 2]) AS m) t LEFT JOIN ow ON ow.seq_id = win.seq_id AND ow.i = win.i AND ow.m = t.m GROUP BY ALL)"
_SUMS = "sums AS (SELECT feature_id, coalesce(sum(value) FILTER (flag), 0) AS p, coalesce(sum(value) FILTER (NOT flag), 0) AS n, count(*) FILTER (flag) AS np, count(*) FILTER (NOT flag) AS nn FROM samples GROUP BY 1)"
_WEIGHT = {
    WeightMode.PREDICTOR: "ln((p + a) / np) - ln((n + a) / nn)",
    WeightMode.ZERO: "CASE WHEN p = 0 OR n = 0 THEN 0 ELSE ln(p / np) - ln(n / nn) END",
    WeightMode.CONSTANT: "ln((p + 1e-8) / np) - ln((n + 1e-8) / nn)",
    WeightMode.PPV: "CASE WHEN p + n > 0 THEN (p / np) / (p / np + n / nn) ELSE 0 END",
    WeightMode.BIPPV: "CASE WHEN p + n > 0 THEN (p / np - n / nn) / (p / np + n / nn) ELSE 0 END",
}


def _log_odds(mode: WeightMode) -> None:
    def run(spark, sf_dir):
        w = placed(spark, sf_dir, PAIRED)
        instances = instantiate([Feature("nOcc")], PAIRED)
        labels = read_table(spark, sf_dir, "labels").select(F.col("doc_id").alias("seq_id"), (F.col("quality") == 1).alias("flag"))
        values = join_large(feature_values(w, instances), labels, "seq_id")
        every = join_large(w.windows, labels, "seq_id").groupBy("flag").count()  # windows without occurrences add to the numbers alone
        n = {r["flag"]: r["count"] for r in every.collect()}
        sums = values.groupBy("feature_id").agg(F.sum(F.when(F.col("flag"), F.col("value")).otherwise(0.0)).alias("p"), F.sum(F.when(~F.col("flag"), F.col("value")).otherwise(0.0)).alias("n"))
        weight = logodds.weight_column(F.col("p"), F.col("n"), F.lit(n.get(True, 0)), F.lit(n.get(False, 0)), mode, 1e-8)
        return sums.select("feature_id", F.round(weight, 6).alias("weight"))

    sql = S.located(PAIRED) + f", {_SAMPLES}, {_SUMS} SELECT feature_id, round({_WEIGHT[mode]}, 6) AS weight FROM (SELECT *, CASE WHEN p = 0 OR n = 0 THEN 1 ELSE 0 END AS a FROM sums)"
    query(f"logodds_{mode.value}", sql)(run)


for _mode in WeightMode:
    _log_odds(_mode)


_PAIRS = f"pair AS (SELECT x.seq_id, x.i, x.m AS a, y.m AS b, count(*) * 1000 / max(x.wl) AS v FROM ow x JOIN ow y ON {S.SAME_WINDOW} AND x.m <= y.m WHERE (x.m < y.m OR {S.LATER} OR NOT {S.OTHER}) AND {S.CENTERS} <= 219 GROUP BY x.seq_id, x.i, x.m, y.m)"
_BY_WINDOW = "win.seq_id, win.i AS win, win.ws AS win_start, win.wl AS win_len"


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 6) + F.lit(0.0))


@query("score_dummy_pairs", S.located(PAIRED) + f", {_PAIRS} SELECT {_BY_WINDOW}, round(coalesce(sum(v), 0), 6) + 0.0::DOUBLE AS score FROM win LEFT JOIN pair ON pair.seq_id = win.seq_id AND pair.i = win.i GROUP BY ALL")
def score_dummy_pairs(spark, sf_dir):
    return _rounded(PairSum(PAIRED).score_windows(sequences(spark, sf_dir)))


_NPAIR = f"SELECT x.seq_id, x.i, 3 + x.m * (x.m + 1) // 2 + y.m AS f, count(*) / max(x.wl) AS v FROM ow x JOIN ow y ON {S.SAME_WINDOW} AND y.m <= x.m AND {S.OTHER} WHERE (y.m < x.m OR {S.LATER}) AND {S.GAP} <= 60 GROUP BY x.seq_id, x.i, x.m, y.m"
_FEATURES = f"fv AS (SELECT seq_id, i, m AS f, count(*) / max(wl) AS v FROM ow GROUP BY seq_id, i, m UNION ALL {_NPAIR})"
SCORE_FEATURES = (Feature("nOcc"), Feature("nPair", 60))


@query("score_dummy_features", S.located(PAIRED) + f", {_FEATURES} SELECT {_BY_WINDOW}, round(coalesce(sum(v), 0), 6) + 0.0::DOUBLE AS score FROM win LEFT JOIN fv ON fv.seq_id = win.seq_id AND fv.i = win.i GROUP BY ALL")
def score_dummy_features(spark, sf_dir):
    return _rounded(FeatureModel(PAIRED, features=SCORE_FEATURES).score_windows(sequences(spark, sf_dir)))


#: Labelled sequences as one window each, and their classes.
_WHOLE = "cls AS (SELECT doc_id AS seq_id, quality = 1 AS flag FROM labels JOIN lens ON doc_id = seq_id), nn AS (SELECT count(*) FILTER (flag) AS np, count(*) FILTER (NOT flag) AS nn FROM cls), wo AS (SELECT o.*, 0 AS i, o.len AS wl FROM occ o JOIN cls USING (seq_id))"
_LOGODDS = "ln((p + CASE WHEN p = 0 OR n = 0 THEN 1 ELSE 0 END) / np) - ln((n + CASE WHEN p = 0 OR n = 0 THEN 1 ELSE 0 END) / nn)"


def _trained(values: str, keys: str, every: str) -> str:
    """tv: training values by whole sequence; wt: weights by key."""
    return f"tv AS ({values}), wt AS (SELECT {keys}, {_LOGODDS} AS w FROM (SELECT {keys}, coalesce(sum(v) FILTER (flag), 0) AS p, coalesce(sum(v) FILTER (NOT flag), 0) AS n FROM {every} LEFT JOIN (SELECT tv.*, flag FROM tv JOIN cls USING (seq_id)) USING ({keys}) GROUP BY {keys}), nn)"


_TRAIN_PAIRS = _PAIRS.removeprefix("pair AS (").removesuffix(")").replace("ow x", "wo x").replace("ow y", "wo y")
_ALL_PAIRS = "(SELECT x AS a, y AS b FROM (SELECT unnest([0, 1, 2]) AS x), (SELECT unnest([0, 1, 2]) AS y) WHERE x <= y)"


@query("score_pairwise_logodds", S.located(PAIRED) + f", {_PAIRS}, {_WHOLE}, {_trained(_TRAIN_PAIRS, 'a, b', _ALL_PAIRS)}, ws AS (SELECT win.seq_id, win.i, coalesce(sum(v * w), 0) AS s FROM win LEFT JOIN pair ON pair.seq_id = win.seq_id AND pair.i = win.i LEFT JOIN wt USING (a, b) GROUP BY ALL) SELECT lens.seq_id, round(coalesce(max(s), 0), 6) + 0.0::DOUBLE AS score FROM lens LEFT JOIN ws USING (seq_id) GROUP BY ALL")
def score_pairwise_logodds(spark, sf_dir):
    return _rounded(PairLogOdds(PAIRED).fit(labelled(spark, sf_dir)).score_sequences(sequences(spark, sf_dir)))


_TRAIN_FEATURES = _FEATURES.removeprefix("fv AS (").removesuffix(")").replace("ow x", "wo x").replace("ow y", "wo y").replace("FROM ow GROUP", "FROM wo GROUP")


@query("score_feature_logodds", S.located(PAIRED) + f", {_FEATURES}, {_WHOLE}, {_trained(_TRAIN_FEATURES, 'f', '(SELECT unnest(range(9)) AS f)')}, ws AS (SELECT win.seq_id, win.i, coalesce(sum(v * w), 0) AS s FROM win LEFT JOIN fv ON fv.seq_id = win.seq_id AND fv.i = win.i LEFT JOIN wt USING (f) GROUP BY ALL) SELECT lens.seq_id, round(coalesce(max(s), 0), 6) + 0.0::DOUBLE AS score FROM lens LEFT JOIN ws USING (seq_id) GROUP BY ALL")
def score_feature_logodds(spark, sf_dir):
    return _rounded(FeatureModel(PAIRED, features=SCORE_FEATURES, kind="logodds").fit(labelled(spark, sf_dir)).score_sequences(sequences(spark, sf_dir)))


@query("score_max_window", S.located(PAIRED) + f", {_PAIRS}, ws AS (SELECT win.seq_id, win.i, coalesce(sum(v), 0) AS s FROM win LEFT JOIN pair ON pair.seq_id = win.seq_id AND pair.i = win.i GROUP BY ALL) SELECT lens.seq_id, round(coalesce(max(s), 0), 6) + 0.0::DOUBLE AS score FROM lens LEFT JOIN ws USING (seq_id) GROUP BY ALL")
def score_max_window(spark, sf_dir):
    return _rounded(PairSum(PAIRED).score_sequences(sequences(spark, sf_dir)))


def _area_sql(at: str, height: str, x: float) -> str:
    return f"""{_SCORED}, r AS (SELECT *, sum(flag::INT) OVER w AS tp, sum((NOT flag)::INT) OVER w AS fp, row_number() OVER w AS k FROM t, n WINDOW w AS (ORDER BY score DESC, event_id)),
c AS (SELECT k, {at} AS a, {height} AS h FROM r), d AS (SELECT *, coalesce(lag(a) OVER (ORDER BY k), 0) AS a0, coalesce(lag(h) OVER (ORDER BY k), 0) AS h0 FROM c)
SELECT round(sum(CASE WHEN a = a0 THEN 0 WHEN a < {x} THEN (a - a0) * (h + h0) / 2 ELSE ({x} - a0) * (h0 + h0 + (h - h0) * ({x} - a0) / (a - a0)) / 2 END), 9) AS area FROM d WHERE a0 < {x}"""


@query("roc_auc_partial", _area_sql("fp / n", "tp / p", 0.25))
def roc_auc_partial(spark, sf_dir):
    return metrics.roc_area(scored(spark, sf_dir), 0.25, "event_id").select(F.round("area", 9).alias("area"))


@query("prc_auc_partial", _area_sql("tp / p", "tp / k", 0.5))
def prc_auc_partial(spark, sf_dir):
    return metrics.prc_area(scored(spark, sf_dir), 0.5, "event_id").select(F.round("area", 9).alias("area"))


@query("confusion", _SCORED + ", c AS (SELECT count(*) FILTER (score >= 50 AND flag) AS tp, count(*) FILTER (score >= 50 AND NOT flag) AS fp, count(*) FILTER (score < 50 AND NOT flag) AS tn, count(*) FILTER (score < 50 AND flag) AS fn FROM t) SELECT *, (tp + tn) / (tp + fp + tn + fn) AS accuracy, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 'nan'::DOUBLE END AS ppv FROM c")
def confusion(spark, sf_dir):
    return metrics.confusion(scored(spark, sf_dir), 50.0)


@query(
    "calibrate_precision",
    _SCORED
    + ", r AS (SELECT score, row_number() OVER w AS k, (p - coalesce(sum(flag::INT) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / (total - row_number() OVER w + 1) AS q FROM t, n WINDOW w AS (ORDER BY score, event_id)), d AS (SELECT *, coalesce(lag(score) OVER (ORDER BY k), 0) AS s0, coalesce(lag(q) OVER (ORDER BY k), -1) AS q0 FROM r), f AS (SELECT coalesce(min(k) FILTER (q >= 0.3), max(k)) AS k FROM d) SELECT round(CASE WHEN q = q0 THEN s0 ELSE s0 + (0.3 - q0) * (score - s0) / (q - q0) END, 9) AS threshold FROM d JOIN f USING (k)",
)
def calibrate_precision(spark, sf_dir):
    return metrics.calibrate_precision(scored(spark, sf_dir), 0.3, "event_id").select(F.round("threshold", 9).alias("threshold"))


@query("vote_majority", "WITH v AS (SELECT l_orderkey AS seq_id, l_linenumber % 3 AS class_order, count(*) AS n FROM lineitem GROUP BY ALL) SELECT seq_id, class_order::INT AS class_order FROM v QUALIFY row_number() OVER (PARTITION BY seq_id ORDER BY n DESC, class_order) = 1")
def vote_majority(spark, sf_dir):
    votes = read_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("seq_id"), (F.col("l_linenumber") % 3).cast("int").alias("class_order"))
    return metrics.majority_vote(votes)


def _intervals(spark, sf_dir) -> DataFrame:
    at = F.unix_timestamp("ts")
    return read_table(spark, sf_dir, "events").select(F.col("user_id").alias("chrom"), at.alias("start"), (at + 3600 + F.col("event_id") % 7200).alias("end"), F.col("value").alias("score"))


def _merge_sql(source: str, slack: int, key: str) -> str:
    return f"""m1 AS (SELECT *, max(e) OVER (PARTITION BY {key} ORDER BY s, e, score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM ({source})),
m2 AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach + {slack} THEN 1 ELSE 0 END) OVER (PARTITION BY {key} ORDER BY s, e, score ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM m1),
merged AS (SELECT {key}, min(s) AS start_pos, max(e) AS end_pos, max(score) AS score FROM m2 GROUP BY {key}, island)"""


_EVENTS = "SELECT user_id AS chrom, floor(epoch(ts))::BIGINT AS s, floor(epoch(ts))::BIGINT + 3600 + event_id % 7200 AS e, value AS score FROM events"


def _named(df: DataFrame, key: str = "chrom") -> DataFrame:
    return df.select(key, F.col("start").alias("start_pos"), F.col("end").alias("end_pos"), "score")


@query("merge_intervals", "WITH " + _merge_sql(_EVENTS, 0, "chrom") + " SELECT * FROM merged")
def merge_intervals(spark, sf_dir):
    return _named(intervals.merge(_intervals(spark, sf_dir)))


@query("merge_with_slack", "WITH " + _merge_sql(_EVENTS, 1800, "chrom") + " SELECT * FROM merged")
def merge_with_slack(spark, sf_dir):
    return _named(intervals.merge(_intervals(spark, sf_dir), 1800))


_PREDICTED = f"{_PAIRS}, sw AS (SELECT win.seq_id, win.i, win.ws, win.wl, coalesce(sum(v), 0) AS score FROM win LEFT JOIN pair ON pair.seq_id = win.seq_id AND pair.i = win.i GROUP BY ALL)"
_MERGED = S.located(PAIRED) + f", {_PREDICTED}, " + _merge_sql("SELECT seq_id, ws AS s, ws + wl AS e, score FROM sw WHERE score >= 40", STEP, "seq_id")


def _predicted(spark, sf_dir) -> DataFrame:
    found = intervals.predicted_windows(PairSum(PAIRED).score_windows(sequences(spark, sf_dir)), 40.0)
    return intervals.merge(found, STEP, "seq_id")


@query("predict_windows_merged", _MERGED + " SELECT seq_id, start_pos, end_pos, round(score, 6) AS score FROM merged")
def predict_windows_merged(spark, sf_dir):
    return _rounded(_named(_predicted(spark, sf_dir), "seq_id"))


@query("gff_rows", _MERGED + " SELECT seq_id || chr(9) || 'strandline' || chr(9) || 'Prediction' || chr(9) || start_pos || chr(9) || end_pos || chr(9) || rtrim(rtrim(printf('%.3f', score), '0'), '.') || chr(9) || '.' || chr(9) || '.' || chr(9) || '1' AS line FROM (SELECT seq_id, start_pos, end_pos, round(score)::DOUBLE AS score FROM merged)")
def gff_rows(spark, sf_dir):
    return sinks.gff_rows(_predicted(spark, sf_dir).withColumnRenamed("seq_id", "chrom").withColumn("score", F.round("score").cast("double")))


@query("wig_rows", S.located(PAIRED) + f", {_PREDICTED} SELECT seq_id AS chrom, i AS place, CASE WHEN score >= 40 THEN printf('%d', round(score)::BIGINT) ELSE '-9999999999' END AS line FROM sw UNION ALL SELECT DISTINCT seq_id, -1, 'fixedStep chrom=' || seq_id || ' start=1 step=100 span=500' FROM sw")
def wig_rows(spark, sf_dir):
    w = PairSum(PAIRED).score_windows(sequences(spark, sf_dir)).select(F.col("seq_id").alias("chrom"), "win", F.when(F.col("score") >= 40, F.round("score")).otherwise(F.col("score")).cast("double").alias("score"))
    return sinks.wig_rows(w, STEP, SIZE, 40.0)


_CORE = " UNION ALL ".join(f"SELECT seq_id, {n} AS size, i * 50 AS ws, least(i * 50 + {n}, len) AS we FROM (SELECT seq_id, len, unnest(range({S.n_windows('len', n, 50)})) AS i FROM lens)" for n in windows.CORE_SIZES)


@query(
    "core_multi_size",
    "WITH " + S.occurrences(motif_set(("GC6", "GCCATG", 0))) + f", w AS ({_CORE}), sc AS (SELECT w.seq_id, size, ws, we, count(o.s) * 1000.0::DOUBLE / (we - ws) AS score FROM w LEFT JOIN occ o ON o.seq_id = w.seq_id AND o.s >= ws AND o.e <= we GROUP BY w.seq_id, size, ws, we), best AS (SELECT * FROM sc WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY seq_id ORDER BY score DESC, size, ws) = 1) SELECT w.seq_id, coalesce(max(b.ws), 0) AS core_start, coalesce(max(b.we), 0) AS core_end, round(coalesce(max(b.score), 0), 6) + 0.0::DOUBLE AS core_score FROM w LEFT JOIN best b ON b.seq_id = w.seq_id GROUP BY w.seq_id",
)
def core_multi_size(spark, sf_dir):
    """Occurrences per 1000 bases in windows of eight sizes; the best window of each sequence."""
    seqs = sequences(spark, sf_dir)
    occ = scan(seqs, motif_set(("GC6", "GCCATG", 0)))
    parts = None
    for size in windows.CORE_SIZES:
        n = windows.occurrences_in_windows(occ, size, windows.CORE_STEP).groupBy("seq_id", "win").agg(F.count("*").alias("n")).withColumn("size", F.lit(size))
        parts = n if parts is None else parts.unionByName(n)
    cut = join_large(windows.multi_size(seqs), parts, ["seq_id", "win", "size"], "left")
    best = windows.best_core(cut.withColumn("score", F.coalesce("n", F.lit(0)) * 1000.0 / F.col("win_len")))
    return best.withColumn("core_score", F.round("core_score", 6) + F.lit(0.0))


def _machine(name: str, kind: str, settings: Settings, label: str = "flag") -> None:
    def run(spark, sf_dir):
        rows = vectors(spark, sf_dir)
        return vector.decide(rows, vector.fit(rows, kind, settings, "vec_id", label)).select("vec_id", "flag", "label", "score")

    query(name)(run)


_machine("svm_linear", "svm", Settings(svm_type=SvmType.C_SVC))
_machine("svm_quadratic", "svm", Settings(svm_type=SvmType.C_SVC, kernel=Kernel.QUADRATIC, c0=1.0))
_machine("svm_rbf", "svm", Settings(svm_type=SvmType.C_SVC, kernel=Kernel.RBF))
_machine("svm_nu", "svm", Settings(svm_type=SvmType.NU_SVC, nu=0.3))
_machine("svm_one_class", "svm", Settings(svm_type=SvmType.ONE_CLASS, nu=0.3, kernel=Kernel.RBF))
_machine("svr_epsilon", "svm", Settings(svm_type=SvmType.EPSILON_SVR, p=0.1))
_machine("svr_nu", "svm", Settings(svm_type=SvmType.NU_SVR, nu=0.3))
_machine("svm_multiclass_vote", "vote", Settings(svm_type=SvmType.C_SVC), "label")
_machine("forest_score", "forest", Settings())
_machine("lda_score", "lda", Settings())
_machine("perceptron_score", "perceptron", Settings(perceptron_rounds=200))


@query(
    "lda_moments",
    """WITH v AS (SELECT vec_id, label < 5 AS flag, embedding[i + 1]::DOUBLE AS x, i::INT AS i FROM embeddings, range(64) t(i) WHERE i < len(embedding)),
m AS (SELECT flag, i, avg(x) AS mean, count(*) AS n FROM v GROUP BY ALL)
SELECT a.flag, a.i, b.i AS j, any_value(ma.n) AS n, round(any_value(ma.mean), 9) + 0.0::DOUBLE AS mean, round(sum((a.x - ma.mean) * (b.x - mb.mean)), 7) + 0.0::DOUBLE AS product
FROM v a JOIN v b USING (vec_id) JOIN m ma ON ma.flag = a.flag AND ma.i = a.i JOIN m mb ON mb.flag = b.flag AND mb.i = b.i GROUP BY a.flag, a.i, b.i""",
)
def lda_moments(spark, sf_dir):
    """What a discriminant is made from: means and centred products of all features by class."""
    found = class_moments(vectors(spark, sf_dir))
    rows = [(flag, i, j, m.n, float(m.mean[i]), float(m.products[i, j])) for flag, m in found.items() for i in range(len(m.mean)) for j in range(len(m.mean))]
    df = spark.createDataFrame(rows, "flag boolean, i int, j int, n long, mean double, product double")  # as many rows as the features' square
    return df.withColumn("mean", F.round("mean", 9) + F.lit(0.0)).withColumn("product", F.round("product", 7) + F.lit(0.0))


#: A discriminant of two features in closed form: the inverse of a matrix of two rows.
_PLANE = """WITH v AS (SELECT vec_id, label < 5 AS flag, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings),
m AS (SELECT flag, avg(x) AS mx, avg(y) AS my FROM v GROUP BY flag),
c AS (SELECT sum((x - mx) ** 2) / (count(*) - 2) AS xx, sum((y - my) ** 2) / (count(*) - 2) AS yy, sum((x - mx) * (y - my)) / (count(*) - 2) AS xy FROM v JOIN m USING (flag)),
r AS (SELECT (1 - 1e-4) * xx + 1e-4 * (xx + yy) / 2 AS xx, (1 - 1e-4) * yy + 1e-4 * (xx + yy) / 2 AS yy, (1 - 1e-4) * xy AS xy FROM c),
w AS (SELECT (yy * (p.mx - n.mx) - xy * (p.my - n.my)) / (xx * yy - xy * xy) AS a, (xx * (p.my - n.my) - xy * (p.mx - n.mx)) / (xx * yy - xy * xy) AS b, (p.mx + n.mx) / 2 AS cx, (p.my + n.my) / 2 AS cy
  FROM r, (SELECT * FROM m WHERE flag) p, (SELECT * FROM m WHERE NOT flag) n)
SELECT vec_id, round(a * (x - cx) + b * (y - cy), 6) + 0.0::DOUBLE AS score FROM v, w"""


@query("lda_plane_score", _PLANE)
def lda_plane_score(spark, sf_dir):
    rows = vectors(spark, sf_dir).withColumn("features", F.slice("features", 1, 2))
    return _rounded(vector.decide(rows, vector.fit(rows, "lda", Settings(), "vec_id")).select("vec_id", "score"))


@query("forest_all_rows_score")
def forest_all_rows_score(spark, sf_dir):
    """A forest grown over partitions, no table gathered: splits of nodes of over 256 rows are counted by Spark."""
    rows = vectors(spark, sf_dir)
    forest = train_forest_all_rows(rows, "vec_id", trees=50, seed=1, local_rows=256)
    return vector.decide(rows, forest).select("vec_id", "flag", "score", F.lit(forest.oob_error).alias("oob_error"))


@query("perceptron_mixed_score")
def perceptron_mixed_score(spark, sf_dir):
    """A perceptron mixed over partitions, on vectors that one feature separates."""
    rows = vectors(spark, sf_dir).withColumn("flag", F.col("features")[0] > 0).where(F.abs(F.col("features")[0]) > 0.02)
    return vector.decide(rows, train_perceptron_all_rows(rows, "vec_id")).select("vec_id", "flag", "score")


def _feature_machine(name: str, kind: str, settings: Settings) -> None:
    def run(spark, sf_dir):
        model = FeatureModel(PAIRED, settings, features=(*SCORE_FEATURES, Feature("GC"), Feature("MDP")), kind=kind)
        return model.fit(labelled(spark, sf_dir)).score_sequences(sequences(spark, sf_dir))

    query(name)(run)


_feature_machine("score_feature_svm", "svm", Settings())
_feature_machine("score_feature_forest", "forest", Settings())
_feature_machine("score_feature_lda", "lda", Settings())
_feature_machine("score_feature_perceptron", "perceptron", Settings(perceptron_rounds=200))


def _hierarchical(spark, sf_dir, kind: str) -> Hierarchical:
    settings = Settings(svm_type=SvmType.C_SVC, trees=20, cost=0.1)
    return Hierarchical(RARE, settings, kind=kind).fit(labelled(spark, sf_dir))


@query("hier_svm_score")
def hier_svm_score(spark, sf_dir):
    return _hierarchical(spark, sf_dir, "svm").score_sequences(sequences(spark, sf_dir))


@query("hier_forest_score")
def hier_forest_score(spark, sf_dir):
    return _hierarchical(spark, sf_dir, "forest").score_sequences(sequences(spark, sf_dir))


def _cores(spark, sf_dir, mode: CoreMode) -> DataFrame:
    """Cores of windows with at least two occurrences of a motif, each of weight 1."""
    w = placed(spark, sf_dir, RARE)
    w.stored()
    hits = w.occurrences.select("seq_id", "win", "start", "end", F.lit(1.0).alias("weight"))
    n = hits.groupBy("seq_id", "win").agg(F.sum("weight").alias("score"))
    return intervals.core_predictions(hits, join_large(w.windows, n, ["seq_id", "win"]), 2.0, mode, SIZE).withColumnsRenamed({"start": "start_pos", "end": "end_pos"})


#: site: occurrences of windows that have two, and the bases around them; their order among a window's by start and end.
_SITES = S.located(RARE) + """, site AS (SELECT *, s * 100 + e - s AS k, row_number() OVER () AS id FROM (
  SELECT seq_id, i, ws + wl AS we, s, e, s + (e - s) // 2 - 250 AS lo, s + (e - s) // 2 + 250 AS hi, count(*) OVER (PARTITION BY seq_id, i) AS n FROM ow) WHERE n >= 2)"""
#: A site's hits begin in it and come before the first of those that ends after it.
_STRONG = """, upto AS (SELECT x.*, min(y.k) FILTER (y.e > x.hi) AS stop FROM site x JOIN site y ON x.seq_id = y.seq_id AND x.i = y.i AND y.s >= x.lo GROUP BY ALL),
weighed AS (SELECT x.*, count(*) AS total FROM upto x JOIN site y ON x.seq_id = y.seq_id AND x.i = y.i AND y.s >= x.lo AND (stop IS NULL OR y.k < stop) GROUP BY ALL)"""


@query(
    "core_motifs",
    _SITES
    + _STRONG
    + """, told_strong AS (SELECT *, max(total) OVER (PARTITION BY seq_id, i) >= 2 AS any_strong FROM weighed),
chosen AS (SELECT seq_id, i, k, id, CASE WHEN any_strong THEN greatest(lo, 0) ELSE lo END AS a, CASE WHEN any_strong THEN least(hi, we) ELSE hi END AS b, CASE WHEN any_strong THEN total ELSE 1 END AS v FROM told_strong WHERE total >= 2 OR NOT any_strong),
cut AS (SELECT *, CASE WHEN a < max(b) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS f FROM chosen WINDOW w AS (PARTITION BY seq_id, i ORDER BY k, id)),
told AS (SELECT *, sum(f) OVER (PARTITION BY seq_id, i ORDER BY k, id) AS island FROM cut),
flat AS (SELECT seq_id, i, arg_min(a, k) AS a, max(b) AS b, max(v) AS v FROM told GROUP BY seq_id, i, island)
SELECT seq_id, i AS win, a AS start_pos, b AS end_pos, v::DOUBLE AS score FROM (SELECT *, max(v) OVER (PARTITION BY seq_id, i) AS most FROM flat) WHERE v >= 2 OR most < 2""",
)
def core_motifs(spark, sf_dir):
    return _cores(spark, sf_dir, CoreMode.MOTIFS)


def _gated(spark, sf_dir, mode: CoreMode) -> tuple[DataFrame, DataFrame]:
    """Windows, and their cores as a genome's prediction gates them: as _cores, windows from one occurrence on."""
    w = placed(spark, sf_dir, RARE)
    w.stored()
    hits = w.occurrences.select("seq_id", "win", "start", "end", F.lit(1.0).alias("weight"))
    n = hits.groupBy("seq_id", "win").agg(F.sum("weight").alias("score"))
    found = join_large(w.windows, n, ["seq_id", "win"], "left").fillna(0.0, ["score"])
    return found, intervals.gated_cores(intervals.core_predictions(hits, found, 2.0, mode, SIZE, numbered=True), 2.0)


#: Cores of _FLAT by window in order, and the last one's score.
_GATED = ", gated AS (SELECT *, arg_max(score, start_pos) OVER (PARTITION BY seq_id, win) AS last FROM core)"


@query(
    "genome_core_gff",
    "WITH core AS (" + ORACLE["core_motifs"] + ")" + _GATED + ", " + _merge_sql("SELECT seq_id, start_pos AS s, end_pos AS e, score FROM gated WHERE last >= 2", 0, "seq_id")
    + " SELECT seq_id || chr(9) || 'strandline' || chr(9) || 'Prediction' || chr(9) || start_pos || chr(9) || end_pos || chr(9) || score::BIGINT || chr(9) || '.' || chr(9) || '.' || chr(9) || '1' AS line FROM merged",
)
def genome_core_gff(spark, sf_dir):
    """Cores of windows whose last core reaches the threshold, merged where they touch."""
    _, cores = _gated(spark, sf_dir, CoreMode.MOTIFS)
    merged = intervals.merge(cores.where("kept").select(F.col("seq_id").alias("chrom"), "start", "end", "score"), 0, spread=True)
    return sinks.gff_rows(merged)


@query(
    "genome_core_wig",
    "WITH core AS (" + ORACLE["core_motifs"] + ")" + _GATED + ", shown AS (SELECT seq_id, win, any_value(last) AS last FROM gated GROUP BY ALL), every AS (" + S.located(RARE) + " SELECT seq_id, i FROM win)"
    + " SELECT every.seq_id AS chrom, i AS place, CASE WHEN last IS NULL THEN '-9999999999' ELSE last::BIGINT::VARCHAR END AS line FROM every LEFT JOIN shown ON shown.seq_id = every.seq_id AND win = i UNION ALL SELECT DISTINCT seq_id, -1, 'fixedStep chrom=' || seq_id || ' start=1 step=100 span=500' FROM every",
)
def genome_core_wig(spark, sf_dir):
    """The track of the same prediction: a window shows its last core."""
    found, cores = _gated(spark, sf_dir, CoreMode.MOTIFS)
    track = intervals.core_track(found, cores, sinks.NONE_PREDICTED)
    return sinks.wig_rows(track.withColumnRenamed("seq_id", "chrom"), STEP, SIZE)


@query("core_motifs_strong", _SITES + _STRONG + " SELECT seq_id, i AS win, greatest(lo, 0) AS start_pos, least(hi, we) AS end_pos, total::DOUBLE AS score FROM weighed WHERE total >= 2")
def core_motifs_strong(spark, sf_dir):
    return _cores(spark, sf_dir, CoreMode.MOTIFS_STRONG)


@query(
    "core_continuous",
    _SITES
    + """, line AS (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY seq_id, i) AS many FROM site WINDOW w AS (PARTITION BY seq_id, i ORDER BY (lo + hi) // 2, s, e)),
span AS (SELECT x.seq_id, x.i, x.rn AS xr, y.rn AS yr, greatest(x.lo, 0) AS a, least(y.hi, y.we) AS b FROM line x JOIN line y ON x.seq_id = y.seq_id AND x.i = y.i AND y.rn >= x.rn AND y.hi <= x.lo + 500 WHERE x.rn < x.many),
dense AS (SELECT p.*, count(*) AS total FROM span p JOIN site c ON c.seq_id = p.seq_id AND c.i = p.i AND c.s >= a AND c.e <= b WHERE b - a >= 500 GROUP BY ALL)
SELECT seq_id, i AS win, a AS start_pos, b AS end_pos, total::DOUBLE AS score FROM dense QUALIFY row_number() OVER (PARTITION BY seq_id, i ORDER BY total / (b - a) DESC, xr, yr) = 1""",
)
def core_continuous(spark, sf_dir):
    return _cores(spark, sf_dir, CoreMode.CONTINUOUS)


@query(
    "core_max",
    S.located(PAIRED)
    + f""", {_PREDICTED}, p AS (SELECT seq_id, ws, ws + wl AS we, round(score, 6) AS score FROM sw WHERE score >= 40),
q AS (SELECT *, CASE WHEN ws <= lag(we) OVER w THEN 0 ELSE 1 END AS f FROM p WINDOW w AS (PARTITION BY seq_id ORDER BY ws)),
r AS (SELECT *, sum(f) OVER (PARTITION BY seq_id ORDER BY ws) AS run FROM q)
SELECT seq_id, ws AS start_pos, we AS end_pos, score FROM r QUALIFY row_number() OVER (PARTITION BY seq_id, run ORDER BY score DESC, ws) = 1""",
)
def core_max(spark, sf_dir):
    found = intervals.predicted_windows(_rounded(PairSum(PAIRED).score_windows(sequences(spark, sf_dir))), 40.0)
    rows = found.select("seq_id", F.col("start").alias("win_start"), F.col("end").alias("win_end"), "start", "end", "score")
    return _named(intervals.best_of_overlapping(rows, "seq_id"), "seq_id")


#: Of scoring with fixed machines: the first vectors as support, their signs in turn.
SUPPORT, GAMMA, RHO = 6, 1 / 64, 0.25


def _fixed_machine(spark, sf_dir, kernel: Kernel) -> Svm:
    rows = read_table(spark, sf_dir, "embeddings").where(F.col("vec_id") < SUPPORT).orderBy("vec_id").select("embedding").collect()
    support = np.array([r["embedding"] for r in rows], dtype=np.float64)
    ones = np.ones(support.shape[1])
    return Svm(Scaler(-ones, ones), support, np.array([1.0 if i % 2 == 0 else -1.0 for i in range(len(support))]), RHO, kernel, GAMMA, 1.0)


def _kernel_sql(kernel: str) -> str:
    """Machines whose scale leaves values in [-1, 1] as they are."""
    sign = "CASE WHEN sv.vec_id % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0 END"
    x, s = "list_transform(e.embedding, lambda v: v::DOUBLE)", "list_transform(sv.embedding, lambda v: v::DOUBLE)"
    return f"SELECT e.vec_id, round(sum({sign} * {kernel.format(x=x, s=s)}) - {RHO}, 6) + 0.0::DOUBLE AS score FROM embeddings e, embeddings sv WHERE sv.vec_id < {SUPPORT} GROUP BY e.vec_id"


def _decided(name: str, kernel: Kernel, sql: str) -> None:
    def run(spark, sf_dir):
        return _rounded(vector.decide(vectors(spark, sf_dir), _fixed_machine(spark, sf_dir, kernel)).select("vec_id", "score"))

    query(name, _kernel_sql(sql))(run)


_decided("svm_apply_linear", Kernel.LINEAR, "list_inner_product({x}, {s})")
_decided("svm_apply_quadratic", Kernel.QUADRATIC, f"power({GAMMA} * list_inner_product({{x}}, {{s}}) + 1, 2)")
_decided("svm_apply_cubic", Kernel.CUBIC, f"power({GAMMA} * list_inner_product({{x}}, {{s}}) + 1, 3)")
_decided("svm_apply_rbf", Kernel.RBF, f"exp(-{GAMMA} * power(list_distance({{x}}, {{s}}), 2))")


@query("forest_apply", "SELECT vec_id, round(((CASE WHEN embedding[1] <= 0.0 THEN CASE WHEN embedding[3] <= 0.05 THEN 0.2 ELSE 0.9 END ELSE 0.6 END) + (CASE WHEN embedding[2] <= -0.02 THEN 0.1 ELSE 0.75 END)) - 1, 6)::DOUBLE AS score FROM embeddings")
def forest_apply(spark, sf_dir):
    """Two fixed trees."""
    a = Tree(np.array([0, 2, -1, -1, -1]), np.array([0.0, 0.05, 0, 0, 0]), np.array([1, 2, -1, -1, -1]), np.array([4, 3, -1, -1, -1]), np.array([0, 0, 0.2, 0.9, 0.6]))
    b = Tree(np.array([1, -1, -1]), np.array([-0.02, 0, 0]), np.array([1, -1, -1]), np.array([2, -1, -1]), np.array([0, 0.1, 0.75]))
    return _rounded(vector.decide(vectors(spark, sf_dir), Forest((a, b))).select("vec_id", "score"))


# ---- files ----


def _fasta(spark, sf_dir, ordered: bool = False) -> str:
    """A file of the sequences, their bases over lines of 65, under names of two words; in the order of their ids, if asked."""
    path = f"{scratch_folder(spark, 'fasta')}/sequences.fa"
    lines = F.regexp_replace("seq", "(.{65})", "$1\n")
    rows = sequences(spark, sf_dir)
    rows = rows.repartitionByRange("seq_id").sortWithinPartitions("seq_id") if ordered else rows
    rows.select(F.concat(F.lit(">doc "), F.col("seq_id").cast("string"), F.lit("\n"), lines).alias("value")).write.text(path)
    return path


@query("fasta_read", f"WITH {S.SEQS} SELECT 'doc ' || seq_id AS name, len, md5(seq) AS seq_md5 FROM lens")
def fasta_read(spark, sf_dir):
    return read_fasta(spark, _fasta(spark, sf_dir)).select("name", F.col("len").cast("long").alias("len"), F.md5("seq").alias("seq_md5"))


@query("fasta_total_length", f"WITH {S.SEQS} SELECT sum(len)::BIGINT AS bases FROM lens")
def fasta_total_length(spark, sf_dir):
    return spark.createDataFrame([(total_length(read_fasta(spark, _fasta(spark, sf_dir))),)], "bases long")


@query("fasta_flat", f"WITH {S.SEQS} SELECT sum(len)::BIGINT AS len, sum(length(replace(seq, 'A', '')))::BIGINT AS others FROM lens")
def fasta_flat(spark, sf_dir):
    """All records as one sequence, which no row or task holds: it comes in stretches."""
    own = flat_stretches(spark, _fasta(spark, sf_dir), size=1 << 20).select("len", F.expr("substring(seq, 1, int(owned))").alias("seq"))
    others = F.sum(F.length(F.replace("seq", F.lit("A"), F.lit(""))).cast("long"))
    return own.agg(F.max("len").alias("len"), others.alias("others"))


@query("fasta_stretches", f"WITH {S.SEQS} SELECT 'doc ' || seq_id AS name, len, md5(seq) AS seq_md5 FROM lens")
def fasta_stretches(spark, sf_dir):
    """Records read by ranges of 10,000 bytes and put together again."""
    parts = read_stretches(spark, _fasta(spark, sf_dir), chunk=10_000)
    own = F.struct("begin", F.expr("substring(seq, 1, int(owned))").alias("seq"))
    whole = parts.groupBy("seq_id", "name", "len").agg(F.sort_array(F.collect_list(own)).alias("p"))
    return whole.select("name", "len", F.md5(F.array_join(F.col("p.seq"), "")).alias("seq_md5"))


@query("fasta_stretches_scan", "WITH " + S.occurrences(EXACT) + " SELECT 'doc ' || seq_id AS name, m AS motif_id, r AS reverse, s AS start_pos, e AS end_pos FROM occ")
def fasta_stretches_scan(spark, sf_dir):
    """Hits of records read by ranges of 10,000 bytes, those across ranges too."""
    parts = read_stretches(spark, _fasta(spark, sf_dir), overlap=EXACT.max_len - 1, chunk=10_000)
    names = records(parts).select("seq_id", "name")
    return join_large(scan_stretches(parts, EXACT), names, "seq_id").select("name", "motif_id", "reverse", F.col("start").alias("start_pos"), F.col("end").alias("end_pos"))


@query(
    "fasta_flat_scan",
    f"WITH {S.SEQS}, flat AS (SELECT string_agg(seq, '' ORDER BY seq_id) AS s FROM lens), cut AS (SELECT s, unnest(range(0, length(s), 20000)) AS start_pos FROM flat)"
    " SELECT start_pos, length(s)::BIGINT AS len, md5(substr(s, start_pos + 1, 20000)) AS seq_md5, (len(string_split(substr(s, start_pos + 1, 20003), 'GATC')) - 1)::BIGINT AS hits FROM cut",
)
def fasta_flat_scan(spark, sf_dir):
    """All records as one sequence, in stretches of 20,000 bases, with a motif's hits, those across borders too."""
    motif = motif_set(("PAL", "GATC", 0))
    parts = materialize(flat_stretches(spark, _fasta(spark, sf_dir, ordered=True), motif.max_len - 1, 20_000), "flat")
    hits = scan_stretches(parts, motif).where("NOT reverse").groupBy(F.expr("start div 20000 * 20000").alias("begin")).agg(F.count("*").alias("n"))
    return join_large(parts, hits, "begin", "left").select(F.col("begin").alias("start_pos"), "len", F.md5(F.expr("substring(seq, 1, int(owned))")).alias("seq_md5"), F.coalesce("n", F.lit(0)).cast("long").alias("hits"))


@query("fasta_classes", f"WITH {S.SEQS} SELECT 'doc ' || seq_id AS name, 2.0::DOUBLE AS class_value, 'win' AS train_mode, 'enhancer' AS class_name, true AS flag FROM lens")
def fasta_classes(spark, sf_dir):
    classes = Classes()
    classes.register(2.0, "enhancer", True)
    seqs = with_class(read_fasta(spark, _fasta(spark, sf_dir)), classes.value("enhancer"), "win")
    return seqs.join(F.broadcast(classes.to_df(spark)), "class_value").select("name", "class_value", "train_mode", "class_name", "flag")  # a row a class


def _file(spark, name: str, lines: DataFrame, head: str = "", foot: str = "") -> str:
    """A text file of lines (at, line) in order: motif files are small and read whole."""
    path = f"{scratch_folder(spark, name)}/data"
    ends = spark.createDataFrame([(-1, head), (2**62, foot)], "at long, line string").where("line != ''")
    lines.unionByName(ends).repartitionByRange(1, "at").sortWithinPartitions("at").select("line").write.text(path)
    return path


#: A pattern of each supplier: the digits of its key as letters, some the reverse complements of others.
_SPELLED = "translate(lpad((s_suppkey * 7 % 1000)::VARCHAR, 5, '0'), '0123456789', 'ACGTRYSWKM')"


@query(
    "motif_xml_read",
    f"WITH p AS (SELECT s_suppkey, {_SPELLED} AS pattern FROM supplier WHERE s_suppkey % 5 != 4), r AS (SELECT *, reverse(translate(pattern, 'ACGTRYSWKM', 'TGCAYRSWMK')) AS rc FROM p),"
    " k AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY least(pattern, rc) ORDER BY s_suppkey) = 1) SELECT (row_number() OVER (ORDER BY s_suppkey) - 1)::INT AS motif_id, 's' || s_suppkey AS name, pattern, (s_suppkey % 2)::INT AS mismatches FROM k",
)
def motif_xml_read(spark, sf_dir):
    """A motif of each supplier, written as XML and read. Children without all three attributes, and a reverse complement of
    an earlier pattern, are left out."""
    key = F.col("s_suppkey")
    spelled = F.translate(F.lpad((key * 7 % 1000).cast("string"), 5, "0"), "0123456789", "ACGTRYSWKM")
    misses = F.when(key % 5 != 4, F.format_string(' misses="%d"', key % 2)).otherwise("")
    line = F.concat(F.lit('<motif name="s'), key.cast("string"), F.lit('" seq="'), spelled, F.lit('"'), misses, F.lit("/>"))
    out = MotifSet()
    out.add_xml(spark, _file(spark, "xml", read_table(spark, sf_dir, "supplier").select(key.alias("at"), line.alias("line")), "<motifs>", "</motifs>"))
    return out.to_df(spark).select("motif_id", "name", "pattern", "mismatches")


@query(
    "pwm_table_read",
    "SELECT (dense_rank() OVER (ORDER BY s_suppkey) - 1)::INT AS motif_id, 's' || s_suppkey AS name, 2 AS len, c::INT AS place, CASE c WHEN 0 THEN s_acctbal ELSE s_nationkey / 4 END AS weight FROM supplier, range(2) t(c)",
)
def pwm_table_read(spark, sf_dir):
    """A matrix of each supplier, written as a table and read: the weights of A."""
    key, first, second = F.col("s_suppkey"), F.col("s_acctbal").cast("string"), (F.col("s_nationkey") / 4).cast("string")
    row = F.concat(F.lit(">s"), key.cast("string"), F.lit("\nA |\t"), first, F.lit("\t"), second, F.lit("\t\nC |\t0\t1\nG |\t-1\t0.5\nT |\t"), second, F.lit("\t"), first)
    out = MotifSet()
    out.add_pwm_table(spark, _file(spark, "pwm", read_table(spark, sf_dir, "supplier").select(key.alias("at"), row.alias("line"))))
    return out.to_df(spark).select("motif_id", "name", "len", F.posexplode(F.element_at("pwm", 1)).alias("place", "weight"))


# ---- further sinks ----


@query("score_table_rows", _SCORED + " SELECT printf('%.10f', score) || chr(9) || CASE WHEN flag THEN '+' ELSE '-' END AS line FROM t")
def score_table_rows(spark, sf_dir):
    return sinks.score_table(scored(spark, sf_dir))


@query("wig_score_rows", S.located(PAIRED) + f", {_PREDICTED} SELECT 'doc ' || seq_id AS name, i AS place, printf('%.6f', round(score)::DOUBLE) AS line FROM sw UNION ALL SELECT DISTINCT 'doc ' || seq_id, -1, 'fixedStep start=1 step=100 span=500 chrom=doc ' || seq_id FROM sw")
def wig_score_rows(spark, sf_dir):
    rows = PairSum(PAIRED).score_windows(sequences(spark, sf_dir))
    return sinks.wig_scores(rows.select(F.concat(F.lit("doc "), F.col("seq_id").cast("string")).alias("name"), "win", F.round("score").alias("score")), SIZE, STEP)


@query("core_table_rows", "SELECT 'c' || user_id || chr(9) || event_id || chr(9) || event_id + 500 || chr(9) || printf('%.6f', round(value, 1)) AS line FROM events")
def core_table_rows(spark, sf_dir):
    e = read_table(spark, sf_dir, "events")
    rows = e.select(F.concat(F.lit("c"), F.col("user_id").cast("string")).alias("name"), F.col("event_id").alias("core_start"), (F.col("event_id") + 500).alias("core_end"), F.round("value", 1).alias("core_score"))
    return sinks.core_table(rows)


@query("union_split", f"WITH {S.SEQS} SELECT seq_id, len FROM lens")
def union_split(spark, sf_dir):
    """Disjoint random parts of the sequences, put together again."""
    parts = clone_rows(sequences(spark, sf_dir).select("seq_id", "len"), [0.5, 0.3, 0.2], 3)
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
