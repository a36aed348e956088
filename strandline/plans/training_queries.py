"""Queries of how machines are trained, validated, weighed and kept."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.config import Kernel, Settings, SvmType
from strandline.models import store, validation, vector
from strandline.models.binned_forest import permutation_importance, quantile_bins, train_forest_all_rows
from strandline.models.cascade import train_cascade
from strandline.plans.model_queries import vectors
from strandline.session import scratch_folder

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return register


_NEWTON = """WITH RECURSIVE v AS (SELECT embedding[1]::DOUBLE * 10 AS x, embedding[1]::DOUBLE + embedding[2]::DOUBLE > 0 AS y FROM embeddings),
n AS (SELECT count(*) FILTER (y) AS np, count(*) FILTER (NOT y) AS nn FROM v),
t AS (SELECT x, CASE WHEN y THEN (np + 1) / (np + 2) ELSE 1 / (nn + 2) END AS t FROM v, n),
it AS (SELECT 0 AS k, 0.0::DOUBLE AS a, ln((nn + 1) / (np + 1)) AS b FROM n
  UNION ALL SELECT k + 1, a - (hbb * ga - hab * gb) / (haa * hbb - hab * hab), b - (haa * gb - hab * ga) / (haa * hbb - hab * hab)
  FROM (SELECT k, a, b, sum(x * (t - p)) AS ga, sum(t - p) AS gb, sum(x * x * p * (1 - p)) AS haa, sum(p * (1 - p)) AS hbb, sum(x * p * (1 - p)) AS hab FROM (SELECT *, 1 / (1 + exp(a * x + b)) AS p FROM it, t) GROUP BY k, a, b) WHERE k < 30)
SELECT round(a, 6) AS a, round(b, 6) AS b FROM it WHERE k = 30"""


def _scores(spark, sf_dir) -> DataFrame:
    e = F.col("features")
    return vectors(spark, sf_dir).select("vec_id", (e[0] * 10).alias("score"), (e[0] + e[1] > 0).alias("flag"))


@query("platt_sigmoid", _NEWTON)
def platt_sigmoid(spark, sf_dir):
    s = validation.fit_sigmoid(_scores(spark, sf_dir))
    return spark.createDataFrame([(round(s.a, 6), round(s.b, 6))], "a double, b double")


_PAIRED = """WITH r AS (SELECT vec_id, 1 / (1 + exp(-embedding[1]::DOUBLE)) AS r01, 1 / (1 + exp(-embedding[2]::DOUBLE)) AS r02, 1 / (1 + exp(-embedding[3]::DOUBLE)) AS r12 FROM embeddings),
q AS (SELECT vec_id, (1 - r01) ** 2 + (1 - r02) ** 2 AS q00, r01 ** 2 + (1 - r12) ** 2 AS q11, r02 ** 2 + r12 ** 2 AS q22, -r01 * (1 - r01) AS q01, -r02 * (1 - r02) AS q02, -r12 * (1 - r12) AS q12 FROM r),
c AS (SELECT vec_id, q11 * q22 - q12 * q12 + q02 * q12 - q01 * q22 + q01 * q12 - q02 * q11 AS a, q02 * q12 - q01 * q22 + q00 * q22 - q02 * q02 + q01 * q02 - q00 * q12 AS b, q01 * q12 - q02 * q11 + q01 * q02 - q00 * q12 + q00 * q11 - q01 * q01 AS d FROM q)
SELECT vec_id, round(a / (a + b + d), 6) AS p0, round(b / (a + b + d), 6) AS p1, round(d / (a + b + d), 6) AS p2 FROM c"""


@query("pairwise_coupling", _PAIRED)
def pairwise_coupling(spark, sf_dir):
    """Probabilities of three classes from those of their pairs; SQL solves the system of three by cofactors."""
    e = F.col("features")
    pairs = F.array(*[1 / (1 + F.exp(-e[i])) for i in range(3)])
    p = validation.coupled_column(F.col("pairs"), 3)
    out = vectors(spark, sf_dir).select("vec_id", pairs.alias("pairs")).withColumn("p", p)
    return out.select("vec_id", *[F.round(F.col("p")[i], 6).alias(f"p{i}") for i in range(3)])


@query("svm_cross_validation")
def svm_cross_validation(spark, sf_dir):
    """Each vector by machines of two costs that were trained without its fifth of the rows."""
    points = validation.grid(Settings(svm_type=SvmType.C_SVC, kernel=Kernel.RBF), cost=[0.1, 1.0])
    return validation.cross_validated(vectors(spark, sf_dir).select("vec_id", "features", "flag"), points, "vec_id")


@query("svm_cascade_score")
def svm_cascade_score(spark, sf_dir):
    """A machine of all vectors, trained in parts of 200 whose support vectors are merged."""
    rows = vectors(spark, sf_dir)
    samples = rows.select(F.lit(0).alias("g"), F.col("vec_id").alias("id"), "features", F.when(F.col("flag"), 1.0).otherwise(-1.0).alias("y"))
    machine = train_cascade(samples, Settings(svm_type=SvmType.C_SVC, kernel=Kernel.RBF), ["g"], 200)[0,]
    return vector.decide(rows, machine).select("vec_id", "flag", "score")


@query("forest_importance")
def forest_importance(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    bins = quantile_bins(rows)
    forest = train_forest_all_rows(rows, "vec_id", trees=25, seed=1, bins=bins)
    return permutation_importance(rows, forest, bins, "vec_id", seed=1)


@query("stored_machine_score", "SELECT vec_id, round(b * (x - c), 6) + 0.0::DOUBLE AS score FROM (SELECT vec_id, embedding[1]::DOUBLE AS x FROM embeddings), (SELECT (p - n) / v AS b, (p + n) / 2 AS c FROM (SELECT avg(x) FILTER (f) AS p, avg(x) FILTER (NOT f) AS n, (var_pop(x) FILTER (f) * count(*) FILTER (f) + var_pop(x) FILTER (NOT f) * count(*) FILTER (NOT f)) / (count(*) - 2) AS v FROM (SELECT embedding[1]::DOUBLE AS x, label < 5 AS f FROM embeddings)))")
def stored_machine_score(spark, sf_dir):
    """A discriminant of one feature, written to the shared folder and read there by the tasks that score."""
    rows = vectors(spark, sf_dir).withColumn("features", F.slice("features", 1, 1))
    folder = scratch_folder(spark, "machines")
    store.save(vector.fit(rows, "lda", Settings(), "vec_id"), folder)
    out = vector.decide(rows, store.load(folder)).select("vec_id", "score")
    return out.withColumn("score", F.round("score", 6) + F.lit(0.0))
