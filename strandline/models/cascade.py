"""Support vector machines of more samples than one task should hold: a cascade (Graf et al., 2004).

Samples are dealt to parts of bounded size. Each part is trained by a task, which passes on its support vectors alone; two
parts' support vectors are trained together, and so on up to one machine. In the next rounds its support vectors are trained
with the samples of all parts that the machine has wrong. The objective falls with each round, and once no sample violates
the machine, it is that of all samples. What must fit a task is a part, the support vectors of two, and those of the
machine with what it has wrong: up to HELD samples. Machines of more are solved over all their chunks by models.whole,
as nearly all of their samples may be support."""

from __future__ import annotations

import pickle
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.config import Settings, SvmType
from strandline.models.svm import TOLERANCE, Svm, kernel_matrix
from strandline.models.whole import train_all_rows
from strandline.session import materialize, ship_package

#: Samples of a machine whose support a task may hold.
HELD = 1 << 13
#: Rounds at most, and the share of the objective by which a round must better it.
ROUNDS, GAIN = 12, 1e-5
#: By how much a sample may miss its margin.
SLACK = 1e-2


def ranges(samples: DataFrame, group: Sequence[str]) -> DataFrame:
    """group, low, high: the least and largest value of each feature."""
    each = samples.select(*group, F.posexplode("features").alias("i", "v")).groupBy(*group, "i").agg(F.min("v").alias("l"), F.max("v").alias("h"))
    row = F.sort_array(F.collect_list(F.struct("i", "l", "h")))
    return each.groupBy(*group).agg(row.alias("r")).select(*group, F.col("r.l").alias("low"), F.col("r.h").alias("high"))


def objective(m: Svm) -> float:
    """1/2 a'Qa - sum a of a C-SVC."""
    k = kernel_matrix(m.support, m.support, m.kernel, m.gamma, m.c0)
    return float(0.5 * m.coefficients @ k @ m.coefficients - (np.abs(m.coefficients).sum() if m.mass is None else m.mass))


def train_cascade(samples: DataFrame, settings: Settings, group: Sequence[str], part_rows: int, rounds: int = ROUNDS) -> dict[tuple, Svm]:
    """C-SVC machines by group of samples (group, id, features, y: 1 or -1; ids are distinct in a group). A group without
    both signs has a machine without support vectors that decides for its one sign.

    A group of at most part_rows samples is one part, and its machine that of train_svm; one of more than HELD is no cascade.
    Rows are written once, trained
    once in tasks of a part each, and decided once a round; parts are not trained again with all of the support, which
    would take as many copies of it as there are parts."""
    spark, s = samples.sparkSession, settings
    if s.svm_type is not SvmType.C_SVC:
        raise ValueError("a cascade trains C-SVC machines alone")
    ship_package(spark)
    group = list(group)
    large = samples.groupBy(*group).count().where(F.col("count") > HELD).drop("count").collect()  # a row a group
    if large:
        named = F.broadcast(spark.createDataFrame(large, samples.select(*group).schema))
        machines = train_all_rows(samples.join(named, group, "left_semi"), s, group)
        return machines | train_cascade(samples.join(named, group, "left_anti"), settings, group, part_rows, rounds)
    keys = ", ".join(f"{c} {samples.schema[c].dataType.simpleString()}" for c in group)
    sizes = samples.groupBy(*group).agg(F.count("*").alias("n")).withColumn("parts", F.ceil(F.col("n") / part_rows).cast("long"))
    told = sizes.join(ranges(samples, group), group)
    rows = samples.select(*group, F.col("id").cast("long").alias("id"), "features", F.col("y").cast("double").alias("y")).join(told, group)
    rows = materialize(rows.withColumn("part", F.pmod(F.xxhash64("id"), "parts")), "dealt-samples")
    most = rows.agg(F.max("parts")).first()[0] or 0
    names = [c.split()[0] for c in keys.split(", ")]

    def train(key, df: pd.DataFrame) -> pd.DataFrame:
        """Support vectors of a part, and with the last of them the machine."""
        from strandline.models.cascade import objective
        from strandline.models.svm import Scaler, Svm, solved

        df = df.drop_duplicates("id").sort_values("id")
        x, y = np.array(df["features"].tolist(), np.float64), df["y"].to_numpy()
        scaler = Scaler(np.array(df["low"].iloc[0], np.float64), np.array(df["high"].iloc[0], np.float64))
        if len(np.unique(y)) < 2:  # nothing to part: all of it goes on, for a part of the other sign
            gamma = 1.0 / x.shape[1] if s.gamma is None else s.gamma
            machine, used = Svm(scaler, np.zeros((0, x.shape[1])), np.zeros(0), -float(y[0]), s.kernel, gamma, s.c0), np.arange(len(df))
        else:
            machine, used = solved(x, y, s.svm_type, s.kernel, s.cost, s.nu, s.p, s.c0, s.gamma, scaler=scaler)
        out = df.iloc[used][[*names, "id", "features", "y", "low", "high", "parts"]].copy()
        out["part"], out["machine"], out["objective"] = int(key[-1]), None, 0.0
        out.iloc[0, out.columns.get_loc("machine")] = pickle.dumps(machine)
        out.iloc[0, out.columns.get_loc("objective")] = objective(machine) if len(machine.support) else 0.0
        return out

    ddl = f"{keys}, id long, features array<double>, y double, low array<double>, high array<double>, parts long, part long, machine binary, objective double"
    columns = [*group, "id", "features", "y", "low", "high", "parts", "part"]
    machines: dict[tuple, Svm] = {}
    value: dict[tuple, float] = {}
    support: DataFrame | None = None
    for _ in range(rounds):
        layer, width = rows.select(columns), most
        if support is not None:
            held = support.where("parts > 1").select(columns)
            wrong = rows.where("parts > 1").where(_short(machines, group)).withColumn("part", F.lit(0).cast("long")).select(columns)
            wrong = materialize(wrong.join(held.select(*group, "id").hint("merge"), [*group, "id"], "left_anti").select(columns), "wrong-samples")
            if wrong.isEmpty():
                break
            layer, width = held.unionByName(wrong), 1
        layer = materialize(layer.groupBy(*group, "part").applyInPandas(train, ddl), "support")
        while width > 1:
            width = -(-width // 2)
            layer = materialize(layer.withColumn("part", F.floor(F.col("part") / 2)).select(columns).groupBy(*group, "part").applyInPandas(train, ddl), "support")
        found = layer.where("machine IS NOT NULL").select(*group, "machine", "objective", "parts").collect()  # a machine a group
        moving = False
        for r in found:
            key = tuple(r[c] for c in group)
            machines[key] = pickle.loads(r["machine"])
            moving |= r["parts"] > 1 and (key not in value or value[key] - r["objective"] > GAIN * abs(r["objective"]))
            value[key] = r["objective"]
        if not moving:
            break
        support = layer
    return machines


def _short(machines: dict[tuple, Svm], group: Sequence[str]) -> Column:
    """Whether a sample (group, features, y) misses its margin."""
    shared = SparkSession.active().sparkContext.broadcast(machines)

    @F.pandas_udf("boolean")
    def short(key: pd.DataFrame, features: pd.Series, y: pd.Series) -> pd.Series:
        out, x = np.zeros(len(y), bool), np.array(features.tolist(), np.float64)
        code, keys = pd.factorize(pd.Series(list(key.itertuples(index=False, name=None)), dtype=object))
        for i, k in enumerate(keys):
            at = code == i
            out[at] = y.to_numpy()[at] * shared.value[k].decide(x[at]) < 1 - TOLERANCE
        return pd.Series(out)

    return short(F.struct(*group), F.col("features"), F.col("y"))


def violations(samples: DataFrame, machines: dict[tuple, Svm], group: Sequence[str], cost: float) -> DataFrame:
    """group, n, wrong of samples as for train_cascade: those that miss the margin by more than SLACK and are no support
    vectors at their bound; of a machine of all samples, none."""
    shared = samples.sparkSession.sparkContext.broadcast(machines)
    ship_package(samples.sparkSession)

    @F.pandas_udf("boolean")
    def wrong(key: pd.DataFrame, features: pd.Series, y: pd.Series) -> pd.Series:
        out = np.zeros(len(y), bool)
        x, all_keys = np.array(features.tolist(), np.float64), list(key.itertuples(index=False, name=None))
        for k in set(all_keys):
            at = np.array([i for i, other in enumerate(all_keys) if other == k])
            m = shared.value[k]
            held = {z.tobytes() for z, c in zip(m.support, m.coefficients) if abs(c) >= cost * (1 - 1e-9)}
            short = y.to_numpy()[at] * m.decide(x[at]) < 1 - SLACK
            out[at] = [bool(b) and m.scaler(x[i : i + 1])[0].tobytes() not in held for b, i in zip(short, at)]
        return pd.Series(out)

    marked = samples.withColumn("_wrong", wrong(F.struct(*group), F.col("features"), F.col("y")))
    return marked.groupBy(*group).agg(F.count("*").alias("n"), F.count_if("_wrong").alias("wrong"))
