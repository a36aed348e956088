"""Quality rules with risk-controlled thresholds.

Statistics of whole texts give each rule a score, higher is worse. A base rule rejects short and repetitive texts. For
the rest, every rule has a list of cutoffs from lenient to strict, and a stratum has a path: a fixed order of steps, each
of which makes one rule's cutoff stricter. On labelled holdouts of the stratum, the exact binomial test of "all cutoffs
so far together reject more than `risk` of the good documents" is made step by step; the cutoffs before the first step
that can't be refuted hold (fixed-sequence testing), which is the Clopper-Pearson bound staying at or below the risk. As
the rules are tested together, they share no risk and no level, and about 220 good labels certify a stratum of four.

A path may depend on anything but the labels that test it, so a stratum's is chosen on a bounded sample of the other
strata's labels: next comes the step that rejects the most bad documents for the good ones it costs. A stratum alone
takes the rules' cutoffs in turn. Strata are corrected by Bonferroni, so with probability 1 - delta no stratum loses
more than `risk` of its good documents to the cutoffs. Equal texts are one trial. A stratum with too few labels to certify
anything has no cutoffs.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.session import map_arrow, materialize, release_memory, ship_package

RISK = 0.02
DELTA = 0.05
#: Labelled texts, of each quality at most, that paths are chosen on: those with the smallest digests.
PATH_ROWS = 20_000
SYMBOLS = b"#*$%&|<>"
STATS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]

_GEOMETRIC = [round(0.5 * 0.8**i, 4) for i in range(20)]
#: Cutoffs by rule, from lenient to strict; a document is rejected if its score is over the cutoff.
CUTOFFS: dict[str, list[float]] = {
    "symbols": _GEOMETRIC,
    "dup_lines": _GEOMETRIC,
    "repeats": _GEOMETRIC,
    "long_words": [float(x) for x in range(30, 7, -1)],
    "short_words": [round(-2.0 - 0.1 * i, 1) for i in range(25)],
}


def text_stats(text: bytes | None) -> tuple[int, ...]:
    """STATS of one UTF-8 text; a null text has no words."""
    text = text or b""
    words = text.split()
    inner = text.decode("utf-8", "replace")
    word_chars = len(inner) - sum(map(inner.count, " \t\n\v\f\r"))
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(windows) != len(set(windows)):
        counts = Counter(windows)
        end = 0  # words before it are counted
        for i, w in enumerate(windows):
            if counts[w] > 1:
                repeated += i + 3 - max(end, i)
                end = i + 3
    return len(words), word_chars, sum(map(text.count, (bytes([c]) for c in SYMBOLS))), len(lines), len(lines) - len(set(lines)), repeated


def stats(docs: DataFrame, stratum: str = "lang") -> DataFrame:
    """doc_id, stratum ('' for null), text_key (a digest of the text) and STATS of each row of docs (doc_id, text and the
    stratum's column)."""
    ship_package(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from strandline.llm.quality import STATS, text_stats

        for b in batches:
            texts = [t.as_py() for t in b.column(2)]
            keys = pa.array([int.from_bytes(hashlib.blake2b(t or b"", digest_size=8).digest(), "big", signed=True) for t in texts], pa.int64())
            columns = list(zip(*map(text_stats, texts))) or [()] * len(STATS)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), keys, *(pa.array(c, pa.int64()) for c in columns)], names=["doc_id", "stratum", "text_key", *STATS])

    schema = "doc_id long, stratum string, text_key long, " + ", ".join(f"{c} long" for c in STATS)
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"), F.col("text").cast("binary").alias("text"))
    return map_arrow(chosen, work, schema)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def scores() -> dict[str, Column]:
    def share(a: str, b: str) -> Column:
        return F.col(a) / F.greatest(F.col(b), F.lit(1))

    return {"symbols": share("n_symbols", "word_chars"), "dup_lines": share("n_dup_lines", "n_lines"), "repeats": share("n_repeat_words", "n_words"), "long_words": share("word_chars", "n_words"), "short_words": -share("word_chars", "n_words")}


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) of a binomial X, exact up to floating point."""
    if k >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * math.fsum(math.exp(x - top) for x in logs))


def strictest(rejected: list[int], n: int, risk: float, level: float) -> int:
    """Index of the strictest cutoff certified, -1 if none: rejected[j] of n good documents fall to cutoff j."""
    for j, k in enumerate(rejected):
        if k > risk * n or binomial_tail(k, n, risk) > level:
            return j - 1
    return len(rejected) - 1


Path = list[tuple[str, float]]  # rule and its next cutoff


def plain_path() -> Path:
    """All rules' cutoffs in turn, each rule's spread evenly over the path."""
    steps = [((j + 1) / len(cs), i, r, c) for i, (r, cs) in enumerate(CUTOFFS.items()) for j, c in enumerate(cs)]
    return [(r, c) for _, _, r, c in sorted(steps)]


def choose_path(scored: np.ndarray, good: np.ndarray) -> Path:
    """Path of all cutoffs: each step is the rule whose next cutoff newly rejects the largest share of the bad rows for
    the share of the good ones; ties go to the first rule. scored: rows by rules."""
    at = {r: 0 for r in CUTOFFS}
    gone = np.zeros(len(scored), bool)
    n_good, n_bad = int(good.sum()), int((~good).sum())
    path: Path = []
    while True:
        best = None
        for i, (r, cs) in enumerate(CUTOFFS.items()):
            if at[r] < len(cs):
                new = (scored[:, i] > cs[at[r]]) & ~gone
                cost = int((new & good).sum())
                worth = (int(new.sum()) - cost + 0.5) / (n_bad + 1) / ((cost + 0.5) / (n_good + 1))
                if best is None or worth > best[0]:
                    best = (worth, r, new)
        if best is None:
            return path
        _, r, new = best
        path.append((r, CUTOFFS[r][at[r]]))
        at[r] += 1
        gone |= new


def limits_of(path: Path) -> dict[str, list[float]]:
    """The cutoff of each rule after each step, infinite before its first."""
    now = {r: math.inf for r in CUTOFFS}
    out: dict[str, list[float]] = {r: [] for r in CUTOFFS}
    for r, c in path:
        now[r] = c
        for x in CUTOFFS:
            out[x].append(now[x])
    return out


def certified(rejected: list[int], n: int, path: Path, risk: float, level: float) -> dict[str, float]:
    """Cutoffs by rule after the last step of the path that is certified: rejected[j] of n good documents fall to the
    cutoffs after step j."""
    return dict(path[: strictest(rejected, n, risk, level) + 1])


def fit_thresholds(measured: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> dict[str, dict[str, float]]:
    """Cutoffs by stratum and rule from all labelled rows. measured: rows of stats(); labels: doc_id, quality (1 is good;
    a document with any other label is not; null labels and ids count for nothing). Equal texts of a stratum count once.

    The driver gets PATH_ROWS scores of each quality, and for each stratum with enough good texts for a certificate the
    number of them that each step rejects first."""
    spark = measured.sparkSession
    told = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min((F.col("quality") == 1).cast("int")).alias("good"))
    rules = scores()
    held = measured.where(~base_failed()).select("doc_id", "stratum", "text_key", F.array(*[rules[r].cast("double") for r in CUTOFFS]).alias("scores"))
    held = held.join(told, "doc_id").groupBy("stratum", "text_key").agg(F.min("good").alias("good"), F.min("scores").alias("scores"))
    held = materialize(held, "labelled-scores")
    least = math.ceil(math.log(delta) / math.log1p(-risk))  # with fewer texts even no rejection proves nothing
    sizes = {r["stratum"]: r["n"] for r in held.where("good = 1").groupBy("stratum").agg(F.count("*").alias("n")).where(F.col("n") >= least).collect()}
    if not sizes:
        return {}
    few = [held.where(F.col("good") == g).orderBy(F.xxhash64("text_key"), "stratum").limit(PATH_ROWS) for g in (0, 1)]
    sample = few[0].unionByName(few[1]).select("stratum", "good", "scores").toPandas()
    table, good = np.array(sample["scores"].tolist(), dtype=np.float64).reshape(-1, len(CUTOFFS)), sample["good"].to_numpy() == 1
    paths: dict[str, Path] = {}
    for s in sorted(sizes):
        others = (sample["stratum"] != s).to_numpy()
        paths[s] = choose_path(table[others], good[others]) if good[others].any() and (~good[others]).any() else plain_path()
    steps = spark.createDataFrame([(s, [limits_of(p)[r] for r in CUTOFFS]) for s, p in paths.items()], "stratum string, limits array<array<double>>")
    # a rule's cutoffs fall along the path, so those at or above a score tell the first step that rejects it
    first = F.array_min(F.zip_with("scores", "limits", lambda score, limits: F.size(F.filter(limits, lambda x: x >= score))))
    counted = held.where("good = 1").join(F.broadcast(steps), "stratum")  # a row a stratum with enough labels
    rows = counted.groupBy("stratum", first.alias("first")).agg(F.count("*").alias("n")).collect()
    found: dict[str, dict[str, float]] = {}
    for s, path in paths.items():
        falls = np.zeros(len(path) + 1, np.int64)
        for r in rows:
            if r["stratum"] == s:
                falls[r["first"]] += r["n"]
        found[s] = certified(np.cumsum(falls)[:-1].tolist(), sizes[s], path, risk, delta / len(sizes))
    return found


def verdicts(measured: DataFrame, cutoffs: dict[str, dict[str, float]]) -> DataFrame:
    """measured with base_failed, failed_rules (array of names) and kept."""
    rules = scores()
    table = [(s, *(by.get(r) for r in CUTOFFS)) for s, by in cutoffs.items()]
    limits = measured.sparkSession.createDataFrame(table, "stratum string, " + ", ".join(f"cut_{r} double" for r in CUTOFFS))
    marked = measured.join(F.broadcast(limits), "stratum", "left")  # a row per stratum with enough labels
    failed = F.array_compact(F.array(*[F.when(rules[r] > F.col(f"cut_{r}"), F.lit(r)) for r in CUTOFFS]))
    marked = marked.withColumn("base_failed", base_failed()).withColumn("failed_rules", failed)
    return marked.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0)).drop(*[f"cut_{r}" for r in CUTOFFS])


def quality_rules(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """One row per row of docs (doc_id, text, lang; others are not read): doc_id, stratum, STATS, base_failed,
    failed_rules, kept.

    Null and empty texts have no words and fail the base rule; null ids are judged but never labelled; a null stratum is
    the stratum ''. Repeated rows are judged alike, each by its own text. Empty tables give an empty result, empty labels
    no cutoffs."""
    measured = materialize(stats(docs, stratum), "quality-stats")
    return verdicts(measured, fit_thresholds(measured, labels, risk, delta))


def keep_good(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """docs without the rows that quality_rules() rejects; all columns stay. Texts are read twice, to fit and to judge.
    Null and empty texts go, as they fail the base rule; nulls elsewhere, repeated rows and columns of any name stay; an
    empty table gives an empty one."""
    ship_package(docs.sparkSession)
    cutoffs = fit_thresholds(materialize(stats(docs, stratum), "quality-stats"), labels, risk, delta)

    @F.pandas_udf(", ".join(f"{c} long" for c in STATS))
    def measure(texts: pd.Series) -> pd.DataFrame:
        from strandline.llm.quality import STATS, text_stats

        out = pd.DataFrame([text_stats(t) for t in texts], columns=STATS, dtype="int64")
        release_memory()
        return out

    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    measured = docs.select(row, F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"), measure(F.col("text").cast("binary")).alias("m")).select("row", "stratum", "m.*")
    return verdicts(measured, cutoffs).where("kept").select("row.*")
