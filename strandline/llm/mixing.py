"""Mixing sources to target weights by Sainte-Lague apportionment, in DataFrame functions only.

1. Targets: sources in code point order, null last, share `share` times all words by repeating weights; a target stops
   at `cap` times its source's words and the excess is shared again by weight (one sorted pass finds the water level).
2. Quotas: all words of the mix are cut into blocks of `block` words; the blocks go to sources by highest quotients
   target / (2 k + 1), and the words of a source's blocks go to its shards in the same way, by the shards' words. So a
   source is within half a block of its target, and shards of few words lose nothing to blocks that don't fit them.
3. Selection: a shard's documents stand in the order of a seeded hash. The shard's quota takes whole passes over that
   line and, for the rest, a run of blocks from a seeded block on, round the end; a document's share follows from its
   place on the line, without listing blocks.

All windows run over (source, shard) cells; a source that holds most rows is spread over all its shards. Tables of
sources and of cells (sources x shards rows) are small and joined by whichever way Spark picks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
BLOCK_WORDS = 8
SHARDS = 256
SEED = 42


def word_count(text: Column) -> Column:
    """Words of the whole text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _number(text: Column) -> Column:
    """A number below 2**24 from a string, the same in any engine with md5."""
    return F.conv(F.substring(F.md5(text), 1, 6), 16, 10).cast("long")


def source_targets(sources: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """sources (source, source_size) with target: one row per source comes in, so the windows over all rows are small."""
    ranked = sources.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")))
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("place") - 1) % len(weights) + 1).cast("int")).cast("double"))
    ranked = ranked.withColumn("most", cap * F.col("source_size")).withColumn("fills_at", F.col("most") / F.col("weight"))
    line = Window.orderBy("fills_at", "place")
    everything = Window.partitionBy()
    ranked = ranked.withColumn("total", share * F.sum("source_size").over(everything))
    ranked = ranked.withColumn("full_before", F.coalesce(F.sum("most").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    ranked = ranked.withColumn("weight_left", F.sum("weight").over(line.rowsBetween(0, Window.unboundedFollowing)))
    ranked = ranked.withColumn("level", (F.col("total") - F.col("full_before")) / F.col("weight_left")).withColumn("at", F.row_number().over(line))
    ranked = ranked.withColumn("first", F.min(F.when(F.col("fills_at") > F.col("level"), F.struct("at", "level"))).over(everything))
    target = F.when(F.col("first").isNull() | (F.col("at") < F.col("first.at")), F.col("most")).otherwise(F.col("weight") * F.col("first.level"))
    return ranked.select("source", "source_size", "total", target.alias("target"))


def sainte_lague(parties: DataFrame, group: Sequence[str], party: str, weight: str, seats: str, quota: str) -> DataFrame:
    """parties with the column quota: `seats` (one number per group) dealt by the highest quotients weight / (2 k + 1),
    ties to the smaller party. Rounding weight * seats / total is right but for a few seats, at most half the number of
    parties, and a party's part in them is about its share of the weight: only so many of its quotients are listed and
    ranked, some four a party in all."""
    of_group = Window.partitionBy(*group)
    total = F.sum(weight).over(of_group)
    near = F.when((F.col(weight) > 0) & (F.col(seats) > 0), F.floor(F.col(weight) * F.col(seats) / F.col("_total") + 0.5)).otherwise(F.lit(0))
    base = parties.withColumn("_total", total).withColumn("_near", near.cast("long")).withColumn("_diff", F.col(seats) - F.sum("_near").over(of_group))
    # with n parties, seats rise from the rounded ones by share * (diff + n) + 1 at most, and fall by no more
    part = F.when(F.col(weight) > 0, F.floor(F.col(weight) / F.col("_total") * (F.abs("_diff") + F.count("*").over(of_group))) + 2).otherwise(F.lit(0))
    base = base.withColumn("_most", F.least(F.abs("_diff"), part).cast("long"))
    more = F.transform(F.sequence(F.lit(1).cast("long"), F.col("_most")), lambda j: F.col(weight) / (2 * (F.col("_near") + j) - 1))
    fewer = F.transform(F.sequence(F.lit(1).cast("long"), F.least("_most", "_near")), lambda j: F.col(weight) / (2 * (F.col("_near") - j) + 1))
    listed = F.when((F.col("_diff") > 0) & (F.col(weight) > 0), more).when((F.col("_diff") < 0) & (F.col("_near") > 0), fewer)
    rows = base.withColumn("_quotient", F.explode_outer(listed))
    up = Window.partitionBy(*group).orderBy(F.desc_nulls_last("_quotient"), party)
    down = Window.partitionBy(*group).orderBy(F.asc_nulls_last("_quotient"), F.desc(party))
    rows = rows.withColumn("_rank", F.when(F.col("_diff") >= 0, F.row_number().over(up)).otherwise(F.row_number().over(down)))
    step = F.when(F.col("_quotient").isNotNull() & (F.col("_rank") <= F.abs("_diff")), F.signum("_diff").cast("long")).otherwise(F.lit(0))
    keys = [*group, party]
    rest = [c for c in parties.columns if c not in keys]
    return rows.groupBy(*keys).agg(*[F.first(c).alias(c) for c in rest], (F.first("_near") + F.sum(step)).alias(quota))


def _placing(docs: DataFrame, seed: int, shards: int, *more: Column) -> DataFrame:
    """doc_id, source, size and where a row stands: source_key, key (its seeded hash), shard."""
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), *more)
    source_key = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")).alias("source_key")
    key = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("key")
    return out.select("*", source_key, key).withColumn("shard", F.conv(F.substring("key", 1, 6), 16, 10).cast("long") % shards)


def cell_quotas(sized: DataFrame, weights: Sequence[int], share: float, cap: float, block: int, seed: int) -> DataFrame:
    """One row per (source_key, shard) of sized: source_size, target, cell_size, passes, rest, run_from."""
    cells = sized.groupBy("source", "source_key", "shard").agg(F.sum("size").alias("cell_size"))
    targets = source_targets(cells.groupBy("source").agg(F.sum("cell_size").alias("source_size")), weights, share, cap)
    source_key = F.coalesce(F.concat(F.lit("s"), "source"), F.lit(""))
    targets = targets.withColumn("one", F.lit(1)).withColumn("blocks", F.round(F.col("total") / block).cast("long"))
    targets = sainte_lague(targets.withColumn("source_key", source_key), ["one"], "source_key", "target", "blocks", "source_blocks").drop("one", "source")
    targets = targets.withColumn("source_words", F.least(F.col("source_blocks") * block, F.floor(F.col("source_size") * cap)).cast("long"))
    cells = sainte_lague(cells.drop("source").join(targets, "source_key"), ["source_key"], "shard", "cell_size", "source_words", "cell_words")
    words = F.least(F.col("cell_words"), F.floor(F.col("cell_size") * cap))
    cells = cells.withColumn("words", words.cast("long"))
    cells = cells.withColumn("passes", F.when(F.col("cell_size") > 0, F.floor(F.col("words") / F.col("cell_size"))).otherwise(F.lit(0)).cast("long"))
    cells = cells.withColumn("rest", F.col("words") - F.col("passes") * F.col("cell_size"))
    seeded = _number(F.concat(F.lit(f"{seed}|"), "source_key", F.lit("|"), F.col("shard").cast("string")))
    cells = cells.withColumn("run_from", block * (seeded % F.greatest(F.lit(1), F.ceil(F.col("cell_size") / block))))
    return cells.drop("total", "blocks", "source_blocks", "source_words", "cell_words", "words")


def _place(sized: DataFrame, cells: DataFrame) -> DataFrame:
    """sized with its cells' columns and passes, part_from, part_words, head_words, taken."""
    line = Window.partitionBy("source_key", "shard").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("start", F.coalesce(F.sum("size").over(line), F.lit(0))).withColumn("end", F.col("start") + F.col("size"))
    placed = placed.join(cells, ["source_key", "shard"])
    part_from = F.greatest("start", "run_from")
    zero = F.lit(0).cast("long")
    placed = placed.withColumn("part_words", F.greatest(zero, F.least(F.col("end"), F.col("run_from") + F.col("rest")) - part_from))
    placed = placed.withColumn("part_from", F.when(F.col("part_words") > 0, part_from - F.col("start")).otherwise(zero))
    placed = placed.withColumn("head_words", F.greatest(zero, F.least(F.col("end"), F.col("run_from") + F.col("rest") - F.col("cell_size")) - F.col("start")))
    return placed.withColumn("taken", F.col("passes") * F.col("size") + F.col("part_words") + F.col("head_words"))


def mix(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, block: int = BLOCK_WORDS, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """One row per row of docs (doc_id, text, source; more columns are not read): doc_id, source, size, source_size,
    target, taken, and where the words lie: passes over the whole document, then words [part_from, part_from +
    part_words) and the first head_words.

    A null text has no words, a null source is a source of its own, null and repeated doc_ids keep all their rows (equal
    rows may swap their shares), and an empty table gives an empty one. cap is 2 at most: passes are whole."""
    sized = materialize(_placing(docs, seed, shards), "sizes")
    placed = _place(sized, cell_quotas(sized, weights, share, cap, block, seed))
    return placed.select("doc_id", "source", "size", "source_size", "target", "taken", "passes", "part_from", "part_words", "head_words")


def mixed_documents(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, block: int = BLOCK_WORDS, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """The mix itself, in the columns of docs: a row per pass over a document and one per run of its words taken besides
    (white space before the run's first word left out), n_chars, if there, counted anew. A run may begin and end inside a
    document, which is then cut. Edge cases as in mix()."""
    # rows get numbers and are written, so that only narrow rows are placed and texts meet their places by number
    number = "_number" + "_" * max([0, *(len(c) for c in docs.columns if c.startswith("_number"))])
    numbered = materialize(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
    sized = materialize(_placing(numbered, seed, shards, F.col(number).alias("row_number")), "sizes")
    placed = _place(sized, cell_quotas(sized.drop("row_number"), weights, share, cap, block, seed)).where("taken > 0")
    placed = placed.select("row_number", "taken", "passes", "part_from", "part_words", "head_words")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    placed = numbered.select(F.col(number).alias("row_number"), row).join(placed, "row_number")
    pieces = F.regexp_extract_all(F.col("row.text"), F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))

    def run(first: Column, n: Column) -> Column:
        text = F.regexp_replace(F.array_join(F.slice(pieces, (first + 1).cast("int"), n.cast("int")), ""), r"^[\x20\x09-\x0D]+", "")
        return F.when(n > 0, F.array(text)).otherwise(F.array().cast("array<string>"))

    whole = F.array_repeat(F.col("row.text"), F.col("passes").cast("int"))
    texts = F.concat(whole, run(F.col("part_from"), F.col("part_words")), run(F.lit(0), F.col("head_words")))
    out = placed.where("taken > 0").select("row", F.explode(texts).alias("mixed"))
    columns = {"text": F.col("mixed")}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.length("mixed").cast(docs.schema["n_chars"].dataType)
    return out.select(*[columns[c].alias(c) if c in columns else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


#: The same rows in DuckDB's SQL, of mix() with its defaults over the table documents.
ORACLE = rf"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size,
    coalesce('s' || source, '') AS source_key, md5('{SEED}|' || coalesce(doc_id::VARCHAR, '')) AS key FROM documents),
s2 AS (SELECT *, ('0x' || key[1:6])::BIGINT % {SHARDS} AS shard FROM sized),
cells AS (SELECT source, source_key, shard, sum(size)::BIGINT AS cell_size FROM s2 GROUP BY ALL),
r1 AS (
  SELECT source, source_key, sum(cell_size)::BIGINT AS source_size, row_number() OVER (ORDER BY (source IS NULL), encode(source)) AS place FROM cells GROUP BY source, source_key),
r2 AS (SELECT *, ([3.0, 1.0, 2.0])[((place - 1) % 3 + 1)::INT]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS most, 1.5::DOUBLE * sum(source_size) OVER () AS total FROM r1),
r3 AS (
  SELECT *, most / weight AS fills_at, row_number() OVER w AS pos,
    coalesce(sum(most) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS full_before,
    sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_left
  FROM r2 WINDOW w AS (ORDER BY most / weight, place)),
r4 AS (SELECT *, (total - full_before) / weight_left AS level FROM r3),
stop AS (SELECT min(pos) AS pos, arg_min(level, pos) AS level FROM r4 WHERE fills_at > level),
targets AS (
  SELECT r4.source_key, source_size, CASE WHEN stop.pos IS NULL OR r4.pos < stop.pos THEN most ELSE weight * stop.level END AS target, round(total / {BLOCK_WORDS})::BIGINT AS blocks FROM r4, stop),
-- every quotient of every block, and the highest: apportionment by definition
q1 AS (SELECT source_key, target / (2 * k - 1) AS quotient, blocks FROM (SELECT *, unnest(range(1, (target / {BLOCK_WORDS})::BIGINT + 20)) AS k FROM targets) WHERE target > 0),
q2 AS (SELECT source_key FROM q1 QUALIFY row_number() OVER (ORDER BY quotient DESC, encode(source_key)) <= blocks),
seats AS (SELECT source_key, count(*) AS source_blocks FROM q2 GROUP BY 1),
c1 AS (SELECT source_key, shard, cell_size, source_size, target, least(coalesce(source_blocks, 0) * {BLOCK_WORDS}, 2 * source_size) AS source_words FROM cells JOIN targets USING (source_key) LEFT JOIN seats USING (source_key)),
p1 AS (SELECT source_key, shard, cell_size / (2 * k - 1) AS quotient, source_words FROM (SELECT *, unnest(range(1, ceil(cell_size * source_words / source_size)::BIGINT + 200)) AS k FROM c1 WHERE cell_size > 0)),
p2 AS (SELECT source_key, shard FROM p1 QUALIFY row_number() OVER (PARTITION BY source_key ORDER BY quotient DESC, shard) <= source_words),
quota AS (SELECT source_key, shard, count(*) AS cell_words FROM p2 GROUP BY ALL),
c2 AS (
  SELECT c1.*, least(coalesce(cell_words, 0), 2 * cell_size) AS words,
    {BLOCK_WORDS} * (('0x' || md5('{SEED}|' || source_key || '|' || shard::VARCHAR)[1:6])::BIGINT % greatest(1, ceil(cell_size / {BLOCK_WORDS})::BIGINT)) AS run_from
  FROM c1 LEFT JOIN quota USING (source_key, shard)),
c3 AS (SELECT *, CASE WHEN cell_size > 0 THEN words // cell_size ELSE 0 END AS passes, CASE WHEN cell_size > 0 THEN words % cell_size ELSE 0 END AS rest FROM c2),
placed AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source_key, shard ORDER BY key, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS a
  FROM s2 JOIN c3 USING (source_key, shard))
SELECT doc_id, size, source_size, target,
  (passes * size + greatest(0, least(a + size, run_from + rest) - greatest(a, run_from)) + greatest(0, least(a + size, run_from + rest - cell_size) - a))::BIGINT AS taken
FROM placed
"""
