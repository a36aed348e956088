"""Merkle manifest of a table, with proofs by coordinate lookup.

Every node has a coordinate: its tree (one per source, and one above the sources), its level and its index there. From a
leaf's index and the sizes of its tree and of the tree above follow the coordinates of all the siblings that its proof
needs. Leaves explode them, join the written table of nodes, put what comes back in order, concatenate and fold.

The leaves of one run of `fanout` need the same nodes above the run, so a run asks once for all of them; the nodes above
fanout ** 4 leaves are asked for once by each such block. So a coordinate is asked for by at most fanout ** 3 runs, or
by one fanout ** 4th of the leaves and the number of sources, however the rows are spread over sources.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.ordered import running
from strandline.session import materialize

FANOUT = 16
#: Levels below a block: runs look these up themselves.
BLOCK_LEVELS = 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Paths above blocks (some KB each) are broadcast up to so many of them; more are enough keys to shuffle by.
BROADCAST_BLOCKS = 1000
#: The tree above the sources.
TOP = -1
#: Rows of small tables, whose number is known before they are written, that a task writes: no file for a few rows.
ROWS_A_TASK = 2000
#: Up to so many sources are numbered by one task, more by ranges of them.
SOURCES_AT_ONCE = 10_000


def leaf_digest(values: Sequence[Column]) -> Column:
    """sha256 of the values one after another, each `-` if null, else its bytes in UTF-8, `:` and itself."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def _powers(fanout: int) -> list[int]:
    out = [1]
    while out[-1] * fanout < 1 << 62:
        out.append(out[-1] * fanout)
    return out


def tree_depth(size: Column, fanout: int) -> Column:
    """Levels above the leaves: one more while several nodes remain."""
    return reduce(lambda a, b: a + b, [(size > p).cast("int") for p in _powers(fanout)])


def _over(a: Column, b: int) -> Column:
    """Whole quotient of a number that isn't negative, without a detour over doubles."""
    return F.call_function("div", a, F.lit(b))


def _written(df: DataFrame, name: str, rows: int) -> DataFrame:
    """A table of at most so many rows, written by as many tasks as they need."""
    return materialize(df.coalesce(max(1, -(-rows // ROWS_A_TASK))), name)


def _numbered(sizes: DataFrame, sources: int) -> DataFrame:
    """tree, source, size: sources in order, numbered from 0."""
    if sources <= SOURCES_AT_ONCE:
        place = F.row_number().over(Window.orderBy(F.asc_nulls_first("source")))
        return sizes.withColumn("place", place).select((F.col("place") - 1).cast("long").alias("tree"), "source", "size")
    return running(sizes, [F.asc_nulls_first("source")], {}).select((F.col("place") - 1).cast("long").alias("tree"), "source", "size")


@dataclass(frozen=True)
class Manifest:
    """leaves: tree, size (leaves of the tree), idx, leaf and the columns carried along. nodes: tree, size,
    level, idx, digest, written.
    trees: tree, the column that names it, size, subroot. root: the digest of all, null of an empty table."""

    leaves: DataFrame
    nodes: DataFrame
    trees: DataFrame
    root: str | None
    rows: int
    sources: int
    deepest: int
    blocks: int
    fanout: int
    block_levels: int


def build(table: DataFrame, fields: Sequence[str] = FIELDS, tree_by: str = "source", order_by: str = "doc_id", carry: dict[str, Column] | None = None, fanout: int = FANOUT, block_levels: int = BLOCK_LEVELS) -> Manifest:
    """The manifest of table: a leaf per row, a tree per value of tree_by (nulls are one, the first), its leaves ascending by
    order_by (nulls first), equal ones by digest; repeated rows are leaves of their own. Texts are read whole, once, in the
    JVM; carry names columns, such as a digest claimed for the row, that leaves shall have besides order_by and tree_by.
    Other columns are not read and may have any name. An empty table has no leaves, nodes or root."""
    taken = {order_by, tree_by, *(carry or {})} & {"tree", "size", "idx", "leaf", "subroot", "path"}
    if taken:
        raise ValueError(f"the manifest has columns of its own called {sorted(taken)}")
    values = {"leaf": leaf_digest([F.col(f) for f in fields])} | dict(carry or {})
    named = table.select(F.col(tree_by).alias("source"), F.col(order_by).alias("key"), *[v.alias(f"c_{k}") for k, v in values.items()])
    digests = materialize(named.withColumn("row", F.monotonically_increasing_id()), "digests")
    # `row` only divides the copies of a row that is repeated very often over ranges
    ranged = digests.repartitionByRange(F.asc_nulls_first("source"), F.asc_nulls_first("key"), F.asc("c_leaf"), F.asc("row"))
    ranged = materialize(ranged.withColumn("range", F.spark_partition_id()), "ranges")
    parts = ranged.groupBy("source", "range").agg(F.count("*").alias("n"))
    sizes = ranged.groupBy("source").agg(F.count("*").alias("size"))
    sources = sizes.count()
    trees = _written(_numbered(sizes, sources), "trees", sources)
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(F.col("source").alias("s"), F.col("range").alias("r"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    starts = starts.join(trees, F.col("s").eqNullSafe(F.col("source"))).select("s", "r", "first", "tree", "size")
    within = Window.partitionBy("source", "range").orderBy(F.asc_nulls_first("key"), "c_leaf", "row")
    placed = ranged.withColumn("nth", F.row_number().over(within)).join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r")))
    leaves = materialize(placed.select("tree", "size", (F.col("first") + F.col("nth") - 1).alias("idx"), F.col("key").alias(order_by), F.col("source").alias(tree_by), *[F.col(f"c_{k}").alias(k) for k in values]), "leaves")
    block = fanout**block_levels
    counted = trees.agg(F.max("size"), F.sum("size"), F.sum(_over(F.col("size") - 1, block) + 1)).first()
    largest, rows, blocks = (int(x or 0) for x in counted)
    levels = [leaves.select("tree", "size", F.lit(0).alias("level"), "idx", F.col("leaf").alias("digest"))]
    levels += _levels(levels[0], largest, fanout, rows, sources)
    tops = reduce(DataFrame.unionByName, levels).where(F.col("level") == tree_depth(F.col("size"), fanout))
    trees = _written(trees.join(tops.select("tree", F.col("digest").alias("subroot")), "tree"), "subroots", sources)
    first = trees.select(F.lit(TOP).cast("long").alias("tree"), F.lit(sources).cast("long").alias("size"), F.lit(0).alias("level"), F.col("tree").alias("idx"), F.col("subroot").alias("digest"))
    above = [first, *_levels(first, sources, fanout, sources, 1)]
    last = above[-1].select("digest").first()
    nodes = reduce(DataFrame.unionByName, levels + above)
    deepest = sum(largest > p for p in _powers(fanout))
    return Manifest(leaves, nodes, trees.withColumnRenamed("source", tree_by), last and last[0], rows, sources, deepest, blocks, fanout, block_levels)


def _levels(leaves: DataFrame, largest: int, fanout: int, rows: int, trees: int) -> list[DataFrame]:
    """The levels above, each written: runs of `fanout` nodes of a tree that has several become their digest. A level of
    so many rows in so many trees has at most rows / fanout + trees above it."""
    out, nodes, width = [], leaves, 1
    while largest > width:
        more = nodes.where(F.col("size") > width)  # several nodes at this level
        runs = more.groupBy("tree", "size", _over(F.col("idx"), fanout).alias("run")).agg(F.sort_array(F.collect_list(F.struct("idx", "digest"))).alias("members"))
        digest = F.sha2(F.array_join(F.col("members.digest"), ""), 256)
        rows = rows // fanout + trees
        nodes = _written(runs.select("tree", "size", F.lit(len(out) + 1).alias("level"), F.col("run").alias("idx"), digest.alias("digest")), "nodes", rows)
        out.append(nodes)
        width *= fanout
    return out


def _siblings(tree: Column, size: Column, own: Column, level: int, step: int, fanout: int, itself: bool) -> Column:
    """Coordinates of the run of node `own` of a level: (step, tree, level, idx), without own unless asked for; none where
    the tree has but one node there."""
    width = fanout**level
    nodes = _over(size + (width - 1), width)
    first = own - F.pmod(own, F.lit(fanout))
    members = F.sequence(first, F.least(first + fanout, nodes) - 1)
    wanted = members if itself else F.filter(members, lambda i: i != own)
    rows = F.transform(wanted, lambda i: F.struct(F.lit(step).alias("step"), tree.alias("tree"), F.lit(level).alias("level"), i.alias("idx")))
    return F.when(size > width, rows).otherwise(F.expr("array()").cast("array<struct<step:int,tree:bigint,level:int,idx:bigint>>"))


def _looked_up(rows: DataFrame, id_: list[str], wanted: list[Column], nodes: DataFrame) -> DataFrame:
    """rows' ids with found: the nodes at the wanted coordinates, ordered by step and index."""
    asked = rows.select(*id_, F.explode(F.concat(*wanted)).alias("at")).select(*[F.col(c).alias(f"_{c}") for c in id_], "at.*")
    met = asked.join(nodes.select("tree", "level", "idx", "digest"), ["tree", "level", "idx"])
    return met.groupBy(*[f"_{c}" for c in id_]).agg(F.sort_array(F.collect_list(F.struct("step", "idx", "digest"))).alias("found"))


def _step(found: Column, step: int, own: Column) -> Column:
    """What stands left and right of own among the found nodes of a step."""

    def side(keep) -> Column:
        return F.array_join(F.transform(F.filter(found, lambda x: (x["step"] == step) & keep(x["idx"])), lambda x: x["digest"]), "")

    return F.struct(side(lambda i: i < own).alias("left"), side(lambda i: i > own).alias("right"))


_PATH = "array<struct<left:string,right:string>>"


def _path(steps: list[tuple[Column, Column]]) -> Column:
    """The steps whose condition holds."""
    none = F.expr("array()").cast(_PATH)
    return F.concat(none, *[F.when(there, F.array(step)).otherwise(none) for there, step in steps])


def proofs(m: Manifest, asked: DataFrame | None = None) -> DataFrame:
    """asked (rows of m.leaves, all by default) with subroot and path: a struct of what stands left and right of the
    node in its run, for each level from the leaf through the subroot to the root."""
    asked = m.leaves if asked is None else asked
    f, high = m.fanout, m.block_levels
    size, none = F.col("size"), F.expr("array()").cast("array<struct<step:int,tree:bigint,level:int,idx:bigint>>")
    block_width = f**high
    own_columns = [c for c in asked.columns if c not in ("tree", "size")]

    # above blocks: from a tree's level `high` on, then the tree above the sources
    blocks = m.trees.select("tree", "size", "subroot", F.explode(F.sequence(F.lit(0).cast("long"), _over(size - 1, block_width))).alias("block"))
    above = [(k, F.col("tree"), size, _over(F.col("block"), f ** (k - high)), k) for k in range(high, m.deepest)]
    top_size = F.lit(m.sources).cast("long")
    top_depth = sum(m.sources > p for p in _powers(f))
    above += [(m.deepest + k, F.lit(TOP).cast("long"), top_size, _over(F.col("tree"), f**k), k) for k in range(top_depth)]
    wanted = [_siblings(tree, n, own, level, step, f, False) for step, tree, n, own, level in above]
    found = _looked_up(blocks, ["tree", "block"], [none, *wanted], m.nodes)
    tails = blocks.join(found.select(F.col("_tree").alias("tree"), F.col("_block").alias("block"), "found"), ["tree", "block"], "left")
    tails = tails.withColumn("found", F.coalesce("found", F.expr("array()").cast("array<struct<step:int,idx:bigint,digest:string>>")))
    tails = tails.select("tree", "block", "subroot", _path([(n > f**level, _step(F.col("found"), step, own)) for step, _, n, own, level in above]).alias("tail"))
    tails = _written(tails, "paths", m.blocks)

    # within blocks: a run's own leaves, then the siblings of the nodes above it
    runs = asked.groupBy("tree", "size", _over(F.col("idx"), f).alias("run")).agg(F.collect_list(F.struct(*own_columns)).alias("members"))
    runs = _written(runs, "runs", m.rows // f + m.sources)
    low = [(k, _over(F.col("run"), f ** (k - 1))) for k in range(1, min(high, m.deepest))]
    wanted = [_siblings(F.col("tree"), size, F.col("run") * f, 0, 0, f, True), *[_siblings(F.col("tree"), size, own, k, k, f, False) for k, own in low]]
    met = _looked_up(runs, ["tree", "run"], wanted, m.nodes).select(F.col("_tree").alias("tree"), F.col("_run").alias("run"), "found")
    met = runs.join(met, ["tree", "run"], "left").withColumn("found", F.coalesce("found", F.expr("array()").cast("array<struct<step:int,idx:bigint,digest:string>>")))
    upper = _path([(size > f**k, _step(F.col("found"), k, own)) for k, own in low])
    met = met.select("tree", "size", "members", F.filter("found", lambda x: x["step"] == 0).alias("row"), upper.alias("upper"), _over(F.col("run"), f ** (high - 1)).alias("block"))
    whole = met.join(F.broadcast(tails) if m.blocks <= BROADCAST_BLOCKS else tails, ["tree", "block"])
    each = whole.select("tree", "size", F.explode("members").alias("one"), "row", F.concat("upper", "tail").alias("rest"), "subroot")
    path = F.concat(_path([(size > 1, _step(F.col("row"), 0, F.col("one.idx")))]), "rest")
    return each.select("tree", "size", "one.*", "subroot", path.alias("path"))


def folded(digest: Column, path: Column) -> Column:
    """The root that follows from a leaf's digest and a path."""
    return F.aggregate(path, digest, lambda acc, s: F.sha2(F.concat(s["left"], acc, s["right"]), 256))


def proof_digest(path: Column) -> Column:
    """sha256 of all siblings of a path in order."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


ORACLE = r"""
WITH RECURSIVE
crc AS (SELECT doc_id, list_reduce(list_prepend(4294967295::UBIGINT, flatten(list_transform(range(length(doc_id::VARCHAR)), lambda k: [ascii(substr(doc_id::VARCHAR, (k + 1)::INT, 1))::UBIGINT, 0, 0, 0, 0, 0, 0, 0]))),
    lambda c, b: CASE WHEN xor(c, b) & 1 = 1 THEN xor(xor(c, b) >> 1, 3988292384::UBIGINT) ELSE xor(c, b) >> 1 END) AS c
    FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)),
marked AS (SELECT d.*, coalesce(xor(c, 4294967295::UBIGINT) % 5 = 0, false) AS hit FROM documents d LEFT JOIN crc ON crc.doc_id = d.doc_id),
fields AS (SELECT doc_id, source, hit, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
    text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM marked),
leaf AS (SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || CASE WHEN hit THEN coalesce(strlen(low) || ':' || low, '-') ELSE coalesce(strlen(text) || ':' || text, '-') END) AS claimed FROM fields),
trees AS (SELECT source, count(*) AS size, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM leaf GROUP BY source),
placed AS (SELECT l.*, tree, size, row_number() OVER (PARTITION BY l.source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM leaf l JOIN trees t ON l.source IS NOT DISTINCT FROM t.source),
nodes AS (SELECT tree, size AS width, 0 AS level, idx, leaf AS digest FROM placed
    UNION ALL SELECT tree, (width + 15) // 16, level + 1, idx // 16, sha256(string_agg(digest, '' ORDER BY idx)) FROM nodes WHERE width > 1 GROUP BY tree, width, level, idx // 16),
subroots AS (SELECT tree, digest AS subroot FROM nodes WHERE width = 1),
tops AS (SELECT (SELECT count(*) FROM subroots) AS width, 0 AS level, tree AS idx, subroot AS digest FROM subroots
    UNION ALL SELECT (width + 15) // 16, level + 1, idx // 16, sha256(string_agg(digest, '' ORDER BY idx)) FROM tops WHERE width > 1 GROUP BY width, level, idx // 16),
runs AS (SELECT tree, level, idx // 16 AS run, list(digest ORDER BY idx) AS ds FROM nodes WHERE width > 1 GROUP BY ALL),
top_runs AS (SELECT level, idx // 16 AS run, list(digest ORDER BY idx) AS ds FROM tops WHERE width > 1 GROUP BY ALL),
climb AS (SELECT tree, idx AS i, idx, 0 AS level, claimed AS acc, '' AS proof FROM placed
    UNION ALL SELECT c.tree, i, c.idx // 16, c.level + 1, sha256(array_to_string(ds[1:c.idx % 16], '') || acc || array_to_string(ds[c.idx % 16 + 2:], '')),
        proof || array_to_string(ds[1:c.idx % 16], '') || array_to_string(ds[c.idx % 16 + 2:], '')
    FROM climb c JOIN runs r ON r.tree = c.tree AND r.level = c.level AND r.run = c.idx // 16),
arrived AS (SELECT * FROM climb QUALIFY row_number() OVER (PARTITION BY tree, i ORDER BY level DESC) = 1),
rise AS (SELECT tree, i, tree AS idx, 0 AS level, acc, proof FROM arrived
    UNION ALL SELECT tree, i, c.idx // 16, c.level + 1, sha256(array_to_string(ds[1:c.idx % 16], '') || acc || array_to_string(ds[c.idx % 16 + 2:], '')),
        proof || array_to_string(ds[1:c.idx % 16], '') || array_to_string(ds[c.idx % 16 + 2:], '')
    FROM rise c JOIN top_runs r ON r.level = c.level AND r.run = c.idx // 16),
ended AS (SELECT * FROM rise QUALIFY row_number() OVER (PARTITION BY tree, i ORDER BY level DESC) = 1)
SELECT p.doc_id, p.leaf, s.subroot, t.digest AS root, sha256(e.proof) AS proof_sha256, e.acc AS folded_root, e.acc = t.digest AS verified
FROM placed p JOIN ended e ON e.tree = p.tree AND e.i = p.idx JOIN subroots s ON s.tree = p.tree, (SELECT digest FROM tops WHERE width = 1) t
"""
