"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints of 64 bits come from word shingles. Equal fingerprints are one node. Two fingerprints within `radius` bits
agree in at least 3 of radius + 3 bit blocks, so each fingerprint joins one bucket per choice of 3 blocks; buckets of
over `cell` members are cut into parts, and every two parts meet in a cell of their own, so no task holds a whole hot
bucket and no link is lost. Cells are compared with their bits stored as vertical planes: all lanes at one distance s
in a batch are compared at once, plane after plane, with carry-save counters that stop once every lane of a block is
over the radius. A cell gives a spanning forest of its links, at most one edge a member, not its pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.graph import connected_components, written
from strandline.session import map_arrow, materialize, release_memory, ship_package

BITS = 64
SEED = 42
CELL = 512
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_hashes(words: list[bytes], shingle: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of each run of `shingle` words joined by a space, big-endian bytes, 8 a row; of all words if they are fewer."""
    import xxhash

    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    k = min(shingle, len(words))
    spans = zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())
    digest = xxhash.xxh64_digest
    return np.frombuffer(b"".join([digest(line[a:b], seed) for a, b in spans]), np.uint8).reshape(-1, 8)


def majority(hashes: np.ndarray) -> bytes:
    """8 bytes whose bits are set in over half the rows."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        counts += np.unpackbits(hashes[at : at + (1 << 15)], axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(hashes)).tobytes()


def fingerprint(text: bytes | None, shingle: int = 3, seed: int = SEED) -> int:
    """Signed 64-bit SimHash of a UTF-8 text: a bit is 1 if set in over half the XXH64 of the text's shingles, repeats included. A-Z are
    lower-cased; fewer words than a shingle are one shingle; no words give 0."""
    words = (text or b"").lower().split()  # of bytes: A-Z and ASCII white space alone
    return int.from_bytes(majority(shingle_hashes(words, shingle, seed)), "big", signed=True) if words else 0


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = SEED) -> DataFrame:
    """doc_id, fp (long) of each row of docs (doc_id, text), over whole texts; null texts have no words."""
    ship_package(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from strandline.llm.simhash import fingerprint

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(t.as_py(), shingle, seed) for t in b.column(1)], pa.int64())], names=["doc_id", "fp"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")), work, "doc_id long, fp long")


def tables(n: int, choose: int, bits: int = BITS) -> list[int]:
    """The bit masks of all choices of some of n nearly equal blocks, as signed longs. With n = radius + choose, values
    within radius bits agree under one of them at least."""
    cuts = [round(i * bits / n) for i in range(n + 1)]
    blocks = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(cuts, cuts[1:])]
    masks = [reduce(int.__or__, c) for c in combinations(blocks, choose)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


# ---- bit planes ----


def planes_of(values: np.ndarray, bits: list[int]) -> np.ndarray:
    """Bit planes: row i holds bit bits[i] of all values, 64 lanes a word, with a spare word at the end."""
    words = -(-len(values) // 64) + 1
    lanes = np.zeros((len(bits), words * 64), np.uint8)
    for row, bit in enumerate(bits):
        lanes[row, : len(values)] = (values >> np.uint64(bit)) & np.uint64(1)
    return np.packbits(lanes, axis=1, bitorder="little").view(np.uint64)


def shifted(plane: np.ndarray, s: int) -> np.ndarray:
    """plane with lane i + s in the place of lane i."""
    w, b = divmod(s, 64)
    out = np.zeros_like(plane)
    if w < len(plane):
        out[: len(plane) - w] = plane[w:] >> np.uint64(b) if b else plane[w:]
        if b and w + 1 < len(plane):
            out[: len(plane) - w - 1] |= plane[w + 1 :] << np.uint64(64 - b)
    return out


def within(planes: np.ndarray, s: int, radius: int, block: int = 1024) -> np.ndarray:
    """Bit set of the lanes i whose value is within radius bits of lane i + s's."""
    out = np.zeros(planes.shape[1], np.uint64)
    other = [shifted(p, s) for p in planes]
    depth = max(1, radius.bit_length())
    for at in range(0, planes.shape[1], block):
        part = slice(at, at + block)
        counter = [np.zeros_like(out[part]) for _ in range(depth)]
        over = np.zeros_like(out[part])
        for i in range(len(planes)):
            carry = planes[i, part] ^ other[i][part]
            for level in range(depth):  # carry-save: each level adds the carry of the one below
                counter[level], carry = counter[level] ^ carry, counter[level] & carry
            over |= carry
            if i % 8 == 7:
                over |= _above(counter, radius)
                if (over == _ALL).all():
                    break
        out[part] = ~(over | _above(counter, radius))
    return out


def _above(counter: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose counter is over radius."""
    above, equal = np.zeros_like(counter[0]), np.full_like(counter[0], _ALL)
    for level in reversed(range(len(counter))):
        if radius >> level & 1:
            equal = equal & counter[level]
        else:
            above |= equal & counter[level]
            equal = equal & ~counter[level]
    return above


def _roots(root: np.ndarray) -> np.ndarray:
    while (up := root[root]).tobytes() != root.tobytes():
        root = up
    return root


def spanning_edges(values: np.ndarray, group: np.ndarray, radius: int, bits: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Edges (root, member) with the same components as all links within radius inside each group; equal groups adjoin.

    bits: those in which members of a group can differ."""
    size = np.unique(group, return_counts=True)[1]
    first = np.r_[0, np.cumsum(size)[:-1]]
    order = np.argsort(-size, kind="stable")  # large groups first, so that shift s needs a prefix of the lanes
    lane = np.concatenate([np.arange(first[g], first[g] + size[g]) for g in order]) if len(size) else np.zeros(0, int)
    size, values = size[order], values[lane]
    group = np.repeat(np.arange(len(size)), size)
    total = np.cumsum(size)
    planes = planes_of(values, bits)
    root = np.arange(len(values))
    for s in range(1, int(size[0]) if len(size) else 0):
        n = int(total[np.searchsorted(-size, -s, side="left") - 1])  # lanes of groups with over s members
        words = -(-n // 64) + 1
        hit = np.flatnonzero(np.unpackbits(within(planes[:, : words + s // 64 + 1], s, radius)[:words].view(np.uint8), bitorder="little")[: max(0, n - s)])
        hit = hit[group[hit] == group[hit + s]]
        pairs = np.stack([root[hit], root[hit + s]], axis=1)
        pairs = np.unique(np.sort(pairs[pairs[:, 0] != pairs[:, 1]], axis=1), axis=0)
        for a, b in pairs.tolist():
            while root[a] != a:
                a = root[a]
            while root[b] != b:
                b = root[b]
            root[max(a, b)] = min(a, b)
        if len(pairs):
            root = _roots(root)
    member = np.flatnonzero(root != np.arange(len(root)))
    return values[root[member]], values[member]


def links(nodes: DataFrame, radius: int = 2, cell: int = CELL, batch_rows: int = 1 << 15) -> DataFrame:
    """nodes: distinct column fp (long). Edges (a, b) whose components are those of all links within radius bits."""
    ship_package(nodes.sparkSession)
    masks = tables(radius + 3, 3)
    keyed = nodes.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("key")) for i, m in enumerate(masks)])).alias("x")).select("fp", "x.t", "x.key")
    many = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    dealt = keyed.join(many, ["t", "key"]).withColumn("parts", F.ceil(F.col("n") / cell))
    part = F.pmod(F.xxhash64("fp"), F.col("parts"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other")
    cells = dealt.withColumn("part", part).select("fp", "t", "key", "part", other).select("fp", "t", "key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))
    cells = cells.repartition("t", "key", "i", "j").sortWithinPartitions("t", "key", "i", "j")
    free = [[b for b in range(BITS) if not m >> b & 1] for m in masks]

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from strandline.llm.simhash import spanning_edges

        def done(df: pd.DataFrame) -> pd.DataFrame:
            ids = df.groupby(["t", "key", "i", "j"], sort=False).ngroup().to_numpy()
            t, fp = df["t"].to_numpy(), df["fp"].to_numpy().astype(np.int64).view(np.uint64)
            parts = [spanning_edges(fp[t == x], ids[t == x], radius, free[x]) for x in np.unique(t)]
            a, b = (np.concatenate([p[i] for p in parts]).view(np.int64) for i in (0, 1))
            return pd.DataFrame({"a": a, "b": b})

        held: list[pd.DataFrame] = []
        rows = 0
        for frame in frames:
            held.append(frame)
            rows += len(frame)
            if rows < batch_rows:
                continue
            df = pd.concat(held, ignore_index=True)
            last = df[["t", "key", "i", "j"]].iloc[-1]
            open_ = (df[["t", "key", "i", "j"]] == last).all(axis=1).to_numpy()
            if not open_.all():
                yield done(df[~open_])
            held, rows = [df[open_]], int(open_.sum())
        if rows:
            yield done(pd.concat(held, ignore_index=True))

    return cells.mapInPandas(compare, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2, seed: int = SEED) -> DataFrame:
    """One row per row of docs (doc_id, text; others are not read): doc_id, fp (long), component_id, the smallest doc_id
    reachable over links of at most radius bits, itself included.

    Texts without words (null, empty) have fingerprint 0, linked like any other. Repeated rows stay; a component whose
    doc_ids are all null has a null id, and null ids count for nothing else. An empty table gives an empty one."""
    marked = materialize(fingerprints(docs, shingle, seed), "fingerprints")
    nodes = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    stars = materialize(connected_components(links(nodes.select("fp"), radius), "a", "b").withColumnRenamed("node", "fp"), "stars")
    members = stars.join(nodes, "fp")
    least = members.groupBy("root").agg(F.min("least").alias("component"))
    linked = materialize(members.join(materialize(least, "least"), "root").select("fp", "component"), "linked")
    of_fp = materialize(nodes.join(linked, "fp", "left").select("fp", F.coalesce("component", "least").alias("component_id")), "components")
    return marked.join(of_fp, "fp").select("doc_id", "fp", "component_id")


# ---- near-duplicates by similarity ----

SHINGLE = 5
SIMILARITY = 0.8
#: Texts of similarity s share one of BANDS runs of ROWS minima with 1 - (1 - s ** ROWS) ** BANDS: 0.995 at 0.8.
BANDS, ROWS = 10, 4
#: Most differing bits of the first 64 and of all 128: about 2.5 standard deviations over what similarity 0.8 gives.
NEAR, NEARER = 17, 30
WIDE_CELL = 2048
#: Texts of a part where pairs across rejected edges are measured.
OPEN_CELL = 256


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


_FACTORS = _mixed(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)


def bands_of(x: np.ndarray) -> np.ndarray:
    """BANDS numbers of a set of hashes, each of the least of ROWS orders of the set."""
    least = np.full(BANDS * ROWS, _ALL)
    for at in range(0, len(x), 2048):
        least = np.minimum(least, (x[None, at : at + 2048] * _FACTORS[:, None]).min(axis=1))
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        out = _mixed(out * np.uint64(3) + column)
    return out.view(np.int64)


def wide_fingerprint(text: bytes | None, shingle: int = SHINGLE) -> tuple[int, int, int, list[int]]:
    """(content id, two independent SimHashes of the set of shingles, as signed longs, its bands) of a text's lower-cased
    words; no bands without words."""
    words = (text or b"").lower().split()
    content = int.from_bytes(hashlib.blake2b(b" ".join(words), digest_size=8).digest(), "big", signed=True)
    if not words:
        return content, 0, 0, []
    x = np.unique(shingle_hashes(words, shingle).view(">u8").astype(np.uint64))  # similarity is of sets
    hashes, second = (v.astype(">u8").view(np.uint8).reshape(-1, 8) for v in (x, _mixed(x)))
    return content, *(int.from_bytes(majority(h), "big", signed=True) for h in (hashes, second)), bands_of(x).tolist()


def closest_edges(values: np.ndarray, more: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Minimum spanning forest, by differing bits of values and more, of the pairs inside each group (equal groups
    adjoin) that are within NEAR bits in values and NEARER in both: places of the edges' ends."""
    size = np.unique(group, return_counts=True)[1]
    first = np.r_[0, np.cumsum(size)[:-1]]
    order = np.argsort(-size, kind="stable")
    lane = np.concatenate([np.arange(first[g], first[g] + size[g]) for g in order])
    size = size[order]
    group, total = np.repeat(np.arange(len(size)), size), np.cumsum(size)
    a, b = values[lane], more[lane]
    planes = planes_of(a, list(range(BITS)))
    found: list[np.ndarray] = []
    for s in range(1, int(size[0])):
        n = int(total[np.searchsorted(-size, -s, side="left") - 1])
        words = -(-n // 64) + 1
        hit = np.flatnonzero(np.unpackbits(within(planes[:, : words + s // 64 + 1], s, NEAR)[:words].view(np.uint8), bitorder="little")[: max(0, n - s)])
        hit = hit[group[hit] == group[hit + s]]
        if len(hit):
            d = np.bitwise_count(a[hit] ^ a[hit + s]).astype(np.int64) + np.bitwise_count(b[hit] ^ b[hit + s])
            near = d <= NEARER
            found.append(np.stack([d[near], hit[near], hit[near] + s]).astype(np.int32))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    d, i, j = np.concatenate(found, axis=1)
    root, left, right = np.arange(len(lane)), [], []
    for distance in np.unique(d):
        level = d == distance
        x, y = i[level], j[level]
        open_ = root[x] != root[y]
        x, y = x[open_], y[open_]
        _, at = np.unique(np.sort(np.stack([root[x], root[y]], axis=1), axis=1), axis=0, return_index=True)
        for p, q in zip(x[at].tolist(), y[at].tolist()):
            u, v = p, q
            while root[u] != u:
                u = root[u]
            while root[v] != v:
                v = root[v]
            if u != v:
                root[max(u, v)] = min(u, v)
                left.append(p)
                right.append(q)
        root = _roots(root)
    return lane[np.array(left, np.int64)], lane[np.array(right, np.int64)]


def similar_pairs(nodes: DataFrame, cell: int = WIDE_CELL, batch_rows: int = 1 << 15) -> DataFrame:
    """Candidate pairs (a, b) of nodes (node, w0, w1, bands): of each bucket's pairs that SimHash finds near, those of a
    minimum spanning forest, so that a group of near copies gives as many pairs as members, the closest ones. A bucket
    holds the texts that share a band, so buckets grow with groups of like texts, not with the table."""
    spark = nodes.sparkSession
    ship_package(spark)
    keyed = nodes.select("node", "w0", "w1", F.posexplode("bands").alias("t", "key"))
    many = written(keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1"), "buckets", BANDS * nodes.count() // 2, BUCKETS_A_TASK)
    keyed = keyed.join(checked_broadcast(many.select("t", "key")), ["t", "key"], "left_semi")
    hot = written(many.where(F.col("n") > cell), "hot-buckets", many.count())
    dealt = keyed.join(checked_broadcast(hot), ["t", "key"], "left").withColumn("parts", F.coalesce(F.ceil(F.col("n") / cell), F.lit(1)))
    part = F.pmod(F.xxhash64("node"), F.col("parts"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other")
    cells = dealt.withColumn("part", part).select("node", "w0", "w1", "t", "key", "part", other)
    home = F.xxhash64("t", "key", F.least("part", "other"), F.greatest("part", "other")).alias("home")  # two cells that collide are compared as one
    cells = cells.select(home, "node", "w0", "w1").repartition("home").sortWithinPartitions("home")

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from strandline.llm.simhash import closest_edges

        def done(df: pd.DataFrame) -> pd.DataFrame:
            home = df["home"].to_numpy()
            group = np.cumsum(np.r_[0, home[1:] != home[:-1]])
            i, j = closest_edges(df["w0"].to_numpy(np.int64).view(np.uint64), df["w1"].to_numpy(np.int64).view(np.uint64), group)
            node = df["node"].to_numpy()
            release_memory()
            return pd.DataFrame({"a": node[i], "b": node[j]})

        held: list[pd.DataFrame] = []
        rows = 0
        for frame in frames:
            held.append(frame)
            rows += len(frame)
            if rows < batch_rows:
                continue
            df = pd.concat(held, ignore_index=True)
            open_ = (df["home"] == df["home"].iloc[-1]).to_numpy()
            if not open_.all():
                yield done(df[~open_])
            held, rows = [df[open_]], int(open_.sum())
        if rows:
            yield done(pd.concat(held, ignore_index=True))

    return cells.mapInPandas(compare, "a string, b string").where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def shingle_set(text: str, shingle: int = SHINGLE) -> frozenset[bytes]:
    words = text.encode().lower().split()
    return frozenset(h.tobytes() for h in shingle_hashes(words, shingle)) if words else frozenset()


def shingle_array(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """The members of shingle_set as distinct integers."""
    words = (text or b"").lower().split()
    return np.unique(shingle_hashes(words, shingle).view(np.uint64)) if words else np.zeros(0, np.uint64)


def jaccard(a: frozenset, b: frozenset) -> float:
    return len(a & b) / len(a | b) if a or b else 1.0


def similar_edges(sets: list[np.ndarray], root: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Edges (places in sets) that join the groups of root, if any pair of sets of two groups is of `similarity` or more.
    All such pairs are measured exactly but those that edges before have joined. sets: distinct values."""
    size = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    _, ids, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[ids] > 1
    ids, owner = ids[shared], owner[shared]
    first = np.searchsorted(owner, np.arange(len(sets) + 1))
    _, root = np.unique(root, return_inverse=True)
    mark, out = np.zeros(len(count), bool), []
    for x in range(len(sets) - 1):
        if (root[x:] == root[x]).all():
            continue
        mine = ids[first[x] : first[x + 1]]
        mark[mine] = True
        rest = slice(first[x + 1], None)
        both = np.bincount(owner[rest][mark[ids[rest]]], minlength=len(sets))[x + 1 :]
        mark[mine] = False
        union = size[x] + size[x + 1 :] - both
        # the same division as jaccard(); two empty sets are equal
        like = np.divide(both, union, out=np.ones(len(union)), where=union > 0) >= similarity
        for y in (np.flatnonzero(like) + x + 1).tolist():
            if root[x] != root[y]:
                root[root == root[y]] = root[x]
                out.append((x, y))
    return out


def open_links(rejected: DataFrame, stars: DataFrame, texts: DataFrame, similarity: float, shingle: int, n: int, cell: int = OPEN_CELL) -> DataFrame | None:
    """Links (a, b) that a spanning forest of near pairs has missed; None if it can't have missed any. texts has n rows at
    most, and so have the tables of groups and members.

    A rejected edge of the forest stood for all near pairs across it, so the groups of verified links (stars: node, root)
    at its ends stay open: those that rejected edges connect are a field, and inside a field every pair of texts
    of two groups is measured. Groups over `cell` members are cut into parts and smaller ones share parts; every two parts
    meet in a cell of their own, other than those of one group."""
    roots = stars.select("node", "root")
    ends = rejected.select("a", "b").join(roots.select(F.col("node").alias("a"), F.col("root").alias("x")), "a", "left").join(roots.select(F.col("node").alias("b"), F.col("root").alias("y")), "b", "left")
    across = written(ends.select(F.coalesce("x", "a").alias("x"), F.coalesce("y", "b").alias("y")).where("x != y").distinct(), "open-pairs", n)
    if across.isEmpty():
        return None
    fields = written(connected_components(across, "x", "y", n).select(F.col("node").alias("root"), F.col("root").alias("field")), "fields", n)
    members = texts.select("node").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root")).join(fields, "root")
    members = written(members, "open-members", n)
    groups = written(members.groupBy("field", "root").agg(F.count("*").alias("n")), "open-groups", n)
    small = groups.where(F.col("n") <= cell).groupBy("field").agg(F.ceil(F.sum("n") / cell).alias("shared"))
    own = groups.where(F.col("n") > cell).select("root", F.ceil(F.col("n") / cell).alias("own"))
    placed = members.join(own, "root", "left").join(small, "field", "left")
    slot = F.pmod(F.xxhash64("node"), F.coalesce("own", "shared"))
    placed = written(placed.select("node", "root", "field", F.when(F.col("own").isNotNull(), F.col("root")).alias("whose"), slot.alias("slot")), "open-places", n)
    parts = written(placed.select("field", "whose", "slot").distinct().withColumn("part", F.concat_ws(":", F.coalesce("whose", F.lit("")), "slot")), "open-parts", n)
    p, q = parts.alias("p"), parts.alias("q")
    pairs = p.join(q, "field").where("p.part <= q.part AND (p.whose IS NULL OR q.whose IS NULL OR p.whose != q.whose)")
    pairs = pairs.select("field", F.xxhash64("field", "p.part", "q.part").alias("home"), F.array_distinct(F.array("p.part", "q.part")).alias("part"))
    cells = materialize(pairs.select("field", "home", F.explode("part").alias("part")), "open-cells")
    seated = placed.select("node", "root", "field", F.concat_ws(":", F.coalesce("whose", F.lit("")), "slot").alias("part")).join(cells, ["field", "part"])
    seated = materialize(seated.select("home", "node", "root"), "open-seats")
    rows = seated.join(texts, "node").select("home", "node", "root", F.col("text").cast("binary").alias("text")).repartition("home").sortWithinPartitions("home")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from strandline.llm.simhash import shingle_array, similar_edges

        def done(nodes: list[str], root: list[str], sets: list[np.ndarray]) -> pa.RecordBatch:
            edges = similar_edges(sets, np.array(root), similarity)
            ends = [pa.array([nodes[e[i]] for e in edges], pa.string()) for i in (0, 1)]
            return pa.RecordBatch.from_arrays(ends, names=["a", "b"])

        at, held = None, ([], [], [])
        for batch in batches:
            for home, node, root, text in zip(*(c for c in batch.columns)):
                if home.as_py() != at and held[0]:
                    yield done(*held)
                    held = ([], [], [])
                at = home.as_py()
                for part, value in zip(held, (node.as_py(), root.as_py(), shingle_array(text.as_py(), shingle))):
                    part.append(value)
        if held[0]:
            yield done(*held)

    found = map_arrow(rows, compare, "a string, b string")
    return materialize(found.distinct(), "open-links")


#: Whole texts, nodes and buckets that a task writes at least, where there are so many.
TEXTS_A_TASK, NODES_A_TASK, BUCKETS_A_TASK = 500, 10_000, 100_000
#: Rows of two short columns that a broadcast may have; tables over it are joined by a shuffle.
BROADCAST_ROWS = 200_000


def checked_broadcast(df: DataFrame) -> DataFrame:
    """df, a written table of narrow rows, to be broadcast if it has few."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def row_id(columns: list[tuple[str, str]]) -> Column:
    """A digest of (name, type) columns, each told with its length, so that rows of other values have other digests."""
    told = []
    for name, kind in columns:
        value = F.hex(F.col(f"`{name}`")) if kind == "binary" else F.col(f"`{name}`").cast("string")
        told.append(F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.length(value).cast("string"), F.lit(":"), value)))
    return F.md5(F.concat(*told))


def deduplicate(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """docs (doc_id, text and any more columns) with one row of each group of near-duplicates: that with the smallest
    doc_id (null ids last; then any fixed one). Groups are components of pairs whose sets of `shingle`-word runs,
    lower-cased, have a Jaccard similarity of at least `similarity`, among the pairs that share a band and that SimHash
    finds near, each of which is measured unless measured links join it already; texts with equal words are always one
    group, those without words too. Equal rows are one row; columns of any name are kept as they are. An empty table
    gives an empty one."""
    spark = docs.sparkSession
    ship_package(spark)
    columns = docs.columns
    row = "__row" + "_" * max([0, *(len(c) for c in columns if c.startswith("__row"))])  # no column has this name
    keyed = docs.withColumn(row, row_id(docs.dtypes))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from strandline.llm.simhash import wide_fingerprint

        for b in batches:
            marks = list(zip(*(wide_fingerprint(t.as_py(), shingle) for t in b.column(2)))) or [(), (), (), ()]
            nodes = [f"{c & 0xFFFFFFFFFFFFFFFF:016x}{w & 0xFFFFFFFFFFFFFFFF:016x}" for c, w in zip(marks[0], marks[1])]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(nodes, pa.string()), pa.array(marks[1], pa.int64()), pa.array(marks[2], pa.int64()), pa.array(marks[3], pa.list_(pa.int64()))], names=["row", "doc_id", "node", "w0", "w1", "bands"])

    chosen = keyed.select(F.col(row).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    marked = materialize(map_arrow(chosen, work, "row string, doc_id long, node string, w0 long, w1 long, bands array<long>"), "wide-fingerprints")
    rank = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "row")
    rows = marked.count()
    nodes = written(marked.groupBy("node").agg(F.min(rank).alias("first"), F.min("w0").alias("w0"), F.min("w1").alias("w1"), F.first("bands").alias("bands")), "nodes", rows, NODES_A_TASK)
    pairs = materialize(similar_pairs(nodes.select("node", "w0", "w1", "bands")), "similar-pairs")
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    n = pairs.count()
    wanted = written(nodes.join(ends, "node").select("node", F.col("first.row").alias(row)), "texts-wanted", 2 * n)
    texts = written(keyed.select(row, "text").join(checked_broadcast(wanted), row).groupBy("node").agg(F.first("text").alias("text")), "texts", 2 * n, TEXTS_A_TASK)
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("left")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("right")), "b")

    @F.pandas_udf("double")
    def measured(left: pd.Series, right: pd.Series) -> pd.Series:
        from functools import lru_cache

        from strandline.llm.simhash import jaccard, shingle_set

        sets = lru_cache(16)(lambda t: shingle_set(t, shingle))
        out = pd.Series([jaccard(sets(a or ""), sets(b or "")) for a, b in zip(left, right)], dtype="float64")
        release_memory()
        return out

    tested = written(both.select("a", "b", measured("left", "right").alias("j")), "tested-pairs", n, TEXTS_A_TASK)
    links = tested.where(F.col("j") >= similarity).select("a", "b")
    stars = written(connected_components(links, "a", "b", n), "stars", 2 * n)
    more = open_links(tested.where(F.col("j") < similarity), stars, texts, similarity, shingle, 2 * n)
    if more is not None:
        stars = written(connected_components(links.unionByName(more), "a", "b", n + more.count()), "stars", 2 * n)
    members = nodes.select("node", "first").join(stars, "node", "left").select(F.coalesce("root", "node").alias("root"), "first")
    kept = members.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row").alias("row"), F.lit(True).alias("kept"))
    # rows that go, and those that stand more than once; all others stay where they are
    aside = marked.groupBy("row").agg(F.count("*").alias("n")).join(kept, "row", "left").where("kept IS NULL OR n > 1")
    aside = written(aside.select(F.col("row").alias(row), F.col("kept").isNotNull().alias("kept")), "rows-aside", rows, NODES_A_TASK)
    single = keyed.join(checked_broadcast(aside.select(row)), row, "left_anti")
    repeated = written(aside.where("kept").select(row), "rows-repeated", aside.count())
    if not repeated.isEmpty():
        again = keyed.join(checked_broadcast(repeated), row, "left_semi")
        single = single.unionByName(again.groupBy(row).agg(*[F.first(f"`{c}`").alias(c) for c in columns]).select(*[f"`{c}`" for c in keyed.columns]))
    return single.select(*[f"`{c}`" for c in columns])


def fingerprint_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
