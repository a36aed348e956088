"""Chroma audio fingerprints.

Audio becomes frames of twelve pitch-class energies, smoothed and normalized. Sixteen rectangle filters over a sliding
stretch of frames are evaluated with an integral image; each is quantized to two Gray-coded bits, so a stretch packs
into one 32-bit integer. Recordings with equal fingerprints are one class. Classes are aligned by the offsets of runs
they share: a histogram of offsets picks the offset, the share of differing bits over the overlap judges it.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.session import map_arrow, materialize, ship_package

RATE = 11025
FRAME = 4096  # at RATE; shorter in proportion at lower rates
OVERLAP = 3  # a hop is a third of a frame
LOW_HZ, HIGH_HZ = 28.0, 3520.0
WIDTH = 16  # frames under the widest filter
SMOOTHING = (0.25, 0.75, 1.0, 0.75, 0.25)
SILENCE = 1e-6
#: Runs of so many equal integers are what two recordings must share to be aligned.
RUN = 2
MAX_ERROR = 0.25
#: Overlap, in integers, from which the bits alone decide; in the tests' melodies unrelated ends agree by chance up to 20.
MIN_OVERLAP = 24
#: Numbers of a chunk's spectra and of their products that are held at once; lengths that differ more than so many times are
#: compared offset by offset.
SPECTRA, PRODUCTS, UNEQUAL = 1 << 21, 1 << 19, 16

#: Filters by rule: (kind, first pitch class, height, width); kinds are ways to split a rectangle in two.
FILTERS = [(i % 6, (5 * i) % 12 % (13 - h), h, w) for i, (h, w) in enumerate((h, w) for h in (3, 4, 6, 12) for w in (4, 8, 12, 16))]
#: Quantizer steps: below, between and over them are 4 levels.
STEPS = (-0.25, 0.0, 0.25)
#: Mean energy of a pitch class in a frame, what a whole rectangle is held against.
MEAN = 0.15
GRAY = np.array([0, 1, 3, 2], dtype=np.uint32)


def chroma(samples: np.ndarray, rate: int) -> np.ndarray:
    """Frames x 12 pitch-class energies, each row of length 1 or, when silent, 0."""
    size = max(64, round(FRAME * rate / RATE))
    hop = size // OVERLAP
    if len(samples) < size:
        return np.zeros((0, 12))
    frames = np.lib.stride_tricks.sliding_window_view(samples, size)[::hop]
    hz = np.fft.rfftfreq(size, 1 / rate)
    use = (hz >= LOW_HZ) & (hz <= min(HIGH_HZ, rate / 2))
    note = np.round(12 * np.log2(hz[use] / 440.0)).astype(int) % 12
    fold = np.zeros((use.sum(), 12), np.float32)
    fold[np.arange(len(note)), note] = 1.0
    window = np.hanning(size).astype(np.float32)
    out = np.empty((len(frames), 12))
    for at in range(0, len(frames), 256):  # bounds memory for long recordings
        spectrum = np.fft.rfft(frames[at : at + 256] * window, axis=1)[:, use]
        out[at : at + 256] = (spectrum.real**2 + spectrum.imag**2).astype(np.float32) @ fold
    if len(out) >= len(SMOOTHING):
        out = np.apply_along_axis(np.convolve, 0, out, SMOOTHING, "valid")
    else:
        out = out[:0]
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return np.where(norm > SILENCE, out / np.maximum(norm, SILENCE), 0.0)


def integral_image(image: np.ndarray) -> np.ndarray:
    out = np.zeros((image.shape[0] + 1, image.shape[1] + 1))
    out[1:, 1:] = image.cumsum(axis=0).cumsum(axis=1)
    return out


def rectangle(integral: np.ndarray, n: int, x0: int, x1: int, y0: int, y1: int) -> np.ndarray:
    """Sums over frames t + x0 .. t + x1 and pitch classes y0 .. y1 (ends out) for t = 0 .. n - 1."""
    return integral[x1 : x1 + n, y1] - integral[x0 : x0 + n, y1] - integral[x1 : x1 + n, y0] + integral[x0 : x0 + n, y0]


def filter_values(integral: np.ndarray, n: int, kind: int, y: int, h: int, w: int) -> np.ndarray:
    def area(x0: float, x1: float, y0: float, y1: float) -> np.ndarray:
        return rectangle(integral, n, int(x0), int(x1), int(y + y0), int(y + y1))

    whole = area(0, w, 0, h)
    if kind == 0:
        return np.log1p(whole) - np.log1p(MEAN * h * w)
    if kind == 1:  # upper half
        part = area(0, w, h // 2, h)
    elif kind == 2:  # later half
        part = area(w // 2, w, 0, h)
    elif kind == 3:  # two of four quarters
        part = area(0, w // 2, h // 2, h) + area(w // 2, w, 0, h // 2)
    elif kind == 4:  # middle third of pitch classes
        part = area(0, w, h // 3, h - h // 3)
    else:  # middle third of frames
        part = area(w // 3, w - w // 3, 0, h)
    return np.log1p(part) - np.log1p(whole - part)


def fingerprint(samples: np.ndarray, rate: int) -> np.ndarray:
    """Packed 32-bit integers, one for each stretch of WIDTH frames; none if the recording is shorter."""
    image = chroma(np.asarray(samples, dtype=np.float32), rate)
    n = len(image) - WIDTH + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    integral, packed = integral_image(image), np.zeros(n, np.uint32)
    for kind, y, h, w in FILTERS:
        level = np.searchsorted(STEPS, filter_values(integral, n, kind, y, h, w), side="right")
        packed = packed << np.uint32(2) | GRAY[level]
    return packed


def decode_wav(data: bytes | None) -> tuple[np.ndarray, int]:
    """Mono samples in [-1, 1] of a PCM16 WAV file; anything else is an empty recording."""
    import io
    import wave

    try:
        with wave.open(io.BytesIO(data or b"")) as w:
            if w.getsampwidth() != 2:
                return np.zeros(0, np.float32), RATE
            x = np.frombuffer(w.readframes(w.getnframes()), "<i2").astype(np.float32) / 32768
            return x.reshape(-1, w.getnchannels()).mean(axis=1), w.getframerate()
    except (wave.Error, EOFError):
        return np.zeros(0, np.float32), RATE


def melody(vector: list[float] | None, rate: int = 5512) -> tuple[np.ndarray, int]:
    """A recording from a vector, for tables that hold no audio: one note a dimension, as long as a hop, its pitch and
    loudness from the value. Nulls and values that aren't finite are rests."""
    hop = round(FRAME * rate / RATE) // OVERLAP
    v = np.array([x if x is not None and math.isfinite(x) else np.nan for x in vector or []], dtype=np.float64)
    rest = np.isnan(v)
    scaled = np.tanh(4 * np.where(rest, 0.0, v))
    hz = 440.0 * 2.0 ** (np.round(18 * scaled) / 12.0)
    loud = np.where(rest, 0.0, 0.3 + 0.7 * np.abs(scaled))
    phase = np.cumsum(np.repeat(2 * np.pi * hz / rate, hop))
    tone = np.sin(phase) + 0.5 * np.sin(2 * phase)
    return (np.repeat(loud, hop) * tone).astype(np.float32), rate


def fingerprints(recordings: DataFrame, key: str, column: str, decode: Callable[..., tuple[np.ndarray, int]] = decode_wav) -> DataFrame:
    """rec_id, prints (array of packed integers as ints), digest of each row; other columns are not read. Null, empty,
    broken and short recordings have no integers; null and repeated keys stay."""
    ship_package(recordings.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from strandline.llm.chroma import fingerprint

        for b in batches:
            for at in range(0, len(b), 512):
                part = b.slice(at, 512)
                found = [fingerprint(*decode(x.as_py())).view(np.int32) for x in part.column(1)]
                digests = [hashlib.md5(x.astype("<i4").tobytes()).hexdigest() for x in found]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x.tolist() for x in found], pa.list_(pa.int32())), pa.array(digests)], names=["rec_id", "prints", "digest"])

    return map_arrow(recordings.select(F.col(key).cast("long").alias("rec_id"), F.col(column).alias("x")), work, "rec_id long, prints array<int>, digest string")


def _bits(a: Column, b: Column) -> Column:
    """Differing bits of two arrays of ints of one length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0).cast("long"), lambda s, x: s + x)


def _blocks(prints: list[np.ndarray], most: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places, lengths and integers (0 beyond the end) of prints by length, at most so many integers at once or one row."""
    order = np.argsort([len(p) for p in prints], kind="stable")
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and (end + 1 - at) * len(prints[order[end]]) <= most:
            end += 1
        rows = order[at:end]
        size = np.array([len(prints[i]) for i in rows])
        held = np.zeros((len(rows), int(size.max())), "<u4")
        for k, i in enumerate(rows):
            held[k, : size[k]] = prints[i]
        yield rows, size, held
        at = end


def _signs(prints: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Bits of rows of integers as 1 or -1, 0 beyond their ends."""
    out = np.unpackbits(prints.view(np.uint8), axis=1).reshape(*prints.shape, 32).astype(np.float32) * np.float32(2) - 1
    out[np.arange(prints.shape[1]) >= size[:, None]] = 0
    return out


def _circle(least: int) -> int:
    """The next length from `least` on that has no prime factor over 5."""
    while True:
        rest = least
        for p in (2, 3, 5):
            while rest % p == 0:
                rest //= p
        if rest == 1:
            return least
        least += 1


def agreements(q: np.ndarray, q_size: np.ndarray, c: np.ndarray, c_size: np.ndarray, least: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first query, first class, offsets, scores by offset, query and class): agreeing less differing bits, up to rounding, of
    rows of integers at all offsets where `least` of them or more may overlap. All offsets of a pair are one correlation, so
    spectra meet in a matrix product a frequency, and one transform back gives every offset. Rows of very unequal lengths
    are one matrix product an offset. Chunks of pairs bound the memory."""
    width, height = q.shape[1], c.shape[1]
    if min(width, height) < least:
        return
    offsets = np.arange(least - width, height - least + 1)
    if max(width, height) > UNEQUAL * min(width, height):
        a, b = _signs(q, q_size), _signs(c, c_size)
        for o in offsets.tolist():
            i, j = max(0, -o), max(0, o)
            n = min(width - i, height - j)
            yield 0, 0, np.array([o]), (a[:, i : i + n].reshape(len(q), -1) @ b[:, j : j + n].reshape(len(c), -1).T)[None]
        return
    n = _circle(width + height - least)  # so that no two offsets meet at a place of the circle
    most = max(1, SPECTRA // (32 * (n // 2 + 1)))
    c_step = min(256, most)
    q_step = max(1, min(64, PRODUCTS // ((n // 2 + 1) * c_step)))
    before = width - least  # offsets below 0, at the end of the circle
    for top in range(0, len(q), most):
        a = np.ascontiguousarray(np.fft.rfft(_signs(q[top : top + most], q_size[top : top + most]), n, axis=1).conj().transpose(1, 0, 2))
        for j in range(0, len(c), c_step):
            b = np.ascontiguousarray(np.fft.rfft(_signs(c[j : j + c_step], c_size[j : j + c_step]), n, axis=1).transpose(1, 2, 0))
            for i in range(0, a.shape[1], q_step):
                scores = np.fft.irfft(a[:, i : i + q_step] @ b, n, axis=0)
                yield top + i, j, offsets[:before], scores[n - before :]
                yield top + i, j, offsets[before:], scores[: len(offsets) - before]


def passing_offsets(queries: list[np.ndarray], classes: list[np.ndarray], max_error: float, least: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(query, class, offset, overlap, errors) of every offset of every pair whose overlap is at least `least` integers and
    differs in at most max_error of its bits. agreements() finds those that may pass, with more slack than rounding takes;
    their differing bits are counted."""
    held, share = list(_blocks(queries)), 32 * (1 - 2 * max_error)
    for c_rows, c_size, c in _blocks(classes):
        for q_rows, q_size, q in held:
            slack = 1 + 32e-5 * math.sqrt(q.shape[1] * c.shape[1])
            for i, j, offsets, scores in agreements(q, q_size, c, c_size, least):
                q_from, c_from = np.maximum(0, -offsets), np.maximum(0, offsets)
                shortest = np.maximum(least, np.minimum(q_size[0] - q_from, c_size[0] - c_from))  # blocks ascend by length
                longest = np.minimum(q_size[-1] - q_from, c_size[-1] - c_from)
                enough = (np.minimum(share * shortest, share * longest) - slack).astype(np.float32)
                at, x, y = np.unravel_index(np.flatnonzero(scores >= enough[:, None, None]), scores.shape)
                for k in np.unique(at):
                    mine, other = i + x[at == k], j + y[at == k]
                    overlap = np.minimum(q_size[mine] - q_from[k], c_size[other] - c_from[k])
                    differ = np.bitwise_count(q[mine, q_from[k] : q_from[k] + longest[k]] ^ c[other, c_from[k] : c_from[k] + longest[k]])
                    errors = np.where(np.arange(longest[k]) < overlap[:, None], differ, 0).sum(axis=1)
                    ok = (overlap >= least) & (errors <= max_error * 32 * overlap)
                    yield from zip(q_rows[mine[ok]].tolist(), c_rows[other[ok]].tolist(), [int(offsets[k])] * int(ok.sum()), overlap[ok].tolist(), errors[ok].tolist())


def _long_overlaps(queries: DataFrame, classes: DataFrame, max_error: float, block: tuple[int, int] = (1024, 2048)) -> DataFrame:
    """query, match, offset, overlap, errors of all queries with all classes from MIN_OVERLAP on: every block of queries
    meets every block of classes in a cell."""
    g, h = (max(1, -(-df.count() // n)) for df, n in ((queries, block[0]), (classes, block[1])))
    mine, other = F.pmod(F.xxhash64("class_id"), F.lit(g)), F.pmod(F.xxhash64("class_id"), F.lit(h))
    row = lambda asks, home: F.struct(home.cast("long").alias("home"), F.lit(asks).alias("asks"))
    q = queries.select("class_id", "prints", F.explode(F.transform(F.sequence(F.lit(0), F.lit(h - 1)), lambda j: row(True, mine * h + j))).alias("x"))
    c = classes.select("class_id", "prints", F.explode(F.transform(F.sequence(F.lit(0), F.lit(g - 1)), lambda i: row(False, i * h + other))).alias("x"))
    cells = q.unionByName(c).select("x.home", "x.asks", "class_id", "prints").repartition(min(g * h, 2000), "home").sortWithinPartitions("home")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from strandline.llm.chroma import MIN_OVERLAP, passing_offsets

        def done(held: tuple) -> pa.RecordBatch:
            (q_ids, q), (c_ids, c) = held
            found = [(q_ids[i], c_ids[j], *x) for i, j, *x in passing_offsets(q, c, max_error, MIN_OVERLAP) if q_ids[i] != c_ids[j]] if q and c else []
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], pa.int64()) for k in range(5)], names=["query", "match", "offset", "overlap", "errors"])

        at, held = None, (([], []), ([], []))
        for b in batches:
            for home, asks, key, prints in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3)):
                if home != at and at is not None:
                    yield done(held)
                    held = (([], []), ([], []))
                at = home
                ids, values = held[0 if asks else 1]
                ids.append(key)
                values.append(prints.values.to_numpy(zero_copy_only=False).view(np.uint32))
        if at is not None:
            yield done(held)

    return map_arrow(cells, compare, "query long, match long, offset long, overlap long, errors long")


def align(queries: DataFrame, classes: DataFrame, run: int = RUN, max_error: float = MAX_ERROR) -> DataFrame:
    """Aligned pairs of classes: query, match, offset (frames that the match lags), hits (shared runs of `run` equal
    integers at that offset), overlap (integers) and errors (differing bits), for pairs of different classes that differ in
    at most max_error of the overlap's bits at some offset. From MIN_OVERLAP integers on, every offset of every pair is
    compared; a shorter overlap must hold a shared run. The offset with the most agreeing less differing bits is kept.
    queries, classes: class_id, prints."""

    def postings(df: DataFrame, name: str) -> DataFrame:
        runs = F.transform(F.sequence(F.lit(0), F.size("prints") - run), lambda i: F.struct(i.alias("at"), F.xxhash64(F.slice("prints", i + 1, run)).alias("key")))
        flat = df.where(F.size("prints") >= run).select(F.col("class_id").alias(name), F.explode(runs).alias("r"))
        return flat.select(name, F.col("r.key").alias("key"), F.col("r.at").alias(f"{name}_at"))

    hits = postings(queries, "query").join(postings(classes, "match"), "key").where("query != match")
    histogram = hits.groupBy("query", "match", (F.col("match_at") - F.col("query_at")).alias("offset")).agg(F.count("*").alias("hits"))
    histogram = materialize(histogram, "histogram")
    pairs = histogram.join(queries.select(F.col("class_id").alias("query"), F.col("prints").alias("q")), "query").join(classes.select(F.col("class_id").alias("match"), F.col("prints").alias("m")), "match")
    q_from, m_from = F.greatest(F.lit(0), -F.col("offset")), F.greatest(F.lit(0), F.col("offset"))
    pairs = pairs.withColumn("overlap", F.least(F.size("q") - q_from, F.size("m") - m_from)).where(F.col("overlap") < MIN_OVERLAP)
    short = pairs.withColumn("errors", _bits(F.slice("q", q_from + 1, F.col("overlap")), F.slice("m", m_from + 1, F.col("overlap"))))
    short = short.where(F.col("errors") <= max_error * 32 * F.col("overlap")).select("query", "match", F.col("offset").cast("long"), F.col("overlap").cast("long"), "errors")
    every = materialize(short.unionByName(_long_overlaps(queries, classes, max_error)), "passing-offsets")
    rank = F.struct(32 * F.col("overlap") - 2 * F.col("errors"), -F.abs("offset"), F.col("offset"), F.col("overlap"), F.col("errors"))
    best = every.groupBy("query", "match").agg(F.max(rank).alias("b")).select("query", "match", "b.offset", "b.overlap", "b.errors")
    hits = histogram.select("query", "match", F.col("offset").cast("long").alias("offset"), "hits")
    return best.join(hits, ["query", "match", "offset"], "left").select("query", "match", "offset", F.coalesce("hits", F.lit(0).cast("long")).alias("hits"), "overlap", "errors")


def align_all(recordings: DataFrame, key: str, column: str, decode: Callable[..., tuple[np.ndarray, int]] = decode_wav, every: int = 20) -> DataFrame:
    """One row per row of recordings: rec_id, n_prints, digest, class_id (the smallest rec_id with an equal fingerprint;
    recordings without integers are no class and have null), and for the classes that hold a query, a rec_id divisible
    by `every`, the number of other classes aligned with it and the best one: n_links, best_class, best_offset,
    best_errors (share of bits). Queries run against all classes. Equal fingerprints are never paired with each other."""
    prints = materialize(fingerprints(recordings, key, column, decode), "prints")
    some = prints.where(F.size("prints") > 0)
    grouped = some.groupBy("digest").agg(F.min("rec_id").alias("class_id"), F.max(F.coalesce(F.col("rec_id") % every == 0, F.lit(False))).alias("asks"), F.min("prints").alias("prints"))
    classes = materialize(grouped.where("class_id IS NOT NULL"), "classes")
    pairs = align(classes.where("asks").select("class_id", "prints"), classes.select("class_id", "prints"))
    share = F.col("errors") / (32 * F.col("overlap"))
    best = pairs.groupBy("query").agg(F.count("*").alias("n_links"), F.min(F.struct(share.alias("e"), F.col("match").alias("match"), F.col("offset").alias("offset"))).alias("b"))
    best = best.select(F.col("query").alias("class_id"), "n_links", F.col("b.match").alias("best_class"), F.col("b.offset").alias("best_offset"), F.col("b.e").alias("best_errors"))
    told = classes.select("digest", "class_id", "asks").join(best, "class_id", "left")
    told = materialize(told.withColumn("n_links", F.when(F.col("asks"), F.coalesce("n_links", F.lit(0)))).drop("asks"), "alignments")
    out = prints.select("rec_id", F.size("prints").alias("n_prints"), "digest").join(told, "digest", "left")
    return out.select("rec_id", "n_prints", "digest", "class_id", "n_links", "best_class", "best_offset", "best_errors")
