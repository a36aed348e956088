"""FASTA files read by byte ranges, so that one record may be far longer than a row or a task should be.

A first pass sums up each range of bytes: where the first and last `>` stand, how many bases come before the first and after
the last, and the same should the range begin inside a header. Put together in order, file by file, the sums give each
range the state it begins in: the record it continues, that record's name and length, and how many of its bases came
before. That is the offset index, a small Parquet table that can be kept. The data source `fasta` then reads each range in
a task of its own: from its state on, up to its end and `overlap` bases of the same record beyond it, so that whatever lies
across the border is whole in one task. Ranges far smaller than a task's worth are read several to a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from strandline.files import open_file, resolved
from strandline.operators.ordered import running
from strandline.session import join_large, map_arrow, materialize, release_memory, scratch_folder, ship_package

#: Bytes of a range, which its task holds a few times over.
CHUNK = 1 << 22
#: A longer header is an error, not cut: ranges keep the headers that cross their borders.
LONGEST_HEADER = 1 << 16
#: Tasks of the first pass; each takes several ranges beyond that.
MOST_TASKS = 20_000
#: Bytes of neighbouring ranges that a task takes, one after another, at least and at most; in between about one part in
#: so many of the input.
TASK_BYTES, TASK_MOST, SHARES = 1 << 18, 1 << 24, 256
_BLOCK = 1 << 16
_COMPRESSED = (".gz", ".bz2", ".zst", ".xz", ".lz4", ".snappy", ".deflate")
_NOT_BASES = b"\r\n"

SUMMARY = "path string, size long, start long, stop long, headers long, lead_ends boolean, lead_all long, lead_after long, lead_text binary, tail_open boolean, tail_bases long, tail_text binary"
INDEX = "path string, file_no long, start long, stop long, record long, offset long, in_header boolean, open_name string, open_len long, last_name string, last_len long"
STRETCHES = "seq_id long, name string, len long, begin long, owned long, seq string"


def bases_of(data: bytes) -> bytes:
    return data.translate(None, _NOT_BASES)


def _kept(text: bytes) -> bytes | None:
    """What may be a header or a piece of one; None if it is too long for that, as the bases of a long line are."""
    return text if len(text) <= LONGEST_HEADER else None


def summarize(data: bytes) -> tuple:
    """(headers, lead_ends, lead_all, lead_after, lead_text, tail_open, tail_bases, tail_text) of a range: the lead is what
    comes before the first `>`, the tail what comes after the last one."""
    first, last = data.find(b">"), data.rfind(b">")
    lead = data if first < 0 else data[:first]
    newline = lead.find(b"\n")
    after = len(bases_of(lead[newline + 1 :])) if newline >= 0 else 0
    tail = b"" if last < 0 else data[last + 1 :]
    close = tail.find(b"\n")
    tail_bases = len(bases_of(tail[close + 1 :])) if close >= 0 else 0
    return (data.count(b">"), newline >= 0, len(bases_of(lead)), after, _kept(lead[:newline] if newline >= 0 else lead), last >= 0 and close < 0, tail_bases, _kept(tail[:close] if close >= 0 else tail))


def _name(text: bytes) -> str:
    return text.removesuffix(b"\r").decode("utf-8", "replace")


def _piece(text: bytes | None) -> bytes:
    if text is None:
        raise ValueError(f"a header is longer than {LONGEST_HEADER} bytes")
    return bytes(text)


def compose(ranges: pd.DataFrame) -> pd.DataFrame:
    """The index rows of one file from its ranges' sums. A file begins inside a header, of a record that is only one if
    something stands before the first `>`."""
    out: list[list] = []
    in_header, record, offset, name = True, 0, 0, b""
    opened: list[int] = []  # ranges in which the open record goes on
    begun = -1  # the range in which it began

    def close(length: int) -> None:
        for i in opened:
            out[i][8] = length
        if begun >= 0:
            out[begun][10] = length

    for r in ranges.sort_values("start").itertuples(index=False):
        i = len(out)
        row = [r.path, 0, r.start, r.stop, record, offset, in_header, None, 0, None, 0]
        out.append(row)
        opened.append(i)
        row[7] = bytes(name)
        if in_header:
            name += _piece(r.lead_text)
            if r.lead_ends or r.headers:
                for j in opened:
                    out[j][7] = name
                if begun >= 0:
                    out[begun][9] = name
        offset += r.lead_after if in_header else r.lead_all
        if r.headers:
            close(offset)
            record, in_header, offset, name = record + r.headers, bool(r.tail_open), int(r.tail_bases), _piece(r.tail_text)
            row[9], opened, begun = name, [], i
        elif in_header:
            in_header = not r.lead_ends
    close(offset)
    if in_header:
        for j in opened:
            out[j][7] = name
        if begun >= 0:
            out[begun][9] = name
    for row in out:
        row[7] = _name(row[7])
        row[9] = None if row[9] is None else _name(row[9])
    return pd.DataFrame(out, columns=[f.split()[0] for f in INDEX.split(", ")])


def build_index(spark: SparkSession, path: str, folder: str | None = None, chunk: int = CHUNK) -> str:
    """Write the offset index of the files of a path (a file, a folder or a pattern) and return its folder. Compressed files
    have no byte ranges and are refused. Files are composed one by one, a row a range; empty ones have no ranges."""
    ship_package(spark)
    folder = folder or f"{scratch_folder(spark, 'fasta-index')}/index"
    files = spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size"))
    wrong = files.where(F.lower("path").rlike("(" + "|".join(map(_regex, _COMPRESSED)) + ")$")).select("path").first()
    if wrong:
        raise ValueError(f"{wrong[0]} is compressed; read it with read_fasta")
    cut = files.where("size > 0").select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(chunk).cast("long"))).alias("start"))
    n, size = files.agg(F.sum(F.ceil(F.col("size") / chunk)), F.sum("size")).first()
    tasks = max(spark.sparkContext.defaultParallelism, (size or 0) // _task_bytes(size or 0))
    ranges = cut.select("path", "size", "start", F.least(F.col("start") + chunk, "size").alias("stop")).repartition(min(int(n or 1), int(tasks), MOST_TASKS))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from strandline.sources.byteranges import summarize

        for batch in batches:
            for row in batch.to_pylist():
                with open_file(row["path"]) as f:
                    f.seek(row["start"])
                    found = summarize(f.read(row["stop"] - row["start"]))
                names = [x.split()[0] for x in SUMMARY.split(", ")]
                values = [*row.values(), *found]
                kinds = [pa.string(), *[pa.int64()] * 4, pa.bool_(), pa.int64(), pa.int64(), pa.binary(), pa.bool_(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=names)

    def composed(part: pd.DataFrame) -> pd.DataFrame:
        from strandline.sources.byteranges import compose

        return compose(part)

    index = map_arrow(ranges, sums, SUMMARY).groupBy("path").applyInPandas(composed, INDEX)
    each = [f.split()[0] for f in INDEX.split(", ")]
    numbers = spark.createDataFrame([(p, i) for i, p in enumerate(sorted(r["path"] for r in files.select("path").collect()))], "path string, n long")  # a row a file, as Spark's own listing
    placed = index.join(F.broadcast(numbers), "path").withColumn("file_no", F.col("n")).select(*each)
    # in order, so that a task finds its ranges by the statistics of few files
    placed.repartitionByRange("file_no", "start").sortWithinPartitions("file_no", "start").write.mode("overwrite").parquet(folder)
    return folder


def _regex(suffix: str) -> str:
    return suffix.replace(".", "\\.")


@dataclass
class ByteRange:
    path: str
    file_no: int
    start: int
    stop: int
    record: int
    offset: int
    in_header: bool
    open_name: str
    open_len: int
    last_name: str | None
    last_len: int


@dataclass
class ByteRanges(InputPartition):
    """What a task reads: the rows of INDEX of files whose ranges start from low on and before high, by (file_no, low, high).
    The task looks them up, so that what plans the tasks holds none."""

    spans: list[tuple[int, int, int]]


def _task_bytes(total: int) -> int:
    return max(TASK_BYTES, min(TASK_MOST, total // SHARES))


def _tasks(sizes: dict[int, int]) -> list[ByteRanges]:
    """Files (their sizes by number) cut to a task's bytes, small ones several to a task."""
    most = _task_bytes(sum(sizes.values()))
    out: list[ByteRanges] = []
    held = 0
    for n, size in sorted(sizes.items()):
        for low in range(0, size, most):
            part = min(most, size - low)
            if not out or held + part > most:
                out.append(ByteRanges([]))
                held = 0
            out[-1].spans.append((n, low, low + most))
            held += part
    return out


def _beyond(f, at: int, wanted: int) -> bytes:
    """The next bases of the record that is open at a byte, as many as wanted or as there are."""
    f.seek(at)
    out = b""
    while len(out) < wanted:
        block = f.read(_BLOCK)
        if not block:
            break
        end = block.find(b">")
        out += bases_of(block if end < 0 else block[:end])
        if end >= 0:
            break
    return out[:wanted]


def stretches_of(r: ByteRange, overlap: int) -> Iterator[tuple[int, str, int, int, int, bytes]]:
    """(record, name, length, begin, owned, bases) of the parts of records in a range; the last one's overlap included."""
    with open_file(r.path) as f:
        f.seek(r.start)
        data = f.read(r.stop - r.start)
        parts = data.split(b">")
        for i, part in enumerate(parts):
            newline = part.find(b"\n")
            inside = i > 0 or r.in_header
            bases = bases_of(part[newline + 1 :] if newline >= 0 else b"") if inside else bases_of(part)
            last = i == len(parts) - 1
            if i == 0:
                name, length, begin = r.open_name, r.open_len, r.offset
            elif last:
                name, length, begin = r.last_name, r.last_len, 0
            else:
                name, length, begin = _name(part[:newline] if newline >= 0 else part), len(bases), 0
            if not bases:
                continue
            more = min(overlap, length - begin - len(bases)) if last else 0
            yield r.record + i, name, length, begin, len(bases), bases + (_beyond(f, r.stop, more) if more > 0 else b"")


class FastaSource(DataSource):
    """spark.read.format("fasta").option("index", folder of build_index)[.option("overlap", bases)].load(): STRETCHES."""

    @classmethod
    def name(cls) -> str:
        return "fasta"

    def schema(self) -> str:
        return STRETCHES

    def reader(self, schema) -> DataSourceReader:
        return FastaReader(dict(self.options))


class FastaReader(DataSourceReader):
    def __init__(self, options: dict):
        if "index" not in options:
            raise ValueError("state the option index, a folder that build_index wrote")
        self.index, self.overlap = options["index"], int(options.get("overlap", 0))

    def partitions(self) -> list[ByteRanges]:
        """Stretches of files, as for Spark's own files: of the index, batch by batch, only the files' ends are kept."""
        import pyarrow.dataset as ds

        system, path = resolved(self.index)
        sizes: dict[int, int] = {}
        for batch in ds.dataset(path, filesystem=system, format="parquet").to_batches(columns=["file_no", "stop"], batch_size=1 << 16, batch_readahead=0, fragment_readahead=0):
            for n, stop in batch.to_pandas().groupby("file_no")["stop"].max().items():
                sizes[int(n)] = max(int(stop), sizes.get(int(n), 0))
        return _tasks(sizes)

    def _ranges(self, partition: ByteRanges) -> list[ByteRange]:
        import pyarrow.parquet as pq

        system, path = resolved(self.index)
        spans = {n: (low, high) for n, low, high in partition.spans}  # a file is once in a task
        wanted = [("file_no", ">=", min(spans)), ("file_no", "<=", max(spans))]
        if len(spans) == 1:
            wanted += [("start", ">=", partition.spans[0][1]), ("start", "<", partition.spans[0][2])]
        rows = pq.read_table(path, filesystem=system, filters=wanted).sort_by([("file_no", "ascending"), ("start", "ascending")]).to_pylist()
        return [ByteRange(**row) for row in rows if spans[row["file_no"]][0] <= row["start"] < spans[row["file_no"]][1]]

    def read(self, partition: ByteRanges | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # there are no ranges
            return
        held: list[list] = [[] for _ in range(6)]

        def made() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(held, kinds)], names=["seq_id", "name", "len", "begin", "owned", "seq"])

        size = 0
        for part in self._ranges(partition):
            for record, name, length, begin, owned, bases in stretches_of(part, self.overlap):
                for column, value in zip(held, (part.file_no << 40 | record, name, length, begin, owned, bases.decode("utf-8", "replace"))):
                    column.append(value)
                size += len(bases)
                if size >= 1 << 22 or len(held[0]) >= 2000:
                    yield made()
                    held, size = [[] for _ in range(6)], 0
                    release_memory()
        if held[0]:
            yield made()
        release_memory(0)


def read_stretches(spark: SparkSession, path: str | None = None, overlap: int = 0, index: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """seq_id, name, len (of the record), begin, owned, seq: each record in stretches, one a byte range that holds bases of
    it. A stretch owns its first `owned` bases; up to `overlap` more follow, those that the next stretches own.

    Names, bases and the order of seq_id are those of read_fasta, which drops records without bases; malformed UTF-8 is
    read with replacement characters. Files are read twice, once if an index is given."""
    ship_package(spark)
    spark.dataSource.register(FastaSource)
    return spark.read.format("fasta").option("index", index or build_index(spark, path, chunk=chunk)).option("overlap", str(overlap)).load()


def records(stretches: DataFrame) -> DataFrame:
    """seq_id, name, len of each record that has bases."""
    return stretches.where("begin = 0").select("seq_id", "name", "len")


def flat_stretches(spark: SparkSession, path: str, overlap: int = 0, size: int = CHUNK) -> DataFrame:
    """All records of the files end to end as one sequence, headers left out, in stretches of `size` bases: STRETCHES with
    seq_id 0 and the path as name. Records lie where the lengths of those before them add up to; each stretch gathers the
    parts of records that it and its overlap cover, however short they are."""
    parts = materialize(read_stretches(spark, path), "stretches")
    lengths = running(records(parts).select("seq_id", "len"), [F.col("seq_id")], {"upto": F.col("len")})
    lengths = materialize(lengths.select("seq_id", (F.col("upto") - F.col("len")).alias("offset"), "upto"), "offsets")
    total = lengths.agg(F.max("upto")).first()[0] or 0
    placed = join_large(parts, lengths.select("seq_id", "offset"), "seq_id").select((F.col("offset") + F.col("begin")).alias("at"), "owned", "seq")
    cut = placed.select("*", F.explode(F.sequence(F.expr(f"greatest(at - {overlap}, 0) div {size}"), F.expr(f"(at + owned - 1) div {size}"))).alias("k"))
    cut = cut.withColumn("low", F.greatest("at", F.col("k") * size)).withColumn("high", F.least(F.col("at") + F.col("owned"), (F.col("k") + 1) * size + overlap)).where("high > low")
    part = F.struct("low", F.expr("substring(seq, int(low - at) + 1, int(high - low))").alias("seq"))
    whole = cut.select("k", part.alias("p")).groupBy("k").agg(F.sort_array(F.collect_list("p")).alias("p"))
    begin = F.col("k") * size
    return whole.select(F.lit(0).cast("long").alias("seq_id"), F.lit(path).alias("name"), F.lit(total).cast("long").alias("len"), begin.alias("begin"), F.least(F.lit(size), F.lit(total) - begin).cast("long").alias("owned"), F.array_join("p.seq", "").alias("seq"))
