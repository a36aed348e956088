"""Deterministic sharded WARC writer and reader.

Records are cut into shards at exact byte quantiles of their sorted keys (running sums over ranges of keys), so the
same table gives the same files whatever its partitions. A shard's records go out in key order, one gzip member
each; a file is rolled once it reaches a compressed size. Headers, record ids and digests are made anew from content
alone. Tasks write under temporary names of their own and list what they wrote; a second pass moves just the listed
files to their final names, and a committed manifest ends the write. Lost or repeated tasks leave only unlisted files.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import storage
from strandline.operators.ordered import running
from strandline.session import hadoop_path, map_arrow, materialize, ship_package

DATE = "2020-01-01T00:00:00Z"
SHARDS = 256
SHARD_BYTES = (1 << 18, 1 << 30)
ROLL_BYTES = 256 << 20
BINS = 4
LEVEL = 6
_MANIFEST = "file string, temporary string, shard long, part int, records long, bytes long, sha1 string"


def digest32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(key: int | None, uri: str | None, digest: str, repeat: int) -> str:
    """A record's id from its content: rows that are equal differ by their place among them."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha1(json.dumps([key, uri, digest, repeat]).encode()).digest()[:16], version=5)}>"


def make_record(key: int | None, uri: str | None, payload: bytes, date: str, repeat: int, refers: tuple[int | None, str | None] | None) -> bytes:
    """One record: a response, or a revisit of the response (key, uri) with the same payload."""
    digest = digest32(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers else 'response'}", f"WARC-Record-ID: {record_id(key, uri, digest, repeat)}", f"WARC-Date: {date}"]
    if uri is not None:
        head.append(f"WARC-Target-URI: {_header(uri)}")
    if key is not None:
        head.append(f"X-Record-Key: {key}")
    if refers:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(*refers, digest, 0)}"]
        if refers[1] is not None:
            head.append(f"WARC-Refers-To-Target-URI: {_header(refers[1])}")
        if refers[0] is not None:
            head.append(f"X-Refers-To-Key: {refers[0]}")
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{digest32(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _header(value: str) -> str:
    """Header values hold no control characters; those are percent-encoded."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in value)


def shard_bounds(sized: DataFrame, shard_bytes: int) -> list[tuple[int, int, int]]:
    """(smallest key, first shard, shards) of each run of keys; sized: key (no nulls), bytes. Running sums cut the keys
    into bins of a part of shard_bytes, which are joined up to shard_bytes; the records of a key over it are dealt over
    shards by digest. The driver gets BINS rows a shard."""
    upto = running(sized.groupBy("key").agg(F.sum("bytes").alias("bytes")), [F.col("key")], {"upto": F.col("bytes")})
    at = F.floor((F.col("upto") - F.col("bytes")) / max(1, shard_bytes // BINS))
    bins = upto.groupBy(at.alias("bin"), (F.col("bytes") > shard_bytes).alias("over")).agg(F.min("key").alias("low"), F.sum("bytes").alias("bytes"))
    out, shard, held = [], -1, shard_bytes
    for start, size in sorted((r["low"], r["bytes"]) for r in bins.select("low", "bytes").collect()):
        parts = max(1, round(size / shard_bytes))
        if parts > 1:
            out.append((start, shard + 1, parts))
            shard, held = shard + parts, shard_bytes
        elif held + size > shard_bytes or held >= shard_bytes:
            shard, held = shard + 1, size
            out.append((start, shard, 1))
        else:
            held += size
    return out


def write_archives(pages: DataFrame, folder: str, revisit_from: int = 0, shards: int = SHARDS, roll_bytes: int = ROLL_BYTES, date: str = DATE, level: int = LEVEL) -> DataFrame:
    """Write pages (page_id, url, html; others are not read) as WARC files into folder and return the manifest.

    Of records with equal payloads of at least revisit_from bytes, the one with the smallest page_id (nulls last, then
    by url) is a response, the others revisit it; equal rows count as records of their own. A null html is an empty
    payload. A folder that a manifest commits is not written again."""
    spark = pages.sparkSession
    ship_package(spark)
    if storage.read_whole(f"{folder}/_COMMITTED") is not None:
        return spark.read.parquet(f"{folder}/_manifest")
    records = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    key = F.coalesce("page_id", F.lit(-(1 << 63)).cast("long"))
    records = records.withColumn("digest", F.sha1("payload")).withColumn("key", key)
    narrow = materialize(records.select("page_id", "url", "key", "digest", F.octet_length("payload").cast("long").alias("bytes")), "warc-digests")
    total = narrow.agg(F.sum(F.col("bytes") + 512)).first()[0] or 0
    shard_bytes = min(SHARD_BYTES[1], max(SHARD_BYTES[0], total // shards))
    bounds = shard_bounds(narrow.select("key", (F.col("bytes") + 512).alias("bytes")), shard_bytes)
    lows, first, parts = (np.array([b[i] for b in bounds] or [0], dtype=np.int64) for i in range(3))
    table = spark.sparkContext.broadcast((lows, first, np.maximum(parts, 1)))  # three numbers a shard

    @F.pandas_udf("long")
    def shard_of(key: pd.Series, digest: pd.Series) -> pd.Series:
        lows, first, parts = table.value
        at = np.maximum(0, np.searchsorted(lows, key.to_numpy(np.int64), side="right") - 1)
        n = parts[at]
        shard = first[at].copy()
        for i in np.flatnonzero(n > 1):
            shard[i] += int(digest.iloc[i][:8], 16) % n[i]
        return pd.Series(shard)

    same = narrow.where(F.col("bytes") >= revisit_from)
    firsts = same.groupBy("digest").agg(F.min(F.struct(F.col("page_id").isNull().alias("n"), "page_id", "url")).alias("first"), F.count("*").alias("n")).where("n > 1")
    firsts = materialize(firsts.select("digest", F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url")), "warc-firsts")
    notes = same.join(firsts, "digest").where(~F.col("page_id").eqNullSafe(F.col("first_id")))
    notes = notes.select("page_id", "key", "digest", "first_id", "first_url").distinct()
    notes = notes.select("page_id", "key", "digest", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), "first_id", "first_url")
    rows = records.select("page_id", "key", "digest", F.lit(1).alias("kind"), "url", "payload", F.lit(None).cast("long").alias("first_id"), F.lit(None).cast("string").alias("first_url"))
    dealt = rows.unionByName(notes).withColumn("shard", shard_of("key", "digest")).drop("key")
    dealt = dealt.repartition(F.col("shard")).sortWithinPartitions("shard", "page_id", "digest", "kind", "url")
    temporary = f"{folder}/_temporary/{uuid.uuid4().hex}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from strandline.llm import storage
        from strandline.llm.warc import make_record

        attempt = f"{temporary}/{uuid.uuid4().hex}"
        listed: list[tuple] = []
        out = None  # [stream, shard, part, records, bytes, sha1]
        run, note, repeat, head = None, None, 0, None

        def close() -> None:
            out[0].close()
            name = f"shard-{out[1]:06d}-{out[2]:05d}.warc.gz"
            listed.append((name, f"{attempt}/{name}", *out[1:5], out[5].hexdigest()))

        for batch in batches:
            for page_id, digest, kind, url, payload, first_id, first_url, shard in zip(*(c.to_pylist() for c in batch.columns)):
                if (page_id, digest) != run:
                    run, note, repeat, head = (page_id, digest), None, 0, None
                if kind == 0:
                    note = (first_id, first_url)
                    continue
                refers = note
                if note is None and repeat and len(payload) >= revisit_from:
                    refers = head
                if repeat == 0:
                    head = (page_id, url)
                if out is None or out[1] != shard or out[4] >= roll_bytes:
                    part = 0
                    if out is not None:
                        close()
                        part = out[2] + 1 if out[1] == shard else 0
                    storage.make_folder(attempt)
                    f, path = storage.open_fs(f"{attempt}/shard-{shard:06d}-{part:05d}.warc.gz")
                    out = [f.open_output_stream(path, compression=None), shard, part, 0, 0, hashlib.sha1()]
                packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                member = packer.compress(make_record(page_id, url, payload, date, repeat, refers)) + packer.flush()
                out[0].write(member)
                out[5].update(member)
                out[3] += 1
                out[4] += len(member)
                repeat += 1
        if out is not None:
            close()
        names = [f.split()[0] for f in _MANIFEST.split(", ")]
        types = [pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in listed], t) for i, t in enumerate(types)], names=names)

    listed = materialize(map_arrow(dealt, write, _MANIFEST), "warc-listed")

    def publish(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from strandline.llm import storage

        for frame in frames:
            for r in frame.itertuples():
                if storage.size_of(f"{folder}/{r.file}") != r.bytes or storage.size_of(r.temporary) >= 0:
                    storage.move(r.temporary, f"{folder}/{r.file}")
            yield frame

    storage.make_folder(folder)
    listed.mapInPandas(publish, _MANIFEST).drop("temporary").write.mode("overwrite").parquet(f"{folder}/_manifest")
    manifest = spark.read.parquet(f"{folder}/_manifest")
    sums = manifest.agg(F.count("*").alias("files"), F.sum("records").alias("records"), F.sum("bytes").alias("bytes")).first().asDict()
    storage.write_whole(f"{folder}/_COMMITTED", json.dumps(sums).encode())
    fs, path = hadoop_path(spark, f"{folder}/_temporary")
    fs.delete(path, True)
    return manifest


def read_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an uncompressed stream."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/1."):
            raise ValueError(f"no WARC record: {line[:40]!r}")
        headers = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode().partition(":")
            headers[name.strip()] = value.strip()
        block = stream.read(int(headers["Content-Length"]))
        if len(block) != int(headers["Content-Length"]):
            raise ValueError("the archive ends inside a record")
        yield headers, block


READ = "page_id long, url string, record_id string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary"


def read_archives(spark: SparkSession, folder: str, with_payload: bool = True) -> DataFrame:
    """One row per record of a committed folder. Digests of blocks, and of payloads where they are there, are computed
    from the bytes and must equal those in the headers. Each file is streamed by one task."""
    ship_package(spark)
    if storage.read_whole(f"{folder}/_COMMITTED") is None:
        raise FileNotFoundError(f"{folder} holds no committed archives")

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pa.RecordBatch]:
        from strandline.llm import storage
        from strandline.llm.warc import digest32, read_records

        names = [f.split()[0] for f in READ.split(", ")]
        types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

        rows, held = [], 0
        for frame in frames:
            for name in frame.column(0).to_pylist():
                f, path = storage.open_fs(f"{folder}/{name}")
                with f.open_input_stream(path, compression=None, buffer_size=1 << 20) as raw, gzip.GzipFile(fileobj=raw) as stream:
                    for head, block in read_records(stream):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        if "sha1:" + digest32(block) != head["WARC-Block-Digest"]:
                            raise ValueError(f"{name}: a block differs from its digest")
                        digest, size = head["WARC-Payload-Digest"].removeprefix("sha1:"), len(payload)
                        if head["WARC-Type"] == "revisit":  # the payload's length is in the HTTP headers it keeps
                            size = next(int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                        elif digest32(payload) != digest:
                            raise ValueError(f"{name}: a payload differs from its digest")
                        key, refers = head.get("X-Record-Key"), head.get("X-Refers-To-Key")
                        rows.append((None if key is None else int(key), head.get("WARC-Target-URI"), head["WARC-Record-ID"], head["WARC-Type"], digest, size, None if refers is None else int(refers), payload if with_payload and head["WARC-Type"] == "response" else None))
                        held += len(block)
                        if held > 8 << 20:
                            yield batch(rows)
                            rows, held = [], 0
        if rows:
            yield batch(rows)

    manifest = spark.read.parquet(f"{folder}/_manifest")
    n, size = manifest.agg(F.count("*"), F.sum("bytes")).first()
    # a stated number: rows of names are small, and Spark would else merge them into one task
    tasks = max(1, min(n, max(3 * spark.sparkContext.defaultParallelism, (size or 0) // ROLL_BYTES)))
    return map_arrow(manifest.select("file").repartition(tasks, F.col("file")), read, READ)


_BASE32 = " || ".join(f"'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[(('0x' || x[{5 * g + 1}:{5 * g + 5}])::INT >> {shift} & 31) + 1]" for g in range(8) for shift in (15, 10, 5, 0))
#: The rows of op2's query in DuckDB's SQL, over the table pages: five hex digits of a SHA-1 are four of base 32.
ORACLE = f"""
WITH d AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS x FROM pages),
r AS (SELECT *, row_number() OVER w AS k, first_value(page_id) OVER w AS head FROM d WINDOW w AS (PARTITION BY x ORDER BY page_id NULLS LAST))
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest, CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN k > 1 THEN head END AS refers_to FROM r
"""
