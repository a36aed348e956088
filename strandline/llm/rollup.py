"""Delta-maintained token counts.

Totals by source, language and tokenizer version are sums of signed changes: an insert adds a document and its tokens,
a delete takes them away, a revised count does both. Each batch is summed (partial sums before any shuffle, so a source
with most rows is no hot key) into a small delta table, and committed by publishing the next numbered log entry: the
entry is written under a temporary name and gets its own by a step that fails if the name is taken, so an entry is whole
or not there, and a writer that dies at any point leaves nothing that readers or other writers see. A batch id commits
once: replays after a crash or a lost answer change nothing. Compaction folds all before it into one delta, and its entry
keeps the ids; readers begin at the last one, and vacuum() removes what lies before it.

The step needs a file system that can refuse to replace a file: local and mounted ones (hard links), HDFS and others with
an atomic rename. Object stores can't, so they are refused.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.session import hadoop_path

KEYS = ["source", "lang", "tokenizer"]
DELTA = "source string, lang string, tokenizer string, docs long, tokens long"
#: Their renames replace or are no single step.
OBJECT_STORES = frozenset(("s3", "s3a", "s3n", "gs", "oss", "obs", "cos", "cosn", "wasb", "wasbs", "swift"))


def signed(rows: DataFrame, sign: int, tokenizer: str | Column, tokens: str | Column) -> DataFrame:
    """Change rows (KEYS, docs, tokens) that insert (1) or delete (-1) each row's document, whatever its text's length.

    Null counts are 0 tokens, null sources, languages and versions keys of their own. Repeated rows count each. No rows
    give no changes. Further columns of rows are not read, those called docs or tokens neither, unless `tokens` names one."""
    version = F.lit(tokenizer) if isinstance(tokenizer, str) else tokenizer
    n = F.col(tokens) if isinstance(tokens, str) else tokens
    return rows.select(F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), version.alias("tokenizer"), F.lit(sign).cast("long").alias("docs"), (sign * F.coalesce(n.cast("long"), F.lit(0))).cast("long").alias("tokens"))


def inserted(rows: DataFrame, tokenizer: str | Column, tokens: str | Column = "n_tokens") -> DataFrame:
    return signed(rows, 1, tokenizer, tokens)


def deleted(rows: DataFrame, tokenizer: str | Column, tokens: str | Column = "n_tokens") -> DataFrame:
    return signed(rows, -1, tokenizer, tokens)


def revised(rows: DataFrame, tokenizer: str | Column, old: str | Column, new: str | Column, new_tokenizer: str | Column | None = None) -> DataFrame:
    """A document keeps its place but for its count, and perhaps its tokenizer's version."""
    return signed(rows, -1, tokenizer, old).unionByName(signed(rows, 1, tokenizer if new_tokenizer is None else new_tokenizer, new))


def check_scheme(scheme: str) -> None:
    if scheme in OBJECT_STORES:
        raise ValueError(f"{scheme} can't refuse to replace a file: keep the rollup on a file system that can")


class TokenRollup:
    """A rollup in a folder of the shared file system. Null sources, languages and versions are keys of their own; keys
    whose documents and tokens are both 0 are left out; an empty rollup has no rows."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.fs, path = hadoop_path(spark, f"{self.folder}/log")
        path = path.makeQualified(self.fs.getUri(), self.fs.getWorkingDirectory())
        self.scheme = path.toUri().getScheme()
        check_scheme(self.scheme)
        self.fs.mkdirs(path)
        self._log = path

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _read(self, name: str) -> str | None:
        """A file's text, None if it is not there."""
        path = self._path(name)
        if not self.fs.exists(path):
            return None
        stream = self.fs.open(path)
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _versions(self) -> list[int]:
        names = (status.getPath().getName() for status in self.fs.listStatus(self._path("log")))
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _entry(self, version: int) -> dict | None:
        """None for a file that is no whole entry: such a number is void."""
        text = self._read(f"log/{version:012d}.json")
        return json.loads(text) | {"version": version} if text and text.endswith("\n") else None

    def log(self) -> list[dict]:
        """Committed entries in order, from the last compaction on. Small files, one a commit since then."""
        versions = self._versions()
        hint = (self._read("log/compacted") or "").strip()
        if hint.isdigit() and int(hint) in versions and (self._entry(int(hint)) or {}).get("compacted"):
            versions = [v for v in versions if v >= int(hint)]
        entries = [e for e in map(self._entry, versions) if e]
        last = max((i for i, e in enumerate(entries) if e.get("compacted")), default=0)
        return entries[last:]

    def _next(self) -> int:
        """The number after all names that are there, of void ones too."""
        return max(self._versions(), default=-1) + 1

    def _publish(self, version: int, entry: dict) -> bool:
        """Publish a whole log entry under its number; False if the number is taken."""
        return self._rename(self._write_temporary(entry), f"{version:012d}.json")

    def _write_temporary(self, entry: dict) -> str:
        name = f".{uuid.uuid4().hex}.tmp"
        stream = self.fs.create(self._path(f"log/{name}"), False)
        stream.write(bytearray((json.dumps(entry) + "\n").encode()))
        stream.close()
        return name

    def _rename(self, name: str, target: str) -> bool:
        try:
            if self.scheme == "file":
                folder = unquote(urlparse(self._log.toUri().toString()).path)
                try:
                    os.link(f"{folder}/{name}", f"{folder}/{target}")
                except FileExistsError:
                    return False
                return True
            return self._rename_once(name, target)
        finally:
            self.fs.delete(self._path(f"log/{name}"), False)

    def _rename_once(self, name: str, target: str) -> bool:
        """Rename in one step that does not replace."""
        sc = self.spark.sparkContext
        context = sc._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._log.toUri(), sc._jsc.hadoopConfiguration())
        none = sc._gateway.new_array(getattr(sc._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(self._path(f"log/{name}"), self._path(f"log/{target}"), none)
        except Exception as e:
            if "FileAlreadyExists" in str(e) or "already exists" in str(e):
                return False
            raise
        return True

    def batches(self) -> list[str]:
        return [b for e in self.log() for b in e["batches"]]

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Add the changes (KEYS, docs, tokens) under batch_id; False, and nothing done, if it is committed already."""
        if batch_id in self.batches():
            return False
        data = f"deltas/{uuid.uuid4().hex}"
        delta = changes.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs != 0 OR tokens != 0")
        delta.write.parquet(f"{self.folder}/{data}")
        while True:
            version = self._next()  # first, so that a batch committed in between takes this number or is seen
            if batch_id in self.batches():
                self.fs.delete(self._path(data), True)
                return False
            if self._publish(version, {"batches": [batch_id], "data": data}):
                return True

    def totals(self) -> DataFrame:
        """KEYS, docs, tokens: sums over all committed batches, without keys that have neither."""
        return self._sum([e["data"] for e in self.log()])

    def _sum(self, data: list[str]) -> DataFrame:
        if not data:
            return self.spark.createDataFrame([], DELTA)
        deltas = self.spark.read.schema(DELTA).parquet(*[f"{self.folder}/{d}" for d in data])
        return deltas.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs != 0 OR tokens != 0")

    def compact(self) -> bool:
        """Fold all committed deltas into one; False if another writer committed meanwhile (try again) or nothing is there."""
        version, entries = self._next(), self.log()
        if not entries:
            return False
        data = f"deltas/{uuid.uuid4().hex}"
        self._sum([e["data"] for e in entries]).write.parquet(f"{self.folder}/{data}")
        if not self._publish(version, {"batches": [b for e in entries for b in e["batches"]], "data": data, "compacted": True}):
            self.fs.delete(self._path(data), True)
            return False
        name = f".{uuid.uuid4().hex}.tmp"
        stream = self.fs.create(self._path(f"log/{name}"), False)
        stream.write(bytearray(f"{version}\n".encode()))
        stream.close()
        self.fs.delete(self._path("log/compacted"), False)  # a hint: without it all entries are read
        self.fs.rename(self._path(f"log/{name}"), self._path("log/compacted"))
        return True

    def vacuum(self, seconds: float = 7 * 86400) -> int:
        """Delete entries before the last compaction, and temporary files and deltas that no entry since names, if they are
        older than `seconds`: longer than any reader or writer that may still use them runs. How many were deleted."""
        entries = self.log()
        first = entries[0]["version"] if entries else 0
        used = {e["data"] for e in entries}
        before = 1000 * (time.time() - seconds)
        gone = 0
        for folder in ("deltas", "log"):
            if not self.fs.exists(self._path(folder)):
                continue
            for status in self.fs.listStatus(self._path(folder)):
                name = status.getPath().getName()
                if folder == "deltas":
                    useless = f"deltas/{name}" not in used
                else:
                    useless = name.endswith(".tmp") or (name.endswith(".json") and name[:-5].isdigit() and int(name[:-5]) < first)
                if useless and status.getModificationTime() <= before:
                    gone += bool(self.fs.delete(status.getPath(), True))
        return gone
