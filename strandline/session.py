"""Session plumbing: shipping this package to executors and finding the shared folder."""

from __future__ import annotations

import atexit
import ctypes
import hashlib
import io
import os
import tempfile
import time
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
#: Rows of an Arrow batch: rows here are whole texts, and Spark's default of 10,000 holds too many of them at once.
BATCH_ROWS = "2000"
#: And its bytes, of which Spark allows 64 MB: a worker holds a batch several times over.
BATCH_BYTES = "8m"


def ship_package(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once per application, and keep Arrow batches of texts small,
    unless the session states a size of its own."""
    sc = spark.sparkContext
    arrow = "spark.sql.execution.arrow"
    for name, default, own in ((f"{arrow}.maxRecordsPerBatch", "10000", BATCH_ROWS), (f"{arrow}.maxBytesPerBatch", "67108864b", BATCH_BYTES)):
        if spark.conf.get(name) == default:
            spark.conf.set(name, own)
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(root.rglob("*.py")):
            z.writestr(zipfile.ZipInfo(str(path.relative_to(root.parent))), path.read_bytes())
    data = buffer.getvalue()
    target = Path(tempfile.mkdtemp(prefix="strandline-")) / f"strandline_{hashlib.sha1(data).hexdigest()[:12]}.zip"
    target.write_bytes(data)
    sc.addPyFile(str(target))
    _SHIPPED.add(sc.applicationId)


_RELEASED = [0.0]


def release_memory(every: float = 1.0) -> None:
    """Give memory that is free, but still held by this process's allocators, back to the system. Texts of very uneven
    length leave hundreds of MB of it in a worker, which Spark keeps for later tasks. Does nothing more than once in
    `every` seconds."""
    now = time.monotonic()
    if now - _RELEASED[0] < every:
        return
    _RELEASED[0] = now
    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # other C libraries return it by themselves
        pass


def map_arrow(df: DataFrame, work, schema) -> DataFrame:
    """mapInArrow whose worker gives memory back between batches and at its end."""
    ship_package(df.sparkSession)

    def lean(batches):
        from strandline.session import release_memory

        for out in work(batches):
            yield out
            release_memory()
        release_memory(0)

    return df.mapInArrow(lean, schema)


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a local session gets a
    temporary one; a cluster, whose machines don't share theirs, an error."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not sc._jsc.sc().getCheckpointDir().isDefined():
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            sc.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='strandline-shared-')}")
        root = sc._jsc.sc().getCheckpointDir().get()
    return root.rstrip("/")


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) of Hadoop for a URI."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _remove(spark: SparkSession, path: str) -> None:
    try:
        fs, p = hadoop_path(spark, path)
        fs.delete(p, True)
    except Exception:  # the session may have ended; the folder then stays for whoever cleans the shared folder
        pass


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the shared one, removed when the driver's Python ends."""
    path = f"{shared_root(spark)}/strandline/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_folder(spark, name)}/data"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Successive:
    """A table that is written anew again and again, each time from the one before, which then goes."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.path = spark, name, ""

    def put(self, df: DataFrame) -> DataFrame:
        path = scratch_folder(self.spark, self.name)
        df.write.parquet(f"{path}/data")
        if self.path:
            _remove(self.spark, self.path)
        self.path = path
        return self.spark.read.schema(df.schema).parquet(f"{path}/data")


def join_large(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """left.join(right) of tables that both grow with the input, by sorting. Spark judges a table by its compressed files or
    shuffle, and by its rows before an explode, so that it would have tables of many times the limit broadcast by the driver."""
    return left.join(right.hint("merge"), on, how)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df, a read table, over all cores if it comes in fewer partitions than there are: a file of one row group is one
    task. Does nothing to tables of many files."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df._jdf.queryExecution().toRdd().getNumPartitions() >= cores else df.repartition(cores)


def local_session(app: str = "strandline", cores: int | None = None, **conf: str) -> SparkSession:
    """A session for tests and benches."""
    cores = cores or int(os.environ.get("BENCH_CPUS", "8"))
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    settings = {"spark.sql.shuffle.partitions": str(cores), "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "6g", "spark.driver.bindAddress": "127.0.0.1", "spark.driver.host": "127.0.0.1"}
    for k, v in (settings | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
