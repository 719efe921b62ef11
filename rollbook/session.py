"""Session settings the library relies on, and the shared scratch folder."""

from __future__ import annotations

import tempfile
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import AbstractContextManager, contextmanager

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings. Skewed join partitions are split even where the split
# costs an extra exchange: one hot id, school or NULL key must not end up in a
# single task.
ADAPTIVE = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}

# Set when a session is built: recording the Python line of every column
# expression takes longer than planning the query does.
AT_START = {"spark.python.sql.dataFrameDebugging.enabled": "false"}

TARGET_PARTITION_BYTES = 128 * 1024 * 1024
# Parquet is read compressed; a shuffled row is several times larger.
SHUFFLE_EXPANSION = 4


def tune(spark: SparkSession) -> SparkSession:
    """Apply the adaptive settings to a session; no other setting is touched."""
    for key, value in ADAPTIVE.items():
        spark.conf.set(key, value)
    return spark


def initial_partitions(input_bytes: int, at_least: int = 1) -> int:
    """Partitions that keep one shuffle block set near the target size.

    For the caller who knows how much a job reads: as the session's
    ``spark.sql.adaptive.coalescePartitions.initialPartitionNum`` it is where
    adaptive execution starts to coalesce. Queries never change the setting.
    """
    return max(at_least, -(-input_bytes * SHUFFLE_EXPANSION // TARGET_PARTITION_BYTES))


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see, named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder of this machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    sc = spark.sparkContext
    existing = sc.getCheckpointDir()
    if existing:
        return existing.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="rollbook-")
    sc.setCheckpointDir(folder)
    return folder


def new_shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` through a reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


# Shuffle files of a stored table's computation are of no use once it is stored.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


_lock = threading.Lock()
_held: dict[str, list[str | None]] = {}  # the settings before, once for each step at work
_stores: list[tuple[str, str | None]] = []  # paths and tables written by this process


@contextmanager
def held(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """Within this, a setting has ``value``; it is put back when the last of several threads leaves."""
    with _lock:
        befores = _held.setdefault(key, [])
        befores.append(befores[0] if befores else spark.conf.get(key, None))
        spark.conf.set(key, value)
    try:
        yield
    finally:
        with _lock:
            before = befores.pop()
            if befores:
                pass
            elif before is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, before)


def dropped_shuffles(spark: SparkSession) -> AbstractContextManager[None]:
    """Within this, a finished query's shuffle files are removed."""
    return held(spark, DROP_SHUFFLES, "true")


#: Bytes of an Arrow batch, which the executor and its Python worker hold several times.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> AbstractContextManager[None]:
    """Within this, rows go to Python workers in batches of about ``BATCH_BYTES`` at most, a
    longer row alone. Without it a batch of texts may be a whole partition.
    """
    return held(spark, _BATCH, str(BATCH_BYTES))


#: Seconds after which the driver's heap is collected again.
COLLECT_EVERY = 1.0
_collected = time.monotonic()


def collect_garbage(spark: SparkSession) -> None:
    """Let the driver's JVM collect what finished queries left, at most every second or so.

    Loops of many small queries leave plans and events faster than the heap is collected, so
    it grows to its limit though little of it lives; a full collection gives memory back.
    """
    global _collected
    with _lock:
        now = time.monotonic()
        due = now - _collected >= COLLECT_EVERY
        if due:
            _collected = now
    if due:
        spark.sparkContext._jvm.System.gc()


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back.

    Used where several later steps need the same table: it is computed once,
    survives lost executors, and its true size guides the choice of joins.
    """
    path = new_shared_path(df.sparkSession, label)
    _stores.append((path, None))
    with dropped_shuffles(df.sparkSession):
        df.write.parquet(path)
    collect_garbage(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, label: str, key: str, buckets: int | None = None) -> DataFrame:
    """Store a table that later steps join and group by ``key``, in buckets of it.

    Two such tables of one number of buckets (the session's number of shuffle partitions if
    not given) meet by their key without another shuffle. Rows of one key share a bucket.
    """
    spark = df.sparkSession
    count = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path, table = new_shared_path(spark, label), f"rollbook_{uuid.uuid4().hex}"
    _stores.append((path, table))
    with dropped_shuffles(spark):
        df.repartition(count, key).write.bucketBy(count, key).sortBy(key).option("path", path).saveAsTable(table)
    return spark.table(table)


def together(*steps: Callable[[], object]) -> list:
    """Results of steps that store tables of their own, run at the same time.

    Their jobs share the executors, so one phase's short last tasks do not keep the other
    waiting. The first error is raised once all have ended.
    """
    out: list = [None] * len(steps)
    errors: list[BaseException] = []

    def run(k: int) -> None:
        try:
            out[k] = steps[k]()
        except BaseException as error:
            errors.append(error)

    threads = [InheritableThread(target=run, args=(k,)) for k in range(len(steps))]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    if errors:
        raise errors[0]
    return out


@contextmanager
def stores(spark: SparkSession) -> Iterator[None]:
    """The owner of all tables stored inside: they are removed when it ends.

    Results must be written or collected before that.
    """
    with _lock:
        begin = len(_stores)
    try:
        yield
    finally:
        with _lock:
            mine, _stores[begin:] = _stores[begin:], []
        for path, table in mine:
            if table:
                spark.sql(f"DROP TABLE IF EXISTS {table}")
            folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
