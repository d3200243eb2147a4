"""Tables written once into the folder that all machines share, and dense numbering over them."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of its own only where that is unset, as in tests.

    A folder of this machine's own serves a local session only; on a cluster an unset one is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-slipcoach-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def place(spark: SparkSession, label: str) -> str:
    return f"{folder(spark)}/{label}-{uuid.uuid4().hex}"


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_lock, _asked, _cleaning = threading.Lock(), {}, {}


@contextmanager
def _small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most so many rows; of saves that run side by side in a session the smallest counts, the last one sets it back."""
    with _lock:
        before, held = _asked.setdefault(id(spark), (spark.conf.get(_BATCH), []))
        held.append(rows)
        spark.conf.set(_BATCH, min(held))
    try:
        yield
    finally:
        with _lock:
            held.remove(rows)
            spark.conf.set(_BATCH, min(held) if held else before)
            if not held:
                del _asked[id(spark)]


@contextmanager
def _cleaned(spark: SparkSession) -> Iterator[None]:
    """Spark deletes the shuffle files of what is written meanwhile as soon as it is written; else they stay until the driver collects its garbage."""
    with _lock:
        before, n = _cleaning.get(id(spark), (spark.conf.get(_CLEANUP, "false"), 0))
        _cleaning[id(spark)] = before, n + 1
        spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        with _lock:
            before, n = _cleaning.pop(id(spark))
            if n > 1:
                _cleaning[id(spark)] = before, n - 1
            else:
                spark.conf.set(_CLEANUP, before)


def save(df: DataFrame, label: str, batch_rows: int = 1000) -> DataFrame:
    """Writes df as Parquet and returns the table read back: the lineage ends here.

    batch_rows: rows of an Arrow batch on the way through Python, so that long texts do not fill a worker's memory.
    """
    path = place(df.sparkSession, label)
    with _small_batches(df.sparkSession, batch_rows), _cleaned(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def drop(*tables: DataFrame) -> None:
    """Deletes the files of tables made by save() that nothing reads any more."""
    for df in tables:
        remove(df.sparkSession, df._scratch_path)


def numbered(df: DataFrame, order: list[Column], name: str, start: int = 1, keep: Sequence[str] | None = None) -> DataFrame:
    """df with dense numbers start, start+1, ... in the given total order, without a single-task window.

    keep: the columns that are still wanted once the order is known, all if none are named.

    Rows are dealt by range and sorted; monotonically_increasing_id then holds the partition and the place in it, and
    only one count a partition is summed up on the way. The numbered rows are saved first, so a rerun cannot deal anew.
    """
    at = F.monotonically_increasing_id()
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", at)
    dealt = save(placed.select(*keep, "__at") if keep else placed, "numbered")
    dealt = dealt.withColumn("__part", F.shiftright("__at", 33)).withColumn("__row", F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = dealt.groupBy("__part").agg((F.max("__row") + 1).alias("__held"))
    before = sizes.selectExpr("__part", "sum(__held) OVER (ORDER BY __part) - __held AS __before")  # a row for each partition
    return dealt.join(F.broadcast(before), "__part").withColumn(name, F.col("__before") + F.col("__row") + start).drop("__at", "__part", "__row", "__before")
