"""Session helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from contextlib import suppress
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.session import run_once, shared_folder

#: The part of the driver's heap that may be taken, garbage included, before a table is written.
HEAP = 0.25
#: Bytes of a batch of rows that goes to a Python worker. Spark's own bound, 10,000 rows, is tens of MB of texts, held twice by the JVM and again by the worker.
BATCH = "2m"
#: Rows of one long column that may be broadcast (8 MB of keys); above it a shuffled join is used.
BROADCAST_KEYS = 1_000_000


def _place(spark: SparkSession, path: str):
    """(Hadoop path, its file system)."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back. The files go by ``release``, or when the application ends."""
    spark = df.sparkSession
    small_batches(spark)
    collect(spark)
    path = f"{shared_folder(spark)}/lacuna-{uuid.uuid4().hex}"
    with run_once(spark):
        df.write.parquet(path)
    place, system = _place(spark, path)
    system.deleteOnExit(place)
    out = spark.read.schema(df.schema).parquet(path)
    out._lacuna_path = path
    return out


def small_batches(spark: SparkSession) -> None:
    """Bound the batches that go to Python workers by their bytes, from now on: plans run after their operator has returned."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)


def collect(spark: SparkSession) -> None:
    """Collect the driver's garbage once it has taken a part of the heap.

    Many small jobs leave plans and metrics behind. A heap rather grows to its
    limit than collects them, and a full collection lets it shrink again.
    """
    heap = spark._jvm.java.lang.Runtime.getRuntime()
    if heap.totalMemory() - heap.freeMemory() > HEAP * heap.maxMemory():
        spark._jvm.System.gc()


def drop_shuffles(spark: SparkSession) -> None:
    """Have Spark drop the shuffle files of plans that are gone, and give freed memory back.

    Spark does so when the driver's garbage is collected, which a driver with
    little garbage does too seldom for executors' disks.
    """
    spark._jvm.System.gc()
    give_back()


def release(*tables: DataFrame) -> None:
    """Delete materialized tables that no plan reads any more, and drop the shuffle files of plans that are gone."""
    for table in tables:
        place, system = _place(table.sparkSession, table._lacuna_path)
        system.delete(place, True)
    for table in tables[:1]:
        drop_shuffles(table.sparkSession)


def give_back() -> None:
    """Return memory that this process has freed to the system."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def lean(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The same function of a task's batches, which at its end gives memory back: workers live on, and each would keep the most that it ever needed."""

    @wraps(work)
    def run(batches: Iterator) -> Iterator:
        yield from work(batches)
        give_back()

    return run


def join_keys(big: DataFrame, keys: DataFrame, on: str, how: str) -> DataFrame:
    """Join a wide table with a materialized key table; broadcast the keys only when they are few enough."""
    if keys.count() <= BROADCAST_KEYS:
        keys = F.broadcast(keys)
    return big.join(keys, on, how)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
