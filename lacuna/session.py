"""Spark session defaults and shipping of this package to executors."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent
#: Whether Spark deletes the shuffle files of a plan as soon as it has run.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: What the operators rely on: UTC timestamps, last value wins for a repeated map key, adaptive plans.
CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.adaptive.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in CONF.items():
        spark.conf.set(key, value)
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_lacuna_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="lacuna-code-")
    archive = os.path.join(folder, "lacuna.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(ROOT.rglob("*.py")):
            out.write(path, path.relative_to(ROOT.parent))
    sc.addPyFile(archive)
    sc._lacuna_shipped = True


def session(name: str = "lacuna", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    # Noting the call site of every column operation takes longer than planning where expressions are large.
    for key, value in {**CONF, "spark.python.sql.dataFrameDebugging.enabled": "false", **conf}.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir. A private one is made only where all run in this process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="lacuna-checkpoint-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


@contextmanager
def run_once(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs within go at its end. Else they stay until the driver's garbage is collected, which may be after the next step has written its own."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def materialized(rows: DataFrame) -> DataFrame:
    """``rows`` written to the shared folder and read back, so that what made them runs once. The files go when the application ends."""
    spark = rows.sparkSession
    path = f"{shared_folder(spark)}/lacuna-{uuid.uuid4().hex}"
    with run_once(spark):
        rows.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(rows.schema).parquet(path)
