"""Prefetch files: container, digest and name in SQL; run data by an optional decoder."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal
from io import BytesIO
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.functions.binary import container, filetime, zero_filled
from lacuna.functions.names import prefetch_parts

# Fixed value: how many run times a file has room for.
SLOTS = 8
RUN = "content_hash string, run_count long, run_ticks array<decimal(20,0)>, n_filenames long, volume_serial long, volume_path string, decode_error string"


def library(content: bytes) -> dict[str, Any]:
    """Run data of a file by the optional decoder; what it can't give is left out."""
    import pyscca

    file = pyscca.file()
    file.open_file_object(BytesIO(content))

    def get(call: Callable[..., Any], *args: Any) -> Any:
        try:
            return call(*args)
        except Exception:
            return None

    try:
        number = get(file.get_prefetch_hash)
        volume = get(file.get_volume_information, 0) if get(file.get_number_of_volumes) else None
        return {
            "content_hash": f"{number:08X}" if isinstance(number, int) else None,
            "run_count": get(file.get_run_count),
            "run_ticks": [get(file.get_last_run_time_as_integer, k) for k in range(SLOTS)],
            "n_filenames": get(file.get_number_of_filenames),
            "volume_serial": get(volume.get_serial_number) if volume else None,
            "volume_path": get(volume.get_device_path) if volume else None,
        }
    finally:
        file.close()


def _decoder(decode: Callable[[bytes], dict[str, Any]]):
    names = [c.split()[0] for c in RUN.split(", ")]

    @F.pandas_udf(f"struct<{RUN.replace(' ', ':').replace(',:', ', ')}>")
    def run(contents: pd.Series) -> pd.DataFrame:
        rows = []
        for content in contents:
            row = dict.fromkeys(names)
            try:
                row |= decode(bytes(content))
                row["run_ticks"] = [Decimal(t) for t in row["run_ticks"] or [] if isinstance(t, int) and t > 0]
            except ModuleNotFoundError:
                row["decode_error"] = "no decoder is installed"
            except Exception as e:
                row["decode_error"] = f"{type(e).__name__}: {str(e)[:200]}"
            rows.append(row)
        return pd.DataFrame(rows, columns=names)

    return run


def latest_run(ticks: Column) -> Column:
    """Time of the latest of a file's run times; null without any."""
    return filetime(F.array_max(F.filter(ticks, lambda t: t > 0)))


def describe(files: DataFrame, decode: Callable[[bytes], dict[str, Any]] = library) -> DataFrame:
    """files(path, length, content) with container, digest, name parts, run data, status and error.

    Only files with a known container are decoded. One that is not, as no
    decoder is installed, is degraded and not failed; its run data are null.
    """
    name = F.element_at(F.split("path", "/"), -1)
    executable, name_hash = prefetch_parts(name)
    kind = container(F.substring("content", 1, 8))
    out = files.select("path", "content", F.length("content").cast("long").alias("size_bytes"), F.sha2("content", 256).alias("sha256"), executable.alias("executable"), name_hash.alias("name_hash"), kind.alias("container"), zero_filled(F.col("content")).alias("zeros"))
    out = out.withColumn("container", F.when((F.col("container") == "UNKNOWN") & F.col("zeros"), "ZERO_FILLED").otherwise(F.col("container"))).drop("zeros")
    error = F.when(F.col("size_bytes") == 0, "empty file").when(F.col("container") == "ZERO_FILLED", "only zero bytes").when(F.col("container") == "UNKNOWN", "not a prefetch file")
    out = out.withColumn("error", error)
    good = out.where("error is null").withColumn("run", _decoder(decode)("content"))
    both = good.unionByName(out.where("error is not null"), allowMissingColumns=True).drop("content")
    missing = F.col("run.decode_error") == "no decoder is installed"
    fields = [F.col(f"run.{c.split()[0]}") for c in RUN.split(", ")[:-1]]
    out = both.select("*", *fields, latest_run(F.col("run.run_ticks")).alias("last_run"), F.coalesce(missing, F.lit(False)).alias("degraded"))
    return agreement(out.withColumn("error", F.coalesce("error", F.when(~missing, F.col("run.decode_error"))))).drop("run")


def agreement(rows: DataFrame) -> DataFrame:
    """The hash of the file name against that of the content, where both are known."""
    same = F.when(F.col("name_hash").isNotNull() & F.col("content_hash").isNotNull(), F.upper("name_hash") == F.upper("content_hash"))
    return rows.withColumn("hash_agrees", same)


def read_prefetch(spark: SparkSession, path: str, decode: Callable[[bytes], dict[str, Any]] = library) -> DataFrame:
    """Prefetch files of a folder, or one file."""
    return describe(spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][fF]").load(path), decode)
