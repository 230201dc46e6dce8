"""Registry hives as rows of keys and values.

The format is read by an optional library. Where it is missing, or a hive can't
be opened, the hive is one row with an error, and none of its values is guessed.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator
from io import BytesIO

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: key_path is relative to the root; a key has one row without a value name, then one for each value. ``value`` is what is stored if that is binary, ``text`` its written form.
SCHEMA = "hive string, ordinal long, key_path string, value_name string, value binary, text string, written timestamp, error string"

#: (key_path, written, [(name, stored value)]) of every key of a hive, parents first.
Keys = Iterator[tuple[str, "dt.datetime | None", list[tuple[str, object]]]]


def library(content: bytes) -> Keys:
    """All keys by the optional library; what of a hive can't be read is left out."""
    from Registry import Registry

    stack = [(Registry.Registry(BytesIO(content)).root(), "")]
    while stack:
        key, at = stack.pop()
        values = []
        for value in key.values():
            try:
                values.append((value.name(), value.value()))
            except Exception:
                values.append((value.name(), None))
        yield at, key.timestamp(), values
        stack += [(k, f"{at}\\{k.name()}".lstrip("\\")) for k in reversed(key.subkeys())]


def values(files: DataFrame, reader: Callable[[bytes], Keys] = library) -> DataFrame:
    """files(path, content) to the rows of their hives, in the hives' order. A hive is read by one task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                rows: list[tuple] = []
                try:
                    for key, written, own in reader(bytes(content)):
                        at = pd.Timestamp(written, tz="UTC") if written is not None and written.tzinfo is None else written
                        rows.append((path, len(rows), key, None, None, None, at, None))
                        for name, stored in own:
                            raw = bytes(stored) if isinstance(stored, bytes | bytearray) else None
                            rows.append((path, len(rows), key, name, raw, None if raw is not None or stored is None else str(stored), at, None))
                except ModuleNotFoundError:
                    rows = [(path, 0, "", None, None, None, None, "no reader of registry hives is installed")]
                except Exception as e:
                    rows.append((path, len(rows), "", None, None, None, None, f"the hive cannot be read: {type(e).__name__}: {str(e)[:200]}"))
                out = pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])
                out["written"] = pd.to_datetime(out["written"], utc=True)
                yield out

    return files.select("path", "content").mapInPandas(run, SCHEMA)


def read(spark: SparkSession, path: str, reader: Callable[[bytes], Keys] = library) -> DataFrame:
    return values(spark.read.format("binaryFile").load(path), reader)


def failed(keys: DataFrame) -> DataFrame:
    """(hive, error) of hives that could not be read, wholly or to the end."""
    return keys.where(F.col("error").isNotNull()).select("hive", "error")


def readable(keys: DataFrame) -> DataFrame:
    """(hive) of those that were read to the end, each once."""
    return keys.groupBy("hive").agg(F.count("error").alias("errors")).where("errors = 0").select("hive")
