"""Timeline files of 17 columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.operators.numbering import numbered
from lacuna.operators.timeline import COLUMNS

#: Bytes of a file, at most.
MOST_BYTES = 500_000_000


def read_timeline(spark: SparkSession, path: str) -> DataFrame:
    """Rows with row_num (from 1, over non-blank records, by file order) and bad_record, the text of a record with another number of fields."""
    header = spark.read.csv(path, header=True, multiLine=True).columns
    if absent := missing_columns(header):
        raise ValueError(f"the file has no columns {', '.join(absent)}")
    schema = ", ".join(f"`{c}` string" for c in header) + ", bad_record string"
    rows = spark.read.schema(schema).csv(path, header=True, multiLine=True, mode="PERMISSIVE", columnNameOfCorruptRecord="bad_record", escape='"')
    return numbered(rows, "row_num").select(*COLUMNS, "bad_record", "row_num")


def check_size(spark: SparkSession, path: str, most: int = MOST_BYTES) -> None:
    """Refuses files that are too large; only their sizes are read."""
    large = spark.read.format("binaryFile").load(path).where(F.col("length") > most).select("path", "length").first()
    if large:
        raise ValueError(f"{large['path']} has {large['length']} bytes; {most} are allowed")


def missing_columns(header: list[str]) -> list[str]:
    return [c for c in COLUMNS if c not in header]
