"""Documents of a collector that takes stock of a machine: event counts and what could not be collected.

Counts may be lower bounds, and a query that failed is not a count of zero.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COUNT = "struct<status:string,count:bigint,count_is_lower_bound:boolean>"
SCHEMA = (
    "run_id string, collection_started_utc string, collection_finished_utc string, analysis_interval_utc struct<start:string,end:string>, "
    f"platform struct<caption:string,build_number:string,edition_id:string,display_version:string>, security_event_counts map<string,{COUNT}>, collection_errors array<struct<source:string,message:string>>"
)


def read_baselines(spark: SparkSession, path: str) -> DataFrame:
    """One row for each document; bad_document is the text of one that can't be read."""
    schema = f"{SCHEMA}, bad_document string"
    return spark.read.schema(schema).json(path, multiLine=True, mode="PERMISSIVE", columnNameOfCorruptRecord="bad_document").withColumn("path", F.col("_metadata.file_path"))


def event_counts(baselines: DataFrame) -> DataFrame:
    """(path, run_id, event_id, status, count, count_is_lower_bound, usable): usable says whether the count is exact."""
    rows = baselines.select("path", "run_id", F.explode("security_event_counts").alias("event_id", "c"))
    usable = (F.col("c.status") == "queried") & ~F.coalesce("c.count_is_lower_bound", F.lit(False))
    return rows.select("path", "run_id", F.col("event_id").cast("int").alias("event_id"), "c.*", usable.alias("usable"))


def collection_errors(baselines: DataFrame) -> DataFrame:
    return baselines.select("path", "run_id", F.explode("collection_errors").alias("e")).select("path", "run_id", "e.*")
