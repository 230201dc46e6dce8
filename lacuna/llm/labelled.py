"""A bounded, reproducible sample of labelled documents for training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.llm.session import materialize

#: Labelled documents that are learned from, at most.
SAMPLE = 4000
#: Tasks that make features of the sample.
TASKS = 16


def fold(column: str, parts: int) -> Column:
    """crc32 of a number's text modulo ``parts``; null for null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % parts


def labelled(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, rows: int = SAMPLE) -> DataFrame:
    """(doc_id, key, text, y) of at most ``rows`` labelled documents, those with the least hash (``key``) of doc_id, texts whole.

    ``allowed`` says which doc_ids may be learned from. Repeated label rows
    count once, with the least label; rows without a label or id don't count.
    Of several texts under one id that with the least hash counts, once.
    Materialized, in ``TASKS`` parts.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & allowed)
    known = known.groupBy("doc_id").agg(F.min("y").alias("y"))
    chosen = F.broadcast(known.withColumn("key", F.xxhash64("doc_id")).orderBy("key", "doc_id").limit(rows))
    found = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(chosen, "doc_id")
    one = found.groupBy("doc_id").agg(F.first("key").alias("key"), F.min(F.struct(F.xxhash64("text"), "text"))["text"].alias("text"), F.first("y").alias("y"))
    return materialize(one.repartition(TASKS, "doc_id"))
