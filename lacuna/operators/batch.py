"""Batches of inputs: limits, outcomes, collisions, digests of folders and sources, reports."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lacuna.operators.numbering import ranked


def limited(items: DataFrame, order: list[str], limit: int) -> DataFrame:
    """items(source, invalid, ...) with processed: whether an item is among the first of its source."""
    rank = F.row_number().over(Window.partitionBy("source").orderBy(*order))
    return items.withColumn("processed", rank <= limit)


def outcomes(sources: DataFrame, items: DataFrame) -> DataFrame:
    """Per source: items there, items processed, invalid ones, and status. Nothing there is a failure; left-out or invalid items make it partial."""
    used = F.col("processed")
    counted = items.groupBy("source").agg(F.count("*").alias("available"), F.count_if(used).alias("processed"), F.count_if(used & F.col("invalid")).alias("invalid"))
    both = sources.join(counted, "source", "left")
    partial = (F.col("invalid") > 0) | (F.col("available") > F.col("processed")) | (F.col("processed") == 0)
    status = F.when(F.col("available").isNull(), "failed").when(partial, "partial").otherwise("ok")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return both.select("source", zero("available"), zero("processed"), zero("invalid"), status.alias("status"))


def summary(rows: DataFrame) -> DataFrame:
    return rows.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("ok", "partial", "failed")], F.sum(F.col("available") - F.col("processed")).alias("items_left_out"))


def report(rows: DataFrame, limit: int | None = None) -> DataFrame:
    """Positions, problems first, then in order of source; no limit gives all, numbered by ranges of that order."""
    order = [F.col("status") == "ok", F.col("source")]
    if limit is None:
        return ranked(rows.select("source", "status"), order, "position").select("position", "source", "status")
    return rows.orderBy(*order).limit(limit).select(F.row_number().over(Window.orderBy(*order)).alias("position"), "source", "status")


def collisions(rows: DataFrame) -> DataFrame:
    """Outputs that more than one input would write."""
    return rows.groupBy("output").agg(F.count("*").alias("inputs")).where("inputs > 1")


def tree_digest(rows: DataFrame, folder: str, name: str, line: str) -> DataFrame:
    """Digest of each folder's lines in order of name, and the number of files. Lines stream through the digest in sorted order; no folder is held whole."""

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, digest, count = None, None, 0
        for frame in frames:
            done = []
            for key, text in zip(frame[folder], frame[line], strict=True):
                key = None if pd.isna(key) else key
                if digest is None or key != at:
                    if digest is not None:
                        done.append((at, digest.hexdigest(), count))
                    at, digest, count = key, hashlib.sha256(), 0
                count += 1
                digest.update((text or "").encode())
            yield pd.DataFrame(done, columns=[folder, "tree_sha256", "file_count"])
        if digest is not None:
            yield pd.DataFrame([(at, digest.hexdigest(), count)], columns=[folder, "tree_sha256", "file_count"])

    own = rows.select(folder, name, line)
    return own.repartition(folder).sortWithinPartitions(folder, name, line).mapInPandas(fold, f"`{folder}` {dict(own.dtypes)[folder]}, tree_sha256 string, file_count long")


def rehash(recorded: DataFrame, now: DataFrame, key: str) -> DataFrame:
    """Recorded digests against those of now: same, changed or missing."""
    state = F.when(F.col("now").isNull(), "missing").when(F.col("now") == F.col("recorded"), "same").otherwise("changed")
    return recorded.join(now, key, "left").select(key, state.alias("state"))


def capped_counts(rows: DataFrame, by: str, most: int) -> DataFrame:
    """Rows of each kind, at most so many, and whether the number is only a lower bound."""
    return rows.groupBy(by).agg(F.least(F.count("*"), F.lit(most)).alias("n"), (F.count("*") >= most).alias("lower_bound"))
