"""The readers of artifact files by name: how each reads a path, and in what order its rows are written out."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.sources import amcache, mft, prefetch, registry


@dataclass(frozen=True)
class Adapter:
    read: Callable[[SparkSession, str], DataFrame]
    order: tuple[str, ...]
    #: What of an export says how it was read: columns whose different values are listed.
    listed: tuple[str, ...] = ()


ADAPTERS = {
    "mft": Adapter(mft.read_mft, ("path", "expected_record_number")),
    "prefetch": Adapter(prefetch.read_prefetch, ("path",), ("container",)),
    "amcache": Adapter(amcache.read_amcache, ("hive", "section", "key_path"), ("section",)),
    "shimcache": Adapter(registry.read_application_cache, ("hive", "raw_offset", "path"), ("parse_method", "control_set")),
    "shellbags": Adapter(registry.read_folder_bags, ("hive", "key_path", "raw_value_name"), ("bag_type",)),
}


def distinct_values(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row: the different values of each column, sorted, without nulls and empty texts."""
    return rows.agg(*[F.array_sort(F.collect_set(F.when(F.col(c) != "", F.col(c)))).alias(c) for c in columns])


def incomplete(rows: DataFrame) -> Column:
    """Whether a row stands for something that was not, or not wholly, read."""
    out = F.col("error").isNotNull()
    return out | F.coalesce("degraded", F.lit(False)) if "degraded" in rows.columns else out
