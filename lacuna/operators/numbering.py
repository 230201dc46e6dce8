"""Numbers of rows over all partitions without a window over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.session import materialized

#: Bits of monotonically_increasing_id() that count rows within a partition.
WITHIN = 33


def _counted(own: DataFrame, name: str, first: int) -> DataFrame:
    """Rows with _at, their number within a partition and that of the partition, with their number over all."""
    own = own.withColumn("_part", F.shiftright("_at", WITHIN))
    counts = {r["_part"]: r["count"] for r in own.groupBy("_part").count().collect()}
    before, starts = first, []
    for part in sorted(counts):
        starts.append((part, before))
        before += counts[part]
    starts_ = own.sparkSession.createDataFrame(starts, "_part long, _first long")
    out = own.join(F.broadcast(starts_), "_part")
    return out.withColumn(name, F.col("_first") + (F.col("_at") - F.shiftleft("_part", WITHIN))).drop("_at", "_part", "_first")


def numbered(rows: DataFrame, name: str, first: int = 1) -> DataFrame:
    """``rows`` with their number in order of partitions. Each partition counts its own rows; only those counts meet.

    The rows must come in the same partitions each time they are read, as those
    of files do.
    """
    return _counted(rows.withColumn("_at", F.monotonically_increasing_id()), name, first)


def ranked(rows: DataFrame, order: list[Column | str], name: str, first: int = 1) -> DataFrame:
    """``rows`` with their number in an order. They are dealt by ranges of it and sorted within them, and kept so: ranges come from a sample, which another run may draw anew.

    Rows that are equal in the order have no order of their own.
    """
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    return _counted(materialized(placed), name, first)
