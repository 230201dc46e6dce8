"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm.session import materialize, release


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 31))).first())


def _least(pairs: DataFrame) -> DataFrame:
    """Each pair (u, v) with m, the least node among u and what u meets."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(least, "u")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node that links reach, for every node of ``edges(u, v)``.

    Loops and repeated edges are allowed. Every round is two aggregations with
    map-side combine; rounds grow with the logarithm of the longest path.
    """
    edges = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = _state(edges)
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = _least(large)
        small = least.select("u", F.col("m").alias("v")).unionAll(least.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        old, edges = edges, materialize(small.where("u <> v").distinct())
        release(old)
        before, state = state, _state(edges)
        if before == state:
            roots = edges.select(F.col("v").alias("node")).distinct()
            return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionAll(roots.select("node", F.col("node").alias("component")))
