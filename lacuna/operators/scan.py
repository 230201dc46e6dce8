"""What the rows before a row say, where one key may hold any number of rows.

Rows are dealt by (key, segment), and a segment holds a bounded stretch of the
order. Within one, a window runs; of each only its last values meet those of
the other segments of its key, and what they carry on is joined back. So a
key's rows are checked by as many tasks as it has segments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Places of a segment, where they are numbers.
SEGMENT = 100_000


def segment_of(rows: DataFrame, order: str) -> Column:
    """The default segment: a stretch of SEGMENT places; all rows in one where places are no numbers."""
    kind = dict(rows.dtypes)[order]
    numbers = ("tinyint", "smallint", "int", "bigint", "double", "float")
    return F.floor(F.col(order) / SEGMENT).cast("long") if kind in numbers or kind.startswith("decimal") else F.lit(0).cast("long")


def before(rows: DataFrame, key: str, order: str, *, previous: dict[str, Column] | None = None, known: dict[str, Column] | None = None, segment: Column | None = None) -> DataFrame:
    """``rows`` with, by name, values of the row before (``previous``) and the last non-null values of all rows before (``known``), null at a key's first row.

    ``segment`` must grow with the order; a null key is a key of its own. Rows
    at one place of a key have no order of their own.
    """
    previous, known = previous or {}, known or {}
    rows = rows.withColumn("_segment", segment if segment is not None else segment_of(rows, order))
    within = Window.partitionBy(key, "_segment").orderBy(order)
    last = F.struct(*[c.alias(n) for n, c in previous.items()], F.lit(1).alias("_is"))
    earlier = within.rowsBetween(Window.unboundedPreceding, -1)
    inner = {"_previous": F.lag(last).over(within), **{f"_known_{n}": F.last(c, ignorenulls=True).over(earlier) for n, c in known.items()}}
    out = rows.withColumns(inner)
    ends = rows.groupBy(key, "_segment").agg(F.max_by(last, order).alias("_end"), *[F.max_by(c, F.when(c.isNotNull(), F.col(order))).alias(f"_end_{n}") for n, c in known.items()])
    along = Window.partitionBy(key).orderBy("_segment")
    until = along.rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(F.col(key).alias("_key"), F.col("_segment").alias("_at"), F.lag("_end").over(along).alias("_end"), *[F.last(f"_end_{n}", ignorenulls=True).over(until).alias(f"_end_{n}") for n in known])
    # A key's first segment has nothing before it, so that short keys have no row here.
    out = out.join(carried.where("_end is not null"), F.col(key).eqNullSafe(F.col("_key")) & F.col("_segment").eqNullSafe(F.col("_at")), "left")
    ready = F.coalesce("_previous", "_end")
    out = out.withColumns({**{n: ready[n] for n in previous}, **{n: F.coalesce(f"_known_{n}", f"_end_{n}") for n in known}})
    return out.drop("_segment", "_previous", "_key", "_at", "_end", *[f"_known_{n}" for n in known], *[f"_end_{n}" for n in known])


def first_of(rows: DataFrame, keys: list[str], order: str, value: Column, name: str) -> DataFrame:
    """``rows`` with, where an earlier row has the same keys, the ``value`` of the first such row.

    Rows of a key are counted by partial aggregates; only keys that repeat are
    joined back, by a join that Spark can split where one key has many rows.
    """
    own = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    firsts = rows.groupBy(*own).agg(F.min(order).alias("_first"), F.min_by(value, F.col(order)).alias("_value"), F.count("*").alias("_times")).where("_times > 1")
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    out = rows.join(firsts, same, "left").withColumn(name, F.when(F.col(order) > F.col("_first"), F.col("_value")))
    return out.drop("_first", "_value", "_times", *[f"_k{i}" for i in range(len(keys))])
