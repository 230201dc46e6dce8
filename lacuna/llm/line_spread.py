"""Line deduplication by distinct-site spread, in DataFrame operations only.

A line that many sites carry is boilerplate. A HyperLogLog sketch of each
line's sites is built map-side and merged; lines whose estimate is near the
threshold get an exact distinct count; the rest follow their estimate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.llm.session import BROADCAST_KEYS, join_keys, materialize, read

#: Sites from which on a line is boilerplate; log2 of a sketch's registers; the estimate's error that is counted exactly.
SITES, REGISTERS, ERROR = 10, 12, 0.1


def _key(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def _lines(docs: DataFrame) -> DataFrame:
    lines = docs.where("_site is not null").select("_site", F.explode(F.split("_text", "\n")).alias("line"))
    return lines.where(F.trim("line") != "").select("_site", _key(F.col("line")).alias("key"))


def boilerplate(docs: DataFrame, sites: int = SITES) -> DataFrame:
    """Keys of the lines that at least ``sites`` sites carry, of ``docs(_site, _text)``."""
    lines = _lines(docs)
    spread = lines.groupBy("key").agg(F.hll_sketch_agg("_site", REGISTERS).alias("sketch")).select("key", F.hll_sketch_estimate("sketch").alias("about"))
    spread = materialize(spread.where(F.col("about") >= sites * (1 - ERROR) - 1))
    near = spread.where(F.col("about") <= sites * (1 + ERROR) + 1).select("key")
    exact = join_keys(lines, near, "key", "left_semi").distinct().groupBy("key").count().where(F.col("count") >= sites).select("key")
    return materialize(spread.where(F.col("about") > sites * (1 + ERROR) + 1).select("key").unionAll(exact))


def remove_boilerplate(docs: DataFrame, *, text_col: str = "text", site_col: str = "source", sites: int = SITES) -> DataFrame:
    """``docs`` with boilerplate lines removed, and columns n_lines and n_removed (replaced if ``docs`` has them).

    Lines are compared without spaces around them; blank lines are never
    removed. A document all of whose lines are boilerplate is a copy of a whole
    page, which near-duplicate removal decides about; it keeps its lines. A row
    without a site counts for no site but loses boilerplate like others. A null
    text stays null with 0 lines. Repeated rows are treated alike.
    """
    own = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    # Columns of docs stay inside one struct, so that none can clash with those made here.
    others = [c for c in own if c != text_col]
    rows = docs.select(F.struct(*others).alias("doc") if others else F.lit(True).alias("doc"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("row"))
    flagged = boilerplate(docs.select(F.col(site_col).cast("string").alias("_site"), F.col(text_col).alias("_text")), sites)
    hits = rows.select("row", F.explode(F.transform(F.split("text", "\n"), _key)).alias("key"))
    # Which boilerplate a text has. Texts of one hash may share, as every key here is boilerplate.
    found = materialize(join_keys(hits, flagged, "key", "left_semi").groupBy("row").agg(F.collect_set("key").alias("keys")))
    held = found.agg(F.coalesce(F.sum(F.size("keys") + 4), F.lit(0))).first()[0]
    rows = rows.join(F.broadcast(found) if held <= BROADCAST_KEYS else found, "row", "left")
    split = F.split("text", "\n")
    stays = F.filter(split, lambda x: (F.trim(x) == "") | ~F.array_contains("keys", _key(x)))
    kept = F.when(F.col("keys").isNull() | ~F.exists(stays, lambda x: F.trim(x) != ""), split).otherwise(stays)
    rows = rows.select("doc", "text", kept.alias("kept"))
    text = F.when(F.size("kept") == F.size(split), F.col("text")).otherwise(F.array_join("kept", "\n"))
    n_lines = F.coalesce(F.when(F.col("text").isNull(), 0).otherwise(F.size(split)), F.lit(0)).cast("long")
    n_removed = F.when(F.col("text").isNull(), 0).otherwise(F.size(split) - F.size("kept")).cast("long")
    return rows.select(*[(text if c == text_col else F.col("doc")[c]).alias(c) for c in own], n_lines.alias("n_lines"), n_removed.alias("n_removed"))


def op10_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without cross-site boilerplate lines: counts of lines, and MD5 of the text that is left."""
    out = remove_boilerplate(read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "n_lines", "n_removed", F.md5(F.encode("text", "utf-8")).alias("text_md5"))


ORACLE = f"""
WITH l AS (SELECT source, trim(unnest(string_split(text, chr(10)))) AS line FROM documents WHERE source IS NOT NULL),
f AS (SELECT line FROM l WHERE line <> '' GROUP BY line HAVING count(DISTINCT source) >= {SITES}),
k AS (SELECT coalesce(list(line), []) AS keys FROM f),
d AS (SELECT doc_id, text, string_split(text, chr(10)) AS own FROM documents),
s AS (SELECT doc_id, text, own, list_filter(own, lambda x: trim(x) = '' OR NOT list_contains(keys, trim(x))) AS stays FROM d, k),
e AS (SELECT doc_id, text, own, CASE WHEN len(list_filter(stays, lambda x: trim(x) <> '')) = 0 THEN own ELSE stays END AS kept FROM s)
SELECT doc_id, coalesce(len(own), 0)::BIGINT AS n_lines, coalesce(len(own) - len(kept), 0)::BIGINT AS n_removed,
       md5(array_to_string(kept, chr(10))) AS text_md5
FROM e
"""
