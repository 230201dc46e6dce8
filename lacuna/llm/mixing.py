"""Mixing sources to target weights, in DataFrame operations only.

A source's documents in random order are a stream of words, read once more
from its start where the target exceeds it, and cut into blocks by the place
where each document begins. How many blocks of each source every output shard
takes is drawn by a splitting tree: a node with exact quotas of blocks by source
is split in two by a multivariate hypergeometric draw, as if its blocks were
shuffled and cut. A leaf is a shard; it draws its quotas from each source's permuted
blocks, disjoint from those of all other shards, and shuffles what they hold.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lacuna.llm.session import BROADCAST_KEYS, materialize, read

#: Weights of the sources in order, repeating; words of the mix to words there are; times that a document may be taken.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
#: Words of a block, blocks of a shard.
BLOCK, SHARD = 1 << 16, 64
#: Documents of a cell, about; levels of the tree between two tables.
CELL, LEVELS = 2000, 6
#: Changes every permutation and draw.
SEED = 17
#: A prime to permute blocks by.
PRIME = 2_147_483_647


def order_key(id_: Column, size: Column, seed: int = SEED) -> Column:
    """Text by which documents are in random order."""
    return F.md5(F.concat(F.coalesce(id_.cast("string"), F.lit("")), F.lit(":"), size.cast("string"), F.lit(f":{seed}")).cast("binary"))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, n_docs, number, target) of sizes(source, source_size, n_docs).

    The sources by code point, null last, take ``weights`` in turn. Together
    they share ``share`` times all words; none exceeds ``most`` times its own,
    and the excess is shared by weight among those below that. So targets are
    the lesser of a source's bound and a common level times its weight: sources
    reach their bound in order of bound to weight, and the level is what is
    left after those that do. The table of sources is small; its one window
    is over sources, not documents.
    """
    # All sources are one row here: a mix has as many as someone gave weights to.
    order = F.array_sort(F.collect_list(F.struct(F.col("source").isNull().alias("last"), "source", "source_size", "n_docs")))
    named = F.transform(order, lambda s, i: F.struct(s["source"].alias("source"), s["source_size"].alias("source_size"), s["n_docs"].alias("n_docs"), i.alias("number"), F.get(F.array(*[F.lit(float(w)) for w in weights]), i % len(weights)).alias("weight"), (F.lit(float(most)) * s["source_size"]).alias("most")))
    rows = sizes.agg(named.alias("s")).select(F.explode("s").alias("s")).select("s.*")
    by = Window.orderBy(F.col("most") / F.col("weight"), "number")
    below, rest = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    all_ = Window.orderBy("number").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("all", F.lit(float(share)) * F.sum("source_size").over(all_))
    rows = rows.withColumn("level", (F.col("all") - F.coalesce(F.sum("most").over(below), F.lit(0.0))) / F.sum("weight").over(rest))
    # The first source whose bound is above its level, and all after it, share that level.
    rows = rows.withColumn("level", F.min(F.when(F.col("level") * F.col("weight") <= F.col("most"), F.struct(F.col("most") / F.col("weight"), "number", "level"))).over(all_)["level"])
    return rows.select("source", "source_size", "n_docs", F.col("number").cast("int").alias("number"), F.least("most", F.coalesce(F.col("level") * F.col("weight"), F.col("most"))).alias("target"))


def drawn(total: Column, good: Column, draws: Column, u: Column) -> Column:
    """How many of ``good`` among ``total`` are in a random ``draws`` of them, for a random ``u`` in [0, 1).

    Hypergeometric by inversion: weights go from one count to the next by
    their ratio, within eight deviations of the mean (beyond lie less than
    1e-14 of all cases) and what is possible.
    """
    n, k, d = (c.cast("double") for c in (total, good, draws))
    mean = d * k / F.greatest(n, F.lit(1.0))
    spread = 8 * F.sqrt(mean * (n - k) / F.greatest(n, F.lit(1.0)) * (n - d) / F.greatest(n - 1, F.lit(1.0))) + 8
    least, most = F.greatest(F.lit(0.0), d + k - n), F.least(d, k)
    low = F.greatest(least, F.floor(mean - spread).cast("double")).cast("long")
    high = F.least(most, F.ceil(mean + spread).cast("double")).cast("long")
    counts = F.sequence(low, high)
    after = lambda w, x: w * (k - x) * (d - x) / ((x + 1) * (n - k - d + x + 1))
    start = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"))
    following = lambda acc, x: F.when(x < high, after(acc["w"], x.cast("double"))).otherwise(F.lit(0.0))
    whole = F.aggregate(counts, start, lambda acc, x: F.struct(following(acc, x).alias("w"), (acc["sum"] + acc["w"]).alias("sum")), lambda acc: acc["sum"])
    begin = F.struct(F.lit(1.0).alias("w"), (u * whole).alias("left"), low.alias("found"))
    # The count at which what is left of u's share is used up.
    step = lambda acc, x: F.struct(following(acc, x).alias("w"), (acc["left"] - acc["w"]).alias("left"), F.when(acc["left"] >= 0, x).otherwise(acc["found"]).alias("found"))
    return F.aggregate(counts, begin, step, lambda acc: acc["found"])


def _random(*what: Column) -> Column:
    return F.pmod(F.xxhash64(*what), F.lit(1 << 52)) / float(1 << 52)


def _split(level: DataFrame, blocks: int, shards: int, seed: int) -> DataFrame:
    """Both halves of each node (lo, hi, parts: source's number, its first block here, how many); nodes of one shard stay as they are."""
    edge = lambda shard: F.floor(shard * F.lit(blocks) / F.lit(shards)).cast("long")
    middle = F.floor((F.col("lo") + F.col("hi")) / 2)
    need, total = edge(middle) - edge(F.col("lo")), edge(F.col("hi")) - edge(F.col("lo"))
    kind = "array<struct<number:int,first:bigint,count:bigint>>"
    start = F.struct(need.alias("need"), total.alias("total"), F.array().cast("array<bigint>").alias("left"))

    def source(acc, part):
        got = drawn(acc["total"], part["count"], acc["need"], _random(F.col("lo"), F.col("hi"), part["number"], F.lit(seed)))
        return F.struct((acc["need"] - got).alias("need"), (acc["total"] - part["count"]).alias("total"), F.array_append(acc["left"], got).alias("left"))

    # An alias of its own, so that the draw is not made again for each use.
    ready = level.select("lo", "hi", "parts", F.when(F.col("hi") - F.col("lo") > 1, F.aggregate("parts", start, source, lambda acc: acc["left"])).alias("got"))
    left = F.zip_with("parts", "got", lambda p, g: F.struct(p["number"].alias("number"), p["first"].alias("first"), g.alias("count")))
    right = F.zip_with("parts", "got", lambda p, g: F.struct(p["number"].alias("number"), (p["first"] + g).alias("first"), (p["count"] - g).alias("count")))
    some = lambda parts: F.filter(parts, lambda p: p["count"] > 0).cast(kind)
    half = lambda lo, hi, parts: F.struct(lo.alias("lo"), hi.alias("hi"), parts.alias("parts"))
    both = F.array(half(F.col("lo"), middle, some(left)), half(middle, F.col("hi"), some(right)))
    nodes = F.when(F.col("got").isNull(), F.array(half(F.col("lo"), F.col("hi"), F.col("parts")))).otherwise(both)
    return ready.select(F.explode(nodes).alias("n")).select("n.*")


def quotas(sources: DataFrame, blocks: int, shards: int, seed: int = SEED) -> DataFrame:
    """(shard, number, first, count): how many blocks of a source a shard takes, and the first of them in the source's permuted order.

    ``sources`` has number and n_blocks, ``blocks`` together. Every shard takes
    ``blocks / shards`` of them, rounded down or up, every block goes to one
    shard.
    """
    parts = F.array_sort(F.collect_list(F.struct("number", F.lit(0).cast("long").alias("first"), F.col("n_blocks").alias("count"))))
    level = sources.where("n_blocks > 0").agg(parts.alias("parts")).select(F.lit(0).cast("long").alias("lo"), F.lit(shards).cast("long").alias("hi"), "parts")
    depth = math.ceil(math.log2(shards)) if shards > 1 else 0
    for k in range(depth):
        if k and k % LEVELS == 0:  # that many nodes are work for many tasks
            level = materialize(level.repartition(F.col("lo")))
        level = _split(level, blocks, shards, seed)
    return level.select(F.col("lo").alias("shard"), F.explode("parts").alias("p")).select("shard", "p.*")


def _permuted(block: Column, count: Column, number: Column, seed: int) -> Column:
    """The place of a block in its source's permuted order."""
    step = F.greatest(F.pmod(F.lit(PRIME), count), F.lit(1))
    return F.pmod(block * step + F.pmod(F.xxhash64(number, F.lit(seed)), count), count)


def mix(docs: DataFrame, *, id_col: str = "doc_id", size_col: str = "size", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, block: int = BLOCK, shard: int = SHARD, seed: int = SEED) -> DataFrame:
    """``docs`` with source_size, target, and draws: for each time a row is taken its pass, shard, place in it and words (replaced if ``docs`` has such columns).

    A row whose stream place is before its source's target is taken; of the
    last one only the first words are, so that a source's words are its target,
    rounded. Rows of size 0 are taken with 0 words. A null size counts as 0, a
    null source is a source of its own. Rows are in random order by id and size;
    repeated rows are taken each. An empty table gives an empty one. The result depends on ids, sizes,
    sources and ``seed`` alone. Sources are as many as a row can hold.
    """
    made = ("source_size", "target", "draws")
    own = [c for c in docs.columns if c not in made]
    size = F.coalesce(F.col(size_col).cast("long"), F.lit(0))
    rows = docs.select(F.struct(*own).alias("doc"), F.col(source_col).cast("string").alias("source"), size.alias("size"), order_key(F.col(id_col), size, seed).alias("key"))
    rows = materialize(rows)
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    aim = F.round("target").cast("long")
    sources = materialize(targets(sizes, weights, share, most).withColumns({"aim": aim, "n_blocks": F.ceil(aim / block).cast("long"), "cells": F.ceil(F.col("n_docs") / CELL).cast("long")}))
    # A cell is a range of keys, so that cells in order are the documents in order.
    near = sources.select(F.col("source").alias("_source"), "source_size", "target", "aim", "number", "n_blocks", "cells")
    place = F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * F.col("cells") / F.lit(1 << 32)).cast("long")
    rows = rows.join(F.broadcast(near) if sources.count() <= BROADCAST_KEYS // 10 else near, F.col("source").eqNullSafe(F.col("_source"))).withColumn("cell", place)
    cells = rows.groupBy("number", "cell").agg(F.sum("size").alias("held"))
    before = _before(cells)
    rows = rows.join(before, ["number", "cell"])
    within = Window.partitionBy("number", "cell").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("at", F.col("before") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    blocks = sources.agg(F.coalesce(F.sum("n_blocks"), F.lit(0))).first()[0]
    shards = max(1, -(-blocks // shard))
    dealt = quotas(sources.select("number", "n_blocks"), blocks, shards, seed)
    dealt = materialize(dealt.select("number", "shard", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("count") - 1)).alias("block")))
    few = blocks <= BROADCAST_KEYS
    # Of each pass over the source: where the row begins in the stream, and its block there.
    for k in range(int(most)):
        begin = F.col("at") + F.lit(k) * F.col("source_size")
        taken = F.when(begin < F.col("aim"), F.least(F.col("size"), F.col("aim") - begin))
        rows = rows.withColumns({f"words_{k}": taken, f"block_{k}": F.when(begin < F.col("aim"), _permuted(F.floor(begin / block).cast("long"), F.col("n_blocks"), F.col("number"), seed))})
        shard_of = dealt.select("number", F.col("block").alias(f"block_{k}"), F.col("shard").alias(f"shard_{k}"))
        rows = rows.join(F.broadcast(shard_of) if few else shard_of, ["number", f"block_{k}"], "left")
    draws = F.array(*[F.when(F.col(f"shard_{k}").isNotNull(), F.struct(F.lit(k).alias("pass"), F.col(f"shard_{k}").alias("shard"), F.xxhash64("key", F.lit(seed), F.lit(k)).alias("place"), F.col(f"words_{k}").alias("words"))) for k in range(int(most))])
    return rows.select(*[F.col("doc")[c].alias(c) for c in own], "source_size", "target", F.array_compact(draws).alias("draws"))


def _before(cells: DataFrame) -> DataFrame:
    """(number, cell, before) of cells(number, cell, held): words of the cells of that source before it.

    Cells are summed in groups of CELL, so that a source of CELL ** 2 cells is
    still no large group.
    """
    group = F.floor(F.col("cell") / CELL).cast("long")
    cells = cells.withColumn("group", group)
    own = Window.partitionBy("number", "group").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("inner", F.coalesce(F.sum("held").over(own), F.lit(0)))
    groups = cells.groupBy("number", "group").agg(F.sum("held").alias("all"))
    earlier = Window.partitionBy("number").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("number", "group", F.coalesce(F.sum("all").over(earlier), F.lit(0)).alias("outer"))
    return cells.join(groups, ["number", "group"]).select("number", "cell", (F.col("inner") + F.col("outer")).alias("before"))


def shuffled(mixed: DataFrame) -> DataFrame:
    """The mix itself, a row for each time a document is taken: the columns of ``mixed`` with pass, shard, place and words; each shard in one partition, shuffled."""
    own = [c for c in mixed.columns if c not in ("draws", "pass", "shard", "place", "words")]
    rows = mixed.select(*own, F.explode("draws").alias("draw")).select(*own, "draw.*")
    return rows.repartition("shard").sortWithinPartitions("shard", "place")


def words(text: Column) -> Column:
    """Number of words between ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def op12_target_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document the mix takes, its source's size and target."""
    docs = read(spark, sf_dir, "documents")
    mixed = mix(docs.select("doc_id", "source", words(F.col("text")).alias("size")))
    taken = F.aggregate("draws", F.lit(0).cast("long"), lambda acc, d: acc + d["words"])
    return mixed.select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def _oracle() -> str:
    values = ", ".join(f"({k}, {float(w)!r}::DOUBLE)" for k, w in enumerate(WEIGHTS))
    return f"""
WITH c AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
d AS (SELECT *, md5(coalesce(doc_id::VARCHAR, '') || ':' || size || ':{SEED}') AS k FROM c),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS number FROM d GROUP BY source),
w AS (SELECT s.*, v.weight, {float(MOST)!r}::DOUBLE * source_size AS most, {SHARE!r}::DOUBLE * sum(source_size) OVER () AS total FROM s JOIN (VALUES {values}) AS v(r, weight) ON v.r = number % {len(WEIGHTS)}),
l AS (SELECT *, (total - coalesce(sum(most) OVER (ORDER BY most / weight, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE)) / sum(weight) OVER (ORDER BY most / weight, number ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
f AS (SELECT level FROM l WHERE level * weight <= most ORDER BY most / weight, number LIMIT 1),
t AS (SELECT source, source_size, least(most, coalesce((SELECT level FROM f) * weight, most)) AS target FROM l),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, round(t.target)::BIGINT AS aim,
  coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, ({" + ".join(f"greatest(0, least(size, aim - pos - {k} * source_size))" for k in range(MOST))})::BIGINT AS taken FROM p
"""


ORACLE = _oracle()
