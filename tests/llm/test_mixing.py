from collections import Counter

import duckdb
import pytest
from data import edge, edge_rows, empty
from pyspark.sql import functions as F

from lacuna.llm import mixing
from lacuna.llm.mixing import drawn, mix, quotas, shuffled, words

SF = "/root/testdata/sf0.001"


def shared(sizes, weights, share, most):
    """Targets by resharing the excess until none is above its bound."""
    out, open_, left = {}, dict(enumerate(sizes)), share * sum(sizes)
    while open_:
        total = sum(weights[k % len(weights)] for k in open_)
        level = {k: left * weights[k % len(weights)] / total for k in open_}
        over = [k for k in open_ if level[k] > most * sizes[k]]
        if not over:
            return {**out, **level}
        for k in over:
            out[k] = most * sizes[k]
            left -= out[k]
            del open_[k]
    return out


@pytest.mark.parametrize("sizes", [[100, 900, 30], [5], [0, 10, 10, 400], [7] * 11, [1000, 1, 1, 1], [0, 0]])
def test_targets(spark, sizes):
    rows = spark.createDataFrame([(f"s{k:02}", n, 3) for k, n in enumerate(sizes)], "source string, source_size long, n_docs long")
    got = {r["number"]: r["target"] for r in mixing.targets(rows).collect()}
    want = shared(sizes, mixing.WEIGHTS, 1.5, 2)
    assert {k: pytest.approx(v) for k, v in want.items()} == got


def test_draws_are_hypergeometric(spark):
    cases = [(20, 7, 9), (10, 10, 4), (50, 0, 20), (12, 5, 12), (1, 1, 0), (1000, 300, 500)]
    rows = spark.createDataFrame(cases, "n long, k long, d long").crossJoin(spark.range(4000))
    got = rows.select("n", "k", "d", drawn(F.col("n"), F.col("k"), F.col("d"), F.col("id") / 4000.0 + 1 / 8000.0).alias("x")).collect()
    from math import comb

    for n, k, d in cases:
        seen = Counter(r["x"] for r in got if (r["n"], r["k"], r["d"]) == (n, k, d))
        assert all(max(0, d + k - n) <= x <= min(d, k) for x in seen)
        for x in range(min(d, k) + 1):
            p = comb(k, x) * comb(n - k, d - x) / comb(n, d) if 0 <= d - x <= n - k else 0
            assert abs(seen[x] / 4000 - p) < 0.001


@pytest.mark.parametrize("counts, shards", [([100, 37, 5, 1], 9), ([3], 1), ([0, 8], 3), ([500] * 20, 300)])
def test_every_block_goes_to_one_shard(spark, counts, shards):
    sources = spark.createDataFrame(list(enumerate(counts)), "number int, n_blocks long")
    total = sum(counts)
    rows = quotas(sources, total, shards).collect()
    own, full = Counter(), Counter()
    for r in rows:
        own[r["shard"]] += r["count"]
        full.update((r["number"], b) for b in range(r["first"], r["first"] + r["count"]))
    assert set(full.values()) == {1} and len(full) == total
    assert all(own[s] == (s + 1) * total // shards - s * total // shards for s in range(shards))
    assert rows == quotas(sources, total, shards).collect() and max(own) < shards


def test_blocks_are_permuted_whole(spark):
    rows = spark.createDataFrame([(n, s) for n in (1, 2, 7, 4096) for s in (0, 1)], "n long, s int").select("n", "s", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("b"))
    got = rows.groupBy("n", "s").agg(F.count_distinct(mixing._permuted(F.col("b"), F.col("n"), F.col("s"), 5)).alias("c"), F.min(mixing._permuted(F.col("b"), F.col("n"), F.col("s"), 5)).alias("m")).collect()
    assert all(r["c"] == r["n"] and r["m"] == 0 for r in got)


def test_mix_takes_targets_and_shuffles(spark):
    docs = spark.range(3000).select("id", (F.col("id") % 37).alias("size"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, None).otherwise(F.concat(F.lit("s"), F.col("id") % 4)).alias("source"), F.lit("x").alias("shard"))
    mixed = mix(docs, id_col="id", block=64, shard=8)
    rows = mixed.collect()
    taken, target = Counter(), {}
    for r in rows:
        own = sum(d["words"] for d in r["draws"])
        assert own <= 2 * r["size"] and len({d["pass"] for d in r["draws"]}) == len(r["draws"])
        taken[r["source"]] += own
        target[r["source"]] = r["target"]
    assert len(rows) == 3000 and all(abs(taken[s] - t) <= 0.5 for s, t in target.items())
    out = shuffled(mixed.drop("shard"))
    by = out.withColumn("part", F.spark_partition_id()).groupBy("shard").agg(F.count_distinct("part").alias("parts"), F.sum("words").alias("w"), F.count_distinct("source").alias("sources")).collect()
    assert all(r["parts"] == 1 for r in by) and len(by) > 100 and sum(r["w"] for r in by) == sum(taken.values())
    assert sum(r["sources"] > 1 for r in by) > 0.9 * len(by)
    again = mix(docs.repartition(7), id_col="id", block=64, shard=8)
    assert sorted(map(str, again.collect())) == sorted(map(str, rows))


def test_edges(spark):
    rows = edge(spark).withColumn("size", words(F.col("text")))
    out = mix(rows.withColumn("draws", F.lit(1)))
    got = out.collect()
    assert out.columns == [*rows.columns, "source_size", "target", "draws"] and len(got) == len(edge_rows())
    for source in {r["source"] for r in got}:
        own = [r for r in got if r["source"] == source]
        assert abs(sum(d["words"] for r in own for d in r["draws"]) - own[0]["target"]) <= 0.5
        assert own[0]["source_size"] == sum(r["size"] for r in own)
    assert mix(empty(spark).withColumn("size", F.lit(1))).count() == 0
    assert mix(rows.where("doc_id is null").withColumn("size", F.lit(None))).collect()[0]["draws"] == []


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = sorted(map(tuple, con.execute(mixing.ORACLE).fetchall()))
    assert sorted(map(tuple, mixing.op12_target_mix(spark, SF).collect())) == want
