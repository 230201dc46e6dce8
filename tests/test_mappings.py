"""Any number of mappings: joined, they say what a plan with all of them says."""

import random

from pyspark.sql import functions as F

from lacuna.operators import timeline
from lacuna.plans import mappings


def lines(spark, rng, n):
    pick = lambda p: rng.choice([None, *(f"{p}{k}" for k in range(4))])
    return spark.createDataFrame([(k, pick("s"), pick("t"), pick("k"), pick("f")) for k in range(n)], "row_num long, source string, sourcetype string, type string, format string")


def test_joined_mappings_equal_those_in_the_plan(spark):
    rng = random.Random(2)
    pick = lambda p: rng.choice([None, None, *(f"{p}{k}" for k in range(4))])
    for n, every in ((0, False), (1, True), (25, False), (60, False), (3, True)):
        rows = [(pick("s"), pick("t"), pick("k"), pick("f"), f"a{k}", f"x{k}") for k in range(n)]
        rows = [r for r in rows if any(r[:4])] + [(None, None, None, None, "all", "x")] * every
        table = lines(spark, rng, 300)
        want = timeline.classify(table, rows, max_rows=250)
        got = timeline.classify(table, mappings.mappings(spark, rows), max_rows=250)
        assert got.columns == want.columns
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_fifty_thousand_mappings_are_a_small_plan(spark):
    table = spark.range(20_000).select(F.col("id").alias("row_num"), F.concat(F.lit("s"), F.col("id") % 30_000).alias("source"), F.lit("t").alias("sourcetype"), F.concat(F.lit("k"), F.col("id") % 7).alias("type"), F.lit(None).cast("string").alias("format"))
    rows = spark.range(50_000).select(F.col("id").cast("int").alias("ordinal"), F.concat(F.lit("s"), F.col("id") % 25_000).alias("source"), F.lit(None).cast("string").alias("sourcetype"), F.when(F.col("id") < 25_000, F.concat(F.lit("k"), F.col("id") % 7)).alias("type"), F.lit(None).cast("string").alias("format"), F.concat(F.lit("a"), "id").alias("activity"), F.lit("x").alias("artifact_type"))
    out = timeline.classify(table, rows, max_rows=None)
    assert len(out._jdf.queryExecution().optimizedPlan().toString()) < 20_000
    counts = {r["class"]: r["count"] for r in out.groupBy("class").count().collect()}
    assert counts == {"ambiguous": 20_000}
    few = timeline.classify(table, rows.where("ordinal >= 25000"), max_rows=None)
    assert few.where(F.col("activity") == F.concat(F.lit("a"), F.col("row_num") + 25_000)).count() == 20_000


def test_ranks_over_ranges_equal_a_window(spark):
    from pyspark.sql import Window

    from lacuna.operators.numbering import ranked

    rng = random.Random(3)
    rows = spark.createDataFrame([(k, rng.choice([None, *range(5)])) for k in range(2000)], "id long, g long").repartition(6)
    order = [F.col("g").desc_nulls_first(), F.col("id")]
    want = rows.withColumn("k", F.row_number().over(Window.orderBy(*order)).cast("long"))
    got = ranked(rows, order, "k")
    assert sorted(map(tuple, got.select("id", "k").collect())) == sorted(map(tuple, want.select("id", "k").collect()))
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()
    assert ranked(rows.where("id < 0"), order, "k", 0).count() == 0


def test_ids_as_bytes_and_cut_descriptions(spark):
    from lacuna.functions.names import bytes_without_prefix, without_prefix

    rows = spark.createDataFrame([(bytearray(b"\0\0\0\0\xab\xcd"), "00000000abcd"), (bytearray(b"\1\2\3\4"), "ab"), (None, None)], "b binary, t string")
    got = [tuple(r) for r in rows.select(bytes_without_prefix(F.col("b")), without_prefix(F.col("t"))).collect()]
    assert got == [("ABCD", "ABCD"), (None, "AB"), (None, None)]
    lines_ = spark.createDataFrame([(1, "abcdef", "unmatched")], "row_num long, desc string, class string")
    assert timeline.unmatched_sample(lines_, ["desc"], description=3).first()["desc"] == "abc"
