"""Every query with SQL against DuckDB over the smallest tables."""

import duckdb
import pytest
from conftest import SF

from lacuna import queries as q

TABLES = "region nation customer supplier part orders lineitem events documents pages embeddings benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def text(frame, columns):
    frame = frame[columns].astype(object)
    return sorted(map(tuple, frame.where(frame.notna(), None).astype(str).to_numpy().tolist()))


@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_matches_sql(spark, duck, name):
    got, want = q.QUERIES[name](spark, SF).toPandas(), duck.execute(q.ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert text(got, columns) == text(want, columns)


def test_verify_checks_finds_what_was_altered(spark):
    rows = q.QUERIES["verify_checks"](spark, SF).collect()
    for r in rows:
        k = int(r["doc_key"])
        assert r["code"] == (1 if k % 3 == 0 else 2 if k % 5 == 0 else 0)
        assert (r["failed"] == "payload_hash") == (k % 3 == 0)


def test_registry_and_flagship(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_records_of_a_master_file_table_have_a_small_plan(spark):
    # Parts of a record that are used twice are columns, not copies of an expression.
    plan = q.mft_parts(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 20_000


def test_records_of_small_files_go_on_together(spark):
    from lacuna.sources import mft

    files = q.mft_parts(spark, SF).coalesce(1)
    sizes = mft.records(files).mapInArrow(lambda batches: batches, mft.SCHEMA)
    rows = {r["path"]: r for r in sizes.collect()}
    assert len(rows) == files.count()
    for r in files.collect():
        want = mft.decode(bytes(r["content"]), 0)
        assert (rows[r["path"]]["record_number"], len(rows[r["path"]]["names"])) == (want["record_number"], len(want["names"]))


def test_a_time_that_begins_before_the_ticks_by_chance(spark, duck, tmp_path):
    from pyspark.sql import functions as F

    part = spark.read.parquet(f"{SF}/part.parquet").where("p_partkey < 20").withColumn("p_partkey", F.col("p_partkey") + 101_100)
    part.write.parquet(f"{tmp_path}/part.parquet")
    got = q.QUERIES["cache_of_hives"](spark, str(tmp_path)).toPandas()
    con = duckdb.connect()
    con.execute(f"create view part as select * from '{tmp_path}/part.parquet/*.parquet'")
    want = con.execute(q.ORACLES["cache_of_hives"]).df()
    columns = sorted(got.columns)
    assert text(got, columns) == text(want, columns)
    assert got.set_index("p_partkey")["last_modified"][101_104].year == 2013


@pytest.mark.parametrize("name", ["verify_checks", "mft_records"])
def test_rows_of_one_file_are_dealt_before_python(spark, name):
    plan = q.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan[plan.index("MapIn") :]
