import random

import corpus_pipeline as p
import pytest
from data import corpus, edge, prose

from lacuna.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def test_stages_and_queries():
    assert [n for n, _ in p.STAGES] == ["quality", "line_dedup", "near_dedup", "decontaminate", "packing"]
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14)) and set(ORACLES) <= set(QUERIES)


def test_run_over_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs]
    for _, stage in p.STAGES[:-1]:
        from lacuna.llm.session import materialize

        seen.append(materialize(stage(spark, seen[-1], SF)))
        assert seen[-1].columns == docs.columns and 0 < seen[-1].count() <= seen[-2].count()
    ids = {r["doc_id"] for r in seen[-1].collect()}
    packed = p.STAGES[-1][1](spark, seen[-1], SF)
    assert {r["doc_id"] for r in packed.collect()} == ids
    from test_ngram_join import brute

    before = [(r["doc_id"], r["text"]) for r in seen[2].collect()]
    assert {r["doc_id"] for r in seen[3].collect()} == {c for _, _, c in brute(before, 5, 80)}


@pytest.mark.parametrize("stage", ["quality", "line_dedup", "near_dedup", "decontaminate", "packing"])
def test_stages_take_odd_rows(spark, stage):
    docs = edge(spark).select("doc_id", "text", "lang", "source", "n_chars")
    out = dict(p.STAGES)[stage](spark, docs, SF)
    assert (out.count() > 0) if stage == "packing" else (out.count() <= 14 and out.columns == docs.columns)
    assert dict(p.STAGES)[stage](spark, docs.limit(0), SF).count() == 0


def test_near_dedup_keeps_one_row_of_a_group(spark):
    rng = random.Random(8)
    a, b, c, d, e = (prose(rng, 60) for _ in range(5))
    rows = [(3, a), (3, a), (5, a), (None, a), (3, b), (7, c), (None, c), (None, d), (None, d), (2, e), (1, e + " more"), (1, e + " more"), (4, ""), (4, ""), (None, None), (None, None)]
    docs = corpus(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    got = sorted(((r["doc_id"], r["text"]) for r in p.near_dedup(spark, docs, SF).collect()), key=str)
    assert got == sorted([(3, a), (3, b), (7, c), (None, d), (1, e + " more"), (4, ""), (4, ""), (None, None), (None, None)], key=str)


def test_tables_are_written_with_little_garbage_in_the_heap(spark, monkeypatch):
    """Garbage beyond a part of the driver's heap is collected before the next table is written; a heap with little in it is left alone."""
    from lacuna.llm import session

    heap = spark._jvm.java.lang.Runtime.getRuntime()
    used = lambda: heap.totalMemory() - heap.freeMemory()
    spark._jvm.System.gc()
    count = lambda: sum(b.getCollectionCount() for b in spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans() if "Old" in b.getName() or "MarkSweep" in b.getName())
    before = count()
    monkeypatch.setattr(session, "HEAP", 1.0)
    session.materialize(spark.range(3))
    assert count() == before
    monkeypatch.setattr(session, "HEAP", used() / heap.maxMemory() / 2)
    assert session.materialize(spark.range(3)).count() == 3
    assert count() > before
