"""Line spread and URL model: brute force, SQL, edges, and no Python in their plans."""

import os
import random

import duckdb
import pytest
from data import corpus, edge, empty, prose

from lacuna.llm import line_spread, url_model

SF = "/root/testdata/sf0.001"


def strip(text, keys):
    own = text.split("\n")
    stays = [x for x in own if not x.strip(" ") or x.strip(" ") not in keys]
    return "\n".join(stays if any(x.strip(" ") for x in stays) else own)


def test_lines_against_brute_force(spark):
    rng = random.Random(1)
    boiler = {f"line {k}": k for k in range(1, 21)}
    rows = []
    for k in range(300):
        lines = [prose(rng, 5) for _ in range(3)] + [b if rng.random() < 0.5 else f" {b} " for b, n in boiler.items() if k % 20 < n and rng.random() < 0.9]
        rng.shuffle(lines)
        rows.append((k, "\n".join(lines), f"s{k % 20}"))
    sites = {}
    for _, text, source in rows:
        for x in text.split("\n"):
            sites.setdefault(x.strip(" "), set()).add(source)
    keys = {x for x, s in sites.items() if len(s) >= line_spread.SITES and x}
    assert 5 < len(keys) < 20
    got = {r["doc_id"]: r for r in line_spread.remove_boilerplate(corpus(spark, rows)).collect()}
    for d, text, _ in rows:
        assert got[d]["text"] == strip(text, keys)
        assert got[d]["n_lines"] - got[d]["n_removed"] == len(strip(text, keys).split("\n"))


def test_whole_copies_stay(spark):
    rows = [(k, "all of\nthis page", f"s{k}") for k in range(15)] + [(99, "all of\nmore", "s1")]
    got = {r["doc_id"]: r["text"] for r in line_spread.remove_boilerplate(corpus(spark, rows)).collect()}
    assert got[3] == "all of\nthis page" and got[99] == "more"


@pytest.mark.parametrize("most", [0, 1_000_000])
def test_lines_of_tables_with_clashing_names(spark, monkeypatch, most):
    from lacuna.llm import session

    monkeypatch.setattr(line_spread, "BROADCAST_KEYS", most)
    monkeypatch.setattr(session, "BROADCAST_KEYS", most)
    names = ["doc", "row", "keys", "key", "kept", "_row", "_keys", "_kept", "_site", "_text", "n_lines"]
    rows = [(None if k % 2 else k, f"own {k}\nboiler", f"s{k}", *(f"{n}{k}" for n in names)) for k in range(12)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{n} string" for n in names))
    got = line_spread.remove_boilerplate(frame)
    assert got.columns == [c for c in frame.columns if c != "n_lines"] + ["n_lines", "n_removed"]
    by_row = {r["row"]: r for r in got.collect()}
    for r in rows:
        own = by_row[r[4]]
        assert own["text"] == r[1].split("\n")[0] and (own["doc_id"], own["source"], own["_row"], own["n_lines"], own["n_removed"]) == (r[0], r[2], r[8], 2, 1)


def test_line_edges(spark):
    out = line_spread.remove_boilerplate(edge(spark), sites=1)
    rows = out.collect()
    assert len(rows) == 14 and set(edge(spark).columns) <= set(out.columns)
    assert {r["n_lines"] for r in rows if r["text"] is None} == {0}
    assert line_spread.remove_boilerplate(empty(spark)).count() == 0


def test_url_rules(spark):
    urls = ["http://a.com/en/1", "http://Example.COM/en/7x?q", "http://x.example.com/en/71", "http://example.net/de/8", "http://b.net/de/1#f", "http://q.org/es/", "http://badcom/en/", None, "no scheme", "http://com/en/", "http://y.com/EN/1", "http://example.com?/en/7", "a://b://c/d"]
    got = {r["page_id"]: r for r in url_model.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    assert [got[k]["rule"] for k in range(13)] == ["com/en/", "example.com/en/7", "example.com/en/7", "example.net/de/8", "net/de/", "org/es/", None, None, None, "com/en/", None, None, None]
    assert [got[k]["verdict"] for k in (0, 1, 3, 4, 5)] == ["block", "allow", "block", "allow", "block"]
    assert (got[1]["host"], got[1]["path"]) == ("example.com", "/en/7x") and (got[7]["host"], got[7]["path"]) == ("", "") and got[12]["host"] == "b:"
    assert {r["verdict"] for r in got.values()} <= {"allow", "block"}


def test_url_edges(spark):
    rows = [(1, "http://a.net/de/1", "h", "p", "r", "v"), (1, "http://a.net/de/1", "h", "p", "r", "v"), (None, None, None, None, None, None), (2, "", "", "", "", ""), (3, "x" * 100_000, "", "", "", "")]
    frame = spark.createDataFrame(rows, "page_id long, url string, host string, path string, rule string, verdict string")
    assert url_model.judge(frame).count() == 5
    assert url_model.judge(frame.limit(0)).count() == 0


def test_joins_of_small_and_large_models_agree(spark, monkeypatch):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    small = sorted(map(str, url_model.judge(pages).collect()))
    monkeypatch.setattr(url_model, "BROADCAST_GRAMS", 0)
    assert sorted(map(str, url_model.judge(pages).collect())) == small


@pytest.mark.parametrize("module,query", [(line_spread, "op10_line_spread"), (url_model, "op8_url_ratio")])
def test_sql(spark, module, query):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    frame = getattr(module, query)(spark, SF)
    want = con.execute(module.ORACLE).df()[frame.columns]
    assert sorted(map(str, frame.toPandas().astype(object).where(lambda x: x.notna(), None).to_numpy().tolist())) == sorted(map(str, want.astype(object).where(lambda x: x.notna(), None).to_numpy().tolist()))
    plan = frame._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and os.path.exists(module.__file__)
