import datetime as dt
import json

import pytest
from test_sources import CASE, record

from lacuna import cli
from lacuna.operators import verify
from lacuna.sources import amcache, hives, prefetch, registry, timelines


@pytest.fixture
def run(spark, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda: spark)
    return lambda *argv: cli.main([str(a) for a in argv])


def test_import_writes_sealed_documents(run, tmp_path, capsys):
    (tmp_path / "table.bin").write_bytes(record(0) + record(1) + record(2))
    out = tmp_path / "out.json"
    assert run("import-mft", tmp_path / "table.bin", "--output", out, "--max", 2) == 0
    document = json.loads(out.read_text())
    assert document["counts"] == {"available": 3, "exported": 2, "left_out": 1} and len(document["records"]) == 2
    assert all(ok for _, _, ok, _ in verify.export_checks(document))
    capsys.readouterr()
    assert run("verify", out, "--sources", tmp_path) == 0 and '"failures":0' in capsys.readouterr().out
    (tmp_path / "table.bin").write_bytes(record(0))
    assert run("verify", out, "--sources", tmp_path) == 1 and "sources_rehash" in capsys.readouterr().out
    out.write_text(out.read_text().replace('"left_out": 1', '"left_out": 0'))
    assert run("verify", out) == 1


def test_exit_codes_of_imports(run, tmp_path, capsys):
    assert run("import-mft", tmp_path / "none") == 2
    (tmp_path / "bad.bin").write_bytes(record(0) + b"\0" * 1024)
    assert run("import-mft", tmp_path / "bad.bin", "--summary") == 1
    assert "1 of 2 rows" in capsys.readouterr().out
    assert run("import-mft", tmp_path / "bad.bin", "--allow-partial") == 0
    (tmp_path / "A.EXE-0BD30981.pf").write_bytes(b"MAM\x04" + b"x" * 300)
    assert run("import-prefetch", tmp_path / "A.EXE-0BD30981.pf") == 1
    (tmp_path / "Amcache.hve").write_bytes(b"regf")
    for name in ("amcache", "shimcache", "shellbags"):
        assert run(f"import-{name}", tmp_path / "Amcache.hve") == 1
        assert "hive" in capsys.readouterr().err


def test_batch_command(run, tmp_path, capsys):
    folder = tmp_path / "in"
    folder.mkdir()
    for k in range(3):
        (folder / f"{k}.bin").write_bytes(record(k))
    out = tmp_path / "out"
    assert run("batch", folder, "--adapter", "mft", "--out-dir", out, "--pattern", "*.bin") == 0
    assert len(list(out.glob("*.json"))) == 4 and json.loads((out / "manifest.json").read_text())["summary"]["ok"] == 3
    assert run("batch", folder, "--adapter", "mft", "--out-dir", tmp_path / "two", "--max-inputs", 2) == 1
    assert run("batch", folder, "--adapter", "mft", "--out-dir", tmp_path / "three", "--max-inputs", 2, "--allow-partial", "--json") == 0
    assert run("batch", folder, "--adapter", "mft", "--out-dir", tmp_path / "four", "--min-inputs", 9) == 2
    assert not (tmp_path / "four").exists()


def line(kind="4688", source="Microsoft-Windows-Security-Auditing"):
    return ",".join(["d", "t", "z", "m", source, "Security", kind, *["x"] * 10])


def test_timeline_with_template(run, tmp_path, capsys):
    head = ",".join(timelines.COLUMNS)
    (tmp_path / "t.csv").write_text(f"{head}\n{line()}\nshort,row\n{line('4624')}\n{line('9')}\n{line('4624')}\n")
    mapping = [{"source": None, "sourcetype": None, "type": t, "format": None, "activity": a, "artifact_type": f"security_event_{t}"} for t, a in (("4688", "process_execution"), ("4624", "successful_logon"))]
    (tmp_path / "m.json").write_text(json.dumps(mapping))
    (tmp_path / "case.json").write_text(json.dumps(CASE))
    out, said = tmp_path / "out.json", tmp_path / "said.json"
    assert run("import-timeline", tmp_path / "t.csv", "--mapping", tmp_path / "m.json", "--case", tmp_path / "case.json", "--output", out, "--diagnostics", said, "--evidence-prefix", "ref") == 0
    enriched = json.loads(out.read_text())
    assert enriched["activities"][:2] == CASE["activities"]
    assert enriched["activities"][2] == {"action": "successful_logon", "observations": [{"artifact_type": "security_event_4624", "status": "unknown", "reason": "conditions_unverified", "evidence_ref": "ref/row-3/successful_logon/security_event_4624"}]}
    document = json.loads(said.read_text())
    assert all(ok for _, _, ok, _ in verify.export_checks(document))
    assert document["counts"]["matched_rows"] == 3 and document["counts"]["unmatched_rows"] == 1 and document["counts"]["rejected_rows"] == 1
    assert document["mappings_used"] == ["process_execution/security_event_4688", "successful_logon/security_event_4624"] and document["unmatched_sample"][0]["row_num"] == 4 and document["errors"][0]["row_error"] == "field_count"
    assert run("import-timeline", tmp_path / "t.csv", "--mapping", tmp_path / "m.json", "--max-rows", 2) == 0
    assert '"total_rows":2' in capsys.readouterr().out


def test_timelines_that_are_refused(run, tmp_path, monkeypatch):
    assert run("import-timeline", tmp_path / "none.csv") == 2
    (tmp_path / "t.csv").write_text("date,time\n1,2\n")
    assert run("import-timeline", tmp_path / "t.csv") == 2
    (tmp_path / "t.csv").write_text(",".join(timelines.COLUMNS) + "\n" + line() + "\n")
    (tmp_path / "case.json").write_text(json.dumps({**CASE, "schema_version": "x"}))
    assert run("import-timeline", tmp_path / "t.csv", "--case", tmp_path / "case.json", "--output", tmp_path / "o") == 2
    assert run("import-timeline", tmp_path / "t.csv", "--case", tmp_path / "case.json") == 2
    monkeypatch.setattr(timelines.check_size, "__defaults__", (10,))
    assert run("import-timeline", tmp_path / "t.csv") == 2


@pytest.fixture
def tree():
    # A function of a function: workers cannot import this module.
    def tree(content):
        """A hive of the tests: keys and values by the first byte."""
        if content == b"!":
            raise ValueError("broken")
        when = dt.datetime(2024, 1, 2)
        path = b"\x14\x00" + "D:\\data".encode("utf-16-le") + b"\0\0\0\0"
        yield "", when, []
        yield "Root\\File", when, []
        yield "Root\\File\\abc", when, [("0", "Paint\0"), ("6", "1f"), ("15", "C:\\p.exe"), ("101", b"0\x000\x000\x000\x00a\x00b\x00")]
        yield "ControlSet001", when, []
        yield "ControlSet001\\Control\\Session Manager", when, [("Other", b"x")]
        yield "Software\\Classes\\Local Settings\\Software\\Microsoft\\Windows\\Shell", when, []
        yield "Software\\Classes\\Local Settings\\Software\\Microsoft\\Windows\\Shell\\BagMRU\\0", when, [("1", path), ("MRUList", path)]

    return tree


def test_rows_of_hives(spark, tree):
    files = spark.createDataFrame([("good", bytearray(b"x")), ("bad", bytearray(b"!"))], "path string, content binary")
    keys = hives.values(files, tree)
    (entry,) = amcache.entries(keys).collect()
    assert (entry["section"], entry["product_name"], entry["file_size"], entry["full_path"], entry["sha1"], entry["key_timestamp"].day) == ("File", "Paint", 31, "C:\\p.exe", "0000AB", 2)
    found = {r["hive"]: r for r in amcache.sections(keys).collect()}
    assert found["good"]["sections_absent"] == ["InventoryApplicationFile"] and found["good"]["error"] is None and "broken" in found["bad"]["error"]
    cache = {r["hive"]: r["error"] for r in registry.cache_of_hives(keys).collect()}
    assert cache["good"] == "no cache value; control sets: ControlSet001; values: Other" and "broken" in cache["bad"]
    bags = {r["hive"]: r for r in registry.bags_of_hives(keys).collect()}
    assert bags["good"]["folder_path"] == "D:\\data" and "broken" in bags["bad"]["error"]
    assert [r["hive"] for r in hives.readable(keys).collect()] == ["good"] and [r["hive"] for r in hives.failed(keys).collect()] == ["bad"]
    (missing,) = hives.values(files.limit(1)).collect()
    assert missing["error"]


def test_prefetch_run_data(spark):
    def decode(content):
        if content.endswith(b"!"):
            raise OSError("truncated")
        return {"content_hash": "0BD30981", "run_count": 3, "run_ticks": [133_500_000_000_000_000, 0, None, 133_600_000_000_000_000], "n_filenames": 7, "volume_serial": 5, "volume_path": "\\V"}

    files = [(f"/x/{n}", bytearray(b"MAM\x04" + x)) for n, x in (("CMD.EXE-0BD30981.pf", b"ok"), ("A.EXE-11111111.pf", b"ok"), ("B.EXE-22222222.pf", b"!"))]
    rows = {r["executable"]: r for r in prefetch.describe(spark.createDataFrame(files, "path string, content binary"), decode).collect()}
    assert rows["CMD.EXE"]["hash_agrees"] and not rows["A.EXE"]["hash_agrees"] and rows["CMD.EXE"]["run_count"] == 3 and rows["CMD.EXE"]["last_run"].year == 2024 and len(rows["CMD.EXE"]["run_ticks"]) == 2
    assert "truncated" in rows["B.EXE"]["error"] and not any(r["degraded"] for r in rows.values())


def test_harness(run, tmp_path, capsys):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "$MFT").write_bytes(record(0))
    (tmp_path / "in" / "deep" / "A.EXE-0BD30981.pf").write_bytes(b"MAM\x04" + b"x" * 300)
    (tmp_path / "in" / "notes.txt").write_text("x")
    assert run("harness", tmp_path / "in", "--out-dir", tmp_path / "out") == 1
    text = (tmp_path / "out" / "REPORT.md").read_text()
    assert text.count("none") == 4 and "1 inputs are partial" in text
    assert run("harness", tmp_path / "in", "--out-dir", tmp_path / "mft", "--only", "mft") == 0
    assert run("harness", tmp_path / "out" / "mft", "--out-dir", tmp_path / "none") == 2


def test_keys(monkeypatch, tmp_path, capsys):
    from lacuna.keys import FILE_VARIABLE, VARIABLE, resolve_key

    monkeypatch.delenv(VARIABLE, raising=False)
    monkeypatch.delenv(FILE_VARIABLE, raising=False)
    assert resolve_key() is None
    (tmp_path / "key").write_bytes(b"k" * 32 + b"\n")
    monkeypatch.setenv(FILE_VARIABLE, str(tmp_path / "key"))
    assert resolve_key() == b"k" * 32
    monkeypatch.setenv(VARIABLE, "zz")
    assert resolve_key() == b"k" * 32 and "not hexadecimal" in capsys.readouterr().err
    monkeypatch.setenv(VARIABLE, "00ff")
    assert resolve_key() == b"\x00\xff" and "2 bytes" in capsys.readouterr().err
    monkeypatch.delenv(VARIABLE)
    (tmp_path / "key").write_bytes(b"short")
    assert resolve_key() is None


def test_baselines(spark, tmp_path):
    from lacuna.sources import baseline

    counts = {"4624": {"status": "count_capped", "count": 100000, "count_is_lower_bound": True}, "4688": {"status": "query_failed", "count": None, "count_is_lower_bound": None}, "5156": {"status": "queried", "count": 0, "count_is_lower_bound": False}}
    (tmp_path / "a.json").write_text(json.dumps({"run_id": "r", "security_event_counts": counts, "collection_errors": [{"source": "s", "message": "m"}]}))
    (tmp_path / "b.json").write_text("{")
    rows = baseline.read_baselines(spark, str(tmp_path))
    assert sum(r["bad_document"] is not None for r in rows.collect()) == 1
    assert {r["event_id"]: (r["count"], r["usable"]) for r in baseline.event_counts(rows).collect()} == {4624: (100000, False), 4688: (None, False), 5156: (0, True)}
    assert [r["message"] for r in baseline.collection_errors(rows).collect()] == ["m"]


def test_exports_and_argument_digests():
    import lacuna
    from lacuna.functions.canonical import arguments_digest

    assert all(callable(getattr(lacuna, n)) or n in ("ADAPTERS", "__version__") for n in lacuna.__all__)
    with pytest.raises(AttributeError):
        lacuna.nothing
    assert arguments_digest(None) == arguments_digest({}) != arguments_digest({"b": 1}) and arguments_digest({"a": 1, "b": dt.date(2024, 1, 1)}) == arguments_digest({"b": "2024-01-01", "a": 1})


def test_rows_over_the_limit_are_one_rejection(spark):
    from lacuna.operators import timeline

    lines = spark.createDataFrame([(k, "app", None, "click", None, "x") for k in range(1, 11)], "row_num long, source string, sourcetype string, type string, format string, desc string")
    rows = timeline.classify(lines, [("app", None, "click", None, "process_execution", "security_event_4688")], max_rows=7)
    assert timeline.counters(rows).first().asDict() == {"total_rows": 7, "matched_rows": 7, "unmatched_rows": 0, "rejected_rows": 1, "mapping_errors": 0, "targets": 1}


def test_numbers_follow_the_rows(spark):
    from lacuna.operators.numbering import numbered

    rows = numbered(spark.range(0, 1000, 1, 7), "k", 5).collect()
    assert [r["k"] for r in sorted(rows, key=lambda r: r["id"])] == list(range(5, 1005))
    assert numbered(spark.range(0, 0, 1, 3), "k").count() == 0


def test_analyze_prints_context_and_digest(run, tmp_path, capsys):
    import copy

    def heads(**files):
        folder = tmp_path / f"cases{len(list(tmp_path.iterdir()))}"
        folder.mkdir()
        for name, case in files.items():
            (folder / f"{name}.json").write_text(json.dumps(case))
        assert run("analyze", folder) == 0
        rows = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
        return {r["case_id"].rsplit("/", 1)[-1]: r for r in rows if "analysis_sha256" in r}

    other = copy.deepcopy(CASE)
    other["context"]["scope"] = "another scope"
    capsys.readouterr()
    found = heads(one=CASE, same=CASE, other=other)
    assert found["one.json"]["analysis_sha256"] == found["same.json"]["analysis_sha256"] != found["other.json"]["analysis_sha256"]
    assert found["other.json"]["context"]["scope"] == "another scope" and found["one.json"]["expected"] > 0 and found["one.json"]["catalog_version"]
