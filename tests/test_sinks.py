import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from test_sources import CASE, record

from lacuna import sinks
from lacuna.functions.canonical import digest
from lacuna.operators import digests, provenance, verify
from lacuna.sources import mft


def test_batch_of_files(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"mft {k}.bin").write_bytes(record(0) + record(1))
    (tmp_path / "bad.bin").write_bytes(b"\0" * 1024)
    inputs = sorted(tmp_path.glob("*.bin"))
    read = lambda p: mft.read_mft(spark, str(p).replace(" ", "%20")) if " " not in str(p) else mft.records(spark.createDataFrame([(str(p), bytearray(p.read_bytes()))], "path string, content binary"))
    out = tmp_path / "out"
    manifest = sinks.run_batch([*inputs, tmp_path / "gone", inputs[0]], read, "mft", out, order=["expected_record_number"], max_inputs=3)
    assert manifest["summary"] == {"ok": 2, "partial": 1, "failed": 1} and manifest["inputs_skipped_by_limit"] == 1
    for path in out.glob("*.json"):
        assert all(ok for _, _, ok, _ in verify.export_checks(json.loads(path.read_text())))
    again = sinks.run_batch(inputs, read, "mft", out, order=["expected_record_number"], max_inputs=3)
    assert again["summary"] == {"ok": 2, "partial": 1, "failed": 0}
    Path(inputs[1]).write_bytes(record(5))
    assert sinks.run_batch(inputs, read, "mft", out, order=["expected_record_number"], max_inputs=3)["summary"]["failed"] == 1
    with pytest.raises(ValueError):
        sinks.run_batch([], read, "mft", out, order=[])


def test_provenance_of_files_and_folders(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"x")
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "b").write_bytes(b"y")
    assert provenance.source(tmp_path / "a")["size_bytes"] == 1 and provenance.source(tmp_path / "none")["hash_error"]
    tree = provenance.source(tmp_path / "d")["tree_sha256"]
    (tmp_path / "d" / "c").write_bytes(b"")
    assert provenance.source(tmp_path / "d")["tree_sha256"] != tree and provenance.source(tmp_path / "d")["file_count"] == 2
    rows = provenance.source_rows(spark.read.format("binaryFile").load(str(tmp_path / "a"))).first()
    assert rows["sha256"] == provenance.file_digest(tmp_path / "a")
    assert provenance.attest([tmp_path / "d"]) != provenance.attest([tmp_path / "d"], [tmp_path / "a"])


def test_digests_do_not_depend_on_partitions(spark):
    rows = [(c, "a", f"t{k}", "present", None, "r") for c in (1, 2) for k in range(4)]
    frame = spark.createDataFrame(rows, "case_id int, action string, artifact_type string, status string, reason string, evidence_ref string")
    contexts = spark.createDataFrame([(1, '{"s": 1}'), (2, '{"s": 1}')], "case_id int, context string")
    first = {r["case_id"]: r["analysis_sha256"] for r in digests.analysis_digests(contexts, frame.coalesce(1)).collect()}
    second = {r["case_id"]: r["analysis_sha256"] for r in digests.analysis_digests(contexts, frame.orderBy(F.rand(1)).repartition(7)).collect()}
    changed = {r["case_id"]: r["analysis_sha256"] for r in digests.analysis_digests(contexts, frame.withColumn("status", F.when((F.col("case_id") == 1) & (F.col("artifact_type") == "t1"), "unknown").otherwise(F.col("status")))).collect()}
    assert first == second and first[1] == first[2] and changed[1] != first[1] and changed[2] == first[2]


def test_enriched_case_and_report():
    new = [{"activity": "process_execution", "artifact_type": "security_event_4688", "status": "unknown", "reason": "x", "evidence_ref": "r"}, {"activity": "successful_logon", "artifact_type": "security_event_4624", "status": "unknown", "reason": "conditions_unverified", "evidence_ref": "r"}]
    out = sinks.enrich_case(CASE, new)
    assert out["activities"][0]["observations"] == CASE["activities"][0]["observations"] and out["activities"][-1]["action"] == "successful_logon"
    text = sinks.markdown([{"doc_key": "b", "checks": 3, "failures": 0, "failed": []}, {"doc_key": "z", "checks": 3, "failures": 1, "failed": ["kind"]}])
    assert text.index("| z |") < text.index("| b |") and digest({"x": 1})
