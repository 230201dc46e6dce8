import json
import random
import struct

import pytest
from pyspark.sql.types import StructType

from lacuna.operators import matrix
from lacuna.sources import cases, discovery, mft, prefetch, registry, timelines

TICKS = 133_500_000_000_000_000


def attribute(kind, content):
    head = struct.pack("<IIBBHHHIHH", kind, 0, 0, 0, 0, 0, 0, len(content), 24, 0)
    head = head[:16] + struct.pack("<IHH", len(content), 24, 0)
    size = 24 + len(content) + (-(24 + len(content))) % 8
    return struct.pack("<II", kind, size) + head[8:24] + content + b"\0" * (size - 24 - len(content))


def record(number=42, name="a.txt", size=1024):
    si = struct.pack("<QQQQ", TICKS, TICKS + 10, TICKS + 20, TICKS + 30) + struct.pack("<IIII", 32, 0, 0, 0) + b"\0" * 24
    text = name.encode("utf-16-le")
    body = attribute(0x10, si) + attribute(0x30, struct.pack("<QQQQQQQ", 5 | 7 << 48, 0, 0, 0, 0, 1, 2) + struct.pack("<IBBBB", 0, 0, 0, 0, 0) + bytes([len(name), 1]) + text) + struct.pack("<I", 0xFFFFFFFF)
    head = struct.pack("<4sHHQHHHHII", b"FILE", 48, 3, 0, 3, 1, 56, 1, len(body) + 56, size).ljust(44, b"\0") + struct.pack("<I", number)
    raw = bytearray((head + struct.pack("<HHH", 0x0007, 0, 0)).ljust(56, b"\0") + body)
    raw = raw.ljust(size, b"\0")
    for k in (0, 1):
        raw[50 + 2 * k : 52 + 2 * k] = raw[512 * k + 510 : 512 * k + 512]
        raw[512 * k + 510 : 512 * k + 512] = struct.pack("<H", 7)
    return bytes(raw)


def test_mft_record_fields():
    r = mft.decode(record(), 42)
    assert r["is_valid"] and r["record_number_matches"] and r["fixups_applied"] and r["si"]["created"] == TICKS and r["si"]["accessed"] == TICKS + 30
    assert r["names"][0]["name_spec"] == "a.txt" and r["names"][0]["parent_record"] == 5 and r["names"][0]["parent_directory"] == 7


@pytest.mark.parametrize("raw", [b"", b"FILE", b"\0" * 1024, record()[:4] + b"\xff\xff\xff\xff" + record()[8:]])
def test_mft_bad_records_are_rows(raw):
    r = mft.decode(raw, 3)
    assert not r["is_valid"] and r["error"] and r["record_number"] == 3


def test_mft_file(spark, tmp_path):
    (tmp_path / "mft.bin").write_bytes(record(0) + record(1, "b") + record(2)[:100])
    rows = sorted(mft.read_mft(spark, str(tmp_path)).collect(), key=lambda r: r["expected_record_number"])
    assert [r["is_valid"] for r in rows] == [True, True, False] and rows[0]["created_time"].year == 2024
    assert mft.record_size(record(size=4096)[:4096]) == 4096 and mft.record_size(b"") == 1024


def test_paths_at_any_place():
    rng = random.Random(11)
    for _ in range(200):
        prefix = bytes(rng.randrange(1, 32) for _ in range(rng.randrange(0, 40)))
        want = "C:\\Users\\" + "".join(rng.choice("abcdef") for _ in range(8))
        assert want in [p for _, p in registry.paths(prefix + b"\0\0" * (len(prefix) % 2) + want.encode("utf-16-le") + b"\0\0\0\0")]


def test_cache_entries():
    path = "C:\\Windows\\x.exe".encode("utf-16-le")
    body = b"\0" * 12 + path + b"\0\0" + struct.pack("<Q", TICKS) + b"\0" * 8
    blob = struct.pack("<I", len(body) + 4) + body + b"\0" * 16
    (entry,) = registry.cache_entries(blob)
    assert entry["path"] == "C:\\Windows\\x.exe" and entry["ticks"] == TICKS and entry["parse_method"] == "length-scan"
    assert registry.cache_entries(b"x")[0]["error"] and registry.cache_entries(b"\0" * 64)[0]["error"]


def test_bags_and_first_values(spark):
    blob = bytearray(b"\x14\x00" + "D:\\data".encode("utf-16-le") + b"\0\0\0\0")
    keys = [("h", "Software\\BagMRU", 0, "0", blob), ("h", "Software\\BagMRU\\1a", 1, "1", blob), ("h", "Software\\BagMRU\\xyz", 2, "2", blob), ("h", "Software\\BagMRU", 3, "MRUList", blob), ("h", "ControlSet001\\Control\\Session Manager\\AppCompatCache", 4, "AppCompatCache", blob)]
    rows = spark.createDataFrame(keys, "hive string, key_path string, ordinal int, value_name string, value binary")
    assert sorted(r["key_path"] for r in registry.folder_bags(rows, "Software\\BagMRU").collect()) == ["Software\\BagMRU", "Software\\BagMRU\\1a"]
    assert registry.application_cache(registry.first_values(rows)).count() == 1


def test_prefetch(spark, tmp_path):
    (tmp_path / "CMD.EXE-0BD30981.pf").write_bytes(b"MAM\x04" + b"x" * 300)
    (tmp_path / "Z.pf").write_bytes(b"\0" * 5338)
    (tmp_path / "T.pf").write_bytes(b"text")
    rows = {r["executable"]: r for r in prefetch.read_prefetch(spark, str(tmp_path)).collect()}
    assert rows["CMD.EXE"]["container"] == "MAM" and rows["CMD.EXE"]["name_hash"] == "0BD30981" and rows["CMD.EXE"]["degraded"]
    assert rows["Z"]["container"] == "ZERO_FILLED" and rows["T"]["error"] == "not a prefetch file"
    found = discovery.routed(discovery.files(spark, str(tmp_path), limit=2)).collect()
    assert [r["adapter"] for r in found] == ["prefetch"] * 3 and [r["skipped"] for r in sorted(found, key=lambda r: r["ordinal"])] == [False, False, True]


CASE = {
    "schema_version": "case-v1",
    "context": {"os_profile": "windows", "os_release": "Windows 10 22H2", "scope": "host", "interval_start": "2024-01-01T00:00:00Z", "interval_end": "2024-01-02T00:00:00+00:00", "acquisition_ref": "a"},
    "activities": [{"action": "process_execution", "primary_action_evidence": {"evidence_ref": "p", "observed_at": "2024-01-01T10:00:00Z"}, "observations": [{"artifact_type": "security_event_4688", "status": "present", "evidence_ref": "e"}]}, {"action": "file_change", "observations": []}],
}


def changed(**parts):
    return json.dumps({**CASE, **parts})


BAD = [changed(schema_version="x"), changed(more=1), changed(context={**CASE["context"], "interval_start": "2024-01-01T00:00:00"}), json.dumps(CASE)[:-1] + ',"activities":[]}', changed(activities=[CASE["activities"][1]] * 2), changed(activities=[{"action": "a", "observations": [{"artifact_type": "x", "status": "unknown"}]}]), "[" * 10000, "{", " " * (5 * 1024 * 1024 + 1)]


def test_cases(spark, tmp_path):
    (tmp_path / "good.json").write_text(json.dumps(CASE))
    for k, bad in enumerate(BAD):
        (tmp_path / f"bad{k}.json").write_text(bad)
    found = cases.read_cases(spark, str(tmp_path))
    assert found["errors"].count() == len(BAD) and found["cases"].count() == 1
    rows = matrix.evidence_matrix(found["cases"].select("case_id", "os_release", "actions"), found["observations"], found["activities"])
    assert {(r["artifact_type"], r["status"], r["reason"]) for r in rows.collect()} == {("security_event_4688", "present", None), ("ntfs_usn_change_journal", "unknown", "conditions_unverified"), ("ntfs_mft_entry", "unknown", "conditions_unverified")}


def test_timeline_file(spark, tmp_path):
    head = ",".join(timelines.COLUMNS)
    good = ",".join(["d", "t", "z", "m", "Microsoft-Windows-Security-Auditing", "Security", "4688", *["x"] * 10])
    (tmp_path / "t.csv").write_text(f"{head}\n{good}\nshort,row\n{good}\n")
    rows = timelines.read_timeline(spark, str(tmp_path / "t.csv")).orderBy("row_num").collect()
    assert [r["row_num"] for r in rows] == [1, 2, 3] and [r["bad_record"] is None for r in rows] == [True, False, True]
    assert timelines.missing_columns(["date"])[0] == "time"


def test_mft_in_stretches_equals_whole(spark, tmp_path):
    rng = random.Random(4)
    odd = [record(k, f"n{k}") if rng.random() < 0.8 else bytes(rng.randrange(256) for _ in range(1024)) for k in range(60)]
    (tmp_path / "a b.bin").write_bytes(b"".join(odd) + record(60)[:300])
    (tmp_path / "big.bin").write_bytes(record(0, size=4096) + record(1, size=4096))
    (tmp_path / "empty.bin").write_bytes(b"")
    whole = mft.records(spark.read.format("binaryFile").load(str(tmp_path)).select("path", "content"))
    spark.dataSource.register(mft.MftSource)
    parts = spark.read.format("mft").option("split", 7 * 1024).load(str(tmp_path))
    assert parts.rdd.getNumPartitions() == 11
    names = [c for c in mft.NAMES if c != "path"]
    assert sorted(map(str, parts.select(names).collect())) == sorted(map(str, whole.select(names).collect()))
    assert {r["path"] for r in parts.select("path").distinct().collect()} == {str(tmp_path / "a b.bin"), str(tmp_path / "big.bin")}
    assert mft.read_mft(spark, f"file://{tmp_path}/a%20b.bin").count() == 61 and mft.read_mft(spark, str(tmp_path / "empty.bin")).count() == 0


def test_mft_over_two_gigabytes_is_dealt_to_many_tasks(spark, tmp_path):
    path = tmp_path / "huge.bin"
    with open(path, "wb") as f:  # a sparse file
        f.write(record(0))
        f.truncate(3 << 30)
        f.seek((3 << 30) - 1024)
        f.write(record(7))
    reader = mft.MftReader(str(path), mft.SPLIT, StructType.fromDDL(mft.SCHEMA))
    parts = reader.partitions()
    assert len(parts) == 96 and all(p.start % 1024 == 0 for p in parts)
    (last,) = list(reader.read(mft.Stretch(str(path), 1024, (3 << 30) - 2048, 3 << 30, 3 << 30)))
    assert last.column("is_valid").to_pylist() == [False, True] and last.column("expected_record_number").to_pylist()[1] == 3 * 1024 * 1024 - 1
