import pytest
from pyspark.sql import functions as F

from lacuna.cli import main, parser
from lacuna.functions import binary, canonical, names
from lacuna.operators import chain, matrix, rivals, seal, timeline, verify
from lacuna.plans import catalog, hypotheses, mappings
from lacuna.streaming.chains import check_table

PAYLOAD = {"provenance": {"parser": {"name": "n", "version": "1"}, "transformations": ["t"], "limitations": ["l"], "sources": [{"path": "p", "sha256": "0" * 64}]}, "records": [{"a": 1, "b": "x"}]}


def checks(document):
    return list(verify.export_checks(document))


def test_sealed_export_verifies_and_is_idempotent():
    sealed = seal.seal_export(PAYLOAD)
    assert all(ok for _, _, ok, _ in checks(sealed)) and seal.seal_export(sealed) == sealed and seal.is_sealed(sealed) and not seal.is_sealed(PAYLOAD)


@pytest.mark.parametrize(
    "alter,last",
    [
        (lambda d: d.pop("kind"), "kind"),
        (lambda d: d.update(export_version="9"), "export_version"),
        (lambda d: d.update(canonicalize_version="1"), "canonicalize_version"),
        (lambda d: d.pop("integrity"), "integrity_present"),
        (lambda d: d["integrity"].pop("export_hash"), "integrity_complete"),
        (lambda d: d["integrity"].update(algorithm="md5"), "algorithm"),
        (lambda d: d["integrity"].update(export_hash="Z" * 64), "digest_form"),
        (lambda d: d["provenance"].update(x=1), "provenance_hash"),
        (lambda d: d["records"][0].update(a=2), "payload_hash"),
        (lambda d: d["integrity"].update(export_hash="0" * 64), "export_hash"),
    ],
)
def test_altered_exports_stop_at_the_check(alter, last):
    import copy

    document = copy.deepcopy(seal.seal_export(PAYLOAD))
    alter(document)
    found = checks(document)
    assert found[-1][1] == last and not found[-1][2] and all(ok for _, _, ok, _ in found[:-1])


def bundle():
    counts = {"expected": 1, "present": 1, "confirmed_absent": 0, "unknown": 0, "out_of_scope": 0}
    return {"bundle_id": "b", "bundle_version": "1.0", "timestamp": "t", "context": {"interval_start": "a", "interval_end": "b", "scope": "s"}, "catalog_version": catalog.VERSION, "canonicalize_version": "2", "schema_version": "evidence-matrix-v3", "records": [{"status": "present"}], "counts": counts}


def test_bundle_levels():
    run = lambda b: list(verify.bundle_checks(b, "evidence-matrix-v3"))
    full = seal.seal_bundle(bundle(), "a" * 64)
    assert verify.level(run(full)) == 3 and verify.level(run(seal.seal_bundle(bundle()))) == 2
    assert verify.level(run({**full, "records": []})) == 1 and verify.level(run({})) == 0
    logged = {**seal.seal_bundle(bundle(), "a" * 64, {"chain_tip_sha256": "b" * 64}), "tool_execution_log": [{"entry_hash": "b" * 64}]}
    assert verify.level(run(logged)) == 3 and verify.level(run({**logged, "tool_execution_log": [{"entry_hash": "c" * 64}]})) == 2
    moved = seal.seal_bundle({**bundle(), "bundle_id": "other", "timestamp": "u"}, "a" * 64)
    assert moved["integrity"]["analysis_fingerprint"] == full["integrity"]["analysis_fingerprint"] and moved["integrity"]["bundle_hash"] != full["integrity"]["bundle_hash"]


@pytest.fixture(scope="module")
def log(spark):
    rows = spark.createDataFrame([(c, k, f'{{"k": {k}}}') for c in (1, 2) for k in range(5)], "chain_id long, pos long, payload string")
    return chain.append(rows).cache()


def test_chain_builds_and_breaks(spark, log):
    recomputed = canonical.entry_udf()(F.col("seq"), F.col("prev_hash"), F.col("payload"))
    good = chain.summarize(chain.content_errors(chain.link_errors(log), recomputed))
    assert [r["valid"] for r in good.collect()] == [True, True]
    cut = log.where("not (chain_id = 1 and pos = 2)")
    bad = {r["chain_id"]: r for r in chain.summarize(chain.link_errors(cut)).collect()}
    assert bad[1]["n_seq_gap"] == bad[1]["n_broken_link"] == 1 and bad[1]["first_invalid_seq"] == 4 and bad[2]["valid"]
    forged = log.withColumn("payload", F.when(F.col("pos") == 3, '{"k": 9}').otherwise(F.col("payload")))
    assert {r["first_invalid_seq"] for r in chain.summarize(chain.content_errors(chain.link_errors(forged), recomputed)).collect()} == {4}


def test_keys_and_tips(spark, log):
    mac = canonical.hmac_udf(b"k" * 32)
    signed = log.withColumn("entry_hmac", F.when(F.col("pos") != 1, mac("entry_hash")))
    assert [r["hmac_error"] for r in chain.key_errors(signed, mac).where("pos < 2 and chain_id = 1").orderBy("pos").collect()] == [None, "missing"]
    tips = chain.summarize(chain.link_errors(log)).select("chain_id", F.col("tip").alias("chain_tip"))
    short = chain.summarize(chain.link_errors(log.where("pos < 4 and chain_id = 1")))
    found = {r["chain_id"]: r["tip_mismatch"] for r in chain.tip_errors(short, tips).collect()}
    assert found == {1: True, 2: True}


def test_stream_and_batch_agree(spark, log):
    cut = log.where("not (chain_id = 1 and pos = 2)").select("chain_id", "pos", "seq", "prev_hash", "entry_hash")
    batch = chain.summarize(chain.link_errors(cut)).select("chain_id", "length", "n_seq_gap", "n_broken_link")
    stream = check_table(cut).select("chain_id", "length", "n_seq_gap", "n_broken_link")
    assert sorted(map(tuple, batch.collect())) == sorted(map(tuple, stream.collect()))


def test_jvm_fold_has_valid_links(spark, log):
    rows = log.select("chain_id", "pos", "payload")
    digest = lambda seq, prev, payload: F.sha2(F.concat_ws("|", prev, seq.cast("string"), payload), 256)
    assert all(r["valid"] for r in chain.summarize(chain.link_errors(chain.append(rows, digest))).collect())


CASES = {
    "mixed": {"security_event_4688": "unknown", "security_event_5156": "present", "security_event_4624": "out_of_scope", "security_event_4634": "confirmed_absent", "ntfs_usn_change_journal": "present", "ntfs_mft_entry": "unknown"},
    "seen": {"security_event_4688": "present", "ntfs_usn_change_journal": "unknown"},
    "gone": {"security_event_4688": "confirmed_absent", "ntfs_usn_change_journal": "unknown"},
}
ACTION = {e["artifact_type"]: e["action"] for e in catalog.ENTRIES}


def test_rivals(spark):
    rows = spark.createDataFrame([(c, ACTION[a], a, s) for c, own in CASES.items() for a, s in own.items()], "case_id string, action string, artifact_type string, status string")
    levels = rivals.support(rivals.outcomes(rows.select("case_id").distinct(), rows, hypotheses.predictions(spark)))
    got = {(r["case_id"], r["hypothesis_id"]): r for r in levels.collect()}
    assert {h: got["mixed", h]["support_level"] for h, *_ in hypotheses.HYPOTHESES} == {"benign_loss": "weak", "selective_deletion": "falsified", "sensor_failure": "weak", "configuration_gap": "falsified", "non_applicable": "weak"}
    assert float(got["mixed", "selective_deletion"]["disfavors"]) == 0.8 and float(got["mixed", "selective_deletion"]["neutral"]) == 1.0
    assert got["seen", "selective_deletion"]["support_level"] == "strong" and float(got["seen", "selective_deletion"]["favors"]) == 1.0
    assert got["gone", "selective_deletion"]["support_level"] == "falsified"
    found = {r["case_id"]: (r["any_discriminated"], r["finding"]) for r in rivals.summary(levels).collect()}
    assert found["mixed"] == (True, "falsified")
    assert [r["ordinal"] for r in rivals.top_pivots(hypotheses.pivots(spark)).collect()] == list(range(6))
    assert rivals.dangling_impacts(hypotheses.pivots(spark), hypotheses.hypotheses(spark)).isEmpty()


def test_release_and_profile(spark):
    rows = spark.createDataFrame([("windows 10",), ("Windows 10 22H2",), ("Windows 100",), ("Windows",)], "r string")
    assert [r[0] for r in rows.select(catalog.supports_release(F.col("r"), F.lit("Windows 10"))).collect()] == [True, True, False, False]
    assert catalog.catalog(spark).count() == 6
    with pytest.raises(ValueError):
        catalog.catalog(spark, "linux")


def test_conflicts_and_intervals(spark):
    rows = spark.createDataFrame([(1, "a", "x"), (1, "a", "x"), (1, "b", "x"), (1, "b", "y")], "case_id int, action string, v string")
    assert [r["action"] for r in matrix.conflicts(rows, ["case_id", "action"], F.col("v")).collect()] == ["b"]


def test_timeline_rules(spark):
    rows = spark.createDataFrame([(1, "NTFS", "USN", "USN_CHANGE", "usn"), (2, "NTFS", None, "USN_CHANGE", "usn"), (3, "", "x", "y", "z"), (4, None, "x", "y", "z")], "row_num int, source string, sourcetype string, type string, format string")
    found = timeline.classify(rows, list(mappings.DEFAULT), error=timeline.row_error(["source", "type"])).orderBy("row_num").collect()
    assert [r["class"] for r in found] == ["matched", "unmatched", "invalid", "invalid"]
    assert [r["row_error"] for r in found] == [None, None, "blank_source", "missing_source"]


def test_binary_and_names(spark):
    row = spark.createDataFrame([(bytearray(b"\x10\x00\x00\x00\xff\xff\xff\xff\xff\xff\xff\xff"), "1000", 0, "  x\u00a0\n", "000000001234abcd")], "b binary, h string, z long, s string, p string")
    got = row.select(binary.unsigned(F.col("b"), 0, 4), binary.unsigned(F.col("b"), 4, 8), binary.unsigned(F.col("b"), 8, 8), binary.hex_first_int(F.col("h")), binary.filetime(F.col("z")), names.strip(F.col("s")), names.without_prefix(F.col("p"))).first()
    assert (int(got[0]), int(got[1]), got[2], int(got[3]), got[4], got[5], got[6]) == (16, 2**64 - 1, None, 4096, None, "x", "1234ABCD")
    assert row.select(binary.hmac_sha256(b"k", F.col("h"))).first()[0] == canonical.keyed(b"k", "1000")
    assert row.select(binary.iso(F.timestamp_micros(F.lit(1_500_000)))).first()[0] == "1970-01-01T00:00:01.500000+00:00"


def test_command_line(spark, tmp_path, capsys):
    import json

    (tmp_path / "d.json").write_text(json.dumps(seal.seal_export(PAYLOAD)))
    assert main(["verify", str(tmp_path)]) == 0
    (tmp_path / "d.json").write_text(json.dumps(PAYLOAD))
    assert main(["verify", str(tmp_path)]) == 1 and main(["seal", str(tmp_path)]) == 0
    assert '"failed":["kind"]' in capsys.readouterr().out
    assert parser().parse_args(["analyze", "x"]).command == "analyze"
