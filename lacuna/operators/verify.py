"""Verification of sealed documents: one row per document and check."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.functions.canonical import digest, strict_json
from lacuna.operators import seal

SCHEMA = "doc_key string, ordinal int, check string, name string, passed boolean, detail string"
BUNDLE_FIELDS = "bundle_version timestamp context catalog_version canonicalize_version schema_version records counts integrity".split()
COUNTS = "present confirmed_absent unknown out_of_scope".split()

Check = tuple[str, str, bool, str]


def _hex64(value: Any) -> bool:
    return isinstance(value, str) and len(value) == 64 and set(value) <= set("0123456789abcdef")


def export_checks(document: Any) -> Iterator[Check]:
    """The checks of an export in order; after a hard failure there are no more."""
    if not isinstance(document, dict):
        yield "V1", "object", False, type(document).__name__
        return
    gates: list[tuple[str, str, Callable[[], bool]]] = [
        ("V1", "kind", lambda: document.get("kind") in seal.KINDS),
        ("V1", "export_version", lambda: str(document.get("export_version", "")) == seal.EXPORT_VERSION),
        ("V1", "canonicalize_version", lambda: str(document.get("canonicalize_version", "")) == "2"),
        ("V2", "integrity_present", lambda: isinstance(document.get("integrity"), dict)),
        ("V2", "integrity_complete", lambda: seal.is_sealed(document)),
        ("V2", "algorithm", lambda: document["integrity"].get("algorithm") in (None, "sha256")),
        ("V2", "digest_form", lambda: all(_hex64(document["integrity"][k]) for k in seal.DIGESTS)),
    ]
    body = {k: v for k, v in document.items() if k != "integrity"}
    block = document.get("integrity")
    recorded = {k: block.get(k) for k in seal.DIGESTS[:2]} if isinstance(block, dict) else {}
    derived = {"provenance_hash": lambda: {"provenance": document.get("provenance")}, "payload_hash": lambda: body, "export_hash": lambda: {**body, "integrity": recorded}}
    gates += [(f"V{k}", name, lambda name=name: digest(derived[name]()) == document["integrity"][name]) for k, name in enumerate(seal.DIGESTS, 3)]
    provenance = document.get("provenance")
    gates.append(("V6", "provenance_object", lambda: isinstance(provenance, dict)))
    for check, name, test in gates:
        try:
            passed, detail = bool(test()), ""
        except TypeError as e:
            passed, detail = False, str(e)
        yield check, name, passed, detail
        if not passed:
            return
    parser = provenance.get("parser")
    parser = parser if isinstance(parser, dict) else {}
    yield "V6", "parser_declared", bool(parser.get("name")) and bool(parser.get("version")), ""
    for name in ("transformations", "limitations"):
        yield "V6", name, isinstance(provenance.get(name), list) and bool(provenance[name]), ""
    sources = provenance.get("sources")
    if not isinstance(sources, list) or not sources:
        yield "V6", "sources", False, ""
        return
    bare = [str(s.get("path", "?")) if isinstance(s, dict) else "malformed" for s in sources if not (isinstance(s, dict) and (s.get("sha256") or s.get("tree_sha256")))]
    yield "V6", "sources_have_digests", not bare, ", ".join(bare)


def bundle_checks(bundle: dict[str, Any], schema_version: str) -> Iterator[Check]:
    """The checks of a bundle: structure, digests, counts, attestation, log anchor. Without structure there are no others."""
    block = bundle.get("integrity") if isinstance(bundle.get("integrity"), dict) else {}
    counts = bundle.get("counts") if isinstance(bundle.get("counts"), dict) else {}
    lacking = [f for f in BUNDLE_FIELDS if f not in bundle] + [f for f in ("bundle_hash", "records_hash", "context_hash", "catalog_hash") if f not in block] + [f for f in ("expected", *COUNTS) if f not in counts]
    formed = not lacking and bundle["bundle_version"] == "1.0" and bundle["canonicalize_version"] in ("1", "2") and bundle["schema_version"] == schema_version
    yield "R0", "structure", formed, ", ".join(lacking)
    if not formed:
        return
    version = bundle["canonicalize_version"]
    for name, value in seal.bundle_digests(bundle, version).items():
        yield "R1", name, value == block[name], ""
    covered = {k: v for k, v in bundle.items() if k not in seal.UNCOVERED}
    print_ = block.get("analysis_fingerprint")
    yield "R2", "analysis_fingerprint", not print_ or digest(seal._replay_view(covered), version) == print_, ""
    yield "R1", "bundle_hash", digest(covered, version) == block["bundle_hash"], ""
    log, tip = bundle.get("tool_execution_log"), bundle.get("chain_tip_sha256")
    yield "R1", "seal_scope", "tool_execution_log" not in bundle or bool(tip), ""
    yield "R3", "count_sum", sum(counts[k] for k in COUNTS) == counts["expected"], ""
    tally = {k: sum(r.get("status") == k for r in bundle["records"]) for k in COUNTS}
    yield "R3", "counts_of_records", all(tally[k] == counts[k] for k in COUNTS), ""
    engine = block.get("engine_attestation_hash") or ""
    yield "R4", "engine_attestation", _hex64(engine.lower()), ""
    yield "R4", "engine_attestation_covered", engine == (bundle.get("engine_attestation_hash") or ""), ""
    anchored = "tool_execution_log" not in bundle or (_hex64(str(tip).lower()) and (not bundle.get("chain_tip_hmac") or len(bundle["chain_tip_hmac"]) == 64) and (not log or log[-1].get("entry_hash") == tip))
    yield "R5", "log_anchor", anchored, ""


def level(checks: list[Check]) -> int:
    """0 without structure, 1 with it, 2 with all digests and counts, 3 with attestation and anchor too."""
    passed = lambda *names: all(ok for check, name, ok, _ in checks if name in names)
    if not passed("structure"):
        return 0
    if not passed("records_hash", "context_hash", "catalog_hash", "analysis_fingerprint", "bundle_hash", "count_sum"):
        return 1
    return 3 if passed("engine_attestation", "log_anchor") else 2


def levels(checks: DataFrame) -> DataFrame:
    """Per bundle its conformity level, as ``level`` has it, from rows of checks."""
    failed = lambda names: F.coalesce(F.bool_or(F.col("name").isin(*names) & ~F.col("passed")), F.lit(False))
    digests = ("records_hash", "context_hash", "catalog_hash", "analysis_fingerprint", "bundle_hash", "count_sum")
    found = F.when(failed(("structure", "readable")), 0).when(failed(digests), 1).when(failed(("engine_attestation", "log_anchor")), 2).otherwise(3)
    return checks.groupBy("doc_key").agg(found.alias("conformity_level"))


def source_checks(documents: DataFrame, key: str, column: str, files: DataFrame) -> DataFrame:
    """Check V7: per document whether the digests that it recorded are those of files(path, sha256) now.

    It fails if no source has a digest, a file is gone, or one differs; which
    are gone is in the detail.
    """
    schema = "array<struct<path:string,sha256:string>>"
    found = documents.select(F.col(key).cast("string").alias("doc_key"), F.explode_outer(F.from_json(F.get_json_object(column, "$.provenance.sources"), schema)).alias("s"))
    now = files.select(F.col("path").alias("now_path"), F.col("sha256").alias("now"))
    both = found.select("doc_key", "s.path", "s.sha256").join(now, F.col("path") == F.col("now_path"), "left")
    recorded = F.col("path").isNotNull() & F.col("sha256").isNotNull()
    counted = both.groupBy("doc_key").agg(F.count_if(recorded).alias("n"), F.count_if(recorded & (F.col("now") == F.col("sha256"))).alias("same"), F.array_sort(F.collect_list(F.when(recorded & F.col("now").isNull(), F.col("path")))).alias("gone"))
    detail = F.concat(F.col("same"), F.lit(" of "), F.col("n"), F.lit(" match"), F.when(F.size("gone") > 0, F.concat(F.lit("; gone: "), F.array_join("gone", ", "))).otherwise(F.lit("")))
    return counted.select("doc_key", F.lit(99).alias("ordinal"), F.lit("V7").alias("check"), F.lit("sources_rehash").alias("name"), ((F.col("n") > 0) & (F.col("n") == F.col("same"))).alias("passed"), detail.alias("detail"))


def verify_rows(documents: DataFrame, key: str, column: str, *, kind: str = "export", schema_version: str = "evidence-matrix-v3") -> DataFrame:
    """documents(key, JSON text) exploded into their checks; an unreadable text has one failed check."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for name, text in zip(frame["k"], frame["t"], strict=True):
                try:
                    value = strict_json(text)
                except (ValueError, TypeError, RecursionError) as e:
                    rows.append((name, 0, "V0", "readable", False, type(e).__name__))
                    continue
                found = export_checks(value) if kind == "export" else bundle_checks(value if isinstance(value, dict) else {}, schema_version)
                rows += [(name, k, *check) for k, check in enumerate(found)]
            yield pd.DataFrame(rows, columns=["doc_key", "ordinal", "check", "name", "passed", "detail"])

    return documents.select(F.col(key).cast("string").alias("k"), F.col(column).alias("t")).mapInPandas(run, SCHEMA)


def report(checks: DataFrame) -> DataFrame:
    """Per document: checks, failures and their names in order, and an exit code (0 all passed, 1 not, 2 unreadable)."""
    failed = F.array_sort(F.collect_list(F.when(~F.col("passed"), F.struct("ordinal", "name"))))
    out = checks.groupBy("doc_key").agg(F.count("*").alias("checks"), F.count_if(~F.col("passed")).alias("failures"), F.transform(failed, lambda x: x["name"]).alias("failed"))
    return out.withColumn("code", F.when(F.array_contains("failed", "readable"), 2).when(F.col("failures") > 0, 1).otherwise(0))
