"""Command line: each command reads files with Spark and prints JSON or a report."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna import sinks
from lacuna.adapters import ADAPTERS, distinct_values, incomplete
from lacuna.functions.canonical import hmac_udf
from lacuna.keys import resolve_key
from lacuna.operators import digests, logs, matrix, provenance, rivals, seal, timeline, verify
from lacuna.plans import catalog, hypotheses, mappings
from lacuna.session import session
from lacuna.sources import cases, discovery, registry, timelines


def _matrix(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], DataFrame]:
    found = cases.read_cases(spark, path)
    rows = matrix.evidence_matrix(found["cases"].select("case_id", "os_release", "actions"), found["observations"], found["activities"])
    return found, rows


def _print(rows: DataFrame, order: list[str]) -> int:
    for line in rows.orderBy(*order).toJSON().toLocalIterator():
        print(line)
    return rows.count()


def validate(spark, args) -> int:
    found = cases.read_cases(spark, args.path)
    _print(found["errors"], ["case_id"])
    return 2 if found["errors"].count() else 0


def analyze(spark, args) -> int:
    """Counts of each case with its context and the digest of context and matrix, then the matrix."""
    found, rows = _matrix(spark, args.path)
    known = found["cases"]
    names = [c for c in known.columns if c not in ("case_id", "actions")]
    context = known.select("case_id", F.struct(*names).alias("context"))
    text = context.select("case_id", F.to_json("context", {"ignoreNullFields": "false"}).alias("context"))
    heads = matrix.coverage(rows).join(digests.analysis_digests(text, rows), "case_id").join(context, "case_id")
    _print(heads.withColumns({"schema_version": F.lit(digests.SCHEMA_VERSION), "catalog_version": F.lit(catalog.VERSION)}), ["case_id"])
    _print(rows.drop("required_conditions"), ["case_id", "action", "artifact_type"])
    return 2 if _print(found["errors"], ["case_id"]) else 0


def explain(spark, args) -> int:
    found, rows = _matrix(spark, args.path)
    _print(matrix.explain(rows).select("case_id", "action", "artifact_type", "status", "reason", "missing_conditions", "next_check"), ["case_id", "action", "artifact_type"])
    return 2 if _print(found["errors"], ["case_id"]) else 0


def rival(spark, args) -> int:
    found, rows = _matrix(spark, args.path)
    levels = rivals.support(rivals.outcomes(found["cases"].select("case_id"), rows, hypotheses.predictions(spark)))
    _print(levels, ["case_id", "hypothesis_id"])
    _print(rivals.summary(levels), ["case_id"])
    return 2 if _print(found["errors"], ["case_id"]) else 0


def import_timeline(spark, args) -> int:
    """Counts and new observations; with a case template also the case with them added, and a sealed document of diagnostics."""
    path = Path(args.path)
    if not path.exists() or (args.case and not Path(args.case).is_file()):
        return _refuse(f"{path if not path.exists() else args.case} is not there")
    if args.case and not args.output:
        return _refuse("an enriched case needs --output")
    rows = list(mappings.DEFAULT)
    if args.mapping:
        rows = [tuple(m.get(k) for k in ("source", "sourcetype", "type", "format", "activity", "artifact_type")) for m in json.loads(Path(args.mapping).read_text())]
        if bad := timeline.invalid_targets(mappings.mappings(spark, rows)).count():
            return _refuse(f"{bad} mappings have targets that are not in the catalog")
    template = json.loads(Path(args.case).read_text()) if args.case else {"schema_version": cases.VERSION, "activities": []}
    if template.get("schema_version") != cases.VERSION:
        return _refuse(f"the template's schema_version is not {cases.VERSION}")
    try:
        timelines.check_size(spark, args.path)
        lines = timelines.read_timeline(spark, args.path)
    except ValueError as e:
        return _refuse(str(e))
    error = F.coalesce(F.when(F.col("bad_record").isNotNull(), "field_count"), timeline.row_error())
    classified = timeline.classify(lines, mappings.mappings(spark, rows) if args.mapping else rows, error=error, max_rows=args.max_rows or None)
    counts = timeline.counters(classified)
    _print(counts, ["total_rows"])
    have = [(a["action"], o["artifact_type"]) for a in template["activities"] for o in a.get("observations", [])]
    existing = spark.createDataFrame(have, "activity string, artifact_type string")
    new = timeline.new_observations(timeline.first_matches(classified), existing, F.lit(args.evidence_prefix or path.name))
    _print(new, ["activity", "artifact_type"])
    if args.output:
        found = [r.asDict() for r in new.orderBy("activity", "artifact_type").toLocalIterator()]
        sinks.save_document(Path(args.output), sinks.enrich_case(template, found))
    if args.diagnostics:
        sample = [r.asDict() for r in timeline.unmatched_sample(classified, ["source", "sourcetype", "type", "format", "desc"]).toLocalIterator()]
        used = [f"{r['activity']}/{r['artifact_type']}" for r in timeline.mappings_used(classified).orderBy("position").toLocalIterator()]
        wrong = classified.where("class in ('invalid', 'ambiguous')").orderBy("row_num").limit(timeline.SAMPLE)
        errors = [r.asDict() for r in wrong.select("row_num", "class", "row_error").toLocalIterator()]
        sinks.save_document(Path(args.diagnostics), sinks.diagnostics(counts.first().asDict(), sample, used, [provenance.source(path)], errors))
    return 0


def _refuse(why: str) -> int:
    print(why, file=sys.stderr)
    return 2


def _import(name: str):
    """Exit code 2 for an input that is not there, 1 for one that was not wholly read unless that is allowed."""
    adapter = ADAPTERS[name]

    def run(spark, args) -> int:
        path = Path(args.path)
        if not path.exists():
            return _refuse(f"{path} is not there")
        rows = registry.read_folder_bags(spark, str(path), bag=args.bag) if name == "shellbags" else adapter.read(spark, str(path))
        rows = rows.persist()
        lost = rows.where(incomplete(rows))
        total, wrong = rows.count(), lost.count()
        print(f"{total - wrong} of {total} rows of {path} were wholly read")
        ordered = rows.orderBy(*adapter.order)
        if args.output:
            lists = {c: v for c, v in distinct_values(rows, list(adapter.listed)).first().asDict().items() if v} if adapter.listed else {}
            document = sinks.export(rows, name, [provenance.source(path)], limit=args.max or None, order=list(adapter.order), **lists)
            sinks.save_document(Path(args.output), document)
        shown = (args.max or 100) if args.summary else 0 if args.output else 50
        for line in ordered.limit(shown).toJSON().toLocalIterator():
            print(line)
        if shown and total > shown:
            print(f"and {total - shown} more")
        for r in lost.select("error").distinct().orderBy("error").limit(100).toLocalIterator():
            print(r["error"] or "some rows lack what an optional decoder gives", file=sys.stderr)
        rows.unpersist()
        return 1 if wrong and not args.allow_partial else 0

    return run


def batches(spark, args) -> int:
    """One sealed document for each input and a sealed manifest; exit code 2 if none was begun, 1 if anything was left out."""
    adapter = ADAPTERS[args.adapter]
    found = discovery.inputs(map(Path, args.inputs), args.pattern, args.recursive)
    try:
        manifest = sinks.run_batch(found, lambda p: adapter.read(spark, str(p)), args.adapter, Path(args.out_dir), order=list(adapter.order), listed=adapter.listed, max_inputs=args.max_inputs or None, min_inputs=args.min_inputs, max_items=args.max_items_per_input or None)
    except ValueError as e:
        return _refuse(f"the batch was not begun: {e}")
    if args.json:
        print(json.dumps(manifest, indent=2, sort_keys=True))
    else:
        rows = sorted(manifest["inputs"], key=lambda r: (r["status"] == "ok", r["source"]))
        for r in rows[: args.max_report or None]:
            print(f"{r['status']}\t{r['source']}\t{r['output'] or ''}\t{r['detail']}")
    left = manifest["summary"]["partial"] + manifest["summary"]["failed"] + manifest["inputs_skipped_by_limit"]
    if left:
        print(f"{left} inputs are partial, failed or were left out", file=sys.stderr)
    return 1 if left and not args.allow_partial else 0


def harness(spark, args) -> int:
    """Every artifact below a folder through its adapter, the exports verified again from disk, and a report of both."""
    found: dict[str, list[Path]] = {}
    for file in discovery.inputs([Path(args.path)], recursive=True):
        if name := discovery.adapter_of(file.name):
            found.setdefault(name, []).append(file)
    out, left = Path(args.out_dir), 0
    for name, files in sorted(found.items()):
        if args.only and name not in args.only:
            continue
        adapter = ADAPTERS[name]
        manifest = sinks.run_batch(files, lambda p, adapter=adapter: adapter.read(spark, str(p)), name, out / name, order=list(adapter.order), listed=adapter.listed, max_inputs=None, max_items=None)
        print(f"{name}\t{json.dumps(manifest['summary'], sort_keys=True)}")
        left += manifest["summary"]["partial"] + manifest["summary"]["failed"]
    if not any(out.rglob("*.json")):
        return _refuse(f"no artifacts below {args.path}")
    documents = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").load(str(out)).select("path", F.decode("content", "utf-8").alias("document"))
    reports = [r.asDict() for r in verify.report(verify.verify_rows(documents, "path", "document")).toLocalIterator()]
    sinks.write_atomic(out / "REPORT.md", sinks.markdown(reports) + f"\n{left} inputs are partial or failed. A document that verifies is unchanged, not thereby right.\n")
    return 1 if left or any(r["code"] for r in reports) else 0


def discover(spark, args) -> int:
    _print(discovery.routed(discovery.files(spark, args.path)), ["ordinal"])
    return 0


def _documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", F.decode("content", "utf-8").alias("document"))


def seal_files(spark, args) -> int:
    for row in seal.sealed_rows(_documents(spark, args.path)).toLocalIterator():
        if row["sealed"] is None:
            print(f"{row['path']}: not a JSON object", file=sys.stderr)
            return 2
        print(row["sealed"])
    return 0


def verify_files(spark, args) -> int:
    documents = _documents(spark, args.path)
    checks = verify.verify_rows(documents, "path", "document", kind=args.kind)
    if args.sources:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(args.sources)
        now = files.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), F.sha2("content", 256).alias("sha256"))
        checks = checks.unionByName(verify.source_checks(documents, "path", "document", now))
    found = verify.report(checks)
    if args.kind == "bundle":
        found = found.join(verify.levels(checks), "doc_key")
        found = found.withColumn("code", F.greatest("code", F.when(F.col("conformity_level") < (3 if args.strict else 1), 1).otherwise(0)))
    _print(found, ["doc_key"])
    return found.agg(F.max("code")).first()[0] or 0


def verify_log(spark, args) -> int:
    """Logs of one entry a line, or those within bundles with what these declare of their tips; exit code 1 if any chain is not valid, 2 if there is nothing to verify."""
    if args.bundle:
        documents = _documents(spark, args.path)
        log, declared = logs.logs_of(documents, "path", "document")
    else:
        log = logs.read_log(spark, args.path)
        declared = spark.read.schema("chain_id string, chain_tip string, chain_tip_hmac string").json(args.tips) if args.tips else None
    if log.isEmpty() and declared is None:
        return _refuse(f"{args.path} has no entries")
    mac = None if (key := resolve_key()) is None else hmac_udf(key)
    found = logs.check_log(log, declared, mac).persist()
    wrong = found.where("not valid").count()
    _print(found, ["chain_id"])
    found.unpersist()
    return 1 if wrong else 0


COMMANDS = {
    "validate": validate,
    "analyze": analyze,
    "explain": explain,
    "rivals": rival,
    "import-timeline": import_timeline,
    **{f"import-{name}": _import(name) for name in ADAPTERS},
    "batch": batches,
    "harness": harness,
    "discover": discover,
    "seal": seal_files,
    "verify": verify_files,
    "verify-log": verify_log,
}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="lacuna", description="Reviews declared gaps of evidence; infers neither deletion nor intent.")
    commands = out.add_subparsers(dest="command", required=True)
    for name in COMMANDS:
        own = commands.add_parser(name)
        if name == "batch":
            own.add_argument("inputs", nargs="+")
            own.add_argument("--adapter", required=True, choices=sorted(ADAPTERS))
            own.add_argument("--out-dir", required=True)
            own.add_argument("--pattern", default="*", help="of files in folders")
            for flag in ("--recursive", "--allow-partial", "--json"):
                own.add_argument(flag, action="store_true")
            for flag, default in (("--max-inputs", 0), ("--max-items-per-input", 0), ("--min-inputs", 1), ("--max-report", 20)):
                own.add_argument(flag, type=int, default=default, help="0: all")
            continue
        own.add_argument("path")
        if name == "harness":
            own.add_argument("--out-dir", required=True)
            own.add_argument("--only", action="append", choices=sorted(ADAPTERS))
        elif name == "import-timeline":
            for flag in ("--mapping", "--case", "--output", "--diagnostics", "--evidence-prefix"):
                own.add_argument(flag)
            own.add_argument("--max-rows", type=int, default=timeline.MAX_ROWS, help="0: all")
        elif name.startswith("import-"):
            own.add_argument("--max", type=int, default=0, help="rows written or shown; 0: all")
            own.add_argument("--output", help="a sealed document")
            own.add_argument("--summary", action="store_true")
            own.add_argument("--allow-partial", action="store_true")
            if name == "import-shellbags":
                own.add_argument("--bag", choices=("BagMRU", "Bags"), default="BagMRU")
        if name == "verify-log":
            own.add_argument("--bundle", action="store_true", help="the path is of bundles, whose own logs and tips are verified")
            own.add_argument("--tips", help="declared tips: lines of chain_id, chain_tip, chain_tip_hmac")
        if name == "verify":
            own.add_argument("--kind", choices=("export", "bundle"), default="export")
            own.add_argument("--sources", help="folder of the sources, whose digests are compared with the recorded ones")
            own.add_argument("--strict", action="store_true", help="bundles must reach the highest level")
    return out


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    return COMMANDS[args.command](session(), args)


if __name__ == "__main__":
    sys.exit(main())
