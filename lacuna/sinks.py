"""Writers that never leave half a file and never write over another input's output."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
from collections.abc import Callable, Iterable
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, Row

from lacuna.adapters import distinct_values, incomplete
from lacuna.functions.canonical import digest
from lacuna.operators.provenance import READERS, describe, source
from lacuna.operators.seal import KIND, MANIFEST, seal_export


def write_atomic(path: Path, text: str) -> str:
    """Write through a temporary file, rename, read back; the digest of what is on disk."""
    path.parent.mkdir(parents=True, exist_ok=True)
    handle, temporary = tempfile.mkstemp(dir=path.parent, prefix=f".{path.name}.")
    try:
        with os.fdopen(handle, "w", encoding="utf-8", newline="") as out:
            out.write(text)
            out.flush()
            os.fsync(out.fileno())
        os.replace(temporary, path)
    except BaseException:
        Path(temporary).unlink(missing_ok=True)
        raise
    want, have = hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(path.read_bytes()).hexdigest()
    if want != have:
        raise OSError(f"{path}: what was read back differs")
    return have


def save_document(path: Path, document: dict[str, Any]) -> str:
    return write_atomic(path, json.dumps(document, indent=2, ensure_ascii=False) + "\n")


def plain(value: Any) -> Any:
    """Rows, binary values, decimals and times as JSON values; binary is tagged hexadecimal."""
    if isinstance(value, Row):
        return {k: plain(v) for k, v in value.asDict().items()}
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, list | tuple):
        return [plain(v) for v in value]
    if isinstance(value, bytes | bytearray):
        return "hex:" + bytes(value).hex()
    if value is None or isinstance(value, bool | int | float | str):
        return value
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return int(value) if value == int(value) else float(value)


def export(rows: DataFrame, reader: str, sources: list[dict[str, Any]], *, limit: int | None, order: list[str], kind: str = KIND, **run: Any) -> dict[str, Any]:
    """A sealed document of at most ``limit`` rows (None: all), in order, that says how many there were. A document is one file, which the driver writes."""
    total = rows.count()
    rows = rows.orderBy(*order)
    records = [plain(r) for r in (rows if limit is None else rows.limit(limit)).toLocalIterator()]
    counts = {"available": total, "exported": len(records), "left_out": total - len(records)}
    return seal_export({"provenance": describe(READERS[reader], sources, **run), "counts": counts, "records": records}, kind)


def output_name(ordinal: int, name: str) -> str:
    clean = "".join(c if c.isascii() and (c.isalnum() or c in "._-") else "_" for c in name)
    while "__" in clean and clean != name:
        clean = clean.replace("__", "_")
    return f"{ordinal:04d}_{clean.strip('_') or 'input'}.json"


def run_batch(inputs: Iterable[Path], read: Callable[[Path], DataFrame], reader: str, out: Path, *, order: list[str], max_inputs: int | None = 1000, min_inputs: int = 1, max_items: int | None = 100_000, listed: Iterable[str] = ()) -> dict[str, Any]:
    """One sealed document for each input and a sealed manifest. A failing input is a failed row, and the rest goes on.

    An output that is there already and differs is a failure, not overwritten.
    """
    every = list(dict.fromkeys(p.resolve() for p in inputs))
    there = [p for p in every if p.exists()]
    if len(there) < min_inputs:
        raise ValueError(f"{len(there)} inputs; {min_inputs} are needed")
    taken = there[:max_inputs]
    rows = [{"source": str(p), "output": None, "status": "failed", "detail": "not found"} for p in every if p not in there]
    names = [output_name(k, p.name) for k, p in enumerate(taken)]
    if len(set(names)) < len(names):
        raise ValueError("two inputs have one output")
    for path, name in zip(taken, names, strict=True):
        row: dict[str, Any] = {"source": str(path), "output": None, "status": "failed", "detail": "", "source_digest": None}
        try:
            known = source(path)
            row["source_digest"] = known["sha256"] or known["tree_sha256"]
            found = read(path)
            lists = {c: v for c, v in distinct_values(found, list(listed)).first().asDict().items() if v} if listed else {}
            document = export(found, reader, [known], limit=max_items, order=order, **lists)
            target = out / name
            if target.exists() and json.loads(target.read_text())["integrity"]["export_hash"] != document["integrity"]["export_hash"]:
                raise FileExistsError(f"{name} is there and differs")
            save_document(target, document)
            bad = found.where(incomplete(found)).count() if "error" in found.columns else 0
            partial = bad or document["counts"]["left_out"] or not document["counts"]["exported"]
            row |= {"output": name, "status": "partial" if partial else "ok", "detail": f"{bad} with errors" if bad else "", "item_stats": document["counts"]}
        except Exception as e:
            row["detail"] = f"{type(e).__name__}: {str(e)[:200]}"
        rows.append(row)
    summary = {s: sum(r["status"] == s for r in rows) for s in ("ok", "partial", "failed")}
    manifest = {"batch_version": "1", "adapter": reader, "limits": {"max_inputs": max_inputs, "max_items_per_input": max_items}, "inputs_available": len(there), "inputs_processed": len(rows), "inputs_skipped_by_limit": len(there) - len(taken), "summary": summary, "inputs": rows}
    manifest["provenance"] = describe(READERS[reader], [source(p) for p, r in zip(taken, rows[len(every) - len(there) :], strict=True) if r["output"]])
    sealed = seal_export(manifest, MANIFEST)
    save_document(out / "manifest.json", sealed)
    return sealed


def diagnostics(counters: dict[str, Any], sample: list[dict[str, Any]], used: list[str], inputs: list[dict[str, Any]], errors: list[dict[str, Any]]) -> dict[str, Any]:
    """A sealed document on an import: counts, a sample of unmatched rows, mappings used, the first errors."""
    return seal_export({"provenance": describe(READERS["timeline"], inputs), "counts": plain(counters), "unmatched_sample": plain(sample), "mappings_used": used, "errors": plain(errors)})


def enrich_case(template: dict[str, Any], observations: list[dict[str, Any]]) -> dict[str, Any]:
    """A case with new observations added; what it has already stays as it is."""
    activities = [dict(a, observations=list(a["observations"])) for a in template["activities"]]
    by_action = {a["action"]: a for a in activities}
    for o in observations:
        own = by_action.get(o["activity"])
        if own is None:
            own = by_action[o["activity"]] = {"action": o["activity"], "observations": []}
            activities.append(own)
        if all(x["artifact_type"] != o["artifact_type"] for x in own["observations"]):
            own["observations"].append({k: o[k] for k in ("artifact_type", "status", "reason", "evidence_ref")})
    return {**template, "activities": activities}


def markdown(reports: list[dict[str, Any]]) -> str:
    """A table of verification reports, failures first."""
    lines = ["| document | checks | failed |", "|-|-|-|"]
    for r in sorted(reports, key=lambda r: (not r["failures"], r["doc_key"])):
        lines.append(f"| {r['doc_key']} | {r['checks']} | {', '.join(r['failed']) or 'none'} |")
    return "\n".join(lines) + f"\n\nDigest of this report's data: {digest({'reports': plain(reports)})}\n"
