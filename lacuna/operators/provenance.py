"""Where exported rows come from: readers, their transformations and limits, and digests of sources."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from dataclasses import asdict, dataclass
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VERSION = "1"


@dataclass(frozen=True)
class Reader:
    name: str
    supports: tuple[str, ...]
    transformations: tuple[str, ...]
    limitations: tuple[str, ...]
    requires: str | None = None
    determinism_level: str = "deterministic"
    version: str = "1"


READERS = {
    r.name: r
    for r in (
        Reader("mft", ("NTFS master file table",), ("sector ends restored from the update sequence", "record size taken from the first record", "attributes decoded at their content offset", "times converted by whole-number arithmetic"), ("tested on synthetic records", "content of non-resident attributes is not read")),
        Reader("prefetch", ("Windows prefetch files",), ("container recognised by its first bytes", "file name split into executable and hash", "SHA-256 of the whole file"), ("run times and counts need an optional decoder", "why a file is filled with zeros is not determined"), "decoder library (optional)", "best_effort"),
        Reader("amcache", ("application inventory values",), ("numbered values renamed to fields", "four-byte prefixes removed", "three documented times converted"), ("devices and drivers are not read",), "hive reader (optional)"),
        Reader("shimcache", ("application cache value",), ("first value of its name in each control set", "length-prefixed frames scanned for a path", "method recorded for each entry"), ("the record layout is not decoded", "a time is recognised by its range"), "hive reader (optional)", "best_effort"),
        Reader("shellbags", ("folder bag values",), ("hexadecimal children followed eight levels down", "UTF-16 paths searched at both alignments"), ("only paths are recovered", "a path is no proof that the folder existed"), "hive reader (optional)", "best_effort"),
        Reader("timeline", ("timeline files of 17 columns",), ("rows validated and mapped explicitly", "one unknown observation for each target"), ("unmatched rows are counted, never turned into presence",)),
    )
}


def describe(reader: Reader, sources: list[dict[str, Any]], **run: Any) -> dict[str, Any]:
    """A provenance record for a document."""
    own = asdict(reader)
    parser = {k: list(v) if isinstance(v, tuple) else v for k, v in own.items() if k not in ("transformations", "limitations")}
    record = {"provenance_version": VERSION, "parser": parser, "transformations": list(reader.transformations), "limitations": list(reader.limitations), "sources": sources}
    return {**record, "run": run} if run else record


def file_digest(path: Path) -> str:
    with path.open("rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def tree_digest(root: Path) -> str:
    """Digest of a folder: relative path, size and digest of each file, in order of path."""
    out = hashlib.sha256()
    for path in sorted(p for p in root.rglob("*") if p.is_file()):
        out.update(f"{path.relative_to(root).as_posix()}\0{path.stat().st_size}\0{file_digest(path)}\n".encode())
    return out.hexdigest()


def source(path: Path, label: str = "") -> dict[str, Any]:
    """What is known of a source: digest of a file or of a folder's tree; none of what isn't there."""
    is_file, is_dir = path.is_file(), path.is_dir()
    return {
        "label": label or path.name,
        "path": str(path),
        "is_file": is_file,
        "is_dir": is_dir,
        "size_bytes": path.stat().st_size if is_file else None,
        "sha256": file_digest(path) if is_file else None,
        "tree_sha256": tree_digest(path) if is_dir else None,
        "file_count": sum(p.is_file() for p in path.rglob("*")) if is_dir else None,
        "hash_error": None if is_file or is_dir else "not found",
    }


def source_rows(files: DataFrame) -> DataFrame:
    """files(path, content) as source descriptors, for many files at once."""
    name: Column = F.element_at(F.split("path", "/"), -1)
    return files.select(name.alias("label"), "path", F.lit(True).alias("is_file"), F.length("content").cast("long").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))


def attest(folders: Iterable[Path], manifests: Iterable[Path] = ()) -> str:
    """Digest of the engine: its source trees and dependency manifests, in the order given."""
    out = hashlib.sha256()
    for path in folders:
        out.update(tree_digest(path).encode())
    for path in manifests:
        out.update((file_digest(path) if path.is_file() else "absent").encode())
    return out.hexdigest()
