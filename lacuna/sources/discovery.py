"""Which files there are, and which adapter reads each."""

from __future__ import annotations

import re
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.operators.numbering import ranked

# Adapter, and the pattern of lower-case file names that it reads.
ROUTES = (("mft", r"^\$?mft(\..*)?$"), ("prefetch", r"\.pf$"), ("amcache", r"^amcache\.hve$"), ("shimcache", r"^system$"), ("shellbags", r"^(ntuser\.dat|usrclass\.dat)$"))


def files(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = True, limit: int | None = None) -> DataFrame:
    """Files in order of path, each once, with ordinal; beyond a limit they are marked as skipped, not lost."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(path).select("path", "length", "modificationTime").distinct()
    out = ranked(found, ["path"], "ordinal", 0)
    return out.withColumn("skipped", F.lit(False) if limit is None else F.col("ordinal") >= limit)


def adapter_of(name: str) -> str | None:
    """The adapter that reads a file of that name."""
    return next((a for a, p in ROUTES if re.search(p, name.lower())), None)


def routed(files: DataFrame) -> DataFrame:
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    return files.withColumn("adapter", F.coalesce(*[F.when(name.rlike(p), a) for a, p in ROUTES]))


def inputs(paths: Iterable[Path], pattern: str = "*", recursive: bool = False) -> list[Path]:
    """Files among paths, and those in folders that match, sorted within each folder; each file once, at its first place."""
    found: dict[Path, Path] = {}
    for path in paths:
        inside = sorted(p for p in (path.rglob(pattern) if recursive else path.glob(pattern)) if p.is_file()) if path.is_dir() else [path]
        for file in inside:
            found.setdefault(file.resolve(), file)
    return list(found.values())
