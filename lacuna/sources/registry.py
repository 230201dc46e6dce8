"""Values of registry hives: paths in binary values, application cache blobs, folder bags.

Hives come as rows: keys(hive, ordinal, key_path, value_name, value, ...); see
``hives``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from struct import unpack_from

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.functions.binary import filetime
from lacuna.sources import hives

# How far a scan goes.
FRAMES, FRAME, WINDOW, LONGEST_NAME, DEPTH = 10_000, 4096, 512, 1024, 8
BOOKKEEPING = ("MRUList", "NodeSlotCapacity")
_DRIVE_OR_UNC = re.compile(r"\\\\|.:[\\/]", re.S)
_STRICT = re.compile(r"\\\\|.:\\", re.S)


def _units(data: bytes, at: int) -> str:
    """Printable UTF-16 units from a place on, up to a zero, a control character or the longest name."""
    out = []
    for k in range(at, min(len(data) - 1, at + 2 * LONGEST_NAME), 2):
        unit = data[k] | data[k + 1] << 8
        if unit < 0x20 or unit >= 0xFFFE:
            break
        out.append(chr(unit))
    return "".join(out)


def paths(data: bytes) -> list[tuple[int, str]]:
    """Paths in a value, by either alignment, each text once, in order of place."""
    found: dict[str, int] = {}
    for start in (0, 1):
        at = start
        while at + 1 < len(data):
            text = _units(data, at)
            if len(text) > 3 and _DRIVE_OR_UNC.match(text) and text not in found:
                found[text] = at
                at += 2 * len(text)
            at += 2
    return sorted((at, text) for text, at in found.items())


def path_udf():
    @F.pandas_udf("array<struct<offset:int,path:string>>")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: [{"offset": a, "path": p} for a, p in paths(v or b"")])

    return run


def _frame_path(body: bytes) -> str | None:
    for at in range(0, min(len(body), WINDOW), 2):
        text, zero, _ = body[at:].decode("utf-16-le", "ignore").partition("\0")
        text = text.strip()
        if zero and len(text) > 3 and _STRICT.match(text):
            return text
    return None


def _frame_time(body: bytes) -> int | None:
    """The first number at an even place that is a time in the years 2010 to 2030."""
    low, high = 129_067_776_000_000_000, 135_694_656_000_000_000
    return next((t for t in (unpack_from("<Q", body, k)[0] for k in range(0, len(body) - 8, 2)) if low <= t < high), None)


def _loose_paths(data: bytes) -> Iterator[tuple[int, str]]:
    """Zero-terminated texts at any even place that look like paths; used where no frame has one."""
    at = 0
    while at < len(data) - 4:
        end = data.find(b"\0\0", at)
        if end == -1 or end >= at + 2048:
            at += 2
            continue
        text = data[at:end].decode("utf-16-le", "ignore").strip("\0")
        if len(text) > 3 and _DRIVE_OR_UNC.match(text):
            yield at, text
        at = end + 2


def cache_entries(data: bytes) -> list[dict]:
    """Entries of an application cache value: sized frames with a path, else loose paths, else one row that says why there is none."""
    row = lambda **x: {"path": "", "ticks": None, "entry_size": 0, "raw_offset": 0, "parse_method": "length-scan", "error": None} | x
    if len(data) < 8:
        return [row(error="too small")]
    out, at, frames = [], 0, 0
    while at < len(data) - 8 and frames < FRAMES:
        size = unpack_from("<I", data, at)[0]
        if not 8 <= size <= min(len(data) - at, FRAME):
            at += 2
            continue
        body = data[at + 4 : at + size]
        text = _frame_path(body) if len(body) >= 4 else None
        if text:
            out.append(row(path=text, ticks=_frame_time(body), entry_size=size, raw_offset=at))
        frames += len(body) >= 4
        at += size
    out = out or [row(path=p, raw_offset=a, parse_method="path-scan") for a, p in _loose_paths(data)]
    return out or [row(error="no entries; the layout may be of another version")]


def application_cache(values: DataFrame) -> DataFrame:
    """values(hive, control_set, value) to cache entries with times."""

    def run(frames):
        for frame in frames:
            rows = [{"hive": h, "control_set": s, **e} for h, s, v in zip(frame["hive"], frame["control_set"], frame["value"], strict=True) for e in cache_entries(bytes(v))]
            yield pd.DataFrame(rows, columns=["hive", "control_set", "path", "ticks", "entry_size", "raw_offset", "parse_method", "error"])

    out = values.select("hive", "control_set", "value").mapInPandas(run, "hive string, control_set string, path string, ticks decimal(20,0), entry_size int, raw_offset int, parse_method string, error string")
    return out.withColumn("last_modified", filetime(F.col("ticks"))).drop("ticks")


# Where the cache and the bags are.
CACHE = r"(?i)^(?:Current)?ControlSet[^\\]*\\Control\\Session Manager(?:\\AppCompatCache)?$"
BAG_ROOTS = (r"Software\Microsoft\Windows\Shell", r"Software\Classes\Local Settings\Software\Microsoft\Windows\Shell")


def first_values(keys: DataFrame, name: str = "AppCompatCache") -> DataFrame:
    """Of each hive and control set the first binary value of that name under the session manager, by order."""
    hit = keys.where((F.col("value_name") == name) & F.col("value").isNotNull() & F.col("key_path").rlike(CACHE))
    hit = hit.withColumn("control_set", F.substring_index("key_path", "\\", 1))
    return hit.groupBy("hive", "control_set").agg(F.min_by("value", "ordinal").alias("value"), F.min("ordinal").alias("ordinal"))


def cache_of_hives(keys: DataFrame) -> DataFrame:
    """Cache entries of rows of hives: those of the first value of each hive. A hive without one is a row that says what was looked at."""
    first = first_values(keys).groupBy("hive").agg(F.min_by(F.struct("control_set", "value"), "ordinal").alias("first")).select("hive", "first.*")
    seen = keys.where(F.col("key_path").rlike(CACHE) & F.col("value_name").isNotNull())
    sets = keys.where(F.col("key_path").rlike(r"(?i)^(?:Current)?ControlSet[^\\]*$")).groupBy("hive").agg(F.array_sort(F.collect_set("key_path")).alias("sets"))
    names = seen.groupBy("hive").agg(F.array_sort(F.collect_set("value_name")).alias("names"))
    read = keys.groupBy("hive").agg(F.max("error").alias("error"))
    lost = read.join(first.select("hive"), "hive", "left_anti").join(sets, "hive", "left").join(names, "hive", "left")
    text = lambda c: F.coalesce(F.nullif(F.array_join(c, ", "), F.lit("")), F.lit("none"))
    why = F.concat(F.lit("no cache value; control sets: "), text("sets"), F.lit("; values: "), text("names"))
    return application_cache(first).unionByName(lost.select("hive", F.lit("").alias("path"), F.coalesce("error", why).alias("error")), allowMissingColumns=True)


def bags_of_hives(keys: DataFrame, bag: str = "BagMRU") -> DataFrame:
    """Folder paths of rows of hives, below either root. A hive without a root, or without a path, is a row with an error."""
    found = folder_bags(keys, BAG_ROOTS[0], bag)
    for root in BAG_ROOTS[1:]:
        found = found.unionAll(folder_bags(keys, root, bag))
    has_root = F.max(F.col("key_path").isin(*BAG_ROOTS)).alias("has_root")
    lost = keys.groupBy("hive").agg(F.max("error").alias("error"), has_root).join(found.select("hive").distinct(), "hive", "left_anti")
    why = F.when(F.col("has_root"), F.lit(f"no path in the values of {bag}")).otherwise(F.lit(f"no shell key with {bag}"))
    return found.withColumn("error", F.lit(None).cast("string")).unionByName(lost.select("hive", F.lit(bag).alias("bag_type"), F.coalesce("error", why).alias("error")), allowMissingColumns=True)


def read_application_cache(spark: SparkSession, path: str, reader=hives.library) -> DataFrame:
    return cache_of_hives(hives.read(spark, path, reader))


def read_folder_bags(spark: SparkSession, path: str, reader=hives.library, bag: str = "BagMRU") -> DataFrame:
    return bags_of_hives(hives.read(spark, path, reader), bag)


def folder_bags(keys: DataFrame, root: str, bag: str = "BagMRU") -> DataFrame:
    """Folder paths under a root key: in its values and, through hexadecimal children, eight levels down; the first path of each value."""
    inside = (F.col("key_path") == root) | F.col("key_path").startswith(root + "\\")
    rest = F.filter(F.split(F.expr(f"substring(key_path, {len(root) + 1})"), r"\\"), lambda x: x != "")
    hexadecimal = F.forall("_rest", lambda x: x.rlike("^[0-9A-Fa-f]+$") | (x == bag))
    rows = keys.where(inside).withColumn("_rest", rest).where(hexadecimal & (F.size("_rest") <= DEPTH))
    rows = rows.where(~F.col("value_name").isin(*BOOKKEEPING) & (F.length("value") >= 8))
    found = rows.withColumn("folder_path", F.try_element_at(path_udf()("value"), F.lit(1))["path"])
    return found.where("folder_path is not null").select("hive", F.lit(bag).alias("bag_type"), "key_path", "folder_path", F.col("value_name").alias("raw_value_name"), F.length("value").alias("raw_value_size"))
