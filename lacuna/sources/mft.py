"""Master file tables: fixed-size binary records to rows."""

from __future__ import annotations

import glob
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from struct import Struct, unpack_from
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lacuna.functions.binary import filetime

# Sizes that a record may have, and where its fields are.
SIZES, DEFAULT_SIZE, SECTOR, SHORTEST = (256, 512, 1024, 2048, 4096), 1024, 512, 42
STANDARD, NAME, END = 0x10, 0x30, 0xFFFFFFFF
_HEADER = Struct("<4sHHQHHHHII")  # signature, fixups at, fixups, log number, sequence, links, attributes at, flags, real size, allocated size
_TIMES = Struct("<QQQQ")
#: Bytes of a file that one task reads; records that are decoded at once.
SPLIT, BLOCK = 32 << 20, 4096

SCHEMA = (
    "path string, record_number long, expected_record_number long, record_number_matches boolean, sequence_number int, hard_link_count int, flags int, "
    "is_in_use boolean, is_directory boolean, real_size long, allocated_size long, first_attr_offset int, fixups_applied boolean, is_valid boolean, error string, "
    "si struct<created:decimal(20,0),modified:decimal(20,0),mft_modified:decimal(20,0),accessed:decimal(20,0),file_attributes:long>, "
    "names array<struct<name:string,namespace:int,parent_directory:long,parent_record:long,name_spec:string,namespace_spec:int,file_size:decimal(20,0),real_size:decimal(20,0)>>, "
    "attributes array<struct<type:long,size:long,resident:boolean,resident_spec:boolean>>"
)


def record_size(head: bytes) -> int:
    """The size that the first record says it has, if it is a plausible one."""
    said = unpack_from("<I", head, 28)[0] if len(head) >= 32 else 0
    return said if said in SIZES and said <= len(head) else DEFAULT_SIZE


def repaired(raw: bytes) -> tuple[bytes, str | None]:
    """The record with its sectors' last two bytes put back, or what is wrong with its update sequence."""
    if len(raw) < 8:
        return raw, "too small"
    at, count = unpack_from("<HH", raw, 4)
    if not count:
        return raw, None
    if at + 2 * count > len(raw) or at < 8 or at % 2:
        return raw, f"update sequence at {at} with {count} entries"
    mark, *saved = (raw[at + 2 * k : at + 2 * k + 2] for k in range(count))
    ends = [SECTOR * (k + 1) - 2 for k in range(len(saved))]
    if ends and ends[-1] + 2 > len(raw):
        return raw, f"sector end {ends[-1]} outside"
    out = bytearray(raw)
    for end, own in zip(ends, saved, strict=True):
        if out[end : end + 2] == mark:
            out[end : end + 2] = own
    return bytes(out), None


def attributes(record: bytes, start: int, limit: int) -> Iterator[tuple[int, int, bool, bool, bytes]]:
    """(type, size, resident, resident by the public layout, content) of a record's attributes."""
    while start + 16 <= len(record) and start + 4 <= limit:
        kind, size = unpack_from("<II", record, start)
        if kind == END or not 16 <= size <= len(record) - start:
            return
        own = record[start : start + size]
        resident = not own[10] & 1
        if resident:
            length, at = unpack_from("<IH", own, 16) if size >= 24 else (0, 0)
            if not 24 <= at <= size:
                return
            yield kind, size, True, own[8] == 0, own[at : at + length]
        else:
            yield kind, size, False, own[8] == 0, own[16:]
        start += size


def _name(content: bytes) -> dict:
    reference = unpack_from("<Q", content, 0)[0]
    sizes = unpack_from("<QQ", content, 40)
    text = lambda at, n: content[at : at + 2 * n].decode("utf-16-le", "strict") if at + 2 * n <= len(content) else None

    def safe(at: int, n: int) -> str | None:
        try:
            return text(at, n)
        except UnicodeDecodeError:
            return None

    fits = 66 + 2 * content[60] <= len(content)
    return {
        "name": safe(66, content[60]) if fits else None,
        "namespace": content[61] if fits else None,
        "parent_directory": reference >> 48,
        "parent_record": reference & 0xFFFFFFFFFFFF,
        "name_spec": safe(66, content[64]),
        "namespace_spec": content[65],
        "file_size": sizes[0] if fits else None,
        "real_size": sizes[1] if fits else None,
    }


def decode(raw: bytes, index: int) -> dict:
    """One record. What can't be read is a row with an error, never dropped."""
    out = dict.fromkeys(["sequence_number", "hard_link_count", "flags", "is_in_use", "is_directory", "real_size", "allocated_size", "first_attr_offset", "si", "record_number_matches", "error"])
    out |= {"record_number": index, "expected_record_number": index, "fixups_applied": False, "is_valid": False, "names": [], "attributes": []}
    if len(raw) < SHORTEST:
        return out | {"error": f"record of {len(raw)} bytes"}
    record, wrong = repaired(raw)
    if wrong:
        return out | {"error": f"fixups: {wrong}"}
    out["fixups_applied"] = True
    signature, _, _, _, sequence, links, first, flags, real, allocated = _HEADER.unpack_from(record)
    if signature != b"FILE":
        return out | {"error": f"signature {signature!r}"}
    number = unpack_from("<I", record, 44)[0] if len(record) >= 48 else index
    out |= {"record_number": number, "record_number_matches": number == index, "sequence_number": sequence, "hard_link_count": links, "flags": flags, "is_in_use": bool(flags & 1), "is_directory": bool(flags & 2), "real_size": real, "allocated_size": allocated, "first_attr_offset": first, "is_valid": True}
    if not SHORTEST <= first < len(record):
        return out | {"error": f"attributes at {first}"}
    for kind, size, resident, resident_spec, content in attributes(record, first, min(allocated or len(record), len(record))):
        out["attributes"].append({"type": kind, "size": size, "resident": resident, "resident_spec": resident_spec})
        if resident and kind == STANDARD and len(content) >= 48:
            out["si"] = dict(zip(("created", "modified", "mft_modified", "accessed"), _TIMES.unpack_from(content), strict=True)) | {"file_attributes": unpack_from("<I", content, 32)[0]}
        elif resident and kind == NAME and len(content) >= 66:
            out["names"].append(_name(content))
    return out


def _rows(path: str, content: bytes, size: int, first: int, left: int) -> list[tuple]:
    """Records of ``content``, numbered from ``first``, where ``left`` bytes of the file begin."""
    out = []
    for k, at in enumerate(range(0, len(content), size)):
        row = decode(content[at : at + size], first + k) | {"path": path}
        if left - at < size:
            row |= {"is_valid": False, "error": row["error"] or f"incomplete: {left - at} of {size} bytes"}
        out.append(tuple(row[c] for c in NAMES))
    return out


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([dict(zip(NAMES, r, strict=True)) for r in rows], schema)


def records(files: DataFrame) -> DataFrame:
    """files(path, content) to records; an incomplete last record is a row that says so. A file's size is that of its first record. Records of small files go on together."""
    schema = to_arrow_schema(StructType.fromDDL(SCHEMA))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                path, content = path.as_py(), content.as_py()
                size = record_size(content[:4096])
                for lo in range(0, len(content), size * BLOCK):
                    rows += _rows(path, content[lo : lo + size * BLOCK], size, lo // size, len(content) - lo)
                    if len(rows) >= BLOCK:
                        yield _batch(rows, schema)
                        rows = []
        if rows:
            yield _batch(rows, schema)

    return files.select("path", "content").mapInArrow(run, SCHEMA)


@dataclass
class Stretch(InputPartition):
    """A stretch of a file's records that one task reads."""

    path: str
    size: int
    start: int
    end: int
    whole: int


class MftReader(DataSourceReader):
    def __init__(self, path: str, split: int, schema: StructType):
        self.path, self.split, self.schema = path, split, schema

    def partitions(self) -> list[Stretch]:
        """Stretches of about ``split`` bytes that begin where records do; only each file's first bytes are read for that."""
        out = []
        for path in files_of(self.path):
            whole = os.path.getsize(path)
            with open(path, "rb") as f:
                size = record_size(f.read(4096))
            step = max(1, self.split // size) * size
            out += [Stretch(path, size, at, min(at + step, whole), whole) for at in range(0, whole, step)]
        return out

    def read(self, part: Stretch | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # no file has a byte
            return
        schema = to_arrow_schema(self.schema)
        with open(part.path, "rb") as f:
            f.seek(part.start)
            for at in range(part.start, part.end, part.size * BLOCK):
                content = f.read(min(part.size * BLOCK, part.end - at))
                rows = _rows(part.path, content, part.size, at // part.size, part.whole - at)
                yield _batch(rows, schema)


class MftSource(DataSource):
    """``spark.read.format("mft")``: master file tables of any size, read by as many tasks as they have stretches. Executors must see the path as the driver does."""

    @classmethod
    def name(cls) -> str:
        return "mft"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> MftReader:
        return MftReader(self.options["path"], int(self.options.get("split", SPLIT)), schema)


def files_of(path: str) -> list[str]:
    """Files of a path, a folder (not those below it) or a pattern, in order; hidden ones are none."""
    found = [path] if os.path.exists(path) else sorted(glob.glob(path))
    files = [f for p in found for f in (sorted(os.path.join(p, n) for n in os.listdir(p)) if os.path.isdir(p) else [p])]
    return [f for f in files if os.path.isfile(f) and not os.path.basename(f).startswith((".", "_"))]


def _columns() -> list[str]:
    depth, out, last = 0, [], 0
    for k, c in enumerate(SCHEMA):
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            out.append(SCHEMA[last:k].strip())
            last = k + 1
    return [*out, SCHEMA[last:].strip()]


NAMES = [c.split()[0] for c in _columns()]


def with_times(rows: DataFrame) -> DataFrame:
    """Times of the standard information as timestamps."""
    return rows.select("*", *[filetime(F.col(f"si.{k}")).alias(f"{k}_time") for k in ("created", "modified", "mft_modified", "accessed")])


def read_mft(spark: SparkSession, path: str) -> DataFrame:
    """Records of tables at a path. In a store that only Spark reads, a table is one binary file and so at most 2 GB."""
    if re.match(r"(?!file:)[a-z][a-z0-9+.-]*:", path):
        return with_times(records(spark.read.format("binaryFile").load(path).select("path", "content")))
    spark.dataSource.register(MftSource)
    return with_times(spark.read.format("mft").load(unquote(re.sub("^file:/*", "/", path))))
