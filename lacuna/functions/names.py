"""Names of files and references."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"^[\s\x1c-\x1f\x{85}\x{a0}]+|[\s\x1c-\x1f\x{85}\x{a0}]+$", "")


def prefetch_parts(name: Column) -> tuple[Column, Column]:
    """Executable and upper-case hash of a NAME-XXXXXXXX.pf file name; the hash is null if it isn't eight hex digits."""
    stem = F.regexp_replace(name, r"(?i)\.pf$", "")
    tail = F.regexp_extract(stem, r"^(.*)-([^-]*)$", 2)
    good = tail.rlike("^[0-9A-Fa-f]{8}$")
    return F.when(good, F.regexp_extract(stem, r"^(.*)-([^-]*)$", 1)).otherwise(stem), F.when(good, F.upper(tail))


def safe_name(ordinal: Column, name: Column) -> Column:
    """Name of an input's output file."""
    clean = F.btrim(F.regexp_replace(name, "[^A-Za-z0-9._-]+", "_"), F.lit("_"))
    number = ordinal.cast("string")
    wide = F.concat(F.repeat(F.lit("0"), F.greatest(F.lit(0), 4 - F.length(number))), number)
    return F.concat(wide, F.lit("_"), F.when(clean == "", "input").otherwise(clean), F.lit(".json"))


def evidence_ref(prefix: Column, row: Column, activity: Column, artifact_type: Column) -> Column:
    return F.concat_ws("/", prefix, F.concat(F.lit("row-"), row.cast("string")), activity, artifact_type)


def looks_like_path(text: Column, slash: bool = True) -> Column:
    """A UNC path, or a drive letter, a colon and a separator; four characters at least."""
    drive = r"^.:[\\/]" if slash else r"^.:\\"
    return (F.length(text) > 3) & (text.rlike(r"^\\\\") | text.rlike(drive))


def without_prefix(text: Column) -> Column:
    """Upper case, without the four-byte prefix that file ids have."""
    return F.upper(F.when(F.length(text) > 8, F.substring(text, 9, 1 << 30)).otherwise(text))


def bytes_without_prefix(value: Column) -> Column:
    """The same of an id that is held as bytes; null if there is nothing behind the prefix."""
    return F.when(F.octet_length(value) > 4, F.hex(F.substring(value, 5, 1 << 30)))


def stable_id(kind: Column, name: Column) -> Column:
    """An id from a kind and a name: three letters of the kind, then the name in lower case with underscores."""
    return F.concat_ws("_", F.left(F.substring_index(kind, "_", 1), F.lit(3)), F.translate(F.lower(name), " -", "__"))
