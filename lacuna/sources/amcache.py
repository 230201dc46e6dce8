"""Application inventory entries: numbered values under field names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.functions.binary import filetime, hex_first_int, utf16_text
from lacuna.functions.names import without_prefix
from lacuna.sources import hives

# Value names in hexadecimal, and fields.
FIELDS = {
    "0": "product_name", "1": "company_name", "2": "file_version_number", "3": "language_code", "4": "switchback_context",
    "5": "file_version", "6": "file_size", "7": "pe_header_hash", "8": "unknown1", "9": "pe_header_checksum",
    "a": "unknown2", "b": "unknown3", "c": "file_description", "d": "unknown4", "f": "linker_compile_time",
    "10": "unknown5", "11": "last_modified_timestamp", "12": "created_timestamp", "15": "full_path", "16": "unknown6",
    "17": "last_modified_timestamp_2", "100": "program_id", "101": "sha1",
}
SECTIONS = ("File", "InventoryApplicationFile")
TIMES = ("last_modified_timestamp", "created_timestamp", "last_modified_timestamp_2")
TEXTS = ("full_path", "product_name", "company_name", "file_description", "file_version", "file_version_number", "pe_header_hash")


def fields(values: Column) -> Column:
    """A map of values by name: numbers become field names, other names stay. Of two values of a field the last stays."""
    known = F.create_map(*[F.lit(x) for kv in FIELDS.items() for x in kv])
    return F.transform_keys(values, lambda k, _: F.coalesce(F.element_at(known, F.lower(k)), k))


def entry(values: Column) -> list[Column]:
    """The columns of an entry, from its map of text values."""
    v = fields(values)
    get = lambda k: F.element_at(v, F.lit(k))
    text = lambda k: F.nullif(F.regexp_replace(get(k), "\\x00+$", ""), F.lit("")).alias(k)
    return [
        *map(text, TEXTS),
        hex_first_int(get("file_size")).cast("long").alias("file_size"),
        hex_first_int(get("link_date")).cast("long").alias("link_date"),
        *[without_prefix(get(k)).alias(k) for k in ("sha1", "program_id")],
        *[(hex_first_int(get(k)) != 0).alias(k) for k in ("is_pe_file", "is_os_component")],
        *[filetime(get(k).try_cast("decimal(20,0)")).alias(k) for k in TIMES],
        v.alias("raw_values"),
    ]


def _section(key_path: Column, inside: bool) -> Column:
    """The section that a key is, or is directly inside of; empty for others. A root key of its own name may lie between."""
    tail = r"\\[^\\]+$" if inside else "$"
    return F.regexp_extract(key_path, rf"^(?:Root\\)?({'|'.join(SECTIONS)}){tail}", 1)


def sections(keys: DataFrame) -> DataFrame:
    """Per hive: sections found and absent, and an error for one with neither or that can't be read."""
    here = _section(F.col("key_path"), False)
    out = keys.groupBy("hive").agg(F.array_sort(F.collect_set(F.nullif(here, F.lit("")))).alias("sections_found"), F.max("error").alias("error"))
    absent = F.array_except(F.array(*map(F.lit, SECTIONS)), "sections_found")
    none = F.when(F.size("sections_found") == 0, F.lit(f"no application inventory: neither {' nor '.join(SECTIONS)} is there"))
    return out.select("hive", "sections_found", absent.alias("sections_absent"), F.coalesce("error", none).alias("error"))


def entries(keys: DataFrame) -> DataFrame:
    """Entries of rows of hives: hive, section, key_path, key_timestamp, and the columns of ``entry``. An entry is what is right below a section; of two values of one name the last counts."""
    rows = keys.withColumn("section", _section(F.col("key_path"), True)).where("section <> ''")
    text = F.coalesce("text", utf16_text(F.col("value")))
    values = F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.when(F.col("value_name").isNotNull(), F.struct("ordinal", F.col("value_name").alias("k"), text.alias("v"))))), lambda x: F.struct(x["k"], x["v"])))
    found = rows.groupBy("hive", "section", "key_path").agg(F.max("written").alias("key_timestamp"), values.alias("own"))
    return found.select("hive", "section", "key_path", "key_timestamp", *entry(F.col("own")))


def read_amcache(spark: SparkSession, path: str, reader=hives.library) -> DataFrame:
    """Entries of the hives at a path, and a row with an error for each hive that has none."""
    keys = hives.read(spark, path, reader)
    wrong = sections(keys).where(F.col("error").isNotNull()).select("hive", "error")
    return entries(keys).withColumn("error", F.lit(None).cast("string")).unionByName(wrong, allowMissingColumns=True)
