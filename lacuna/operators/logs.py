"""Logs of chained entries, checked by what they say: numbers, links, content, keys, tip, version and times.

An entry is a JSON object. Its digest covers all of it but its own digests, so
any field that is altered shows. Content is canonicalised in the plan, from
VARIANT, without Python.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.functions.compiled import DEPTH, canonical_sha256, entries, let, nesting, quoted, rendered, tokens
from lacuna.operators import chain
from lacuna.operators.scan import SEGMENT, before, first_of
from lacuna.session import materialized

#: Fields that the chain gives an entry; those of them that its digest leaves out; fields that may differ between two records of one event.
STRUCTURE, OWN, VARYING = ("seq", "prev_hash", "entry_hash", "entry_hmac"), ("entry_hash", "entry_hmac"), ("timestamp", "event_id")
#: A whole number in JSON that VARIANT would round.
LONG_NUMBER = "[0-9]{39}"
STRINGS = r'"(?:[^"\\]|\\.)*+"'


def _field(entry: Column, name: str, kind: str) -> Column:
    """A field of that type; null where there is none or another type."""
    value = F.try_variant_get(entry, f"$.{name}", "variant")
    is_kind = F.schema_of_variant(value) == {"string": "STRING", "bigint": "BIGINT"}[kind]
    return F.when(is_kind, value.cast(kind))


def _there(entry: Column, name: str) -> Column:
    return F.try_variant_get(entry, f"$.{name}", "variant").isNotNull()


def parsed(text: Column) -> Column:
    """A JSON text as VARIANT; null if it is none, has a key twice, or has a number that VARIANT would round."""
    long_ = F.rlike(text, F.lit(LONG_NUMBER)) & F.rlike(F.regexp_replace(text, STRINGS, ""), F.lit(LONG_NUMBER))
    return F.when(~long_, F.try_parse_json(text))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """(chain_id, pos, segment, line, entry, depth) of files of one entry a line.

    A line may say its chain_id and pos, and hold its content as text in
    payload; else its file is its chain and its place in it its pos, and the
    line is the entry. A blank line is none. ``depth`` is that of the entry's
    containers.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    lines = lines.where(F.trim("value") != "").withColumn("line", F.try_parse_json("value"))
    given = F.try_variant_get("line", "$.pos", "bigint")
    pos = F.struct(F.coalesce(given, F.lit(0)).alias("given"), F.when(given.isNull(), F.col("block")).otherwise(0).alias("block"), F.when(given.isNull(), F.col("row")).otherwise(0).alias("row"))
    named = F.try_variant_get("line", "$.chain_id", "string")
    # A block of a file is a stretch of its lines; given places are cut into stretches.
    segment = F.when(given.isNull(), F.col("block")).otherwise(F.floor(given / SEGMENT)).cast("long")
    own = F.coalesce(_field(F.col("line"), "payload", "string"), "value")
    return lines.select(F.coalesce(named, F.col("file")).alias("chain_id"), pos.alias("pos"), segment.alias("segment"), "line", parsed(own).alias("entry"), nesting(own).alias("depth"))


def logs_of(documents: DataFrame, key: str, text: str, field: str = "tool_execution_log") -> tuple[DataFrame, DataFrame]:
    """The logs within JSON documents, as ``read_log`` gives them, and what the documents declare of their tips."""
    docs = documents.select(F.col(key).cast("string").alias("chain_id"), parsed(F.col(text)).alias("v"), nesting(F.col(text)).alias("depth"))
    rows = docs.select("chain_id", "depth", F.posexplode(F.try_variant_get("v", f"$.{field}", "array<variant>")).alias("at", "entry"))
    place = F.struct(F.col("at").cast("long").alias("given"), F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("row"))
    log = rows.select("chain_id", place.alias("pos"), F.floor(F.col("at") / SEGMENT).cast("long").alias("segment"), F.col("entry").alias("line"), "entry", "depth")
    return log, docs.select("chain_id", _field(F.col("v"), "chain_tip_sha256", "string").alias("chain_tip"), _field(F.col("v"), "chain_tip_hmac", "string").alias("chain_tip_hmac"))


def fields_of(entry: Column, depth: int, version: str = "2") -> Column:
    """(key, canonical text) of an entry's fields in order of keys, but for those that the chain gives it; null if it is no object."""
    own = F.filter(entries(F.when(F.startswith(F.schema_of_variant(entry), F.lit("OBJECT")), entry)), lambda e: ~e["key"].isin(*STRUCTURE))
    return F.transform(own, lambda e: F.struct(e["key"].alias("key"), rendered(tokens(e["value"], depth), version).alias("text")))


def digest_of(fields: Column, **given: Column) -> Column:
    """The digest of fields and others given by name, all as canonical texts; null if any is null, as one too deep is."""
    others = F.array(*[F.struct(F.lit(k).alias("key"), text.alias("text")) for k, text in given.items()]) if given else F.array().cast("array<struct<key:string,text:string>>")
    ordered = F.array_sort(F.concat(fields, others), lambda a, b: F.when(a["key"] < b["key"], -1).otherwise(1))
    text = let(ordered, lambda all_: F.when(~F.exists(all_, lambda e: e["text"].isNull()), F.concat(F.lit("{"), F.array_join(F.transform(all_, lambda e: F.concat(quoted(e["key"]), F.lit(": "), e["text"])), ", "), F.lit("}"))))
    return canonical_sha256(text)


def check_entries(log: DataFrame, depth: int | None = None, mac: Callable[[Column], Column] | None = None) -> DataFrame:
    """Every entry of (chain_id, pos, segment, line, entry, depth) with its fields and errors: unreadable, seq_gap, broken_link, tampered, hmac_error, and out_of_range, non_monotonic, duplicate_of, which say nothing of validity.

    The digest is recomputed for both versions of the canonical form. A line
    that is no JSON object, has a key twice, a whole number of 39 digits or
    more, is unreadable; that, and containers more than DEPTH deep, count as
    tampered. ``depth`` is that of the data, looked up if not given.
    """
    if depth is None:
        depth = log.agg(F.max("depth")).first()[0] or 1
    depth = min(depth, DEPTH)
    rows = log.withColumn("unreadable", ~F.coalesce(F.startswith(F.schema_of_variant("entry"), F.lit("OBJECT")), F.lit(False)))
    line = F.col("line")
    rows = rows.withColumns(
        {
            "seq": _field(line, "seq", "bigint"),
            "prev_hash": _field(line, "prev_hash", "string"),
            "entry_hash": _field(line, "entry_hash", "string"),
            "entry_hmac": _field(line, "entry_hmac", "string"),
            "result_summary": _field(line, "result_summary", "string"),
            "marked": F.coalesce(_there(line, "entry_hash") | _there(line, "entry_hmac") | F.coalesce(F.try_variant_get(line, "$.chain_version", "string") == "2", F.lit(False)), F.lit(False)),
            "timestamp": _field(F.col("entry"), "timestamp", "string"),
        }
    )
    # A number or link of another type, or a link beyond ASCII, has no canonical text here: it is wrong in any case.
    ascii_ = F.when(~F.rlike("prev_hash", F.lit("[^\\x20-\\x7e]")), F.col("prev_hash"))
    own = lambda name, text, none: F.when(_there(line, name), text).otherwise(none)
    seq = own("seq", F.concat(F.lit('"'), F.col("seq").cast("string"), F.lit(':int"')), '"0:int"')
    link = lambda tag: own("prev_hash", quoted(ascii_, tag), f'"{tag}"')
    rows = rows.withColumn("fields", fields_of(F.col("entry"), depth))
    rows = rows.withColumns({"digest": digest_of(F.col("fields"), seq=seq, prev_hash=link("s:")), "signature": digest_of(F.filter("fields", lambda e: ~e["key"].isin(*VARYING)))})
    old = digest_of(fields_of(F.col("entry"), depth, "1"), seq=seq, prev_hash=link(""))
    # The first version's form is made for those only that are not of the second.
    same = F.coalesce(F.when(F.col("entry_hash") == F.col("digest"), True).otherwise(F.col("entry_hash") == old), F.lit(False))
    when = F.try_to_timestamp(F.regexp_replace(F.trim("timestamp"), "Z$", "+00:00"))
    # What follows reads its rows several times, and digests are dear.
    rows = materialized(rows.withColumns({"tampered": ~same, "ts": when}).drop("line", "entry", "fields", "depth", "digest"))
    rows = before(rows, "chain_id", "pos", previous={"_seq": F.col("seq"), "_hash": F.col("entry_hash"), "_summary": F.col("result_summary")}, known={"_last": F.col("ts")}, segment=F.col("segment"))
    summary = F.when(F.col("seq") == 1, "GENESIS").otherwise(F.sha2(F.col("_summary").cast("binary"), 256))
    rows = rows.withColumns({"expected_seq": F.coalesce(F.col("_seq") + 1, F.lit(1)), "expected_prev": F.coalesce("_hash", F.lit(chain.GENESIS)), "broken_summary": ~F.col("prev_hash").eqNullSafe(summary), "out_of_range": F.coalesce((F.col("ts") < chain.EARLIEST) | (F.col("ts") >= chain.LATEST), F.lit(False)), "non_monotonic": F.coalesce(F.col("ts") < F.col("_last"), F.lit(False))})
    rows = rows.withColumns({"seq_gap": ~F.col("seq").eqNullSafe(F.col("expected_seq")), "broken_link": ~F.col("prev_hash").eqNullSafe(F.col("expected_prev"))}).drop("_seq", "_hash", "_summary", "_last")
    if mac is not None:
        rows = chain.key_errors(rows, mac)
    return first_of(rows, ["chain_id", "signature"], "pos", F.col("seq"), "duplicate_of").drop("signature")


def check_log(log: DataFrame, declared: DataFrame | None = None, mac: Callable[[Column], Column] | None = None, depth: int | None = None) -> DataFrame:
    """A row for each chain: version, length, errors of each kind, tip and validity, and counts of implausible times and repeated contents.

    ``declared`` has chain_id, chain_tip and chain_tip_hmac; a chain that it
    alone knows has length 0 and the genesis tip. A chain without any mark of
    the second version is checked as one of the first, which covers numbers and
    the summary of the entry before only. All entries are read once.
    """
    rows = check_entries(log, depth, mac)
    hmac = F.col("hmac_error").isNotNull() if mac is not None else F.lit(False)
    bad = F.col("seq_gap") | F.col("broken_link") | F.col("tampered") | hmac
    old = F.col("seq_gap") | F.col("broken_summary")
    names = ("seq_gap", "broken_link", "tampered", "unreadable", "out_of_range", "non_monotonic", "broken_summary")
    counts = {f"n_{n}": F.count_if(n) for n in names} | {"n_hmac_error": F.count_if(hmac), "n_duplicate": F.count("duplicate_of"), "length": F.count("*"), "_bad": F.count_if(bad), "_old": F.count_if(old)}
    out = rows.groupBy("chain_id").agg(*[c.alias(n) for n, c in counts.items()], F.max("marked").alias("marked"), F.min(F.when(bad, F.col("seq"))).alias("_first"), F.min(F.when(old, F.col("seq"))).alias("_first_old"), F.max_by("entry_hash", "pos").alias("tip"))
    if declared is not None:
        # One row for each chain that is declared or there.
        out = out.join(declared.withColumnRenamed("chain_id", "_chain"), F.col("chain_id").eqNullSafe(F.col("_chain")), "full").withColumn("chain_id", F.coalesce("chain_id", "_chain")).drop("_chain")
        out = out.withColumn("marked", F.coalesce("marked", F.lit(False)) | F.col("chain_tip").isNotNull() | F.col("chain_tip_hmac").isNotNull())
        tip = F.coalesce("tip", F.lit(chain.GENESIS))
        out = out.withColumn("tip_mismatch", F.col("chain_tip") != tip)
        out = out.withColumn("tip_hmac_mismatch", F.when(F.col("chain_tip").isNotNull(), F.col("chain_tip_hmac") != mac(tip)) if mac is not None else F.lit(None).cast("boolean"))
    second = F.col("marked")
    wrong = F.coalesce(F.col("tip_mismatch"), F.lit(False)) | F.coalesce(F.col("tip_hmac_mismatch"), F.lit(False)) if declared is not None else F.lit(False)
    none = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    shown = [none(c).alias(c) for c in ("length", "n_seq_gap")]
    shown += [F.when(second, none("n_broken_link")).otherwise(none("n_broken_summary")).alias("n_broken_link"), *[F.when(second, none(c)).otherwise(0).alias(c) for c in ("n_tampered", "n_hmac_error")]]
    shown += [none(c).alias(c) for c in ("n_unreadable", "n_out_of_range", "n_non_monotonic", "n_duplicate")]
    shown += [F.when(second, F.col("_first")).otherwise(F.col("_first_old")).alias("first_invalid_seq"), "tip", *(("chain_tip", "tip_mismatch", "tip_hmac_mismatch") if declared is not None else ())]
    valid = F.when(second, (none("_bad") == 0) & ~wrong).otherwise(none("_old") == 0)
    plausible = none("n_out_of_range") + none("n_non_monotonic") + none("n_duplicate") == 0
    return out.select("chain_id", F.when(second, 2).otherwise(1).alias("version"), *shown, valid.alias("valid"), plausible.alias("plausible"))
