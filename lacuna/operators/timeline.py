"""Import of timeline rows: validation, mapping with wildcards, counters, one observation per target."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.plans import catalog as c

# The columns of a timeline file.
COLUMNS = "date time timezone MACB source sourcetype type user host short desc version filename inode notes format extra".split()
MAX_ROWS, MAX_FIELD, SAMPLE, DESCRIPTION = 1_000_000, 1_000_000, 100, 200
#: What a mapping may ask of a row; mappings of one group that may be broadcast.
CRITERIA, FEW = ("source", "sourcetype", "type", "format"), 100_000


def row_error(columns: list[str] | None = None, field_count: Column | None = None, max_field: int = MAX_FIELD) -> Column:
    """The first rule that a row breaks: number of fields, missing or long field, blank source or type."""
    names = columns or COLUMNS
    rules = [] if field_count is None else [F.when(field_count != len(COLUMNS), "field_count")]
    for name in names:
        rules += [F.when(F.col(name).isNull(), f"missing_{name}"), F.when(F.char_length(name) > max_field, f"too_long_{name}")]
    rules += [F.when(F.trim(F.col(name)) == "", f"blank_{name}") for name in ("source", "type") if name in names]
    return F.coalesce(*rules)


def matching(rows: list[tuple]) -> Column:
    """Ordinals of the mappings that match a row; the mapping table is small and fixed in the plan. A null criterion matches anything."""
    found = []
    for ordinal, (source, sourcetype, kind, form, *_) in enumerate(rows):
        fits = F.lit(True)
        for name, want in zip(CRITERIA, (source, sourcetype, kind, form), strict=True):
            if want is not None:
                fits = fits & F.coalesce(F.col(name) == want, F.lit(False))
        found.append(F.when(fits, F.lit(ordinal)))
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<int>")


def invalid_targets(mapping: DataFrame) -> DataFrame:
    """Mappings whose target is not in the catalog."""
    return mapping.where(~c.key_in_catalog(F.col("activity"), F.col("artifact_type")))


def _criteria(mask: int) -> list[str]:
    return [name for k, name in enumerate(CRITERIA) if mask >> k & 1]


def matched(timeline: DataFrame, mapping: DataFrame) -> DataFrame:
    """``timeline`` with n_matches, and the target of the first mapping that matches, for any number of mappings (ordinal, source, sourcetype, type, format, activity, artifact_type).

    Mappings are grouped by which criteria they have, sixteen groups at most.
    Each group is one row for each of its keys, with how many mappings have it
    and the first of them, and one join on the columns that the group looks at.
    So the plan does not grow with the mappings; a group is broadcast if it is
    small, and else shuffled.
    """
    bit = lambda k, name: F.when(F.col(name).isNotNull(), 1 << k).otherwise(0)
    mask = bit(0, CRITERIA[0])
    for k, name in enumerate(CRITERIA[1:], 1):
        mask = mask + bit(k, name)
    held = mapping.withColumn("mask", mask)
    sizes = {r["mask"]: r["count"] for r in held.groupBy("mask").count().collect()}
    out, hits = timeline, []
    for m in sorted(sizes):
        names = _criteria(m)
        first = F.min(F.struct("ordinal", "activity", "artifact_type"))
        keys = held.where(F.col("mask") == m).groupBy(*[F.col(n).alias(f"_{m}_{n}") for n in names]).agg(F.struct(F.count("*").alias("n"), first.alias("first")).alias(f"_hit_{m}"))
        keys = F.broadcast(keys) if sizes[m] <= FEW else keys
        same = F.lit(True)
        for n in names:
            same = same & (F.col(n) == F.col(f"_{m}_{n}"))
        # Mappings without criteria match every row: a join with one row.
        out = out.join(keys, same, "left") if names else out.crossJoin(F.broadcast(keys))
        out = out.drop(*[f"_{m}_{n}" for n in names])
        hits.append(f"_hit_{m}")
    none = F.lit(None).cast("struct<ordinal:int,activity:string,artifact_type:string>")
    count = sum((F.coalesce(F.col(h)["n"], F.lit(0)) for h in hits), F.lit(0).cast("long"))
    firsts = [F.col(h)["first"] for h in hits]
    return out.select("*", count.cast("int").alias("n_matches"), (F.least(*firsts) if len(firsts) > 1 else firsts[0] if firsts else none).alias("_first")).drop(*hits)


def classify(timeline: DataFrame, rows: list[tuple] | DataFrame, *, error: Column | None = None, max_rows: int | None = MAX_ROWS) -> DataFrame:
    """timeline(row_num, ...) with class (over_limit, invalid, ambiguous, unmatched, matched), n_matches, activity and artifact_type. Without ``max_rows`` no row is over the limit.

    A list of mappings is held in the plan; a DataFrame of them is joined.
    """
    out = timeline.withColumn("row_error", error if error is not None else F.lit(None).cast("string"))
    if isinstance(rows, DataFrame):
        out = matched(out, rows)
        activity, artifact = F.col("_first.activity"), F.col("_first.artifact_type")
    else:
        out = out.withColumn("_first", matching(rows)).withColumn("n_matches", F.size("_first"))
        first = F.get("_first", 0)
        activity, artifact = (F.get(F.array(*[F.lit(r[k]) for r in rows]), first) for k in (4, 5))
    count = F.col("n_matches")
    kind = F.when(F.col("row_num") > max_rows if max_rows is not None else F.lit(False), "over_limit").when(F.col("row_error").isNotNull(), "invalid").when(count > 1, "ambiguous").when(count == 0, "unmatched").otherwise("matched")
    names = [c for c in out.columns if c not in ("_first", "n_matches")]
    is_matched = kind == "matched"
    return out.select(*names, kind.alias("class"), "n_matches", F.when(is_matched, activity).alias("activity"), F.when(is_matched, artifact).alias("artifact_type"))


def first_matches(classified: DataFrame) -> DataFrame:
    """The first matched row of each target, by row number; a partial aggregate, no sort."""
    hit = classified.where(F.col("class") == "matched")
    return hit.groupBy("activity", "artifact_type").agg(F.min("row_num").alias("row_num"), F.count("*").alias("rows"))


def counters(classified: DataFrame) -> DataFrame:
    is_ = lambda k: F.count_if(F.col("class") == k)
    return classified.agg(
        F.count_if(F.col("class") != "over_limit").alias("total_rows"),
        is_("matched").alias("matched_rows"),
        is_("unmatched").alias("unmatched_rows"),
        (is_("invalid") + F.max(F.when(F.col("class") == "over_limit", 1).otherwise(0))).alias("rejected_rows"),
        is_("ambiguous").alias("mapping_errors"),
        F.count_distinct(F.when(F.col("class") == "matched", F.struct("activity", "artifact_type"))).alias("targets"),
    )


def unmatched_sample(classified: DataFrame, columns: list[str], limit: int = SAMPLE, description: int = DESCRIPTION) -> DataFrame:
    """The first unmatched rows, descriptions cut to so many characters."""
    rows = classified.where(F.col("class") == "unmatched").orderBy("row_num").limit(limit)
    return rows.select("row_num", *[F.left(F.col(x), F.lit(description)).alias(x) if x == "desc" else F.col(x) for x in columns])


def new_observations(first: DataFrame, existing: DataFrame, prefix: Column) -> DataFrame:
    """One unknown observation for each target that the template lacks, with the first row as reference."""
    from lacuna.functions.names import evidence_ref

    missing = first.join(existing.select("activity", "artifact_type"), ["activity", "artifact_type"], "left_anti")
    ref = evidence_ref(prefix, F.col("row_num"), F.col("activity"), F.col("artifact_type"))
    return missing.select("activity", "artifact_type", F.lit("unknown").alias("status"), F.lit("conditions_unverified").alias("reason"), ref.alias("evidence_ref"))


def mappings_used(classified: DataFrame) -> DataFrame:
    """Targets in the order in which they first matched."""
    order = Window.orderBy("row_num", "activity", "artifact_type")
    return first_matches(classified).select(F.row_number().over(order).alias("position"), "activity", "artifact_type", "row_num")
