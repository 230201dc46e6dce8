"""The evidence matrix: every artifact that a case's activities should have left, with what is known of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.plans import catalog as c

# What to check next, by reason.
NEXT_CHECKS = {
    "conditions_unverified": "document each required applicability condition across the full analysis interval",
    "catalog_scope_unverified": "verify the declared product/release against the catalog scope; retain UNKNOWN if unmatched",
    "not_collected": "determine whether the source can be acquired for the case interval",
    "retention_gap": "review retention/wrap limits and available forwarded or alternate sources",
    "acquisition_gap": "review acquisition coverage and supplement it from an available source if possible",
    "parser_failure": "validate the parser and version against the acquired source before interpreting the row",
    "ambiguous": "seek an independent observation that discriminates the competing explanations",
}


def expectations(cases: DataFrame) -> DataFrame:
    """Each case's catalog rows; a case with an ``actions`` array has those of its actions only."""
    rows = cases.select("*", F.explode(c.entries()).alias("entry")).select(*cases.columns, "entry.*")
    return rows.where(F.array_contains("actions", F.col("action"))) if "actions" in cases.columns else rows


def evidence_matrix(cases: DataFrame, observations: DataFrame, activities: DataFrame | None = None) -> DataFrame:
    """One row per case(case_id, os_release) and expected artifact. What nobody reported is unknown, never absent.

    observations(case_id, action, artifact_type, status, reason, evidence_ref)
    has one row per key at most; activities(case_id, action, evidence_ref,
    observed_at) adds the evidence of the action itself.
    """
    keys = ["case_id", "action", "artifact_type"]
    seen = observations.select(*keys, "status", "reason", "evidence_ref")
    rows = expectations(cases).join(seen, keys, "left")
    supported = c.supports_release(F.col("os_release"), F.col("release_prefix"))
    reason = F.when(F.col("status").isNull(), F.when(supported, "conditions_unverified").otherwise("catalog_scope_unverified")).otherwise(F.col("reason"))
    rows = rows.select(*keys, F.coalesce("status", F.lit("unknown")).alias("status"), reason.alias("reason"), "evidence_ref", "required_conditions")
    if activities is not None:
        known = activities.select("case_id", "action", F.col("evidence_ref").alias("action_evidence_ref"), F.col("observed_at").alias("action_observed_at"))
        rows = rows.join(known, ["case_id", "action"], "left")
    return rows


def coverage(matrix: DataFrame) -> DataFrame:
    """Counts by case, zero where none: expected, each status, known; and whether they add up."""
    counted = matrix.groupBy("case_id").agg(F.count("*").alias("expected"), *[F.count_if(F.col("status") == s).alias(s) for s in c.STATUSES])
    total = sum((F.col(s) for s in c.STATUSES[1:]), F.col(c.STATUSES[0]))
    return counted.select("*", (F.col("present") + F.col("confirmed_absent")).alias("known"), (total == F.col("expected")).alias("consistent"))


def gate(observations: DataFrame) -> DataFrame:
    """Observations with error_code: the first rule that each breaks, or null.

    Needs action, artifact_type, status, reason, evidence_ref, registered
    (whether the action is an activity of the case), has_action_evidence,
    system_build, os_release, required_conditions, supplied_conditions, uncovered_conditions.
    """
    col = F.col
    blank = lambda x: F.trim(x) == ""
    decided, absent = col("status").isin("present", "confirmed_absent"), col("status") == "confirmed_absent"
    steps: list[tuple[Column, str]] = [
        (~col("registered"), "action_not_registered"),
        (~c.key_in_catalog(col("action"), col("artifact_type")), "artifact_not_in_catalog"),
        (~F.coalesce(col("status").isin(*c.STATUSES), F.lit(False)), "invalid_status"),
        (col("reason").isNotNull() & ~col("reason").isin(*c.REASONS), "invalid_reason"),
        (F.coalesce(blank(col("evidence_ref")), F.lit(False)), "blank_evidence_ref"),
        (F.size(F.array_except("supplied_conditions", "required_conditions")) > 0, "unknown_condition"),
        (decided & col("evidence_ref").isNull(), "evidence_ref_required"),
        (decided & col("reason").isNotNull(), "reason_not_allowed"),
        (absent & ~col("has_action_evidence"), "action_evidence_required"),
        (absent & F.coalesce(blank(col("system_build")), F.lit(True)), "system_build_required"),
        (absent & ~c.supports_release(col("os_release"), F.lit(c.RELEASE)), "release_not_supported"),
        (absent & (F.size(F.array_except("required_conditions", "supplied_conditions")) > 0), "conditions_missing"),
        (absent & (F.size("uncovered_conditions") > 0), "conditions_do_not_cover_interval"),
        ((col("status") == "out_of_scope") & (F.coalesce(col("reason"), F.lit("")) != "not_applicable"), "not_applicable_required"),
        ((col("status") == "out_of_scope") & col("evidence_ref").isNull(), "evidence_ref_required"),
        ((col("status") == "unknown") & (F.coalesce(col("reason"), F.lit("")) == "not_applicable"), "not_applicable_not_allowed"),
    ]
    code = F.coalesce(*[F.when(broken, name) for broken, name in steps])
    return observations.withColumn("error_code", code)


def uncovered(conditions: DataFrame, intervals: DataFrame) -> DataFrame:
    """Conditions(case_id, condition, valid_from, valid_until) that don't cover their case's whole interval; bounds are inside."""
    both = conditions.join(intervals.select("case_id", "interval_start", "interval_end"), "case_id")
    return both.withColumn("covers", (F.col("valid_from") <= F.col("interval_start")) & (F.col("valid_until") >= F.col("interval_end")))


def conflicts(observations: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """Keys that are reported with more than one value; identical reports are one."""
    return observations.groupBy(*keys).agg(F.count("*").alias("reports"), F.count_distinct(value).alias("variants")).where("variants > 1")


def explain(matrix: DataFrame, supplied: Column | None = None) -> DataFrame:
    """Rows of the matrix with missing conditions and what to check next."""
    have = F.array().cast("array<string>") if supplied is None else supplied
    table = F.create_map(*[F.lit(x) for kv in NEXT_CHECKS.items() for x in kv])
    return matrix.withColumns({"missing_conditions": F.array_except("required_conditions", have), "next_check": F.element_at(table, F.col("reason"))})
