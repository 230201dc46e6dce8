"""Rival hypotheses against a matrix: outcomes, support, pivots, counterfactuals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def outcome(actual: Column, expected: Column, falsifies: Column) -> Column:
    """What an observed status says about a prediction."""
    against = (
        F.coalesce(actual == falsifies, F.lit(False))
        | ((actual == "confirmed_absent") & (expected == "present"))
        | ((actual == "present") & (expected == "unknown"))
        | ((actual == "out_of_scope") & expected.isin("unknown", "confirmed_absent"))
    )
    return F.when(actual.isNull(), "untested").when(actual == expected, "favors").when(against, "disfavors").otherwise("neutral")


def outcomes(cases: DataFrame, matrix: DataFrame, predictions: DataFrame) -> DataFrame:
    """Per case and prediction its own outcome and the final one of its artifact: of several predictions on one, the last decides.

    The predictions are a few rows and go to the cases by broadcast.
    """
    wanted = cases.select("case_id", F.explode(F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in row.asDict().items()]) for row in predictions.collect()])).alias("p")).select("case_id", "p.*")
    rows = wanted.join(matrix.select("case_id", "action", "artifact_type", F.col("status").alias("actual")), ["case_id", "action", "artifact_type"], "left")
    own = rows.withColumn("outcome", outcome(F.col("actual"), F.col("expected_status"), F.col("falsifies_if")))
    key = Window.partitionBy("case_id", "hypothesis_id", "action", "artifact_type")
    return own.withColumn("final", F.max_by("outcome", "ordinal").over(key))


def support(outcomes: DataFrame) -> DataFrame:
    """Weighted sums by final outcome, and the level of support. Weights are decimals, so thresholds are exact."""
    weigh = lambda o: F.coalesce(F.sum(F.when(F.col("final") == o, F.col("power"))), F.lit(0)).cast("decimal(13,1)").alias(o)
    sums = outcomes.groupBy("case_id", "hypothesis_id").agg(*map(weigh, ("favors", "disfavors", "neutral", "untested")))
    favors, disfavors = F.col("favors"), F.col("disfavors")
    total = favors + disfavors + F.col("neutral") + F.col("untested")
    level = (
        F.when(total == 0, "untested")
        .when(disfavors > favors, "falsified")
        .when(favors == 0, "weak")
        .when((favors >= disfavors * 2) & (favors * 2 > total), "strong")
        .when((favors > disfavors) & (favors * 10 > total * 3), "moderate")
        .otherwise("weak")
    )
    return sums.withColumn("support_level", level)


def pivot_status(cases: DataFrame, matrix: DataFrame, pivots: DataFrame) -> DataFrame:
    """Whether a pivot's artifact has a status other than unknown."""
    rows = pivots.select("ordinal", "hypothesis_id", "action", "artifact_type").collect()
    wanted = cases.select("case_id", F.explode(F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in r.asDict().items()]) for r in rows])).alias("p")).select("case_id", "p.*")
    seen = matrix.select("case_id", "action", "artifact_type", "status")
    out = wanted.join(seen, ["case_id", "action", "artifact_type"], "left")
    return out.select("case_id", "ordinal", "hypothesis_id", "action", "artifact_type", F.when(F.coalesce(F.col("status") != "unknown", F.lit(False)), "resolved").otherwise("pending").alias("pivot_status"))


def pivot_power(pivots: DataFrame) -> DataFrame:
    """How many different impact patterns a pivot has."""
    pattern = F.array_distinct(F.transform(F.map_values("impact"), lambda m: F.to_json(F.array_sort(F.map_entries(m)))))
    return pivots.withColumn("power", F.size(pattern))


def top_pivots(pivots: DataFrame, k: int = 10) -> DataFrame:
    """The strongest pivots; equal ones in their order."""
    return pivot_power(pivots).orderBy(F.desc("power"), "ordinal").limit(k)


def summary(levels: DataFrame) -> DataFrame:
    """Per case whether any hypothesis is set apart, and the strongest finding."""
    rank = F.create_map(*[F.lit(x) for kv in {"falsified": 4, "strong": 3, "moderate": 2, "weak": 1, "untested": 0}.items() for x in kv])
    out = levels.groupBy("case_id").agg(F.bool_or(F.col("support_level").isin("moderate", "strong", "falsified")).alias("any_discriminated"), F.max(F.element_at(rank, F.col("support_level"))).alias("rank"))
    return out.select("case_id", "any_discriminated", F.element_at(F.array(*map(F.lit, ("untested", "weak", "moderate", "strong", "falsified"))), F.col("rank") + 1).alias("finding"))


def counterfactuals(matrix: DataFrame, predictions: DataFrame) -> DataFrame:
    """What each hypothesis would expect of a case's artifacts: its first prediction on each; no prediction, no row."""
    first = predictions.groupBy("hypothesis_id", "action", "artifact_type").agg(F.min_by("expected_status", "ordinal").alias("expected_status"))
    return matrix.select("case_id", "action", "artifact_type", "status").join(F.broadcast(first), ["action", "artifact_type"])


def resolved_pivots(expected: DataFrame, pivots: DataFrame) -> DataFrame:
    """Pivots of each hypothesis whose artifact is among what it would expect of a case: rows of counterfactuals with the pivot's place and target."""
    own = pivots.select("ordinal", "hypothesis_id", "action", "artifact_type")
    return expected.select("case_id", "hypothesis_id", "action", "artifact_type").join(F.broadcast(own), ["hypothesis_id", "action", "artifact_type"]).select("case_id", "hypothesis_id", "ordinal", F.concat_ws("/", "action", "artifact_type").alias("target"))


def summary_text(level: Column, favors: Column, disfavors: Column, untested: Column) -> Column:
    """One line on a hypothesis: level, weights for and against, weight of what is untested."""
    one = lambda c: F.format_string("%.1f", c.cast("double"))
    weights = F.concat(F.lit(" support, weight "), one(favors), F.lit(" for and "), one(disfavors), F.lit(" against"))
    text = F.when(level == "falsified", F.lit("falsified by observations")).when(level.isin("strong", "moderate", "weak"), F.concat(level, weights)).otherwise(F.lit("not enough evidence"))
    return F.concat(text, F.when(untested > 0, F.concat(F.lit("; weight "), one(untested), F.lit(" untested"))).otherwise(F.lit("")))


def dangling_impacts(pivots: DataFrame, hypotheses: DataFrame) -> DataFrame:
    """Hypotheses that pivots name and that don't exist."""
    named = pivots.select("ordinal", F.explode(F.map_keys("impact")).alias("hypothesis_id"))
    return named.join(F.broadcast(hypotheses.select("hypothesis_id")), "hypothesis_id", "left_anti")
