"""One digest per case over its context and its sorted matrix rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.functions.canonical import analysis_digest
from lacuna.plans.catalog import VERSION

SCHEMA_VERSION = "evidence-matrix-v3"


def analysis_digests(contexts: DataFrame, matrix: DataFrame) -> DataFrame:
    """contexts(case_id, context as JSON) and matrix rows to (case_id, analysis_sha256).

    A case has as many rows as the catalog; they are sorted, so neither
    partitions nor order of input change the digest.
    """
    entry = F.struct("action", "artifact_type", "status", "reason", "evidence_ref")
    rows = matrix.groupBy("case_id").agg(F.to_json(F.array_sort(F.collect_list(entry)), {"ignoreNullFields": "false"}).alias("records"))

    @F.pandas_udf("string")
    def digest(context: pd.Series, records: pd.Series) -> pd.Series:
        import json

        return pd.Series([analysis_digest({"schema": SCHEMA_VERSION, "catalog_version": VERSION, "context": json.loads(c), "records": json.loads(r)}) for c, r in zip(context, records, strict=True)], dtype=object)

    return contexts.join(rows, "case_id").select("case_id", digest("context", "records").alias("analysis_sha256"))
