"""Which timeline rows speak for which catalog entry. A null criterion matches anything."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "ordinal int, source string, sourcetype string, type string, format string, activity string, artifact_type string"
# Source, sourcetype, type, format, activity, artifact.
DEFAULT = (
    ("Microsoft-Windows-Security-Auditing", "Security", "4688", None, "process_execution", "security_event_4688"),
    ("Microsoft-Windows-Security-Auditing", "Security", "5156", None, "permitted_network_connection", "security_event_5156"),
    ("Microsoft-Windows-Security-Auditing", "Security", "4624", None, "successful_logon", "security_event_4624"),
    ("Microsoft-Windows-Security-Auditing", "Security", "4634", None, "session_termination", "security_event_4634"),
    ("NTFS", "USN", "USN_CHANGE", "usn", "file_change", "ntfs_usn_change_journal"),
)


def mappings(spark: SparkSession, rows=DEFAULT) -> DataFrame:
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], SCHEMA)
