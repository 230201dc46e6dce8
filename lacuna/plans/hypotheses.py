"""Rival hypotheses as tables: predictions, pivots, pivot impacts, assumptions, explained observations."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession

# Ids and names of hypotheses in their order.
HYPOTHESES = (
    ("benign_loss", "Benign Loss"),
    ("selective_deletion", "Selective Deletion"),
    ("sensor_failure", "Sensor/Parser Failure"),
    ("configuration_gap", "Configuration Gap"),
    ("non_applicable", "Non-Applicable"),
)
# Hypothesis, expected status, action, artifact, power, status that falsifies.
PREDICTIONS = (
    ("benign_loss", "unknown", "any", "any", "0.3", "confirmed_absent"),
    ("benign_loss", "unknown", "any", "security_event_4688", "0.4", "present"),
    ("selective_deletion", "confirmed_absent", "file_change", "ntfs_usn_change_journal", "0.8", "present"),
    ("selective_deletion", "confirmed_absent", "process_execution", "security_event_4688", "0.6", "present"),
    ("selective_deletion", "present", "process_execution", "security_event_4688", "0.4", None),
    ("sensor_failure", "unknown", "any", "any", "0.5", "confirmed_absent"),
    ("configuration_gap", "out_of_scope", "permitted_network_connection", "security_event_5156", "0.7", "present"),
    ("non_applicable", "out_of_scope", "any", "any", "0.9", "present"),
)
# Hypothesis, action, artifact, impact on hypotheses by status.
PIVOTS = (
    ("benign_loss", "process_execution", "security_event_4688", {"benign_loss": {"confirmed_absent": "disfavors", "unknown": "favors"}, "selective_deletion": {"confirmed_absent": "favors", "unknown": "neutral"}}),
    ("benign_loss", "file_change", "ntfs_usn_change_journal", {"benign_loss": {"confirmed_absent": "disfavors", "unknown": "favors"}, "selective_deletion": {"confirmed_absent": "favors", "unknown": "neutral"}}),
    ("selective_deletion", "process_execution", "security_event_4688", {"selective_deletion": {"confirmed_absent": "favors", "present": "disfavors"}, "benign_loss": {"confirmed_absent": "neutral", "present": "favors"}}),
    ("sensor_failure", "any", "any", {"sensor_failure": {"unknown": "favors"}, "benign_loss": {"unknown": "neutral"}}),
    ("configuration_gap", "permitted_network_connection", "security_event_5156", {"configuration_gap": {"unknown": "favors", "present": "disfavors"}, "benign_loss": {"unknown": "neutral"}}),
    ("non_applicable", "any", "any", {"non_applicable": {"out_of_scope": "favors", "present": "disfavors"}, "benign_loss": {"out_of_scope": "disfavors"}}),
)
# Hypothesis, assumption, confidence.
ASSUMPTIONS = (
    ("benign_loss", "retention_limits", "0.8"),
    ("benign_loss", "audit_policy_disabled", "0.7"),
    ("benign_loss", "acquisition_incomplete", "0.6"),
    ("selective_deletion", "attacker_privileges", "0.6"),
    ("selective_deletion", "selective_targeting", "0.7"),
    ("selective_deletion", "deletion_tools_available", "0.5"),
    ("sensor_failure", "collector_uptime", "0.7"),
    ("sensor_failure", "parser_compatibility", "0.8"),
    ("sensor_failure", "no_buffer_overflow", "0.6"),
    ("configuration_gap", "audit_policy_scope", "0.8"),
    ("configuration_gap", "gpo_consistency", "0.6"),
    ("non_applicable", "platform_mismatch", "0.7"),
)
# Hypothesis, action, artifact, status that it explains.
EXPLAINED = (
    ("benign_loss", "process_execution", "security_event_4688", "unknown"),
    ("benign_loss", "permitted_network_connection", "security_event_5156", "unknown"),
    ("benign_loss", "successful_logon", "security_event_4624", "unknown"),
    ("benign_loss", "session_termination", "security_event_4634", "unknown"),
    ("benign_loss", "file_change", "ntfs_usn_change_journal", "unknown"),
    ("selective_deletion", "process_execution", "security_event_4688", "confirmed_absent"),
    ("selective_deletion", "file_change", "ntfs_usn_change_journal", "confirmed_absent"),
    ("sensor_failure", "process_execution", "security_event_4688", "unknown"),
    ("configuration_gap", "permitted_network_connection", "security_event_5156", "unknown"),
    ("non_applicable", "file_change", "ntfs_usn_change_journal", "out_of_scope"),
)


def hypotheses(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *h) for k, h in enumerate(HYPOTHESES)], "ordinal int, hypothesis_id string, name string")


def predictions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, h, e, a, t, Decimal(p), f) for k, (h, e, a, t, p, f) in enumerate(PREDICTIONS)], "ordinal int, hypothesis_id string, expected_status string, action string, artifact_type string, power decimal(3,1), falsifies_if string")


def pivots(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *p) for k, p in enumerate(PIVOTS)], "ordinal int, hypothesis_id string, action string, artifact_type string, impact map<string,map<string,string>>")


def assumptions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(h, n, Decimal(c), "untested") for h, n, c in ASSUMPTIONS], "hypothesis_id string, assumption string, confidence decimal(3,1), state string")


def explained(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(EXPLAINED), "hypothesis_id string, action string, artifact_type string, status string")
