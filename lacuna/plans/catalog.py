"""The versioned catalog of artifacts that an activity should leave, as one array literal of a plan."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Version, entries, their conditions, limits and sources.
VERSION = "windows-msdocs-2026-10-05-v4"
RELEASE = "Windows 10"
_LOG = "Security log retention/overwrite policy and acquisition coverage must include the interval."
_POLICY = ("Event log retention policy", "https://learn.microsoft.com/en-us/openspecs/windows_protocols/ms-gpsb/0b9673a7-ce0a-49b4-912b-591efdb37cdf")
ENTRIES = (
    {
        "action": "process_execution",
        "artifact_type": "security_event_4688",
        "description": "Security event 4688 records a process creation event.",
        "scope": "Windows 10, matching the linked event and policy documentation; confirm event schema locally.",
        "required_conditions": ["host_build_matches_documented_catalog_scope", "audit_process_creation_enabled_for_interval", "security_log_acquired_and_covers_interval"],
        "retention": _LOG,
        "interpretation_limit": "A missing 4688 is not meaningful if process-creation auditing was disabled or the log interval is incomplete.",
        "source_refs": [("4688 event semantics", "https://learn.microsoft.com/en-us/windows/security/threat-protection/auditing/event-4688"), ("Audit Process Creation policy", "https://learn.microsoft.com/en-us/windows/security/threat-protection/auditing/audit-process-creation"), _POLICY],
    },
    {
        "action": "permitted_network_connection",
        "artifact_type": "security_event_5156",
        "description": "Security event 5156 records a connection permitted by Windows Filtering Platform.",
        "scope": "Windows 10 using Windows Filtering Platform, matching the linked event and policy documentation.",
        "required_conditions": ["host_build_matches_documented_catalog_scope", "audit_filtering_platform_connection_success_enabled_for_interval", "security_log_acquired_and_covers_interval"],
        "retention": _LOG,
        "interpretation_limit": "Success auditing may produce very high event volume; absence is uninterpretable without the policy state and log coverage.",
        "source_refs": [("5156 event semantics", "https://learn.microsoft.com/en-us/previous-versions/windows/it-pro/windows-10/security/threat-protection/auditing/event-5156"), ("Audit Filtering Platform Connection policy", "https://learn.microsoft.com/en-us/previous-versions/windows/it-pro/windows-10/security/threat-protection/auditing/audit-filtering-platform-connection"), _POLICY],
    },
    {
        "action": "successful_logon",
        "artifact_type": "security_event_4624",
        "description": "Security event 4624 records a successfully created logon session.",
        "scope": "Windows 10, matching the linked event and policy documentation; recorded on the computer where the session is created.",
        "required_conditions": ["host_build_matches_documented_catalog_scope", "audit_logon_success_enabled_for_interval", "security_log_acquired_and_covers_interval"],
        "retention": _LOG,
        "interpretation_limit": "A missing event does not show that no logon occurred unless successful logon auditing and log coverage are established.",
        "source_refs": [("4624 event semantics", "https://learn.microsoft.com/en-us/windows/security/threat-protection/auditing/event-4624"), ("Audit Logon policy", "https://learn.microsoft.com/en-us/previous-versions/windows/it-pro/windows-10/security/threat-protection/auditing/audit-logon"), _POLICY],
    },
    {
        "action": "session_termination",
        "artifact_type": "security_event_4634",
        "description": "Security event 4634 records termination of a logon session.",
        "scope": "Windows 10, matching the linked event and policy documentation; records session termination, not necessarily user-initiated logoff.",
        "required_conditions": ["host_build_matches_documented_catalog_scope", "audit_logoff_success_enabled_for_interval", "security_log_acquired_and_covers_interval"],
        "retention": _LOG,
        "interpretation_limit": "A missing event does not show that a session remained active unless successful logoff auditing and log coverage are established.",
        "source_refs": [("4634 event semantics", "https://learn.microsoft.com/en-us/previous-versions/windows/it-pro/windows-10/security/threat-protection/auditing/event-4634"), ("Audit Logoff policy", "https://learn.microsoft.com/en-us/windows/security/threat-protection/auditing/audit-logoff"), _POLICY],
    },
    {
        "action": "file_change",
        "artifact_type": "ntfs_usn_change_journal",
        "description": "The NTFS USN change journal records file, directory, and other NTFS-object changes.",
        "scope": "Windows 10 NTFS volume and change interval; it is not host-wide or cross-filesystem.",
        "required_conditions": ["host_build_matches_documented_catalog_scope", "target_volume_is_ntfs", "usn_journal_active_for_interval", "acquired_journal_range_covers_interval_without_wrap"],
        "retention": "The journal has configured size/allocation bounds; confirm the queried USN range still includes the interval.",
        "interpretation_limit": "A missing USN record is interpretable only for a journal known to be active and acquired across the relevant range.",
        "source_refs": [("USN journal operations and behavior", "https://learn.microsoft.com/en-us/windows-server/administration/windows-commands/fsutil-usn")],
    },
    {
        "action": "file_change",
        "artifact_type": "ntfs_mft_entry",
        "description": "An NTFS MFT (Master File Table) record contains file metadata including creation, last-modified, MFT-modified, and last-accessed timestamps, plus file name and parent directory.",
        "scope": "Windows 10 NTFS volume; each MFT record describes one file/directory on that volume.",
        "required_conditions": ["host_build_matches_documented_catalog_scope", "target_volume_is_ntfs", "mft_acquired_from_volume_image_or_live_acquisition"],
        "retention": "MFT records for deleted files may be reused after deletion; timestamps reflect the last recorded metadata update and may persist after file removal.",
        "interpretation_limit": "An MFT record shows metadata for the last state before deletion or overwrite; it does not capture the full event history of the file.",
        "source_refs": [("FILE_RECORD_SEGMENT_HEADER (on-disk MFT record header, update sequence array, flags)", "https://learn.microsoft.com/en-us/windows/win32/devnotes/file-record-segment-header"), ("Master file table (MFT) overview", "https://learn.microsoft.com/en-us/windows/win32/devnotes/master-file-table"), ("MS-FSCC 5.2 NTFS attribute types ($STANDARD_INFORMATION, $FILE_NAME, $DATA)", "https://learn.microsoft.com/en-us/openspecs/windows_protocols/ms-fscc/a82e9105-2405-4e37-b2c3-28c773902d85")],
    },
)

SCHEMA = (
    "action string, artifact_type string, description string, scope string, required_conditions array<string>, retention string, "
    "interpretation_limit string, source_refs array<struct<title:string,url:string>>, documented_os_release_prefix string"
)
ACTIONS = tuple(dict.fromkeys(e["action"] for e in ENTRIES))
STATUSES = ("present", "confirmed_absent", "unknown", "out_of_scope")
REASONS = ("conditions_unverified", "catalog_scope_unverified", "not_collected", "retention_gap", "acquisition_gap", "parser_failure", "ambiguous", "not_applicable")


def catalog(spark: SparkSession, profile: str = "windows") -> DataFrame:
    """The catalog of a profile; only windows has one."""
    if profile.strip().lower() != "windows":
        raise ValueError(f"unsupported OS profile: {profile!r}; available profile: 'windows'")
    return spark.createDataFrame([(*(e[k] for k in list(ENTRIES[0])), RELEASE) for e in ENTRIES], SCHEMA)


def entries() -> Column:
    """The catalog as an array of structs: exploding it beside cases needs no join."""
    text = lambda x: F.lit(x)
    return F.array(*[F.struct(text(e["action"]).alias("action"), text(e["artifact_type"]).alias("artifact_type"), F.array(*map(text, e["required_conditions"])).alias("required_conditions"), text(RELEASE).alias("release_prefix")) for e in ENTRIES])


def key_in_catalog(action: Column, artifact_type: Column) -> Column:
    return F.concat_ws("/", action, artifact_type).isin([f"{e['action']}/{e['artifact_type']}" for e in ENTRIES])


def supports_release(release: Column, prefix: Column) -> Column:
    """Equal to the prefix, or the prefix and a blank, without regard to case."""
    low = F.lower(prefix)
    return (F.lower(release) == low) | F.startswith(F.lower(release), F.concat(low, F.lit(" ")))


def fingerprint_text() -> str:
    """One JSON line per entry with sorted keys, entries sorted by key; its SHA-256 pins the catalog."""
    rows = sorted(ENTRIES, key=lambda e: (e["action"], e["artifact_type"]))
    return "\n".join(json.dumps({**e, "source_refs": [list(r) for r in e["source_refs"]]}, sort_keys=True) for e in rows)
