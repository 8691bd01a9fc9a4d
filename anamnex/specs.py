"""Record types: their fields, identities, compared fields and closed vocabularies.

Fixed values: names and vocabularies that stored data and other tools rely on.
"""

from __future__ import annotations

from pyspark.sql import types as T

TEXT, NUMBER = "string", "double"

#: Payload fields by record type; the required ones are in REQUIRED.
FIELDS: dict[str, dict[str, str]] = {
    "lab_result": {"test_name": TEXT, "loinc": TEXT, "value_num": NUMBER, "value_text": TEXT, "unit": TEXT, "ref_low": NUMBER, "ref_high": NUMBER, "flag": TEXT, "collected_at": TEXT},
    "medication": {"name": TEXT, "dose": TEXT, "route": TEXT, "frequency": TEXT, "started_on": TEXT, "ended_on": TEXT, "prescriber": TEXT, "status": TEXT, "status_reason": TEXT},
    "procedure": {"name": TEXT, "performed_on": TEXT, "provider": TEXT, "outcome": TEXT},
    "appointment": {"scheduled_for": TEXT, "provider": TEXT, "specialty": TEXT, "reason": TEXT, "summary": TEXT},
    "observation": {"obs_type": TEXT, "observed_at": TEXT, "key": TEXT, "value_num": NUMBER, "value_text": TEXT, "unit": TEXT},
    "allergy": {"substance": TEXT, "reaction": TEXT, "criticality": TEXT, "noted_on": TEXT},
    "condition": {"name": TEXT, "status": TEXT, "onset_on": TEXT, "resolved_on": TEXT, "relation": TEXT, "note": TEXT},
}
TYPES = tuple(FIELDS)
REQUIRED = {
    "lab_result": ("test_name", "collected_at"),
    "medication": ("name",),
    "procedure": ("name",),
    "appointment": ("scheduled_for",),
    "observation": ("obs_type",),
    "allergy": ("substance",),
    "condition": ("name", "status"),
}
DATES = {
    "lab_result": ("collected_at",),
    "medication": ("started_on", "ended_on"),
    "procedure": ("performed_on",),
    "appointment": ("scheduled_for",),
    "observation": ("observed_at",),
    "allergy": ("noted_on",),
    "condition": ("onset_on", "resolved_on"),
}
#: Fields whose value takes part in the identity.
KEYS = {
    "lab_result": ("test_name", "collected_at"),
    "medication": ("name", "dose", "started_on"),
    "procedure": ("name", "performed_on"),
    "appointment": ("provider", "scheduled_for"),
    "observation": ("obs_type", "observed_at", "key"),
    "allergy": ("substance",),
    "condition": ("name", "status", "relation", "onset_on"),
}
#: Fields that make two rows of one identity differ.
COMPARED = {
    "lab_result": ("value_num", "value_text", "unit", "ref_low", "ref_high", "flag", "loinc"),
    "medication": ("route", "frequency", "ended_on", "prescriber", "status", "status_reason"),
    "procedure": ("provider", "outcome"),
    "appointment": ("specialty", "reason", "summary"),
    "observation": ("value_num", "value_text", "unit"),
    "allergy": ("reaction", "criticality", "noted_on"),
    "condition": ("status", "resolved_on", "relation", "note"),
}
#: Types where a missing field is silence and not news.
SPARSE = ("allergy", "condition")
ENUMS = {
    ("allergy", "criticality"): ("high", "low", "unable-to-assess"),
    ("condition", "status"): ("active", "family-history", "history", "resolved"),
}
VITAL, SYMPTOM, ACTIVITY, ORDER, FUNCTIONAL = "vital", "symptom", "activity", "order", "functional"
SELF_REPORTED = (ACTIVITY, SYMPTOM)
OBS_REQUIRED = {FUNCTIONAL: ("observed_at",), SYMPTOM: ("key", "observed_at"), ACTIVITY: ("key", "observed_at")}
OBS_TIMED = SELF_REPORTED
SYMPTOM_RANGE = (0.0, 10.0)

INTERNAL = ("dedup_key", "dedup_base", "dedup_occurrence")
ATTESTATION = ("attested_by", "attested_on", "attested_at")
EDIT_MARK = ("edited_at", "edited_by")

STATUSES = ("confirmed", "superseded", "erroneous-in-source", "disputed", "merged-into", "distinct")
APPENDIX = ("superseded", "erroneous-in-source", "merged-into")
RESOLVING = ("merged-into", "superseded", "distinct")
TERMINAL_MEDS = ("completed", "stopped", "discontinued")
LIFECYCLE_MEDS = (*TERMINAL_MEDS, "active")
RENEWALS = ("reorder", "re-order", "renewal", "renewed")
NORMAL_FLAGS = ("normal", "n", "none")
ORDER_NOISE = ("panel", "profile", "extensive")
ORDER_WINDOW = (-1, 30)
ABNORMAL_MONTHS, SYMPTOM_DAYS, BRIEF_LABS = 12, 30, 10

#: Column that orders a type's rows in time, and the one that names them.
TIME = {"lab_result": "collected_at", "medication": "started_on", "procedure": "performed_on", "appointment": "scheduled_for", "observation": "observed_at", "allergy": "noted_on", "condition": "onset_on"}
NAME = {"lab_result": "test_name", "medication": "name", "procedure": "name", "allergy": "substance", "condition": "name"}


def editable(record_type: str) -> tuple[str, ...]:
    """Payload fields that an edit may change without moving the identity."""
    return tuple(f for f in FIELDS[record_type] if f not in KEYS[record_type])


def payload_schema(record_type: str) -> T.StructType:
    return T.StructType.fromDDL(", ".join(f"`{n}` {k}" for n, k in FIELDS[record_type].items()))


def record_schema(record_type: str) -> T.StructType:
    own = ", ".join(f"`{n}` {k}" for n, k in FIELDS[record_type].items())
    return T.StructType.fromDDL(
        f"{record_type}_id bigint, person_id bigint, document_id bigint, {own}, dedup_key string, dedup_base string, dedup_occurrence int, "
        "attested_by string, attested_on string, attested_at string, edited_at string, edited_by string"
    )


TABLES: dict[str, str] = {
    "person": "person_id bigint, slug string, full_name string, dob string, sex string, blood_type string, notes string, deactivated_at string",
    "document": "document_id bigint, sha256 string, person_id bigint, doc_date string, category string, provider string, source_path string, ocr_text string, ingested_at string, text_source string",
    "conflict": "conflict_id bigint, record_type string, dedup_key string, person_id bigint, document_id bigint, existing_json string, incoming_json string, status string, resolution string, detected_at string, resolved_at string",
    "curation": "record_type string, dedup_base string, record_id bigint, status string, note string, merged_into_base string, attributed_to string, created_at string",
    "record_edit": "record_edit_id bigint, record_type string, record_id bigint, dedup_base string, field string, old_value string, new_value string, note string, attributed_to string, edited_at string",
    "person_unit_pref": "person_id bigint, key string, unit string, set_at string",
    "document_tombstone": "sha256 string, removed_at string, reason string, note string, document_id bigint",
}


def schema_of(table: str) -> T.StructType:
    return record_schema(table) if table in FIELDS else T.StructType.fromDDL(TABLES[table])
