"""Record identity: the parts that name a fact, their hash, and whether two rows of one identity say the same."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..specs import COMPARED, FIELDS, NAME, NUMBER, SPARSE
from .dates import date_only, norm_ts
from .text import Dictionary, collapse, enum_token, filled, key_token, loose_unit, norm


def hash_parts(*parts: Column) -> Column:
    """SHA-256 of the parts between bars; null counts as empty (concat_ws would pass it over)."""
    return F.sha2(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256)


def condition_subject(dictionary: Dictionary = None) -> Column:
    family = F.concat(F.lit("family:"), norm(F.col("relation"), dictionary))
    return F.when(enum_token(F.col("status")) == "family-history", family).otherwise(F.lit("self"))


def condition_episode(dictionary: Dictionary = None) -> Column:
    onset = date_only(F.col("onset_on"))
    return F.when(onset == "", condition_subject(dictionary)).otherwise(F.concat_ws("@", condition_subject(dictionary), onset))


def key_parts(record_type: str, dictionary: Dictionary = None) -> list[Column]:
    """What identifies a row of a type, person first."""
    parts = {
        "lab_result": lambda: [key_token(F.col("test_name"), dictionary), date_only(F.col("collected_at"))],
        "medication": lambda: [norm(F.col("name"), dictionary), F.coalesce(collapse(F.col("dose")), F.lit("")), date_only(F.col("started_on"))],
        "procedure": lambda: [norm(F.col("name"), dictionary), date_only(F.col("performed_on"))],
        "appointment": lambda: [norm(F.col("provider"), dictionary), date_only(F.col("scheduled_for"))],
        "observation": lambda: [norm(F.col("obs_type"), dictionary), norm_ts(F.col("observed_at")), key_token(F.col("key"), dictionary)],
        "allergy": lambda: [norm(F.col("substance"), dictionary)],
        "condition": lambda: [norm(F.col("name"), dictionary), condition_episode(dictionary)],
    }[record_type]()
    return [F.col("person_id").cast("string"), *parts]


def dedup_base(record_type: str, dictionary: Dictionary = None) -> Column:
    return hash_parts(*key_parts(record_type, dictionary))


def occurrence_key(base: Column, occurrence: Column) -> Column:
    """The base itself for the first row of a family, a hash with the number for the others."""
    return F.when(F.coalesce(occurrence, F.lit(0)) == 0, base).otherwise(hash_parts(base, occurrence))


def identity_label(record_type: str, dictionary: Dictionary = None) -> Column:
    person, *rest = key_parts(record_type, dictionary)
    return F.concat_ws(" | ", F.concat(F.lit("person "), person), *(F.coalesce(p, F.lit("")) for p in rest))


def row_label(record_type: str) -> Column:
    if record_type in NAME:
        return F.coalesce(F.col(NAME[record_type]), F.lit(""))
    pair = ("provider", "scheduled_for") if record_type == "appointment" else ("obs_type", "key")
    return F.concat_ws(" ", *(F.when(filled(F.col(c)), F.col(c)) for c in pair))


def values_agree(field: str, kind: str, a: Column, b: Column) -> Column:
    if field == "unit":
        return loose_unit(a) == loose_unit(b)
    return a.cast("double").eqNullSafe(b.cast("double")) if kind == NUMBER else a.eqNullSafe(b)


def rows_equal(record_type: str, stored, incoming) -> Column:
    """Whether two rows agree on all compared fields; in sparse types a missing value agrees with any.

    stored and incoming: functions from a field name to a Column.
    """
    out = F.lit(True)
    for f in COMPARED[record_type]:
        a, b = stored(f), incoming(f)
        same = values_agree(f, FIELDS[record_type][f], a, b)
        if record_type in SPARSE:
            same = a.isNull() | b.isNull() | same
        out = out & same
    return out


def sparse_gains(record_type: str, stored, incoming) -> list[Column]:
    """Names of compared fields that only the incoming row states; none in types that are not sparse."""
    if record_type not in SPARSE:
        return []
    return [F.when(stored(f).isNull() & incoming(f).isNotNull(), F.lit(f)) for f in COMPARED[record_type]]
