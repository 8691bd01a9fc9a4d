"""SQL of the name and date functions, written apart from the Column versions, for the oracle queries (DuckDB)."""

from __future__ import annotations

from .bridge import DICTIONARY


def collapse(x: str) -> str:
    plain = rf"trim(regexp_replace(replace(lower({x}), '_', ' '), '\s+', ' ', 'g'))"
    return rf"regexp_replace(regexp_replace({plain}, '\(\s+', '(', 'g'), '\s+\)', ')', 'g')"


def stem(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace({collapse(x)}, '\([^)]*\)', ' ', 'g'), '\s+', ' ', 'g'))"


def inner(x: str) -> str:
    return rf"trim(regexp_replace(array_to_string(regexp_extract_all({collapse(x)}, '\(([^)]*)\)', 1), ' '), '\s+', ' ', 'g'))"


def mapped(x: str, dictionary=DICTIONARY) -> str:
    return f"CASE {x} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in dictionary.items()) + f" ELSE {x} END" if dictionary else x


def norm(x: str, dictionary=DICTIONARY) -> str:
    full = collapse(x)
    if not dictionary:
        return f"coalesce({stem(x)}, '')"
    return f"coalesce(CASE WHEN {full} IN ({', '.join(repr(k) for k in dictionary)}) THEN {mapped(full, dictionary)} ELSE {mapped(stem(x), dictionary)} END, '')"


def key_token(x: str, dictionary=DICTIONARY) -> str:
    canonical, qualifier = norm(x, dictionary), f"coalesce({mapped(inner(x), dictionary)}, '')"
    declared = f"{collapse(x)} IN ({', '.join(repr(k) for k in dictionary)})" if dictionary else "FALSE"
    return f"CASE WHEN coalesce({declared}, FALSE) OR {qualifier} = '' OR {qualifier} = {canonical} THEN {canonical} WHEN {canonical} = '' THEN {qualifier} ELSE {canonical} || ' (' || {qualifier} || ')' END"


def enum_token(x: str) -> str:
    return f"replace(coalesce({collapse(x)}, ''), ' ', '-')"


def date_only(x: str) -> str:
    return f"coalesce(split_part(replace(trim({x}), 'T', ' '), ' ', 1), '')"


def norm_ts(x: str) -> str:
    return rf"coalesce(regexp_replace(replace(trim({x}), 'T', ' '), '\s+', ' ', 'g'), '')"


def full_date(x: str) -> str:
    return rf"CASE WHEN regexp_full_match({date_only(x)}, '\d{{4}}-\d{{2}}-\d{{2}}') THEN TRY_CAST({date_only(x)} AS DATE) END"


def end_of_period(x: str) -> str:
    d = date_only(x)
    return rf"CASE WHEN regexp_full_match({d}, '\d{{4}}') THEN TRY_CAST({d} || '-12-31' AS DATE) WHEN regexp_full_match({d}, '\d{{4}}-\d{{2}}') THEN last_day(TRY_CAST({d} || '-01' AS DATE)) ELSE {full_date(x)} END"


def hashed(*parts: str) -> str:
    return "sha256(" + " || '|' || ".join(f"coalesce(CAST({p} AS VARCHAR), '')" for p in parts) + ")"


LAB_BASE = hashed("person_id", key_token("test_name"), date_only("collected_at"))
#: Verdicts by row and by family, as the bridge makes them.
VERDICTS = f"""keyed AS (SELECT lab_result_id, {LAB_BASE} AS dedup_base FROM lab_result),
ruled AS (SELECT r.*, k.dedup_base FROM ruling r JOIN keyed k ON k.lab_result_id = r.ruled_id),
row_v AS (SELECT ruled_id, status, note FROM ruled WHERE NOT family),
family_v AS (SELECT dedup_base, arg_min(status, ruled_id) AS status, arg_min(note, ruled_id) AS note FROM ruled WHERE family GROUP BY 1),
lab_v AS (SELECT l.*, k.dedup_base, coalesce(r.status, f.status) AS v_status, coalesce(CASE WHEN r.status IS NOT NULL THEN r.note ELSE f.note END, NULL) AS v_note
  FROM lab_result l JOIN keyed k USING (lab_result_id) LEFT JOIN row_v r ON r.ruled_id = l.lab_result_id LEFT JOIN family_v f ON f.dedup_base = k.dedup_base),
lab_live AS (SELECT * FROM lab_v WHERE v_status IS NULL OR v_status NOT IN ('superseded', 'erroneous-in-source', 'merged-into'))"""


def with_views(query: str, *names: str, verdicts: bool = False) -> str:
    from .bridge import VIEWS

    parts = [f"{n} AS ({VIEWS[n]})" for n in names] + ([VERDICTS] if verdicts else [])
    return "WITH " + ", ".join(parts) + " " + query.strip()


def current_med(today: str) -> str:
    end, status = end_of_period("ended_on"), "lower(trim(coalesce(status, '')))"
    return f"""CASE WHEN {enum_token('status_reason')} IN ('reorder', 're-order', 'renewal', 'renewed') THEN TRUE
  WHEN coalesce(ended_on, '') = '' THEN {status} NOT IN ('completed', 'stopped', 'discontinued')
  WHEN {end} < DATE '{today}' THEN FALSE ELSE {status} = 'active' END"""


ABNORMAL = """((lower(trim(coalesce(flag, ''))) <> '' AND lower(trim(coalesce(flag, ''))) NOT IN ('normal', 'n', 'none'))
  OR coalesce(value_num < ref_low, FALSE) OR coalesce(value_num > ref_high, FALSE))"""
