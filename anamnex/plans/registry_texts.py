"""Oracles of the rendered documents, line by line and whole, and registered queries of what they are made of."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import units
from ..functions.plan import settled
from ..functions.text import number_text
from ..operators import clinical, overlay, registryops, render, search
from ..specs import TYPES, editable
from . import registry, sql
from .bridge import DICTIONARY, catalog
from .registry import _ALL, ORACLES, TODAY, query
from .registry_verbs import base_sql

_HEADED = f"- Generated: {TODAY} (read-only view of DB state)"


def _number(x: str) -> str:
    return f"CASE WHEN {x} = floor({x}) THEN CAST(CAST({x} AS BIGINT) AS VARCHAR) || '.0' ELSE CAST({x} AS VARCHAR) END"


def _opt(x: str, before: str = "", after: str = "") -> str:
    return f"CASE WHEN coalesce({x}, '') <> '' THEN '{before}' || {x} || '{after}' ELSE '' END"


def _dated(x: str) -> str:
    return f"CASE WHEN {sql.date_only(x)} = '' THEN '(undated)' ELSE {sql.date_only(x)} END"


_SHOWN = "CASE name WHEN 'DRUG 1-URGENT' THEN 'Drug 1-Urgent' WHEN 'DRUG 2-HIGH' THEN 'Drug 2-High' WHEN 'DRUG 3-MEDIUM' THEN 'Drug 3-Medium' WHEN 'DRUG 4-NOT SPECIFIED' THEN 'Drug 4-Not Specified' WHEN 'DRUG 5-LOW' THEN 'Drug 5-Low' END"
_CORRECTED = f"CASE WHEN {sql.date_only('edited_at')} = '' THEN '' ELSE '  (corrected ' || {sql.date_only('edited_at')} || ')' END"
_SUFFIX = f"CASE WHEN v_status = 'disputed' THEN '  [DISPUTED: ' || coalesce(v_note, '') || ']' ELSE '' END || {_CORRECTED}"
_RANGE = "CASE WHEN ref_low IS NOT NULL AND ref_high IS NOT NULL THEN '  (ref 10.0-120.0)' WHEN ref_high IS NOT NULL THEN '  (ref <= 120.0)' WHEN ref_low IS NOT NULL THEN '  (ref >= 10.0)' ELSE '' END"
_STATUS = sql.enum_token("status")


def _section(k: int, line: str, order: str, source: str) -> str:
    return f"SELECT person_id, {k} AS section, row_number() OVER (PARTITION BY person_id ORDER BY {order}, line)::INT AS place, line FROM (SELECT *, {line} AS line FROM {source})"


def _meds(k: int, since: bool) -> str:
    more = _opt("started_on", " (since ", ")") if since else "''"
    return _section(k, f"'- ' || {_SHOWN} || {_opt('dose', ' ')} || {more}", "started_on NULLS LAST, name, medication_id", f"medication WHERE {sql.current_med(TODAY)}")


def _conditions(k: int, statuses: str, past: bool = False) -> str:
    over = _opt("resolved_on", "  (resolved ", ")") if past else "''"
    return _section(k, f"'- ' || name || {_opt('onset_on', '  (since ', ')')} || {over} || {_opt('note', ' - ')}", "name, condition_id", f"condition WHERE {_STATUS} IN ({statuses})")


def _allergies(k: int) -> str:
    line = f"'- ' || substance || {_opt('upper(criticality)', ' [', ']')} || {_opt('reaction', ' - ')} || {_opt('noted_on', '  (noted ', ')')}"
    return _section(k, line, f"{sql.enum_token('criticality')} <> 'high', substance, allergy_id", "allergy")


_ORDERS = registry.ORACLES["open_orders"]
_ORDERS = _ORDERS[_ORDERS.index(", mine AS (SELECT *, ") :]
_ORDERS, _OPEN = _ORDERS[: _ORDERS.rindex("SELECT t.person_id")].rstrip().rstrip(","), _ORDERS[_ORDERS.rindex("SELECT t.person_id") :]
_ORDERS = f"{_ORDERS}, open_o AS ({_OPEN.replace('SELECT t.person_id, t.observation_id, t.group_count, f.group_first', 'SELECT t.*, f.group_first')})"

_LAB_VALUE = f"trim(coalesce({_number('value_num')}, value_text, '') || {_opt('unit', ' ')})"
_ABNORMAL = f"(SELECT *, row_number() OVER (PARTITION BY person_id, test_name ORDER BY collected_at DESC NULLS LAST, lab_result_id DESC) AS k FROM lab_live WHERE {sql.ABNORMAL}) WHERE k = 1 OR {sql.full_date('collected_at')} IS NULL OR {sql.full_date('collected_at')} >= DATE '{TODAY}' - INTERVAL 12 MONTH"


def _lab_line(mark: str) -> str:
    return f"'- ' || {sql.date_only('collected_at')} || '  ' || test_name || '  ' || {_LAB_VALUE} || {_opt('flag', ' [', ']')} || {mark} || {_SUFFIX}"


_VITALS = f"""(SELECT *, CASE WHEN moved THEN round(value_num / 0.45359237, 2) ELSE value_num END AS v, CASE WHEN moved THEN 'lb' ELSE unit END AS u FROM (
  SELECT o.*, coalesce(p.unit = 'lb' AND o.unit = 'kg', FALSE) AS moved FROM (SELECT *, {sql.key_token('key')} AS token, row_number() OVER (PARTITION BY person_id, {sql.key_token('key')} ORDER BY {sql.norm_ts('observed_at')} DESC, observation_id DESC) AS k FROM observation WHERE obs_type = 'vital') o
  LEFT JOIN person_unit_pref p ON p.person_id = o.person_id AND p.key = o.token WHERE k = 1))"""
_SYMPTOMS = f"""(SELECT person_id, token, count(*) AS reports, arg_max(key, (ts, observation_id)) AS label, max(ts) AS sort, arg_max(struct_pack(d := {sql.date_only('observed_at')}, v := value_num, ts := ts), (ts, observation_id)) FILTER (WHERE value_num IS DISTINCT FROM 0) AS latest,
  arg_max(struct_pack(d := {sql.date_only('observed_at')}, ts := ts), (ts, observation_id)) FILTER (WHERE value_num = 0) AS over FROM (
  SELECT *, {sql.key_token('key')} AS token, {sql.norm_ts('observed_at')} AS ts FROM observation WHERE obs_type = 'symptom' AND ({sql.full_date('observed_at')} IS NULL OR {sql.full_date('observed_at')} >= DATE '{TODAY}' - 30)) GROUP BY person_id, token)"""
_SYMPTOM_LINE = f"""'- ' || coalesce(label, '') || ' - ' || reports || CASE WHEN reports = 1 THEN ' report' ELSE ' reports' END || ' in 30d' || CASE WHEN latest IS NOT NULL THEN ', latest ' || latest.d || CASE WHEN latest.v IS NOT NULL THEN ' (severity ' || CAST(CAST(latest.v AS BIGINT) AS VARCHAR) || '/10)' ELSE '' END ELSE '' END
  || CASE WHEN over IS NOT NULL AND (latest IS NULL OR over.ts > latest.ts) THEN '; last reported resolved ' || over.d ELSE '' END"""
_WHO = "concat_ws(' ', nullif(provider, ''), nullif(specialty, ''))"
_WHY = "CASE WHEN coalesce(reason, '') <> '' THEN reason ELSE coalesce(summary, '') END"
_VISIT = f"CASE WHEN concat_ws(' - ', nullif({_WHO}, ''), nullif({_WHY}, '')) = '' THEN 'appointment' ELSE concat_ws(' - ', nullif({_WHO}, ''), nullif({_WHY}, '')) END"
_ROUTINE = "regexp_matches(name, '(^|[^a-z0-9])(proc ro)($|[^a-z0-9])', 'i')"
_ORDER_LINE = f"""'- ' || key || {_opt('value_text', ' - ')} || {_opt("concat_ws('; ', CASE WHEN " + sql.date_only('observed_at') + " <> '' THEN 'ordered ' || " + sql.date_only('observed_at') + " END, CASE WHEN group_count > 1 THEN '+' || (group_count - 1) || ' earlier' || CASE WHEN group_first IS NOT NULL THEN ', first ' || group_first ELSE '' END END)", '  (', ')')}"""

SUMMARY_SQL = " UNION ALL ".join([
    _meds(0, True), _conditions(1, "'active'"), _conditions(2, "'resolved', 'history'", True),
    _section(3, "'- ' || CASE WHEN coalesce(relation, '') <> '' THEN relation ELSE 'family' END || ': ' || name", "name, condition_id", f"condition WHERE {_STATUS} = 'family-history'"),
    _allergies(4), _section(5, _ORDER_LINE, f"{sql.date_only('observed_at')} = '', {sql.date_only('observed_at')}, lower(key), observation_id", "open_o"),
    _section(6, f"'- ' || coalesce(key, '') || ': ' || coalesce({_number('v')}, value_text, '') || {_opt('u', ' ')} || {_opt(sql.date_only('observed_at'), '  (', ')')} || CASE WHEN moved THEN '  [converted from ' || {_number('value_num')} || ' ' || unit || ']' ELSE '' END", "token", _VITALS),
    _section(7, _SYMPTOM_LINE, "sort = '', sort DESC, label, token", _SYMPTOMS),
    _section(8, _lab_line(_RANGE), "collected_at DESC NULLS LAST, test_name NULLS FIRST, lab_result_id DESC", f"(SELECT * FROM {_ABNORMAL})"),
    _section(9, f"'- ' || {_dated('performed_on')} || '  ' || name || {_opt('outcome', ' - ')} || {_opt('provider', '  (', ')')}", f"{sql.date_only('performed_on')} = '', performed_on DESC, procedure_id", f"procedure WHERE NOT {_ROUTINE}"),
    f"SELECT person_id, 9, 1073741824, '_' || count(*) || CASE WHEN count(*) = 1 THEN ' routine procedure' ELSE ' routine procedures' END || ' not shown_' FROM procedure WHERE {_ROUTINE} GROUP BY person_id",
    _section(10, f"'- ' || {_dated('scheduled_for')} || '  ' || {_VISIT}", "scheduled_for NULLS LAST, appointment_id", f"appointment WHERE ({sql.date_only('scheduled_for')} <> '' AND {sql.date_only('scheduled_for')} >= '{TODAY}') OR coalesce(trim(summary), '') = ''"),
])
_TABLES = (*_ALL, "person", "person_unit_pref", "ruling")


@query(sql.with_views(f"{_ORDERS} {SUMMARY_SQL}", *_TABLES, verdicts=True))
def summary_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every person's summary, in place."""
    return render.summary_lines(catalog(spark, sf_dir), TODAY, DICTIONARY, ("proc ro",))


def _texts(titles, optional=(), empty=None) -> str:
    """Bodies side by side, and the text after a header."""
    parts = []
    for k, title in enumerate(titles):
        body = f"max(body) FILTER (WHERE section = {k})"
        parts.append(f"'## {title}' || chr(10) || chr(10) || {body if k in optional else f'coalesce({body}, {chr(39)}{(empty or {}).get(k, render.EMPTY)}{chr(39)})'} || chr(10) AS t{k}")
    return ", ".join(parts)


_BODIES = "bodies AS (SELECT person_id, section, string_agg(line, chr(10) ORDER BY place) AS body FROM lines GROUP BY 1, 2)"
_COUNTS = " || ', ' || ".join(f"'{n}=' || (CASE WHEN c.{t} IS NULL THEN 0 ELSE c.{t} END)" for n, t in (("labs", "lab_result"), ("medications", "medication"), ("procedures", "procedure"), ("appointments", "appointment"), ("observations", "observation"), ("conditions", "condition"), ("allergies", "allergy")))
_ROW_COUNTS = "SELECT person_id, " + ", ".join(f"coalesce(sum(n) FILTER (WHERE t = '{t}'), 0)::BIGINT AS {t}" for t in TYPES) + " FROM (" + " UNION ALL ".join(f"SELECT person_id, '{t}' AS t, count(*) AS n FROM {t} GROUP BY 1" for t in TYPES) + ") GROUP BY person_id"
ORACLES["summaries"] = sql.with_views(
    f"""{_ORDERS}, lines AS ({SUMMARY_SQL}), {_BODIES}, wide AS (SELECT p.person_id, {_texts(render.SUMMARY, (7,), {8: '_none flagged_'})} FROM person p LEFT JOIN bodies b USING (person_id) GROUP BY p.person_id), c AS ({_ROW_COUNTS})
SELECT p.person_id, rtrim(concat_ws(chr(10), '# Master Summary: ' || full_name || chr(10) || chr(10) || '- Person: ' || slug || chr(10) || '- DOB: ' || coalesce(nullif(dob, ''), 'unknown') || chr(10) || '{_HEADED}' || chr(10) || '- Source rows: ' || {_COUNTS} || chr(10),
  {', '.join(f't{k}' for k in range(len(render.SUMMARY)))}), chr(10) || ' ') || chr(10) AS text FROM person p JOIN wide w USING (person_id) LEFT JOIN c USING (person_id)""", *_TABLES, verdicts=True)  # fmt: skip


# --- briefs

_RECENT = f"(SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY collected_at DESC NULLS LAST, NOT {sql.ABNORMAL}, test_name NULLS FIRST, lab_result_id DESC) AS k FROM lab_live)"
_CONTEXT = f"""(SELECT person_id, 0 AS kind, coalesce(performed_on, '') AS ts, procedure_id AS id, '- ' || {_dated('performed_on')} || '  procedure: ' || name || {_opt('outcome', ' - ')} AS said FROM procedure
  UNION ALL SELECT person_id, 1, {sql.norm_ts('observed_at')}, observation_id, '- ' || {_dated('observed_at')} || '  ' || obs_type || {_opt('key', ' ')} || CASE WHEN value_num IS NULL AND value_text IS NULL THEN '' ELSE ' = ' || coalesce({_number('value_num')}, value_text) || {_opt('unit', ' ')} END FROM observation WHERE obs_type NOT IN ('symptom', 'activity'))"""
_DISPUTED = """(SELECT l.person_id, k.dedup_base, v.rid, v.note, l.test_name FROM (SELECT dedup_base, ruled_id AS rid, status, note FROM ruled WHERE NOT family UNION ALL SELECT dedup_base, 0, status, note FROM family_v) v
  JOIN (SELECT dedup_base, min(lab_result_id) AS head FROM keyed GROUP BY 1) k USING (dedup_base) JOIN lab_result l ON l.lab_result_id = CASE WHEN v.rid > 0 THEN v.rid ELSE k.head END WHERE v.status = 'disputed')"""
_BRIEF_SQL = " UNION ALL ".join([
    _meds(0, False), _section(1, _lab_line(f"CASE WHEN {sql.ABNORMAL} THEN '  [!]' || {_RANGE} ELSE '' END"), "k", f"{_RECENT} WHERE k <= 10"), _allergies(2), _conditions(3, "'active'"),
    _section(4, "said", "kind, ts DESC, id", _CONTEXT), _section(6, f"'- lab_result: ' || CASE WHEN coalesce(test_name, '') <> '' THEN test_name ELSE '(no live rows)' END || ' - ' || coalesce(note, '')", "dedup_base, rid", _DISPUTED),
])


@query(sql.with_views(_BRIEF_SQL, *_TABLES, verdicts=True))
def brief_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of what a brief says of each person: labs, context and questions among them."""
    return render.brief_lines(catalog(spark, sf_dir), TODAY, DICTIONARY)


def _known(x: str, other: str) -> str:
    return f"CASE WHEN coalesce({x}, '') <> '' THEN {x} ELSE '{other}' END"


ORACLES["briefs"] = sql.with_views(
    f""", lines AS ({_BRIEF_SQL}), {_BODIES}, wide AS (SELECT p.person_id, {_texts(render.BRIEF, (6,), {5: '_none_'})} FROM (SELECT DISTINCT person_id FROM appointment) p LEFT JOIN bodies b USING (person_id) GROUP BY p.person_id)
SELECT appointment_id, person_id, '# Appointment Brief: ' || full_name || chr(10) || chr(10) || '{_HEADED}' || chr(10) || chr(10) || '## Appointment' || chr(10) || chr(10) || '- When: ' || CASE WHEN {sql.date_only('scheduled_for')} = '' THEN 'unscheduled' ELSE {sql.date_only('scheduled_for')} END
  || chr(10) || '- Provider: ' || {_known('provider', 'unknown')} || chr(10) || '- Specialty: ' || {_known('specialty', 'unknown')} || chr(10) || '- Reason: ' || {_known('reason', '(none given)')} || chr(10)
  || rtrim(concat_ws(chr(10), '', {', '.join(f't{k}' for k in range(len(render.BRIEF)))}), chr(10) || ' ') || chr(10) AS text
FROM appointment JOIN person USING (person_id) JOIN wide USING (person_id)""", *_TABLES, verdicts=True)  # fmt: skip


# --- journals

_EVENTS = registry._TIMELINE
for _table in TYPES:
    _mark = _SUFFIX if _table == "lab_result" else "''"
    _EVENTS = _EVENTS.replace(f", document_id, '{_table}' AS record_type,", f", document_id, {_mark} AS mark, '{_table}' AS record_type,").replace(f", document_id, '{_table}', ", f", document_id, {_mark}, '{_table}', ")
_EVENTS = _EVENTS.replace("FROM lab_result", "FROM lab_live").replace("FROM observation", "FROM observation WHERE obs_type NOT IN ('symptom', 'activity')")
_PLACED = f"events_ AS (SELECT *, row_number() OVER w AS place, date IS DISTINCT FROM lag(date) OVER w AS starts FROM ({_EVENTS}) WHERE date <> '' WINDOW w AS (PARTITION BY person_id ORDER BY date, type, record_id, document_id, summary))"
ORACLES["journals"] = sql.with_views(
    f""", {_PLACED}, notes AS (SELECT person_id, document_id, row_number() OVER (PARTITION BY person_id ORDER BY first) AS n FROM (SELECT person_id, document_id, min(place) AS first FROM events_ WHERE document_id IS NOT NULL GROUP BY 1, 2)),
said AS (SELECT person_id, string_agg(CASE WHEN starts THEN chr(10) || '## ' || date || chr(10) || chr(10) ELSE '' END || '- **' || type || '** -- ' || summary || coalesce(' [^' || n || ']', '') || mark, chr(10) ORDER BY place) AS t FROM events_ LEFT JOIN notes USING (person_id, document_id) GROUP BY 1),
cited AS (SELECT n.person_id, string_agg('[^' || n || ']: document #' || n.document_id || CASE WHEN d.document_id IS NULL THEN ' (not found)' ELSE {_opt('category', ', ')} || {_opt('provider', ', ')} || {_opt('doc_date', ', dated ')} || {_opt('source_path', ', sources/')} END, chr(10) ORDER BY n) AS t FROM notes n LEFT JOIN document d ON d.document_id = n.document_id GROUP BY 1)
SELECT p.person_id, '# Journal: ' || full_name || chr(10) || chr(10) || '{_HEADED}' || chr(10) || CASE WHEN s.t IS NULL THEN chr(10) || '_No dated events on record._' ELSE s.t || coalesce(chr(10) || chr(10) || '---' || chr(10) || chr(10) || c.t, '') END || chr(10) AS text
FROM person p LEFT JOIN said s USING (person_id) LEFT JOIN cited c USING (person_id)""", "document", *_TABLES, verdicts=True)  # fmt: skip


# --- units, overlays and searches

_UNIT_ROWS = sorted(units.ALIASES.items())
_SPELT = ", ".join(f"({k}, '{s.replace(chr(39), chr(39) * 2)}', '{u}', '{units.UNITS[u][0]}', {units.UNITS[u][1]!r}, {units.UNITS[u][2]!r})" for k, (s, u) in enumerate(_UNIT_ROWS))
_GOALS = ("kg", "lb", "cm", "in", "degC", "degF", "mg/dL")


@query(f"""WITH spelt(k, text, unit, dimension, factor, shift) AS (VALUES {_SPELT}), goal(goal, dimension, factor, shift) AS (VALUES {', '.join(f"('{u}', '{units.UNITS[u][0]}', {units.UNITS[u][1]!r}, {units.UNITS[u][2]!r})" for u in _GOALS)})
SELECT p_partkey, goal, unit AS canonical, s.dimension, s.unit = goal AS in_target, CASE WHEN s.unit = goal THEN p_retailprice WHEN s.dimension = g.dimension THEN round((p_retailprice * s.factor + s.shift - g.shift) / g.factor, 6) END AS value
FROM part JOIN spelt s ON s.k = p_partkey % {len(_UNIT_ROWS)} CROSS JOIN goal g""")
def unit_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every spelling of every unit, in turn over all parts' prices: its unit, its dimension, and the value in seven units."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    spelt = F.element_at(F.array(*(F.lit(f" {s.upper()}  " if s.isascii() else s) for s, _ in _UNIT_ROWS)), (F.col("p_partkey") % len(_UNIT_ROWS) + 1).cast("int"))
    df = part.select("p_partkey", "p_retailprice", spelt.alias("spelt"), F.explode(F.array(*map(F.lit, _GOALS))).alias("goal"))
    unit = units.canonical_unit(F.col("spelt"))
    value = units.convert(F.col("p_retailprice"), F.col("spelt"), F.col("goal"))
    return df.select("p_partkey", "goal", unit.alias("canonical"), units.dimension_of(unit).alias("dimension"), units.in_target(F.col("spelt"), F.col("goal")).alias("in_target"), F.when(unit == F.col("goal"), value).otherwise(F.round(value, 6)).alias("value"))


@query(sql.with_views("SELECT lab_result_id, CASE WHEN v_status = 'disputed' THEN '  [DISPUTED: ' || coalesce(v_note, '') || ']' ELSE '' END AS plain, CASE WHEN v_status = 'disputed' THEN '  [DISPUTED: ' || coalesce(v_note, '') || ']' WHEN v_status IS NOT NULL THEN '  [' || v_status || ' - ' || v_note || ']' ELSE '' END AS raw FROM lab_v", "lab_result", "ruling", verdicts=True))
def verdict_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a listing says of a row's verdict, plain and raw."""
    cat = catalog(spark, sf_dir)
    df = overlay.with_verdict(cat["lab_result"], cat, "lab_result")
    return df.select("lab_result_id", overlay.verdict_suffix().alias("plain"), overlay.verdict_suffix(raw=True).alias("raw"))


@query(sql.with_views(f"SELECT event_id, CASE WHEN value_num IS NULL THEN NULL ELSE {_number('value_num')} END AS shown FROM (SELECT event_id, CASE WHEN event_id % 50 <> 0 THEN value END AS value_num FROM events)", "person"))
def numbers_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """numbers as people write them."""
    value = F.when(F.col("event_id") % 50 != 0, F.col("value"))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", number_text(value).alias("shown"))


_TEXTS_SQL = registry._TEXTS
_CUT = "cut AS (SELECT *, regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}]+') AS t FROM texts)"


@query(sql.with_views(f", {_TEXTS_SQL}, {_CUT} SELECT source_table, count(*) AS records, sum(len(t))::BIGINT AS tokens, sum(len(list_distinct(t)))::BIGINT AS distinct_tokens FROM cut GROUP BY 1", "document", *_ALL))
def index_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records and tokens of the full-text index by table, over all eight tables."""
    df = search.record_text(catalog(spark, sf_dir)).select("source_table", search.tokens(F.col("text")).alias("t"))
    return df.groupBy("source_table").agg(F.count("*").alias("records"), F.sum(F.size("t")).alias("tokens"), F.sum(F.size(F.array_distinct("t"))).alias("distinct_tokens"))


@query(sql.with_views(f", {_TEXTS_SQL}, {_CUT} SELECT source_table, source_id, len(list_filter(range(1, len(t)), lambda i: t[i] = 'rate' AND t[i + 1] = 'view')) AS hits FROM cut WHERE len(list_filter(range(1, len(t)), lambda i: t[i] = 'rate' AND t[i + 1] = 'view')) > 0", "document", *_ALL))
def phrase_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each record holds the two words of `Rate_view` in a row."""
    phrase = search.phrases("Rate_view!")[0]
    df = settled(search.record_text(catalog(spark, sf_dir)).select("source_table", "source_id", "text"), t=search.tokens(F.col("text")))
    return settled(df, hits=search.hits(F.col("t"), phrase)).select("source_table", "source_id", "hits").where("hits > 0")


@query(sql.with_views("SELECT lab_result_id, person_id, test_name, value_num, edited_at FROM lab_result WHERE person_id = 2", "lab_result"))
def labs_of_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One person's labs by slug, without key machinery."""
    return clinical.public(clinical.labs(catalog(spark, sf_dir), " P-2 ")).select("lab_result_id", "person_id", "test_name", "value_num", "edited_at")


@query(sql.with_views(f"SELECT person_id, count(*) AS events FROM ({registry._TIMELINE.replace('FROM observation', 'FROM observation WHERE obs_type NOT IN (' + chr(39) + 'symptom' + chr(39) + ', ' + chr(39) + 'order' + chr(39) + ')')}) WHERE date <> '' GROUP BY 1", *_ALL))
def timeline_without(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many events each person has without symptoms and orders."""
    return clinical.timeline(catalog(spark, sf_dir), exclude_obs_types=("symptom", "order")).groupBy("person_id").agg(F.count("*").alias("events"))


@query(" UNION ALL ".join(f"SELECT '{t}' AS record_type, '{f}' AS field" for t, fs in {
    "lab_result": "loinc value_num value_text unit ref_low ref_high flag", "medication": "route frequency ended_on prescriber status status_reason", "procedure": "provider outcome", "appointment": "specialty reason summary",
    "observation": "value_num value_text unit", "allergy": "reaction criticality noted_on", "condition": "resolved_on note",
}.items() for f in fs.split()))
def editable_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that a correction may change without moving the record."""
    return spark.createDataFrame([(t, f) for t in TYPES for f in editable(t)], "record_type string, field string")


@query(sql.with_views("SELECT v.record_type, v.record_id, v.status, CASE WHEN v.record_id > 0 THEN r.test_name ELSE f.label END AS label, CASE WHEN v.record_id > 0 THEN 1 ELSE f.n END AS family_size, CASE WHEN v.record_id > 0 THEN r.person_id ELSE f.owner END AS owner FROM (SELECT 'lab_result' AS record_type, dedup_base, ruled_id AS record_id, status FROM ruled WHERE NOT family UNION ALL SELECT 'lab_result', dedup_base, 0, status FROM family_v) v "
    "JOIN (SELECT dedup_base, arg_min(test_name, lab_result_id) AS label, count(*) AS n, arg_min(person_id, lab_result_id) AS owner FROM lab_result JOIN keyed USING (lab_result_id) GROUP BY 1) f USING (dedup_base) LEFT JOIN lab_result r ON r.lab_result_id = v.record_id", "lab_result", "ruling", verdicts=True))  # fmt: skip
def verdict_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts with what they rule on, its owner and size."""
    return registryops.verdict_list(catalog(spark, sf_dir)).select("record_type", "record_id", "status", "label", "family_size", "owner")


_CHECKS = " UNION ALL ".join([
    "SELECT 'medication status' AS check_name FROM medication WHERE status IS NOT NULL AND lower(trim(status)) NOT IN ('', 'completed', 'stopped', 'discontinued', 'active')",
    f"SELECT 'conditions' FROM (SELECT person_id, {sql.norm('name')} AS token, CASE WHEN {_STATUS} = 'family-history' THEN 'family:' || {sql.norm('relation')} ELSE 'self' END AS subject, count(*) FILTER (WHERE coalesce(onset_on, '') <> '') AS dated, count(*) FILTER (WHERE coalesce(onset_on, '') = '') AS undated FROM condition GROUP BY ALL HAVING dated > 0 AND undated > 0)",
    *(f"SELECT 'keys' FROM (SELECT 1 FROM {t} GROUP BY {base_sql(t)} HAVING count(*) > 1)" for t in TYPES),
])


@query(sql.with_views(f"SELECT check_name, count(*) AS problems FROM ({_CHECKS}) GROUP BY 1", *_ALL))
def verify_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many problems of each kind the whole check finds."""
    return registryops.verify(catalog(spark, sf_dir), DICTIONARY).groupBy("check_name").agg(F.count("*").alias("problems"))

