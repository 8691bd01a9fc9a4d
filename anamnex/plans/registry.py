"""Registered queries over the driver's tables, each over whole tables, and the same as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, identity, names, text, units
from ..operators import clinical, commit, diagnostics, ingest, overlay, piiscan, registryops, render, search, sections
from ..sources import decoders
from . import catalog as snapshots
from . import sql
from .bridge import DICTIONARY, catalog, view, whole

TODAY = "2024-01-25"
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return put


# --- names, dates, identity, units

_NAMES = "(SELECT DISTINCT test_name AS name FROM lab_result UNION SELECT DISTINCT key FROM observation UNION SELECT DISTINCT name FROM medication UNION SELECT p_name || ' (' || p_type || ')' FROM part)"


@query(sql.with_views(f"""SELECT name, {sql.collapse('name')} AS collapsed, {sql.stem('name')} AS stem, {sql.inner('name')} AS qualifier, {sql.norm('name')} AS family,
  {sql.key_token('name')} AS token, {sql.key_token('name', {})} AS plain_token, {sql.enum_token('name')} AS enum FROM {_NAMES}""", "lab_result", "observation", "medication"))  # fmt: skip
def name_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1-F8: collapse, qualifiers, family and identity tokens, enumeration tokens."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.concat("p_name", F.lit(" ("), "p_type", F.lit(")")).alias("name"))
    names = [view(spark, sf_dir, v).select(F.col(c).alias("name")) for v, c in (("lab_result", "test_name"), ("observation", "key"), ("medication", "name"))]
    df = names[0].union(names[1]).union(names[2]).union(part).distinct()
    n = F.col("name")
    full = text.collapse(n)
    return df.select(n, full.alias("collapsed"), text.strip_qualifiers(full).alias("stem"), text.qualifier_text(full).alias("qualifier"), text.norm(n, DICTIONARY).alias("family"), text.key_token(n, DICTIONARY).alias("token"), text.key_token(n).alias("plain_token"), text.enum_token(n).alias("enum"))


@query(sql.with_views(f"""SELECT v, {sql.date_only('v')} AS day_text, {sql.norm_ts('v')} AS ts, CAST({sql.full_date('v')} AS VARCHAR) AS day, CAST({sql.end_of_period('v')} AS VARCHAR) AS period_end,
  length(v) > 10 AND substr(v, 11, 1) IN ('T', ' ') AS timed, date_diff('day', DATE '1970-01-01', {sql.full_date('v')})::INT AS day_number, CAST(CAST({sql.full_date('v')} - INTERVAL 3 MONTH AS DATE) AS VARCHAR) AS before
  FROM (SELECT collected_at AS v FROM lab_result UNION SELECT ended_on FROM medication UNION SELECT onset_on FROM condition) WHERE v IS NOT NULL""", "lab_result", "medication", "condition"))  # fmt: skip
def date_precisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates of three precisions."""
    parts = [view(spark, sf_dir, t).select(F.col(c).alias("v")) for t, c in (("lab_result", "collected_at"), ("medication", "ended_on"), ("condition", "onset_on"))]
    v = F.col("v")
    df = parts[0].union(parts[1]).union(parts[2]).where("v IS NOT NULL").distinct().where(dates.is_iso_date(v))
    return df.select(v, dates.date_only(v).alias("day_text"), dates.norm_ts(v).alias("ts"), dates.full_date(v).cast("string").alias("day"), dates.end_of_period(v).cast("string").alias("period_end"), dates.has_time(v).alias("timed"), dates.ordinal(v).alias("day_number"), dates.months_before(dates.full_date(v), 3).cast("string").alias("before"))


def _keys_sql(t: str, *parts: str) -> str:
    base = sql.hashed("person_id", *parts)
    return f"SELECT '{t}' AS record_type, {t}_id AS record_id, {base} AS dedup_base, {sql.hashed(base, '2')} AS third_key FROM {t}"


@query(sql.with_views(" UNION ALL ".join([
    _keys_sql("lab_result", sql.key_token("test_name"), sql.date_only("collected_at")),
    _keys_sql("medication", sql.norm("name"), f"coalesce({sql.collapse('dose')}, '')", sql.date_only("started_on")),
    _keys_sql("procedure", sql.norm("name"), sql.date_only("performed_on")),
    _keys_sql("appointment", sql.norm("provider"), sql.date_only("scheduled_for")),
    _keys_sql("observation", sql.norm("obs_type"), sql.norm_ts("observed_at"), sql.key_token("key")),
    _keys_sql("allergy", sql.norm("substance")),
    _keys_sql("condition", sql.norm("name"), f"CASE WHEN {sql.enum_token('status')} = 'family-history' THEN 'family:' || {sql.norm('relation')} ELSE 'self' END || CASE WHEN {sql.date_only('onset_on')} <> '' THEN '@' || {sql.date_only('onset_on')} ELSE '' END"),
]), "lab_result", "medication", "procedure", "appointment", "observation", "allergy", "condition"))
def identity_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The identity hash of every record of every type, and the key of a family's third row."""
    out = None
    for t in identity.COMPARED:
        base = identity.dedup_base(t, DICTIONARY)
        own = view(spark, sf_dir, t).select(F.lit(t).alias("record_type"), F.col(f"{t}_id").alias("record_id"), base.alias("dedup_base")).withColumn("third_key", identity.occurrence_key(F.col("dedup_base"), F.lit(2)))
        out = own if out is None else out.unionByName(own)
    return out


@query(sql.with_views("""SELECT observation_id, value_num, unit, CASE WHEN unit = 'lbs' THEN 'lb' WHEN unit = 'kg' THEN 'kg' END AS canonical, CASE WHEN unit IS NOT NULL THEN 'mass' END AS dimension,
  round(CASE unit WHEN 'lbs' THEN value_num * 0.45359237 WHEN 'kg' THEN value_num END, 6) AS in_kg, round(CASE unit WHEN 'lbs' THEN value_num WHEN 'kg' THEN value_num / 0.45359237 END, 6) AS in_lb, CAST(NULL AS DOUBLE) AS in_cm
  FROM observation""", "observation"))  # fmt: skip
def unit_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1-M6: spellings, dimensions, conversion within one dimension only."""
    v, u = F.col("value_num"), F.col("unit")
    made = [F.round(units.convert(v, u, F.lit(t)), 6).alias(f"in_{t}") for t in ("kg", "lb", "cm")]
    return view(spark, sf_dir, "observation").select("observation_id", "value_num", "unit", units.canonical_unit(u).alias("canonical"), units.dimension_of(units.canonical_unit(u)).alias("dimension"), *made)


# --- listings

_LAB_COLUMNS = ["lab_result_id", "person_id", "test_name", "value_num", "unit", "collected_at"]


@query(sql.with_views(f"SELECT {', '.join(_LAB_COLUMNS)} FROM lab_result WHERE {sql.norm('test_name')} = 'view' AND {sql.date_only('collected_at')} >= '2024-01-10'", "lab_result"))
def labs_by_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lab rows of one family of analytes since a day, for all persons."""
    return clinical.labs(catalog(spark, sf_dir), test="View", since="2024-01-10", dictionary=DICTIONARY).select(*_LAB_COLUMNS)


@query(sql.with_views(f"SELECT medication_id, person_id, name, started_on, ended_on, status FROM medication WHERE {sql.current_med('1998-06-01')}", "medication"))
def meds_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Courses that go on at a day."""
    return clinical.medications(catalog(spark, sf_dir), active=True, today="1998-06-01").select("medication_id", "person_id", "name", "started_on", "ended_on", "status")


_NUM = "CASE WHEN value_num = floor(value_num) THEN CAST(CAST(value_num AS BIGINT) AS VARCHAR) || '.0' ELSE CAST(value_num AS VARCHAR) END"
_VALUE = f"coalesce({_NUM}, value_text) || CASE WHEN coalesce(unit, '') <> '' THEN ' ' || unit ELSE '' END"
_RENEWAL = f"{sql.enum_token('status_reason')} IN ('reorder', 're-order', 'renewal', 'renewed')"
_TIMELINE = f"""
SELECT person_id, {sql.date_only('collected_at')} AS date, 'lab' AS type, trim(test_name || coalesce(' ' || {_VALUE}, '') || CASE WHEN coalesce(flag, '') <> '' THEN ' [' || flag || ']' ELSE '' END) AS summary, document_id, 'lab_result' AS record_type, lab_result_id AS record_id FROM lab_result
UNION ALL SELECT person_id, {sql.date_only('started_on')}, 'med-start', 'started ' || name || coalesce(' ' || dose, ''), document_id, 'medication', medication_id FROM medication
UNION ALL SELECT person_id, {sql.date_only('ended_on')}, CASE WHEN {_RENEWAL} THEN 'med-renewal' ELSE 'med-stop' END, CASE WHEN {_RENEWAL} THEN 'renewed ' || name || ' (authorization period ended)' ELSE 'stopped ' || name END, document_id, 'medication', medication_id FROM medication
UNION ALL SELECT person_id, {sql.date_only('performed_on')}, 'procedure', name || coalesce(' - ' || outcome, ''), document_id, 'procedure', procedure_id FROM procedure
UNION ALL SELECT person_id, {sql.date_only('scheduled_for')}, 'appointment', provider || coalesce(' ' || specialty, '') || CASE WHEN coalesce(nullif(reason, ''), summary, '') <> '' THEN ' - ' || coalesce(nullif(reason, ''), summary) ELSE '' END, document_id, 'appointment', appointment_id FROM appointment
UNION ALL SELECT person_id, {sql.date_only('observed_at')}, 'observation', trim(obs_type || coalesce(' ' || key, '') || coalesce(' = ' || {_VALUE}, '')), document_id, 'observation', observation_id FROM observation
UNION ALL SELECT person_id, {sql.date_only('onset_on')}, 'condition', name || ' (' || status || ')', document_id, 'condition', condition_id FROM condition WHERE {sql.enum_token('status')} <> 'family-history'
UNION ALL SELECT person_id, {sql.date_only('resolved_on')}, 'condition-resolved', 'resolved ' || name, document_id, 'condition', condition_id FROM condition WHERE {sql.enum_token('status')} <> 'family-history'
UNION ALL SELECT person_id, {sql.date_only('noted_on')}, 'allergy', substance || ' allergy', document_id, 'allergy', allergy_id FROM allergy"""
_ALL = ("lab_result", "medication", "procedure", "appointment", "observation", "condition", "allergy")


@query(sql.with_views(f"SELECT * FROM ({_TIMELINE}) WHERE date >= '1997'", *_ALL))
def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event stream of seven types since a year, for all persons."""
    found = clinical.timeline(catalog(spark, sf_dir), since="1997")
    return found.select("person_id", "date", "type", "summary", "document_id", "record_type", "record_id")


@query(sql.with_views(f"""
, points AS (
  SELECT person_id, 1 AS src, lab_result_id AS id, value_num AS value, unit, collected_at AS stamp, {sql.key_token('test_name')} AS token, {sql.norm('test_name')} AS family,
    coalesce(v_status IN ('superseded', 'erroneous-in-source', 'merged-into'), FALSE) AS hidden FROM lab_v WHERE value_num IS NOT NULL
), mine AS (SELECT *, token = 'view' AS hit, {sql.full_date('stamp')} AS day FROM points WHERE family = 'view'),
live AS (SELECT *, max(stamp) OVER (PARTITION BY person_id) AS last_at FROM mine WHERE hit AND NOT hidden),
stats AS (SELECT person_id, count(*) AS count, min(value) AS min, max(value) AS max, arg_max(value, (stamp, id)) AS latest, max(stamp) AS latest_at, count(*) FILTER (WHERE stamp = last_at) AS latest_tie,
  CASE WHEN count(DISTINCT day) < 2 THEN NULL ELSE round(regr_slope(value, date_diff('day', DATE '1970-01-01', day)), 6) END AS slope, count(DISTINCT unit) AS n_units, min(unit) AS one_unit FROM live GROUP BY person_id),
others AS (SELECT person_id, count(*) FILTER (WHERE NOT hit) AS other_assay_count, array_to_string(list_sort(list_distinct(list(token) FILTER (WHERE NOT hit))), ',') AS other_assays, count(*) FILTER (WHERE hit AND hidden) AS suppressed_count FROM mine GROUP BY person_id)
SELECT o.person_id, 'view' AS test, coalesce(s.count, 0) AS count, CASE WHEN n_units = 1 THEN one_unit WHEN n_units > 1 THEN 'mg/dL' END AS unit, s.min, s.max, latest, latest_at, coalesce(latest_tie, 0) AS latest_tie, slope AS slope_per_day,
  coalesce(other_assays, '') AS other_assays, other_assay_count, suppressed_count FROM others o LEFT JOIN stats s USING (person_id)""", "lab_result", "ruling", verdicts=True))  # fmt: skip
def trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of one analyte for all persons, after verdicts, with siblings disclosed."""
    found = clinical.trends(catalog(spark, sf_dir), "VIEW", dictionary=DICTIONARY)
    return found.select("person_id", "test", "count", "unit", "min", "max", "latest", "latest_at", "latest_tie", F.round("slope_per_day", 6).alias("slope_per_day"), F.array_join("other_assays", ",").alias("other_assays"), "other_assay_count", "suppressed_count")


@query(sql.with_views(f"""
, mine AS (SELECT o.*, p.unit AS pref FROM observation o LEFT JOIN person_unit_pref p USING (person_id)
  WHERE obs_type = 'vital' AND value_num IS NOT NULL AND {sql.key_token('o.key')} = 'rate view'),
shown AS (SELECT *, pref = 'lb' AND unit = 'kg' AS moved, CASE WHEN pref = 'lb' AND unit = 'kg' THEN round(value_num / 0.45359237, 2) ELSE value_num END AS value, CASE WHEN pref = 'lb' AND unit = 'kg' THEN 'lb' ELSE unit END AS u FROM mine)
SELECT person_id, count(*) AS count, round(min(value), 4) AS min, round(max(value), 4) AS max, round(arg_max(value, (coalesce(observed_at, ''), observation_id)), 4) AS latest,
  CASE WHEN max(pref) IS NOT NULL THEN 'lb' WHEN count(DISTINCT u) = 1 THEN min(u) END AS unit, count(*) FILTER (WHERE moved) AS converted_count FROM shown GROUP BY person_id""", "observation", "person_unit_pref"))  # fmt: skip
def trends_converted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vital in two units, in the unit that a person prefers."""
    found = clinical.trends(catalog(spark, sf_dir), "Rate View", dictionary=DICTIONARY)
    return found.where("count > 0").select("person_id", "count", F.round("min", 4).alias("min"), F.round("max", 4).alias("max"), F.round("latest", 4).alias("latest"), "unit", "converted_count")


# --- overlay and sections


@query(sql.with_views("SELECT lab_result_id, person_id, v_status AS status, v_note AS note, coalesce(v_status IN ('superseded', 'erroneous-in-source', 'merged-into'), FALSE) AS hidden FROM lab_v", "lab_result", "ruling", verdicts=True))
def labs_with_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts by row and by family over every lab row."""
    cat = catalog(spark, sf_dir)
    df = overlay.with_verdict(cat["lab_result"], cat, "lab_result")
    return df.select("lab_result_id", "person_id", F.col("_curation.status").alias("status"), F.col("_curation.note").alias("note"), overlay.is_appendix().alias("hidden"))


@query(sql.with_views("SELECT person_id, count(*) FILTER (WHERE v_status IN ('superseded', 'erroneous-in-source', 'merged-into')) AS hidden FROM lab_v GROUP BY person_id", "lab_result", "ruling", verdicts=True))
def hidden_labs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows verdicts hide."""
    cat = catalog(spark, sf_dir)
    return overlay.hidden_count(overlay.with_verdict(cat["lab_result"], cat, "lab_result"), "person_id")


@query(sql.with_views(f"""SELECT person_id, token, observation_id, value_num, unit, observed_at FROM (SELECT *, {sql.key_token('key')} AS token,
  row_number() OVER (PARTITION BY person_id, {sql.key_token('key')} ORDER BY {sql.norm_ts('observed_at')} DESC, observation_id DESC) AS k FROM observation WHERE obs_type = 'vital') WHERE k = 1""", "observation"))  # fmt: skip
def latest_vitals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest of each vital, by normalised time."""
    return sections.latest_vitals(catalog(spark, sf_dir), dictionary=DICTIONARY).select("person_id", "token", "observation_id", "value_num", "unit", "observed_at")


@query(sql.with_views(f"""
, mine AS (SELECT *, {sql.key_token('key')} AS token, {sql.norm_ts('observed_at')} AS ts FROM observation WHERE obs_type = 'symptom' AND ({sql.full_date('observed_at')} IS NULL OR {sql.full_date('observed_at')} >= DATE '2024-02-09' - 30))
SELECT person_id, token, count(*) AS reports, arg_max(key, (ts, observation_id)) AS label, arg_max(observation_id, (ts, observation_id)) FILTER (WHERE value_num <> 0) AS latest_id, arg_max(observation_id, (ts, observation_id)) FILTER (WHERE value_num = 0) AS resolved_id
FROM mine GROUP BY person_id, token""", "observation"))  # fmt: skip
def symptoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of symptoms in a month."""
    found = sections.symptoms(catalog(spark, sf_dir), "2024-02-09", dictionary=DICTIONARY)
    return found.select("person_id", "token", "reports", "label", F.col("latest.observation_id").alias("latest_id"), F.col("resolved.observation_id").alias("resolved_id"))


@query(sql.with_views(f"SELECT person_id, lab_result_id, test_name, collected_at FROM (SELECT *, row_number() OVER (PARTITION BY person_id, test_name ORDER BY collected_at DESC NULLS LAST, lab_result_id DESC) AS k FROM lab_live WHERE {sql.ABNORMAL}) WHERE k = 1 OR {sql.full_date('collected_at')} IS NULL OR {sql.full_date('collected_at')} >= DATE '2024-01-25'", "lab_result", "ruling", verdicts=True))
def abnormal_labs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Abnormal labs of a year, older ones only as the first of their spelling."""
    return sections.abnormal_labs(catalog(spark, sf_dir), "2025-01-25").select("person_id", "lab_result_id", "test_name", "collected_at")


@query(sql.with_views(f"SELECT person_id, lab_result_id, k::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY collected_at DESC NULLS LAST, NOT {sql.ABNORMAL}, test_name NULLS FIRST, lab_result_id DESC) AS k FROM lab_live) WHERE k <= 10", "lab_result", "ruling", verdicts=True))
def recent_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each person's newest labs, abnormal ones first within a draw (a top-k report)."""
    return sections.recent_draws(catalog(spark, sf_dir)).select("person_id", "lab_result_id", "rank")


_ORDER_TOKENS = sql.key_token("part")


@query(sql.with_views(f"""
, mine AS (SELECT *, {sql.norm_ts('observed_at')} AS ts, {sql.full_date('observed_at')} AS day, {sql.key_token('key')} AS token FROM observation WHERE obs_type = 'order'),
ranked AS (SELECT *, row_number() OVER (PARTITION BY person_id, token ORDER BY ts DESC, observation_id DESC) AS k, count(*) OVER (PARTITION BY person_id, token) AS group_count FROM mine),
firsts AS (SELECT person_id, token, min(nullif({sql.date_only('observed_at')}, '')) FILTER (WHERE k > 1) AS group_first FROM ranked GROUP BY 1, 2),
top AS (SELECT * FROM ranked WHERE k = 1),
have AS (SELECT DISTINCT person_id, {sql.key_token('test_name')} AS token, {sql.full_date('collected_at')} AS day FROM lab_live),
parts AS (SELECT observation_id, person_id, day, CASE WHEN contains(p, ',') THEN p ELSE p END AS raw, unnest(string_split(p, ',')) AS part FROM (SELECT *, key AS p FROM top)),
tokens AS (SELECT observation_id, person_id, day, {sql.key_token("trim(replace(part, ' Panel', CASE WHEN contains(raw, ',') THEN '' ELSE ' Panel' END))")} AS token FROM parts),
state AS (SELECT t.observation_id, bool_and(EXISTS (SELECT 1 FROM have h WHERE h.person_id = t.person_id AND h.token = t.token AND date_diff('day', t.day, h.day) BETWEEN -1 AND 30)) AS done FROM tokens t GROUP BY 1)
SELECT t.person_id, t.observation_id, t.group_count, f.group_first FROM top t JOIN firsts f USING (person_id, token) JOIN state s USING (observation_id) WHERE t.day IS NULL OR NOT s.done""", "observation", "lab_result", "ruling", verdicts=True))  # fmt: skip
def open_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest order of each kind that neither it nor all its components have a result for."""
    return sections.open_orders(catalog(spark, sf_dir), dictionary=DICTIONARY).select("person_id", "observation_id", "group_count", "group_first")


@query(sql.with_views(f"SELECT person_id, condition_id, name FROM condition WHERE {sql.enum_token('status')} IN ('resolved', 'history')", "condition"))
def past_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditions by status token."""
    return sections.conditions(catalog(spark, sf_dir), ("resolved", "history")).select("person_id", "condition_id", "name")


@query(sql.with_views(f"SELECT person_id, allergy_id, (row_number() OVER (PARTITION BY person_id ORDER BY {sql.enum_token('criticality')} <> 'high', substance, allergy_id))::INT AS place FROM allergy", "allergy"))
def allergies_by_criticality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """High criticality first."""
    from pyspark.sql import Window

    w = Window.partitionBy("person_id").orderBy(text.enum_token(F.col("criticality")) != "high", "substance", "allergy_id")
    return sections.allergies(catalog(spark, sf_dir)).select("person_id", "allergy_id", F.row_number().over(w).alias("place"))


@query(sql.with_views("SELECT person_id, procedure_id, name, regexp_matches(name, '(^|[^a-z0-9])(proc ro|proc af)($|[^a-z0-9])', 'i') AS routine FROM procedure", "procedure"))
def procedures_routine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Procedures with the routine ones marked."""
    return sections.procedures(catalog(spark, sf_dir), routine=("proc ro", "proc af")).select("person_id", "procedure_id", "name", "routine")


@query(sql.with_views(f"SELECT person_id, appointment_id, scheduled_for FROM appointment WHERE ({sql.date_only('scheduled_for')} <> '' AND {sql.date_only('scheduled_for')} >= '2024-05-01') OR coalesce(trim(summary), '') = ''", "appointment"))
def open_appointments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Appointments to come or without a summary."""
    return sections.open_appointments(catalog(spark, sf_dir), "2024-05-01").select("person_id", "appointment_id", "scheduled_for")


@query(sql.with_views("SELECT person_id, " + ", ".join(f"coalesce(sum(n) FILTER (WHERE t = '{t}'), 0)::BIGINT AS {t}" for t in identity.COMPARED) + " FROM (" + " UNION ALL ".join(f"SELECT person_id, '{t}' AS t, count(*) AS n FROM {t} GROUP BY 1" for t in identity.COMPARED) + ") GROUP BY person_id", *_ALL))
def row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each type by person."""
    return sections.row_counts(catalog(spark, sf_dir))


@query(sql.with_views(f"SELECT person_id, {sql.norm('name')} AS token, CASE WHEN {sql.enum_token('status')} = 'family-history' THEN 'family:' || {sql.norm('relation')} ELSE 'self' END AS subject, count(*) FILTER (WHERE coalesce(onset_on, '') <> '') AS dated, count(*) FILTER (WHERE coalesce(onset_on, '') = '') AS undated FROM condition GROUP BY ALL HAVING dated > 0 AND undated > 0", "condition"))
def conditions_dated_and_not(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditions that appear with and without an onset."""
    return sections.undated_beside_dated(catalog(spark, sf_dir), DICTIONARY)


# --- logs


@query(sql.with_views("""SELECT host, count(*) AS samples, count(*) FILTER (WHERE lost) AS lost, round(100.0 * count(*) FILTER (WHERE lost) / count(*), 2) AS loss_pct, min(v) AS min_ms, quantile_disc(v, 0.5) AS median_ms,
  quantile_disc(v, 0.95) AS p95_ms, quantile_disc(v, 0.99) AS p99_ms, max(v) AS max_ms FROM (SELECT *, CASE WHEN NOT lost THEN ms END AS v FROM sample) GROUP BY host""", "sample"))  # fmt: skip
def ping_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loss and nearest-rank percentiles by host."""
    df = view(spark, sf_dir, "sample").withColumn("ms", F.when(~F.col("lost"), F.col("ms")))
    return diagnostics.ping_summary(df, "host")


@query(sql.with_views("""SELECT host, min(ts) AS start, count(*) AS losses FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY ts, sample_id) - row_number() OVER (PARTITION BY host, lost ORDER BY ts, sample_id) AS island FROM sample)
  WHERE lost GROUP BY host, island HAVING count(*) >= 2""", "sample"))  # fmt: skip
def loss_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of losses by host."""
    return diagnostics.loss_bursts(view(spark, sf_dir, "sample"), "host", order=("ts", "sample_id"))


@query(sql.with_views("""SELECT m.sample_id AS marker_id, count(s.sample_id) AS samples, count(*) FILTER (WHERE s.lost) AS lost, round(coalesce(100.0 * count(*) FILTER (WHERE s.lost) / nullif(count(s.sample_id), 0), 0), 1) AS loss_pct,
  quantile_disc(s.ms, 0.95) AS p95_ms, max(s.ms) AS max_ms FROM sample m LEFT JOIN sample s ON abs(epoch_us(s.ts) - epoch_us(m.ts)) <= 1800 * 1000000 WHERE m.marker GROUP BY m.sample_id""", "sample"))  # fmt: skip
def stall_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples within half an hour of each marker."""
    df = view(spark, sf_dir, "sample")
    markers = df.where("marker").select(F.col("sample_id").alias("marker_id"), F.col("ts").alias("marker_ts"))
    return diagnostics.stall_windows(markers, df.select("ts", "ms", "lost"), 1800).drop("marker_ts")


@query(sql.with_views("""SELECT event_type AS counter, count(*) AS n, round(avg(value), 6) AS mean, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99, max(value) AS max, arg_max(ts, (value, -epoch_us(ts))) AS max_at FROM events GROUP BY 1""", "sample"))
def counter_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of each counter."""
    df = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", F.col("event_type").alias("counter"), "value")
    return diagnostics.counter_stats(df).withColumn("mean", F.round("mean", 6))


@query(sql.with_views("""SELECT marker_id, counter, window_max, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY marker_id ORDER BY window_max / greatest(run_p95, 1e-9) DESC, counter) AS rank FROM (
  SELECT m.sample_id AS marker_id, e.event_type AS counter, max(e.value) AS window_max FROM sample m JOIN events e ON abs(epoch_us(e.ts) - epoch_us(m.ts)) <= 1800 * 1000000 WHERE m.marker GROUP BY 1, 2)
  JOIN (SELECT event_type AS counter, quantile_disc(value, 0.95) AS run_p95 FROM events GROUP BY 1) USING (counter)) WHERE rank <= 3""", "sample"))  # fmt: skip
def counters_at_stalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counters that stand out most at each marker (a top-k report)."""
    markers = view(spark, sf_dir, "sample").where("marker").select(F.col("sample_id").alias("marker_id"), F.col("ts").alias("marker_ts"))
    values = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", F.col("event_type").alias("counter"), "value")
    return diagnostics.counters_at_stalls(markers, values, 1800, top=3).select("marker_id", "counter", "window_max", "rank")


@query(sql.with_views("SELECT sample_id, ts, ms FROM sample ORDER BY ms DESC, ts LIMIT 10", "sample"))
def worst_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten worst samples (a top-k report)."""
    return diagnostics.worst(view(spark, sf_dir, "sample")).select("sample_id", "ts", "ms")


# --- search and line scans

_TEXTS = """texts AS (SELECT 'document' AS source_table, document_id AS source_id, person_id, coalesce(ocr_text, '') AS text FROM document
UNION ALL SELECT 'lab_result', lab_result_id, person_id, coalesce(test_name, '') FROM lab_result UNION ALL SELECT 'medication', medication_id, person_id, coalesce(name, '') FROM medication
UNION ALL SELECT 'procedure', procedure_id, person_id, coalesce(name, '') FROM procedure UNION ALL SELECT 'appointment', appointment_id, person_id, coalesce(reason, '') || ' ' || coalesce(summary, '') FROM appointment
UNION ALL SELECT 'observation', observation_id, person_id, coalesce(key, '') || ' ' || coalesce(value_text, '') FROM observation UNION ALL SELECT 'allergy', allergy_id, person_id, coalesce(substance, '') || ' ' || coalesce(reaction, '') FROM allergy
UNION ALL SELECT 'condition', condition_id, person_id, coalesce(name, '') || ' ' || coalesce(note, '') FROM condition)"""


@query(sql.with_views(", " + _TEXTS + """, cut AS (SELECT *, regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}]+') AS t FROM texts),
counted AS (SELECT *, len(list_filter(t, lambda x: x = 'reouha')) AS a, len(list_filter(t, lambda x: x = 'the')) AS b, len(t) AS n FROM cut),
stats AS (SELECT count(*) AS total, avg(n) AS av, count(*) FILTER (WHERE a > 0) AS da, count(*) FILTER (WHERE b > 0) AS db FROM counted)
SELECT source_table, source_id, c.person_id, round(-(greatest(1e-6, ln((total - da + 0.5) / (da + 0.5))) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * n / av)) + greatest(1e-6, ln((total - db + 0.5) / (db + 0.5))) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * n / av))), 6) AS rank
FROM counted c, stats JOIN person p ON p.person_id = c.person_id WHERE a > 0 AND b > 0""", "document", *_ALL, "person"))  # fmt: skip
def find(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 over all records for two words."""
    return search.find(catalog(spark, sf_dir), "Reoúha the", snippets=False).select("source_table", "source_id", "person_id", F.round("rank", 6).alias("rank"))


#: Given names that the line scan looks for here, lower case.
GIVEN_NAMES = (
    "alice", "andrew", "anna", "brian", "carol", "daniel", "david", "emma", "george", "helen", "james", "jane",
    "jennifer", "john", "karen", "laura", "linda", "maria", "michael", "patricia", "robert", "sarah", "thomas", "william",
)


def _scan_rule(rule: str, pattern: str, where: str = "TRUE", group: int = 1, content: str = "content") -> str:
    return f"SELECT doc_id, line, '{rule}' AS rule, m AS match, person_doc FROM (SELECT doc_id, line, person_doc, unnest(regexp_extract_all({content}, '{pattern}', {group})) AS m FROM kept) WHERE {where}"


_SURNAMES = "(" + ", ".join(f"'{n}'" for n in piiscan.SURNAMES) + ")"
_SLUGS = "(" + ", ".join(f"'{n}'" for n in piiscan.SLUGS) + ")"
_GIVEN = "(" + ", ".join(f"'{n}'" for n in GIVEN_NAMES) + ")"
_LINES = "string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10))"
#: Characters beside which a slug may stand are doubled, so that slugs that follow one another have one each.
_APART = "regexp_replace(content, '([^A-Za-z0-9_./-])', '\\1\\1', 'g')"
_NHS = "regexp_replace(m, '[^0-9]', '', 'g')"
_NHS_SUM = " + ".join(f"CAST(substr({_NHS}, {k + 1}, 1) AS INT) * {10 - k}" for k in range(9))


@query(f"""WITH lines AS (SELECT doc_id, unnest({_LINES}) AS content, generate_subscripts({_LINES}, 1) AS line, regexp_matches(text, '\\b(patient|person|roster|medication|meds|dob|repro|owner|family|slug|ingest|misfil|archive|record|chart|encounter)', 'i') AS person_doc FROM documents),
kept AS (SELECT * REPLACE (regexp_replace(content, '\\\\[nrt]', '  ', 'g') AS content) FROM lines WHERE NOT contains(content, 'pii-allow')), found AS (
{_scan_rule('card', r'\b((?:4\d{3}|5[1-5]\d{2}|3[47]\d{2}|6011)[ -]?\d{4}[ -]?\d{4}[ -]?\d{2,4})\b')}
UNION ALL {_scan_rule('ssn', r'\b(\d{3}-\d{2}-\d{4})\b')}
UNION ALL {_scan_rule('mrn', r'(?i)\b(MRN\s*[:=#]\s*[0-9]{4,12})\b')}
UNION ALL {_scan_rule('dob', r'(?i)\b(?:DOB|D\.O\.B\.?|date of birth|birth ?date)\b\s*[:=]?\s*(\d{4}-\d{1,2}-\d{1,2}|\d{1,2}[/-]\d{1,2}[/-]\d{4})')}
UNION ALL {_scan_rule('nhs', r'(?i)\bNHS(?:\s*(?:number|no\.?))?\s*[:=#]?\s*(\d{3}[ -]?\d{3}[ -]?\d{4})\b', f"(11 - ({_NHS_SUM}) % 11) % 11 = CAST(substr({_NHS}, 10, 1) AS INT)")}
UNION ALL {_scan_rule('patient-name', r"(Patient(?:\s+Name)?\s*:\s*[A-Za-z''-]{2,20}\s*[,^]\s*[A-Za-z''-]{2,20})", f"lower(regexp_extract(m, ':\\s*([A-Za-z''-]{{2,20}})', 1)) NOT IN {_SURNAMES}")}
UNION ALL {_scan_rule('full-name', r'\b([A-Z][a-z]{2,14}(?:\s+[A-Z][a-z]{2,14}){1,3})\b', f"person_doc AND lower(regexp_extract(m, '^[A-Za-z]+')) IN {_GIVEN} AND NOT list_has_any(string_split_regex(lower(m), '\\s+'), list_value{_SURNAMES})")}
UNION ALL {_scan_rule('bare-slug', r'(?:^|[^/._A-Za-z0-9])([a-z]{3,15}-[a-z]{3,15})(?:$|[^./A-Za-z0-9_])', f"m NOT IN {_SLUGS} AND split_part(m, '-', 2) NOT IN {_SURNAMES} AND split_part(m, '-', 1) IN {_GIVEN}", content=_APART)}
) SELECT doc_id, line::INT AS line, rule, match FROM found""")  # fmt: skip
def line_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of all nine rules in the lines of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return piiscan.scan(docs, spark.createDataFrame([(n,) for n in GIVEN_NAMES], "name string")).select("doc_id", "line", "rule", "match")


# --- write path


@query(sql.with_views(f"""
, now AS (SELECT *, {sql.hashed("person_id", sql.key_token("test_name", {}), sql.date_only("collected_at"))} AS new_base FROM lab_result),
first AS (SELECT *, first_value(lab_result_id) OVER (PARTITION BY new_base ORDER BY lab_result_id) AS clash_id FROM now)
SELECT f.lab_result_id AS row_id, f.clash_id, CASE WHEN c.value_num IS NOT DISTINCT FROM f.value_num AND c.value_text IS NOT DISTINCT FROM f.value_text AND lower(trim(coalesce(c.unit, ''))) = lower(trim(coalesce(f.unit, '')))
  AND c.ref_low IS NOT DISTINCT FROM f.ref_low AND c.ref_high IS NOT DISTINCT FROM f.ref_high AND c.flag IS NOT DISTINCT FROM f.flag THEN 'doubled' ELSE 'fused' END AS kind
FROM first f JOIN lab_result c ON c.lab_result_id = f.clash_id WHERE f.lab_result_id <> f.clash_id""", "lab_result"))  # fmt: skip
def rekey_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that another row of the same new identity came before."""
    return commit.collisions(catalog(spark, sf_dir), "lab_result", {}).select("row_id", "clash_id", "kind")


@query(sql.with_views("SELECT record_type, dedup_base, record_id, status, v.note FROM (SELECT 'lab_result' AS record_type, dedup_base, ruled_id AS record_id, status, note FROM ruled WHERE NOT family UNION ALL SELECT 'lab_result', dedup_base, 0, status, note FROM family_v) v", "lab_result", "ruling", verdicts=True))
def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All verdicts, by row and by family."""
    return catalog(spark, sf_dir)["curation"].select("record_type", "dedup_base", "record_id", "status", "note")


@query(sql.with_views("""SELECT dedup_base, arg_min(person_id, lab_result_id) AS owner, arg_min(test_name, lab_result_id) AS label, count(*) AS family_size FROM (SELECT l.*, k.dedup_base FROM lab_result l JOIN keyed k USING (lab_result_id)) GROUP BY dedup_base""", "lab_result", "ruling", verdicts=True))
def lab_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families with owner, label and size."""
    return registryops.families(catalog(spark, sf_dir)).where("record_type = 'lab_result'").select("dedup_base", "owner", "label", "family_size")


@query(sql.with_views("""
, left_over AS (SELECT k.* FROM keyed k JOIN lab_result l USING (lab_result_id) WHERE l.flag IS DISTINCT FROM 'H')
SELECT 'row is gone' AS problem, 'lab_result' AS record_type, ruled_id AS record_id, dedup_base FROM ruled WHERE NOT family AND ruled_id IN (SELECT lab_result_id FROM lab_result WHERE flag = 'H')
UNION ALL SELECT 'no-live-family', 'lab_result', 0, dedup_base FROM family_v WHERE dedup_base NOT IN (SELECT dedup_base FROM left_over)""", "lab_result", "ruling", verdicts=True))  # fmt: skip
def curation_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts that point at nothing once all labs that are flagged high are gone."""
    cat = catalog(spark, sf_dir)
    return registryops.curation_problems(cat.with_tables(lab_result=cat["lab_result"].where("NOT coalesce(flag = 'H', false)")))


@query(sql.with_views("SELECT medication_id, status FROM medication WHERE status IS NOT NULL AND lower(trim(status)) NOT IN ('', 'completed', 'stopped', 'discontinued', 'active')", "medication"))
def odd_medication_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statuses that are no state of a course."""
    return sections.odd_statuses(catalog(spark, sf_dir)).select("medication_id", "status")


# --- documents


@query(sql.with_views("""SELECT d.document_id, p.slug, length(coalesce(ocr_text, '')) > 0 AS has_ocr_text, coalesce(l.n, 0) AS labs, coalesce(m.n, 0) AS meds FROM document d LEFT JOIN person p USING (person_id)
  LEFT JOIN (SELECT document_id, count(*) AS n FROM lab_result GROUP BY 1) l USING (document_id) LEFT JOIN (SELECT document_id, count(*) AS n FROM medication GROUP BY 1) m USING (document_id)""", "document", "person", "lab_result", "medication"))  # fmt: skip
def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with owner and row counts."""
    return registryops.documents(catalog(spark, sf_dir)).select("document_id", "slug", "has_ocr_text", F.col("lab_result").alias("labs"), F.col("medication").alias("meds"))


@query(sql.with_views("SELECT document_id FROM document WHERE trim(coalesce(ocr_text, '')) = ''", "document"))
def documents_without_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that have nothing to search."""
    return registryops.without_text(catalog(spark, sf_dir)).select("document_id")


@query("SELECT sha256(text) AS sha256, min(doc_id) AS first_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def duplicate_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of equal content, by hash."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text IS NOT NULL").select("doc_id", F.sha2("text", 256).alias("sha256"))
    return docs.groupBy("sha256").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")).where("copies > 1")


@query(sql.with_views("""SELECT p.person_id AS document_id, CASE p.person_id % 4 WHEN 0 THEN 'match' WHEN 1 THEN CASE WHEN o.slug IS NULL THEN 'unverified' ELSE 'mismatch' END WHEN 2 THEN 'suspect' ELSE 'unverified' END AS verdict,
  CASE p.person_id % 4 WHEN 0 THEN p.slug WHEN 1 THEN o.slug END AS matched_slug FROM person p LEFT JOIN person o ON o.person_id = p.person_id + 1""", "person"))  # fmt: skip
def owner_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters about their person, the next one, a patient without name, or nobody."""
    cat = catalog(spark, sf_dir)
    k, name = F.col("person_id"), F.col("full_name")
    other = F.concat(F.lit("Customer#"), F.lpad((k + 1).cast("string"), 9, "0"))
    letter = F.when(k % 4 == 0, F.concat(F.lit("A note on "), name, F.lit("."))).when(k % 4 == 1, F.concat(F.lit("Seen today, "), other)).when(k % 4 == 2, F.lit("Patient: see the other page")).otherwise(F.lit("Nothing to report"))
    docs = cat["person"].select(k.alias("document_id"), k, letter.alias("text"))
    return ingest.owner_checks(docs, cat["person"]).select("document_id", "verdict", "matched_slug")


@query()
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of all pages."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", decoders.html_to_text("html").alias("text"))


# --- rendered documents


@query()
def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B1: the summary of every person."""
    return render.summaries(catalog(spark, sf_dir), TODAY, TODAY, DICTIONARY, routine=("proc ro",))


@query()
def briefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B2: the brief of every appointment."""
    return render.briefs(catalog(spark, sf_dir), TODAY, TODAY, DICTIONARY)


@query()
def journals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The journal of every person."""
    return render.journals(catalog(spark, sf_dir), TODAY)


@query(sql.with_views("""SELECT person_id, status AS heading, note, count(*) AS verdicts, sum(CASE WHEN rid > 0 THEN 1 ELSE n END)::BIGINT AS rows FROM (
  SELECT l.person_id, r.status, r.note, r.ruled_id AS rid, 1 AS n FROM ruled r JOIN lab_result l ON l.lab_result_id = r.ruled_id WHERE NOT family
  UNION ALL SELECT k.person_id, f.status, f.note, 0, k.n FROM family_v f JOIN (SELECT dedup_base, arg_min(person_id, lab_result_id) AS person_id, count(*) AS n FROM (SELECT l.person_id, k.* FROM lab_result l JOIN keyed k USING (lab_result_id)) GROUP BY 1) k USING (dedup_base))
  WHERE status IN ('superseded', 'erroneous-in-source', 'merged-into') GROUP BY 1, 2, 3""", "lab_result", "ruling", verdicts=True))  # fmt: skip
def curation_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rulings by person."""
    return render.curation_groups(catalog(spark, sf_dir)).select("person_id", "heading", "note", "verdicts", "rows")


@query()
def curation_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The curation record of every person that has one."""
    return render.curations(catalog(spark, sf_dir), TODAY)


# --- small ones


@query("""WITH s AS (SELECT CAST(event_id AS VARCHAR) AS name, ts, CAST(ts AS DATE) AS d FROM events), ranked AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY ts DESC, name DESC) AS k FROM s),
daily AS (SELECT name FROM ranked WHERE k = 1 ORDER BY ts DESC LIMIT 7), rest AS (SELECT * FROM s WHERE name NOT IN (SELECT name FROM daily)),
weekly AS (SELECT name FROM (SELECT *, row_number() OVER (PARTITION BY isoyear(d), weekofyear(d) ORDER BY ts DESC, name DESC) AS k FROM rest) WHERE k = 1 ORDER BY ts DESC LIMIT 4)
SELECT name, ts, name IN (SELECT name FROM daily) OR name IN (SELECT name FROM weekly) AS keep FROM s""")  # fmt: skip
def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which snapshots stay, where every event counts as one."""
    df = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").cast("string").alias("name"), "ts")
    return snapshots.retained(df)


@query(sql.with_views(f"""SELECT lab_result_id, CASE WHEN ref_low IS NOT NULL AND ref_high IS NOT NULL THEN '  (ref 10.0-120.0)' WHEN ref_high IS NOT NULL THEN '  (ref <= 120.0)' WHEN ref_low IS NOT NULL THEN '  (ref >= 10.0)' ELSE '' END AS ref_range,
  {sql.ABNORMAL} AS abnormal FROM lab_result""", "lab_result"))  # fmt: skip
def reference_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference ranges as text, and what is abnormal."""
    df = view(spark, sf_dir, "lab_result")
    return df.select("lab_result_id", render.reference_range(F.col("ref_low"), F.col("ref_high")).alias("ref_range"), sections.is_abnormal().alias("abnormal"))


_SHOWN = _TIMELINE.replace("FROM lab_result", "FROM lab_live").replace("FROM observation", "FROM observation WHERE obs_type NOT IN ('symptom', 'activity')")


@query(sql.with_views(f", events_ AS (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY date, type, record_id, document_id) AS place FROM ({_SHOWN}) WHERE date <> ''), firsts AS (SELECT person_id, document_id, min(place) AS first FROM events_ GROUP BY 1, 2) "
    "SELECT person_id, document_id, (row_number() OVER (PARTITION BY person_id ORDER BY first))::INT AS note_no FROM firsts", *_ALL, "ruling", verdicts=True))  # fmt: skip
def journal_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents numbered by first appearance in the journal of each person."""
    return render.footnotes(render.journal_events(catalog(spark, sf_dir)))


@query(sql.with_views(f", events_ AS (SELECT person_id, date FROM ({_SHOWN}) WHERE date <> '') SELECT person_id, date, count(*) AS events FROM events_ GROUP BY 1, 2", *_ALL, "ruling", verdicts=True))
def journal_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The date sections of each person's journal, counted by their headings."""
    df = render.journal_events(catalog(spark, sf_dir))
    found = df.groupBy("person_id", "date").agg(F.count("*").alias("events"), F.count_if("starts").alias("headings"))
    return found.where("headings = 1").select("person_id", "date", "events")


@query(sql.with_views("""SELECT person_id, slug, CASE WHEN d IS NULL THEN '' ELSE array_to_string(list_sort(list_distinct([strftime(d, '%Y-%m-%d'), strftime(d, '%m/%d/%Y'), strftime(d, '%-m/%-d/%Y'), strftime(d, '%m-%d-%Y'), strftime(d, '%B %-d, %Y'), strftime(d, '%-d %B %Y'), strftime(d, '%b %-d, %Y'), strftime(d, '%-d %b %Y')])), '|') END AS dobs,
  'customer ' || substr(full_name, 10) AS tokens FROM (SELECT *, CAST(dob AS DATE) AS d FROM person)""", "person"))  # fmt: skip
def person_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of names and spellings of birth dates."""
    df = registryops.people(catalog(spark, sf_dir))
    return df.select("person_id", "slug", F.array_join(F.array_sort(dates.dob_renderings(F.col("dob"))), "|").alias("dobs"), F.array_join(text.name_tokens(F.col("full_name")), " ").alias("tokens"))


@query(sql.with_views("SELECT medication_id, CASE name WHEN 'DRUG 1-URGENT' THEN 'Drug 1-Urgent' WHEN 'DRUG 2-HIGH' THEN 'Drug 2-High' WHEN 'DRUG 3-MEDIUM' THEN 'Drug 3-Medium' WHEN 'DRUG 4-NOT SPECIFIED' THEN 'Drug 4-Not Specified' WHEN 'DRUG 5-LOW' THEN 'Drug 5-Low' END AS shown FROM medication", "medication"))
def medication_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names for display."""
    return view(spark, sf_dir, "medication").select("medication_id", names.display_name("name").alias("shown"))


@query(sql.with_views("SELECT dedup_key, count(*) AS rows FROM (SELECT k.dedup_base AS dedup_key FROM keyed k) GROUP BY 1 HAVING count(*) > 1", "lab_result", "ruling", verdicts=True))
def doubled_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that more than one row holds."""
    return catalog(spark, sf_dir)["lab_result"].groupBy("dedup_key").agg(F.count("*").alias("rows")).where(F.col("rows") > 1)


from . import registry_sources, registry_texts, registry_verbs  # noqa: E402, F401  (they register their queries)
from . import registry_fronts, registry_index, registry_live, registry_more  # noqa: E402, F401
