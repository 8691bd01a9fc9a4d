"""Registered queries of the write path: commit, conflicts, rekeying, verbs on persons, documents, records and verdicts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import identity
from ..operators import commit, ingest, registryops
from ..specs import COMPARED, FIELDS, NUMBER, SPARSE, TIME, TYPES
from . import catalog as snapshots
from . import sql
from .bridge import DICTIONARY, catalog, view, whole
from .registry import _ALL, query
from .scratch import fresh_dir, written

NOW = dt.datetime(2024, 2, 1, tzinfo=dt.timezone.utc)
STAMP = "2024-02-01T00:00:00+00:00"
DENSE = tuple(t for t in TYPES if t not in SPARSE)

#: What identifies a row of each type, as SQL: a person besides.
PARTS = {
    "lab_result": lambda d: (sql.key_token("test_name", d), sql.date_only("collected_at")),
    "medication": lambda d: (sql.norm("name", d), f"coalesce({sql.collapse('dose')}, '')", sql.date_only("started_on")),
    "procedure": lambda d: (sql.norm("name", d), sql.date_only("performed_on")),
    "appointment": lambda d: (sql.norm("provider", d), sql.date_only("scheduled_for")),
    "observation": lambda d: (sql.norm("obs_type", d), sql.norm_ts("observed_at"), sql.key_token("key", d)),
    "allergy": lambda d: (sql.norm("substance", d),),
    "condition": lambda d: (sql.norm("name", d), f"CASE WHEN {sql.enum_token('status')} = 'family-history' THEN 'family:' || {sql.norm('relation', d)} ELSE 'self' END || CASE WHEN {sql.date_only('onset_on')} <> '' THEN '@' || {sql.date_only('onset_on')} ELSE '' END"),
}


def base_sql(t: str, dictionary=DICTIONARY, person: str = "person_id") -> str:
    return sql.hashed(person, *PARTS[t](dictionary))


def _columns(t: str) -> set[str]:
    """Payload fields that the view of a type has; the others are null."""
    from .bridge import VIEWS

    return {f for f in FIELDS[t] if f" AS {f}" in VIEWS[t]}


def _fields(t: str) -> list[str]:
    return [f for f in COMPARED[t] if f in _columns(t)]


# --- commit

#: What counts as stored already: rows of before a day.
BEFORE = {"lab_result": "2024-01-12", "medication": "1995-01-01", "procedure": "1995-06-17", "appointment": "2024-05-01", "observation": "2024-01-12"}


def _says(t: str, alias: str) -> str:
    return "concat_ws('|', " + ", ".join(f"coalesce(lower(trim(CAST({alias}.{f} AS VARCHAR))), '~')" if f == "unit" else f"coalesce(CAST({alias}.{f} AS VARCHAR), '~')" for f in _fields(t)) + ")"


def _commit_sql(t: str) -> str:
    pk = f"{t}_id"
    return f"""SELECT '{t}' AS record_type, r.{pk} AS pos,
  CASE WHEN h.head IS NULL THEN CASE WHEN r.{pk} = f.first THEN 'new' WHEN r.says = f.first_says THEN 'duplicate' ELSE 'conflict' END WHEN w.twin IS NOT NULL THEN 'duplicate' ELSE 'conflict' END AS outcome,
  CASE WHEN h.head IS NOT NULL THEN coalesce(w.twin, h.head) END AS target_id
FROM {t}_r r LEFT JOIN (SELECT b, min({pk}) AS head FROM {t}_r WHERE stored GROUP BY b) h USING (b) LEFT JOIN (SELECT b, says, min({pk}) AS twin FROM {t}_r WHERE stored GROUP BY b, says) w ON w.b = r.b AND w.says = r.says
JOIN (SELECT b, min({pk}) AS first, arg_min(says, {pk}) AS first_says FROM {t}_r GROUP BY b) f ON f.b = r.b"""


@query(sql.with_views(
    ", " + ", ".join(f"{t}_r AS (SELECT t.{t}_id, {base_sql(t)} AS b, {_says(t, 't')} AS says, {sql.date_only(TIME[t])} < '{BEFORE[t]}' AS stored FROM {t} t)" for t in DENSE) + " " + " UNION ALL ".join(map(_commit_sql, DENSE)), *DENSE,
))
def commit_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of five types submitted where those of before a day are stored: new, duplicate or conflict, and with which row."""
    cat, out = catalog(spark, sf_dir), None
    for t in DENSE:
        rows = cat[t]
        stored = rows.where(F.coalesce(F.split(F.replace(F.trim(TIME[t]), F.lit("T"), F.lit(" ")), " ")[0], F.lit("")) < BEFORE[t])
        found = commit.outcomes(stored, rows.withColumn("pos", F.col(f"{t}_id")), t).select(F.lit(t).alias("record_type"), "pos", "outcome", "target_id")
        out = found if out is None else out.unionByName(found)
    return out


@query(sql.with_views(f"""
, mine AS (SELECT *, {base_sql('allergy', person="CAST(person_id % 5 AS VARCHAR)")} AS b FROM allergy), stored AS (SELECT * FROM mine WHERE allergy_id IN (SELECT min(allergy_id) FROM mine WHERE reaction IS NOT NULL GROUP BY b)),
incoming AS (SELECT * FROM mine WHERE allergy_id IN (SELECT max(allergy_id) FROM mine GROUP BY b))
SELECT i.allergy_id AS pos, CASE WHEN s.allergy_id IS NULL THEN 'new'
  WHEN coalesce(s.reaction <> i.reaction, FALSE) OR coalesce(s.criticality <> i.criticality, FALSE) OR coalesce(s.noted_on <> i.noted_on, FALSE) THEN 'conflict'
  WHEN (s.reaction IS NULL AND i.reaction IS NOT NULL) OR (s.criticality IS NULL AND i.criticality IS NOT NULL) OR (s.noted_on IS NULL AND i.noted_on IS NOT NULL) THEN 'enriched' ELSE 'duplicate' END AS outcome, s.allergy_id AS target_id
FROM incoming i LEFT JOIN stored s USING (b)""", "allergy"))  # fmt: skip
def commit_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All persons' allergies as those of five households, the last of each substance submitted where the first with a reaction is stored."""
    allergies = whole(view(spark, sf_dir, "allergy").withColumn("person_id", F.col("person_id") % 5), "allergy")
    base = allergies.withColumn("dedup_base", identity.dedup_base("allergy", DICTIONARY)).withColumn("dedup_occurrence", F.lit(0))
    first = base.where("reaction IS NOT NULL").groupBy("dedup_base").agg(F.min("allergy_id").alias("allergy_id")).select("allergy_id")
    last = base.groupBy("dedup_base").agg(F.max("allergy_id").alias("allergy_id")).select("allergy_id")
    found = commit.outcomes(base.join(first, "allergy_id", "left_semi"), base.join(last, "allergy_id", "left_semi").withColumn("pos", F.col("allergy_id")), "allergy")
    return found.select("pos", "outcome", "target_id")


def _firsts(rows: DataFrame, t: str) -> DataFrame:
    """The first row of each identity, by id."""
    first = F.min(f"{t}_id").over(Window.partitionBy("dedup_base"))
    return rows.withColumn("first", first).where(F.col("first") == F.col(f"{t}_id")).drop("first")


def _after_commit(spark: SparkSession, sf_dir: str):
    """Medications of before a day stored, the first of each later identity submitted."""
    cat = catalog(spark, sf_dir)
    rows = cat["medication"].where("started_on >= '1995-06-17'")
    stored = cat["medication"].where("started_on < '1995-06-17'")
    incoming = _firsts(rows, "medication").select(F.col("medication_id").alias("pos"), "person_id", "document_id", *FIELDS["medication"])
    return commit.commit(cat.with_tables(medication=stored), "medication", incoming, DICTIONARY, NOW)


@query(sql.with_views(f""", med_r AS (SELECT *, {base_sql('medication')} AS b FROM medication),
fresh AS (SELECT * FROM med_r WHERE medication_id IN (SELECT min(medication_id) FROM med_r WHERE started_on >= '1995-06-17' GROUP BY b))
SELECT person_id, document_id, b AS dedup_base, count(*) AS rows, count(*) FILTER (WHERE src = 'new') AS added FROM (SELECT person_id, document_id, b, 'old' AS src FROM med_r WHERE started_on < '1995-06-17' UNION ALL SELECT person_id, document_id, b, 'new' FROM fresh) GROUP BY ALL""", "medication"))  # fmt: skip
def committed_medications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of medications after a submission, with new ids behind the old ones."""
    top = catalog(spark, sf_dir)["medication"].where("started_on < '1995-06-17'").agg(F.max("medication_id")).first()[0]
    after, _ = _after_commit(spark, sf_dir)
    return after["medication"].groupBy("person_id", "document_id", "dedup_base").agg(F.count("*").alias("rows"), F.count_if(F.col("medication_id") > top).alias("added"))


def _conflicted(spark: SparkSession, sf_dir: str):
    """Labs of before a day stored (the first of each identity), and all others of those identities as open conflicts."""
    cat = catalog(spark, sf_dir)
    rows = cat["lab_result"]
    stored = written(_firsts(rows, "lab_result"))
    staged = commit.plain_outcomes(stored, rows.withColumn("pos", F.col("lab_result_id")), "lab_result", "person_id", "document_id", *FIELDS["lab_result"]).where("outcome = 'conflict'")
    conflicts = staged.select(
        F.col("pos").alias("conflict_id"), F.lit("lab_result").alias("record_type"), F.col("dedup_base").alias("dedup_key"), "person_id", "document_id", "existing_json",
        F.to_json(F.struct(*FIELDS["lab_result"]), {"ignoreNullFields": "false"}).alias("incoming_json"), F.lit("open").alias("status"), F.lit(None).cast("string").alias("resolution"), F.lit(STAMP).alias("detected_at"), F.lit(None).cast("string").alias("resolved_at"),
    )
    return cat.with_tables(lab_result=stored, conflict=written(conflicts))


_CONFLICTS = f"""lab_r AS (SELECT *, {base_sql('lab_result')} AS b, {_says('lab_result', 'lab_result')} AS says FROM lab_result),
heads AS (SELECT b, min(lab_result_id) AS head, arg_min(says, lab_result_id) AS head_says, arg_min(document_id, lab_result_id) AS head_document FROM lab_r GROUP BY b),
open_c AS (SELECT r.*, h.head, h.head_document FROM lab_r r JOIN heads h USING (b) WHERE r.says <> h.head_says)"""


@query(sql.with_views(f", {_CONFLICTS} SELECT lab_result_id AS conflict_id, b AS base, 1::BIGINT AS size, head AS anchor_id FROM open_c", "lab_result"))
def conflict_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open conflicts with the family that they stand against, its size and its first row."""
    return commit.conflict_families(_conflicted(spark, sf_dir), "lab_result", DICTIONARY)


@query(sql.with_views(f", {_CONFLICTS}, pairs AS (SELECT document_id, lab_result_id AS c FROM open_c UNION SELECT head_document, lab_result_id FROM open_c) SELECT document_id, array_to_string(list_sort(list(c)), ',') AS conflicts FROM pairs WHERE document_id IS NOT NULL GROUP BY 1", "lab_result"))
def document_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open conflicts that cite a document or stand against one of its rows."""
    found = registryops.document_conflicts(_conflicted(spark, sf_dir))
    return found.select("document_id", F.array_join("conflict_ids", ",").alias("conflicts"))


@query(sql.with_views(f""", {_CONFLICTS}, ranked AS (SELECT *, row_number() OVER (ORDER BY lab_result_id) AS k FROM open_c WHERE head <> lab_result_id),
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY head ORDER BY lab_result_id) AS n FROM open_c) WHERE n = 1), four AS (SELECT *, row_number() OVER (ORDER BY lab_result_id) AS k FROM firsts)
SELECT h.lab_result_id, CASE WHEN f.k = 2 THEN f.value_num ELSE h.value_num END AS value_num, CASE WHEN f.k = 2 THEN f.flag ELSE h.flag END AS flag, CASE WHEN f.k = 2 THEN f.document_id ELSE h.document_id END AS document_id, 0 AS dedup_occurrence
FROM lab_r h JOIN heads ON heads.head = h.lab_result_id LEFT JOIN four f ON f.head = h.lab_result_id AND f.k = 2
UNION ALL SELECT (SELECT max(head) FROM heads) + 1, value_num, flag, document_id, 1 FROM four WHERE k = 3""", "lab_result"))  # fmt: skip
def resolved_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lab table after the first three disputed facts are settled: the existing row kept, the incoming one, both."""
    cat = _conflicted(spark, sf_dir)
    families = commit.conflict_families(cat, "lab_result", DICTIONARY).groupBy("anchor_id").agg(F.min("conflict_id").alias("c")).orderBy("c").limit(3).collect()  # three settled by hand
    for row, keep in zip(families, ("existing", "incoming", "both")):
        cat, _ = commit.resolve(cat, row["c"], keep, "seen", DICTIONARY, now=NOW)
    return cat["lab_result"].select("lab_result_id", "value_num", "flag", "document_id", "dedup_occurrence")


# --- rekeying


def _rekey_sql(t: str) -> str:
    pk = f"{t}_id"
    return f"""SELECT '{t}' AS record_type, {pk} AS row_id, old AS old_key, CASE WHEN k = 1 THEN new ELSE {sql.hashed('new', 'k - 1')} END AS new_key, new AS new_base, (k - 1)::INT AS new_occurrence
FROM (SELECT {pk}, {base_sql(t)} AS old, {base_sql(t, {})} AS new, row_number() OVER (PARTITION BY {base_sql(t, {})} ORDER BY {pk}) AS k FROM {t}) WHERE k > 1 OR new <> old"""


#: Types that are rekeyed, and those whose ids are unique in the driver's tables.
_KEYED, _UNIQUE = tuple(TYPES), tuple(t for t in TYPES if t != "procedure")


@query(sql.with_views(" UNION ALL ".join(map(_rekey_sql, _KEYED)), *_KEYED))
def rekey_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What moving all keys of all types to another dictionary changes, clashes queued behind their family."""
    return commit.rekey_plan(catalog(spark, sf_dir), {})[0].select("record_type", "row_id", "old_key", "new_key", "new_base", "new_occurrence")


@query(sql.with_views(f""", now AS (SELECT l.*, {base_sql('lab_result', {})} AS nb FROM lab_v l), ruled_now AS (SELECT *, CASE WHEN v_status IN ('merged-into', 'superseded') THEN 'merged' WHEN v_status = 'distinct' THEN 'distinct' END AS ruling, first_value(lab_result_id) OVER (PARTITION BY nb ORDER BY lab_result_id) AS head FROM now)
SELECT a.lab_result_id AS row_id, a.head AS clash_id, CASE WHEN a.ruling IS NOT NULL AND b.ruling IS NOT NULL AND a.ruling <> b.ruling THEN 'contradictory' ELSE coalesce(a.ruling, b.ruling) END AS settlement FROM ruled_now a JOIN ruled_now b ON b.lab_result_id = a.head WHERE a.lab_result_id <> a.head""", "lab_result", "ruling", verdicts=True))  # fmt: skip
def rekey_settlements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which clashes of labs verdicts settle."""
    return commit.collisions(catalog(spark, sf_dir), "lab_result", {}).select("row_id", "clash_id", "settlement")


@query(sql.with_views("""
, used AS (SELECT dedup_base, status, note FROM family_v WHERE status = 'superseded'),
made AS (SELECT u.status, u.note, k.lab_result_id AS record_id FROM used u JOIN keyed k USING (dedup_base) WHERE k.lab_result_id NOT IN (SELECT ruled_id FROM row_v))
SELECT record_id, status, note FROM made UNION ALL SELECT ruled_id, status, note FROM row_v UNION ALL SELECT 0, status, note FROM family_v WHERE status <> 'superseded'""", "lab_result", "ruling", verdicts=True))  # fmt: skip
def narrowed_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Family verdicts that settle a clash become verdicts on the rows that they covered, where every row has clashed."""
    cat = catalog(spark, sf_dir)
    labs = cat["lab_result"]
    clashes = labs.select(F.col("lab_result_id").alias("row_id"), F.col("lab_result_id").alias("clash_id"))
    return commit.narrowed(cat, cat["curation"], "lab_result", clashes, labs).select("record_id", "status", "note")


# --- persons, preferences


@query(sql.with_views("""SELECT person_id, slug, CASE slug WHEN 'p-1' THEN 'Renamed One' ELSE full_name END AS full_name, CASE WHEN slug = 'p-2' THEN NULL ELSE dob END AS dob, CASE slug WHEN 'p-1' THEN 'seen' END AS notes, CASE slug WHEN 'p-3' THEN '2024-02-01T00:00:00+00:00' END AS deactivated_at FROM person
UNION ALL SELECT max(person_id) + 1, 'p-new', 'New Person', '1990-01-02', NULL, NULL FROM person""", "person"))  # fmt: skip
def persons_edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persons after one is added, two edited, one deactivated, and one deactivated and back; one that has rows is not removed."""
    cat = catalog(spark, sf_dir)
    cat = registryops.add_person(cat, " P-New", "New Person", dob="1990-01-02")
    try:
        cat = registryops.remove_person(cat, "p-2")
    except registryops.RefusedError:
        pass
    cat = registryops.edit_person(registryops.edit_person(cat, "p-1", full_name="Renamed One", notes="seen"), "P-2", dob="")
    cat = registryops.deactivate_person(cat, "p-3", NOW)
    cat = registryops.deactivate_person(registryops.deactivate_person(cat, "p-4", NOW), "p-4", back=True)
    return cat["person"].select("person_id", "slug", "full_name", "dob", "notes", "deactivated_at")


@query(sql.with_views("""SELECT person_id, key, CASE WHEN person_id = 2 THEN 'kg' ELSE unit END AS unit FROM person_unit_pref WHERE person_id <> 4 UNION ALL SELECT 1, 'weight', 'lb'""", "person_unit_pref"))
def prefs_edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit preferences after one is replaced, one set and one cleared."""
    cat = registryops.set_pref(catalog(spark, sf_dir), "p-2", "Rate  View", "Kilograms", DICTIONARY, NOW)
    cat = registryops.clear_pref(registryops.set_pref(cat, "p-1", "Weight", " pounds", DICTIONARY, NOW), "p-4", "rate_view", DICTIONARY)
    return cat["person_unit_pref"].select("person_id", "key", "unit")


@query(sql.with_views(" UNION ALL ".join(f"SELECT DISTINCT person_id, '{t}' AS table_name FROM {t} WHERE person_id IS NOT NULL" for t in (*TYPES, "document", "person_unit_pref")), *_ALL, "document", "person_unit_pref"))
def dependents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What hangs on each person, and so keeps them from being removed."""
    return registryops.dependents(catalog(spark, sf_dir))


# --- documents and tombstones


def _hashed_documents(spark: SparkSession, sf_dir: str):
    cat = catalog(spark, sf_dir)
    return cat.with_tables(document=cat["document"].withColumn("sha256", F.sha2("ocr_text", 256)))


_LONE = "(SELECT min(first) FROM (SELECT min(document_id) AS first FROM document GROUP BY ocr_text HAVING count(*) = 1))"


def _lone(cat) -> int:
    """The first document whose content no other has."""
    return cat["document"].groupBy("sha256").agg(F.min("document_id").alias("d"), F.count("*").alias("n")).where("n = 1").agg(F.min("d")).first()[0]


@query(sql.with_views(" UNION ALL ".join([f"SELECT '{t}' AS table_name, count(*) AS rows, coalesce(sum({t}_id), 0)::BIGINT AS ids FROM {t} WHERE document_id IS DISTINCT FROM {_LONE}" for t in (*TYPES, "document")]
    + [f"SELECT 'curation', count(*), coalesce(sum(CASE WHEN family THEN 0 ELSE ruled_id END), 0)::BIGINT FROM (SELECT DISTINCT dedup_base, CASE WHEN family THEN 0 ELSE ruled_id END AS ruled_id, family FROM ruled WHERE family OR ruled_id NOT IN (SELECT lab_result_id FROM lab_result WHERE document_id = {_LONE}))"]), "document", *_ALL, "ruling", verdicts=True))
def document_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows, and which in sum, each table has after a document went with its rows and their verdicts."""
    cat = _hashed_documents(spark, sf_dir)
    cat, out = registryops.remove_document(cat, _lone(cat), now=NOW), None
    for t in (*TYPES, "document", "curation"):
        pk = "record_id" if t == "curation" else f"{t}_id"
        own = cat[t].agg(F.count("*").alias("rows"), F.coalesce(F.sum(pk), F.lit(0)).alias("ids")).withColumn("table_name", F.lit(t))
        out = own if out is None else out.unionByName(own)
    return out


@query(sql.with_views(f"""SELECT sha256(ocr_text) AS sha256, '{STAMP}' AS removed_at, 'asked' AS reason, document_id, CAST(NULL AS BIGINT) AS live_document_id FROM document WHERE document_id = {_LONE}
UNION ALL SELECT repeat('ab', 32), '{STAMP}', 'spam', NULL, NULL""", "document"))  # fmt: skip
def tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tombstones after a document was removed with one, two were added by hash, and one was lifted."""
    cat = _hashed_documents(spark, sf_dir)
    cat = registryops.remove_document(cat, _lone(cat), tombstone=True, reason="asked", now=NOW)
    cat = registryops.add_tombstone(registryops.add_tombstone(cat, " " + "AB" * 32, "spam", now=NOW), "cd" * 32, now=NOW)
    return registryops.tombstones(registryops.lift_tombstone(cat, "CD" * 32)).select("sha256", "removed_at", "reason", "document_id", "live_document_id")


@query(sql.with_views("SELECT sha256(ocr_text) AS sha256, max(document_id) AS document_id FROM document WHERE category = 'en' GROUP BY 1", "document"))
def lost_tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tombstones (one for each content in one language) that going back to a catalog without them would lose."""
    cat = _hashed_documents(spark, sf_dir)
    buried = cat["document"].where("category = 'en'").groupBy("sha256").agg(F.max("document_id").alias("document_id"))
    now = cat.with_tables(document_tombstone=whole(buried, "document_tombstone"))
    return snapshots.lost_tombstones(now, cat).select("sha256", "document_id")


@query(sql.with_views("""SELECT document_id, CASE document_id WHEN 5 THEN 'text by hand' ELSE ocr_text END = ocr_text AS same_text, CASE document_id WHEN 5 THEN 'manual' END AS text_source, CASE document_id WHEN 6 THEN '2020-02-29' WHEN 7 THEN NULL ELSE doc_date END AS doc_date, CASE document_id WHEN 6 THEN 'letter' ELSE category END AS category FROM document""", "document"))
def documents_edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents after one got a text by hand, one a date and a category, and one lost its date."""
    cat = catalog(spark, sf_dir)
    was = cat["document"].select("document_id", F.col("ocr_text").alias("was"))
    cat = registryops.edit_document(registryops.edit_document(registryops.set_text(cat, 5, "text by hand", force=True), 6, doc_date="2020-02-29", category="letter"), 7, doc_date="")
    return cat["document"].join(was, "document_id").select("document_id", (F.col("ocr_text") == F.col("was")).alias("same_text"), "text_source", "doc_date", "category")


@query(sql.with_views(", me AS (SELECT max(person_id) + 1 AS person_id FROM person) " + " UNION ALL ".join(f"SELECT '{t}' AS record_type, {t}_id AS record_id, (SELECT person_id FROM me) AS person_id, {base_sql(t, person='(SELECT person_id FROM me)')} AS dedup_base FROM {t} WHERE document_id = 11" for t in TYPES), "person", *_ALL))
def document_reassigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of a document that went to a person without rows, with new identities."""
    cat = registryops.add_person(catalog(spark, sf_dir), "p-new", "New Person")
    (cat, _), out = registryops.reassign(cat, 11, "p-new", DICTIONARY), None
    for t in TYPES:
        own = cat[t].where("document_id = 11").select(F.lit(t).alias("record_type"), F.col(f"{t}_id").alias("record_id"), "person_id", "dedup_base")
        out = own if out is None else out.unionByName(own)
    return out


# --- records


@query(sql.with_views(f"""SELECT allergy_id, substance, criticality, noted_on, edited_by, attested_by, {sql.hashed('person_id', sql.norm('substance'))} AS dedup_base FROM (
  SELECT allergy_id, person_id, CASE allergy_id WHEN 2 THEN 'Peanut_' ELSE substance END AS substance, CASE allergy_id WHEN 1 THEN 'high' WHEN 2 THEN NULL ELSE criticality END AS criticality, noted_on, CASE WHEN allergy_id IN (1, 2) THEN 'me' END AS edited_by, NULL AS attested_by FROM allergy WHERE allergy_id <> 3
  UNION ALL SELECT max(allergy_id) + 1, 1, 'latex', 'high', '2020', NULL, 'mother' FROM allergy)""", "allergy"))  # fmt: skip
def records_edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Allergies after one was corrected, one moved to another identity, one removed and one put on a mother's word."""
    return _edited(spark, sf_dir)["allergy"].select("allergy_id", "substance", "criticality", "noted_on", "edited_by", "attested_by", "dedup_base")


def _edited(spark: SparkSession, sf_dir: str):
    cat = catalog(spark, sf_dir)
    cat = registryops.edit_record(cat, "allergy", 1, {"criticality": "high"}, "misread", "me", DICTIONARY, now=NOW)
    cat = registryops.edit_record(cat, "allergy", 2, {"substance": "Peanut_", "criticality": ""}, "renamed", "me", DICTIONARY, identity_too=True, now=NOW)
    cat = registryops.remove_record(cat, "allergy", 3, DICTIONARY)
    return registryops.assert_record(cat, "allergy", "p-1", {"substance": "latex", "criticality": "high", "noted_on": "2020"}, "mother", "2024-01-31", DICTIONARY, NOW)[0]


@query(sql.with_views("""SELECT row_number() OVER (ORDER BY allergy_id, field)::BIGINT AS record_edit_id, allergy_id AS record_id, field, old_value, new_value, note, CASE allergy_id WHEN 2 THEN 'Peanut_' ELSE substance END AS label FROM (
  SELECT allergy_id, substance, 'criticality' AS field, criticality AS old_value, CASE allergy_id WHEN 1 THEN 'high' END AS new_value, CASE allergy_id WHEN 1 THEN 'misread' ELSE 'renamed' END AS note FROM allergy WHERE allergy_id IN (1, 2)
  UNION ALL SELECT allergy_id, substance, 'substance', substance, 'Peanut_', 'renamed' FROM allergy WHERE allergy_id = 2) WHERE old_value IS DISTINCT FROM new_value""", "allergy"))  # fmt: skip
def edit_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of corrections with the label that each row has now."""
    return registryops.edits(_edited(spark, sf_dir)).select("record_edit_id", "record_id", "field", "old_value", "new_value", "note", "label")


@query(sql.with_views("""SELECT 'allergy' AS record_type, max(allergy_id) + 1 AS record_id, 'p-1' AS slug, 'mother' AS attested_by, '2024-01-31' AS attested_on, 'latex' AS label, 'attested' AS state FROM allergy
UNION ALL SELECT 'medication', medication_id, slug, 'pharmacist', '2024-01-01', name, 'superseded' FROM medication LEFT JOIN person USING (person_id) WHERE status IS NULL""", "allergy", "medication", "person"))  # fmt: skip
def attested_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows on someone's word: an allergy without a document, and medications that have got one since."""
    cat = _edited(spark, sf_dir)
    word = F.col("status").isNull()
    meds = cat["medication"].withColumn("attested_by", F.when(word, "pharmacist")).withColumn("attested_on", F.when(word, "2024-01-01"))
    return registryops.attested(cat.with_tables(medication=meds), superseded=True).select("record_type", "record_id", "slug", "attested_by", "attested_on", "label", "state")


# --- verdicts


@query(sql.with_views(f"""
, target AS (SELECT {sql.LAB_BASE} AS b FROM lab_result WHERE lab_result_id = 21), other AS (SELECT {sql.LAB_BASE} AS b FROM lab_result WHERE lab_result_id = 41)
SELECT dedup_base, record_id, status, note FROM (SELECT dedup_base, ruled_id AS record_id, status, note FROM ruled WHERE NOT family UNION ALL SELECT dedup_base, 0, status, note FROM family_v)
  WHERE record_id <> 20 AND NOT (record_id = 0 AND dedup_base IN (SELECT b FROM target UNION ALL SELECT b FROM other))
UNION ALL SELECT {sql.LAB_BASE}, 20, 'disputed', 'ask again' FROM lab_result WHERE lab_result_id = 20
UNION ALL SELECT b, 0, 'confirmed', 'seen' FROM target""", "lab_result", "ruling", verdicts=True))  # fmt: skip
def verdicts_edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts after one on a row and one on a family were put in place of what was there, and one on a family was cleared."""
    cat = catalog(spark, sf_dir)
    base = {r["lab_result_id"]: r["dedup_base"] for r in cat["lab_result"].where("lab_result_id IN (21, 41)").select("lab_result_id", "dedup_base").collect()}
    cat = registryops.annotate(cat, "lab_result", "", "disputed", " ask again ", record_id=20, now=NOW)
    cat = registryops.annotate(cat, "lab_result", base[21], "confirmed", "seen", now=NOW)
    return registryops.clear_verdict(cat, "lab_result", base[41])["curation"].select("dedup_base", "record_id", "status", "note")


_STALE = f", moved AS (SELECT lab_result_id, {base_sql('lab_result')} AS was, {base_sql('lab_result', {})} AS now FROM lab_result)"


def _drifted(spark: SparkSession, sf_dir: str):
    """Verdicts as they are, and labs whose identities follow another dictionary."""
    cat = catalog(spark, sf_dir)
    return cat, cat.with_tables(lab_result=cat["lab_result"].withColumn("dedup_base", identity.dedup_base("lab_result", {})))


@query(sql.with_views(f"{_STALE} SELECT r.ruled_id AS record_id, m.now AS dedup_base, r.status FROM ruled r JOIN moved m ON m.lab_result_id = r.ruled_id WHERE NOT family UNION ALL SELECT 0, dedup_base, status FROM family_v", "lab_result", "ruling", verdicts=True))
def breadcrumbs_refreshed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row verdicts with the bases that their rows have by another dictionary."""
    return registryops.refresh_breadcrumbs(_drifted(spark, sf_dir)[1])["curation"].select("record_id", "dedup_base", "status")


@query(sql.with_views(f"""{_STALE}
, successors AS (SELECT was, min(now) AS now FROM moved GROUP BY was), lost AS (SELECT f.*, s.now FROM family_v f JOIN successors s ON s.was = f.dedup_base WHERE f.dedup_base NOT IN (SELECT now FROM moved)),
claims AS (SELECT *, row_number() OVER (PARTITION BY now ORDER BY dedup_base) AS k FROM lost)
SELECT dedup_base, CASE WHEN k = 1 AND now NOT IN (SELECT dedup_base FROM family_v) THEN 'reaffirmed' ELSE 'skipped' END AS action FROM claims""", "lab_result", "ruling", verdicts=True))  # fmt: skip
def reaffirmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of family verdicts whose families moved, each pointed at the successor of its family."""
    was, cat = _drifted(spark, sf_dir)
    both = was["lab_result"].select("lab_result_id", F.col("dedup_base").alias("old_base")).join(cat["lab_result"].select("lab_result_id", F.col("dedup_base").alias("new_base")), "lab_result_id")
    successors = both.groupBy("old_base").agg(F.min("new_base").alias("new_base")).withColumn("record_type", F.lit("lab_result"))
    return registryops.reaffirm(cat, successors)[1].select("dedup_base", "action")


# --- ingest


_INGEST = """files AS (SELECT doc_id, lang, text, sha256(text) AS sha, row_number() OVER (PARTITION BY sha256(text) ORDER BY CAST(doc_id AS VARCHAR)) AS k FROM documents WHERE text IS NOT NULL)"""


def _ingested(spark: SparkSession, sf_dir: str):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text IS NOT NULL")
    files = docs.select(F.col("doc_id").cast("string").alias("path"), F.lit(".txt").alias("suffix"), F.sha2("text", 256).alias("sha256"), "text", F.lit("native").alias("route"), F.lit(None).cast("string").alias("error"), F.lit(None).cast("binary").alias("content"))
    shas = docs.select("lang", F.sha2("text", 256).alias("sha256"))
    stored = whole(shas.where("lang = 'en'").select("sha256").distinct().withColumn("document_id", F.lit(1)), "document")
    buried = whole(shas.where("lang = 'de'").select("sha256").distinct(), "document_tombstone")
    cat = snapshots.Catalog(spark, {"person": catalog(spark, sf_dir)["person"], "document": stored, "document_tombstone": buried})
    return ingest.ingest(cat, files, "p-1", now=NOW)


@query(f"""WITH {_INGEST} SELECT CAST(doc_id AS VARCHAR) AS path, CASE WHEN k > 1 OR sha IN (SELECT sha FROM files WHERE lang = 'en') THEN 'duplicate' WHEN sha IN (SELECT sha FROM files WHERE lang = 'de') THEN 'tombstoned' ELSE 'new' END AS status FROM files""")
def ingest_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of each document as a file, where one language is stored already and another buried."""
    return _ingested(spark, sf_dir)[1].select("path", "status")


@query(f"""WITH {_INGEST} SELECT sha AS sha256, substr(sha, 1, 2) || '/' || sha || '.txt' AS source_path, 'native' AS text_source, 1::BIGINT AS person_id FROM files WHERE k = 1 AND sha NOT IN (SELECT sha FROM files WHERE lang IN ('en', 'de'))""")
def ingested_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that an ingest adds, with the places of their content."""
    return _ingested(spark, sf_dir)[0]["document"].where("ingested_at IS NOT NULL").select("sha256", "source_path", "text_source", "person_id")


@query("""SELECT doc_id AS document_id, CASE lang WHEN 'en' THEN 'missing-blob' ELSE CASE WHEN n_chars > 20000 THEN 'failed' WHEN source = (SELECT min(source) FROM documents) THEN 'unchanged' WHEN lang = 'de' THEN 'shrunk' ELSE 'written' END END AS status FROM documents WHERE trim(text) <> ''""")
def reextracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a new extraction of all documents does, where one language has no blobs, very long ones fail, one source is as before and one language got shorter."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("trim(text) <> ''")
    first = docs.agg(F.min("source")).first()[0]
    new = F.when(F.col("source") == first, F.col("text")).when(F.col("lang") == "de", F.expr("substr(trim(text), 1, 1)")).otherwise(F.concat("text", F.lit(" more")))
    cat = snapshots.Catalog(spark, {"document": whole(docs.select(F.col("doc_id").alias("document_id"), F.col("doc_id").cast("string").alias("sha256"), F.col("text").alias("ocr_text")), "document")})
    decoded = docs.where("lang <> 'en'").select(F.col("doc_id").cast("string").alias("sha256"), new.alias("text"), F.lit("native").alias("route"), F.when(F.col("n_chars") > 20000, F.lit("too long")).alias("error"))
    return ingest.reextracted(cat, decoded, force=True)[1]


# --- snapshots


@query(sql.with_views(" UNION ALL ".join([f"SELECT '{t}' AS table_name, count(*) AS rows FROM {t}" for t in ("person", "document", "person_unit_pref", *TYPES)] + ["SELECT 'curation', (SELECT count(*) FROM row_v) + (SELECT count(*) FROM family_v)"]), "person", "document", "person_unit_pref", *_ALL, "ruling", verdicts=True))
def snapshot_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of all tables after a snapshot was written, checked, replaced by another and restored."""
    root = fresh_dir(spark)
    cat = catalog(spark, sf_dir)
    snapshots.snapshot(cat, root, "anamnex-20240201-0000")
    snapshots.snapshot(snapshots.Catalog(spark, {"person": cat["person"].where("false")}), root, "anamnex-20240202-0000")
    assert snapshots.integrity(spark, root, snapshots.resolve(spark, root, "anamnex-20240201-0000")) == "ok" and snapshots.exists(spark, root)
    snapshots.restore(spark, root, "anamnex-20240201-0000")
    return registryops.table_counts(snapshots.load(spark, root))


@query(sql.with_views(f"SELECT allergy_id, {base_sql('allergy')} AS dedup_base, 0 AS dedup_occurrence, CAST(NULL AS VARCHAR) AS attested_by FROM allergy", "allergy"))
def migrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Allergies of an older schema, without bases, occurrences and attestation, in today's."""
    cat = catalog(spark, sf_dir)
    old = snapshots.Catalog(spark, {"allergy": cat["allergy"].drop("dedup_base", "dedup_occurrence", "attested_by", "attested_on")})
    assert snapshots.pending(old) == ["allergy"]
    return snapshots.migrate(old)["allergy"].select("allergy_id", "dedup_base", "dedup_occurrence", "attested_by")


# --- validation, identities


@query(sql.with_views(" UNION ALL ".join([
    "SELECT 'lab_result' AS record_type, lab_result_id AS record_id, 0 AS problems FROM lab_result",
    "SELECT 'medication', medication_id, 0 FROM medication",
    "SELECT 'procedure', procedure_id, 0 FROM procedure",
    "SELECT 'appointment', appointment_id, 0 FROM appointment",
    f"SELECT 'observation', observation_id, CASE WHEN obs_type IN ('symptom', 'activity') AND observed_at IS NULL THEN 1 ELSE 0 END + CASE WHEN obs_type = 'symptom' AND NOT coalesce(value_num BETWEEN 0 AND 10, TRUE) THEN 1 ELSE 0 END FROM observation",
    "SELECT 'allergy', allergy_id, 0 FROM allergy",
    "SELECT 'condition', condition_id, 0 FROM condition",
]), *_ALL))
def validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rules of its type each row of all seven types breaks."""
    cat, out = catalog(spark, sf_dir), None
    for t in TYPES:
        own = cat[t].select(F.lit(t).alias("record_type"), F.col(f"{t}_id").alias("record_id"), F.size(commit.errors(t)).alias("problems"))
        out = own if out is None else out.unionByName(own)
    return out


def _label_sql(t: str) -> str:
    parts = " || ' | ' || ".join(f"coalesce({p}, '')" for p in PARTS[t](DICTIONARY))
    row = {"lab_result": "test_name", "medication": "name", "procedure": "name", "allergy": "substance", "condition": "name", "appointment": "concat_ws(' ', nullif(provider, ''), nullif(scheduled_for, ''))", "observation": "concat_ws(' ', nullif(obs_type, ''), nullif(key, ''))"}[t]
    return f"SELECT '{t}' AS record_type, {t}_id AS record_id, 'person ' || person_id || ' | ' || {parts} AS identity, coalesce({row}, '') AS label FROM {t}"


@query(sql.with_views(" UNION ALL ".join(map(_label_sql, TYPES)), *_ALL))
def record_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How messages name the identity of a row, and the row."""
    cat, out = catalog(spark, sf_dir), None
    for t in TYPES:
        own = cat[t].select(F.lit(t).alias("record_type"), F.col(f"{t}_id").alias("record_id"), identity.identity_label(t, DICTIONARY).alias("identity"), identity.row_label(t).alias("label"))
        out = own if out is None else out.unionByName(own)
    return out


@query(sql.with_views(" UNION ALL ".join(
    f"SELECT '{t}' AS record_type, a.{t}_id AS record_id, " + " AND ".join([f"(a.{f} IS NULL OR b.{f} IS NULL OR a.{f} = b.{f})" if t in SPARSE else (f"lower(trim(coalesce(a.{f}, ''))) = lower(trim(coalesce(b.{f}, '')))" if f == "unit" else f"a.{f} IS NOT DISTINCT FROM b.{f}") for f in _fields(t)])
    + f" AS agrees FROM (SELECT *, {base_sql(t)} AS b, min({t}_id) OVER (PARTITION BY {base_sql(t)}) AS head FROM {t}) a JOIN {t} b ON b.{t}_id = a.head" for t in _UNIQUE
), *_UNIQUE))
def agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """whether each row says the same as the first of its identity, in six types."""
    cat, out = catalog(spark, sf_dir), None
    for t in _UNIQUE:
        rows = cat[t]
        head = rows.groupBy("dedup_base").agg(F.min_by(F.struct(*COMPARED[t]), f"{t}_id").alias("head"))
        equal = identity.rows_equal(t, lambda f: F.col(f"head.{f}"), F.col)
        own = rows.join(head, "dedup_base").select(F.lit(t).alias("record_type"), F.col(f"{t}_id").alias("record_id"), equal.alias("agrees"))
        out = own if out is None else out.unionByName(own)
    return out


assert NUMBER == "double"
