"""Registered queries of the command line and of the tool server: their verbs and tools over the driver's tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import cli
from ..server import Server
from . import registry, sql
from .bridge import DICTIONARY, catalog, whole
from .registry import _ALL, ORACLES, TODAY, query
from .registry_verbs import _hashed_documents

_WORDS = {"synonyms": DICTIONARY, "routine": ("proc ro",), "medication_display": {}}


def shown(cat, *argv: str) -> DataFrame:
    """What a reading verb shows."""
    a = cli.parser().parse_args(["--store", "none", "--today", TODAY, *argv])
    return cli.reads(cat, a, DICTIONARY)[a.verb]()


def done(cat, *verbs: tuple[str, ...]):
    """The catalog after writing verbs."""
    for argv in verbs:
        a = cli.parser().parse_args(["--store", "none", *argv])
        cat, _ = cli.written(cat.spark, cat, a, DICTIONARY)
    return cat


# --- reading verbs, for one person


@query(sql.with_views("SELECT lab_result_id, test_name, value_num, collected_at FROM lab_live WHERE person_id = 2 AND substr(replace(trim(collected_at), 'T', ' '), 1, 10) >= '2024-01-05'", "lab_result", "ruling", verdicts=True))
def cli_labs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1, V3: one person's labs since a day, without those that verdicts hide."""
    return shown(catalog(spark, sf_dir), "labs", "p-2", "--since", "2024-01-05").select("lab_result_id", "test_name", "value_num", "collected_at")


@query(sql.with_views(f"SELECT medication_id, name, CASE WHEN {sql.enum_token('status_reason')} IN ('reorder', 're-order', 'renewal', 'renewed') THEN 'renewed' WHEN {sql.current_med(TODAY)} THEN 'current' ELSE 'ended' END AS state FROM medication WHERE person_id = 2", "medication"))
def cli_meds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One person's medications, each with whether it goes on."""
    return shown(catalog(spark, sf_dir), "meds", "P-2").select("medication_id", "name", "state")


_MINE = registry._TIMELINE.replace("FROM lab_result", "FROM lab_live")


@query(sql.with_views(f"SELECT date, type, summary, record_type FROM ({_MINE}) WHERE person_id = 2 AND date <> ''", *_ALL, "ruling", verdicts=True))
def cli_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One person's timeline without what verdicts hide, and without identities."""
    df = shown(catalog(spark, sf_dir), "timeline", "p-2")
    assert not {"dedup_base", "record_id"} & set(df.columns)
    return df.select("date", "type", "summary", "record_type")


ORACLES["cli_trends"] = registry.ORACLES["trends"] + " WHERE o.person_id = 2"


@query(ORACLES["cli_trends"])
def cli_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V2: one person's trend."""
    found = shown(catalog(spark, sf_dir), "trends", "p-2", "VIEW")
    return found.select("person_id", "test", "count", "unit", "min", "max", "latest", "latest_at", "latest_tie", F.round("slope_per_day", 6).alias("slope_per_day"), F.array_join("other_assays", ",").alias("other_assays"), "other_assay_count", "suppressed_count")


@query("SELECT source_table, source_id, person_id, rank FROM (" + registry.ORACLES["find"] + ") WHERE person_id = 2")
def cli_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V6, V8: search in one person's records, with ranks of all records."""
    return shown(catalog(spark, sf_dir), "find", "Reoúha the", "--person", "p-2").select("source_table", "source_id", "person_id", F.round("rank", 6).alias("rank"))


@query(sql.with_views("SELECT person_id, slug, full_name FROM person", "person"))
def cli_person_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All active persons."""
    return shown(catalog(spark, sf_dir), "person-list").select("person_id", "slug", "full_name")


@query(sql.with_views("SELECT slug, full_name, (SELECT count(*) FROM lab_result WHERE person_id = 2) AS labs, (SELECT count(*) FROM medication WHERE person_id = 2) AS meds, (SELECT string_agg(key || ' ' || unit, ',') FROM person_unit_pref WHERE person_id = 2) AS prefs FROM person WHERE slug = 'p-2'", "person", "lab_result", "medication", "person_unit_pref"))
def cli_person_show(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One person with counts and preferences."""
    df = shown(catalog(spark, sf_dir), "person-show", "p-2")
    prefs = F.array_join(F.transform("unit_prefs", lambda p: F.concat(p["key"], F.lit(" "), p["unit"])), ",")
    return df.select("slug", "full_name", F.col("lab_result").alias("labs"), F.col("medication").alias("meds"), prefs.alias("prefs"))


@query(sql.with_views("SELECT document_id, category, (SELECT count(*) FROM lab_result WHERE document_id = 5) AS labs, (SELECT count(*) FROM procedure WHERE document_id = 5) AS procedures, length(ocr_text) AS chars FROM document WHERE document_id = 5", "document", "lab_result", "procedure"))
def cli_document_show(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document with its text and what came from it."""
    df = shown(catalog(spark, sf_dir), "document-show", "5")
    return df.select("document_id", "category", F.col("lab_result").alias("labs"), F.col("procedure").alias("procedures"), F.length("ocr_text").alias("chars"))


@query(sql.with_views("SELECT d.document_id, slug FROM document d JOIN person p USING (person_id) WHERE slug = 'p-2'", "document", "person"))
def cli_document_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One person's documents."""
    return shown(catalog(spark, sf_dir), "document-list", "--person", "p-2").select("document_id", "slug")


@query(sql.with_views("SELECT 'medication status' AS check_name, count(*) FILTER (WHERE k <= 10) AS listed, max(CASE WHEN total > 10 THEN '... and ' || (total - 10) || ' more' END) AS more FROM (SELECT row_number() OVER () AS k, count(*) OVER () AS total FROM medication WHERE status IS NOT NULL AND lower(trim(status)) NOT IN ('', 'completed', 'stopped', 'discontinued', 'active')) HAVING count(*) > 0 "
    "UNION ALL SELECT 'conditions', count(*) FILTER (WHERE k <= 10), max(CASE WHEN total > 10 THEN '... and ' || (total - 10) || ' more' END) FROM (SELECT row_number() OVER () AS k, count(*) OVER () AS total FROM (" + registry.ORACLES["conditions_dated_and_not"][registry.ORACLES["conditions_dated_and_not"].rindex("SELECT person_id") :] + ")) HAVING count(*) > 0", "medication", "condition"))  # fmt: skip
def cli_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The problems of two checks, ten of each at most, and how many more there are."""
    df = shown(catalog(spark, sf_dir).with_tables(curation=whole(spark.createDataFrame([], "record_id bigint"), "curation")), "verify").where("check_name IN ('medication status', 'conditions')")
    more = F.col("message").startswith("... and ")
    return df.groupBy("check_name").agg(F.count_if(~more).alias("listed"), F.max(F.when(more, F.col("message"))).alias("more"))


@query("SELECT text FROM (" + registry.ORACLES["journals"] + ") WHERE person_id = 2")
def cli_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One person's journal."""
    a = cli.parser().parse_args(["--store", "none", "--today", TODAY, "journal", "p-2"])
    return cli.texts(catalog(spark, sf_dir), a, _WORDS)["journal"]().where("person_id = 2").select("text")


@query("SELECT text FROM (" + ORACLES["summaries"] + ") WHERE person_id = 2")
def cli_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One person's summary."""
    a = cli.parser().parse_args(["--store", "none", "--today", TODAY, "summary", "p-2"])
    return cli.texts(catalog(spark, sf_dir), a, _WORDS)["summary"]().where("person_id = 2").select("text")


# --- writing verbs


@query(sql.with_views("""SELECT person_id, slug, CASE slug WHEN 'p-1' THEN 'Renamed One' ELSE full_name END AS full_name, deactivated_at IS NOT NULL OR slug = 'p-3' AS inactive FROM person UNION ALL SELECT max(person_id) + 1, 'p-new', 'New Person', FALSE FROM person""", "person"))
def cli_person_verbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persons after verbs that add, edit, deactivate and reactivate."""
    cat = done(catalog(spark, sf_dir), ("person-add", "p-new", "New Person"), ("person-edit", "p-1", "--full-name", "Renamed One"), ("person-deactivate", "p-3"), ("person-deactivate", "p-4"), ("person-deactivate", "p-4", "--back"))
    return cat["person"].select("person_id", "slug", "full_name", F.col("deactivated_at").isNotNull().alias("inactive"))


@query(sql.with_views("SELECT person_id, key, unit FROM person_unit_pref WHERE person_id <> 4 AND person_id = 2 UNION ALL SELECT 2, 'weight', 'kg'", "person_unit_pref"))
def cli_unit_prefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One person's preferences after one is set, and another person's cleared."""
    cat = done(catalog(spark, sf_dir), ("unit-pref", "p-2", "Weight", "--unit", "kilograms"), ("unit-pref", "p-4", "rate view"))
    return shown(cat, "unit-prefs", "p-2").select("person_id", "key", "unit")


@query(sql.with_views("SELECT document_id, CASE document_id WHEN 6 THEN 'letter' ELSE category END AS category FROM document WHERE document_id <> 7", "document"))
def cli_document_verbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents after verbs that edit one and remove one."""
    return done(catalog(spark, sf_dir), ("document-edit", "6", "--category", "letter"), ("document-remove", "7"))["document"].select("document_id", "category")


@query("SELECT repeat('cd', 32) AS sha256, 'spam' AS reason")
def cli_tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tombstones after two were added and one lifted."""
    cat = done(_hashed_documents(spark, sf_dir), ("tombstone-add", "ab" * 32), ("tombstone-add", "CD" * 32, "--reason", "spam"), ("tombstone-remove", "AB" * 32))
    return shown(cat, "tombstones").select("sha256", "reason")


@query(sql.with_views("SELECT allergy_id, CASE allergy_id WHEN 1 THEN 'high' ELSE criticality END AS criticality, NULL AS attested_by FROM allergy WHERE allergy_id <> 3 UNION ALL SELECT max(allergy_id) + 1, 'low', 'mother' FROM allergy", "allergy"))
def cli_record_verbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Allergies after verbs that correct, remove and assert one."""
    cat = done(catalog(spark, sf_dir), ("record-edit", "allergy", "1", "criticality=high", "--note", "misread", "--by", "me"), ("record-remove", "allergy", "3"), ("record-assert", "allergy", "p-1", "substance=latex", "criticality=low", "--by", "mother", "--on", "2024-01-31"))
    return cat["allergy"].select("allergy_id", "criticality", "attested_by")


@query(sql.with_views("SELECT record_id, status, note FROM (SELECT ruled_id AS record_id, status, note FROM ruled WHERE NOT family UNION ALL SELECT 0, status, note FROM family_v) WHERE record_id NOT IN (20, 22) UNION ALL SELECT 20, 'disputed', 'ask again'", "lab_result", "ruling", verdicts=True))
def cli_verdict_verbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts after verbs that put one on a row and clear one."""
    cat = done(catalog(spark, sf_dir), ("annotate", "lab_result", "-", "disputed", "--note", "ask again", "--row", "20"), ("clear-verdict", "lab_result", "-", "--row", "22"))
    return cat["curation"].select("record_id", "status", "note")


# --- tools


def called(cat, name: str, **arguments):
    """A tool's answer, through the protocol."""
    server = Server(cat.spark, lambda: cat, lambda new: "snapshot", None, TODAY)
    server.words.update(_WORDS)
    reply = server.answer(json.loads(json.dumps({"jsonrpc": "2.0", "id": 1, "method": "tools/call", "params": {"name": name, "arguments": arguments}})))
    return json.loads(reply["result"]["content"][0]["text"])


@query(sql.with_views("SELECT lab_result_id, value_num, v_status AS status FROM lab_v WHERE person_id = 2", "lab_result", "ruling", verdicts=True))
def tool_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One person's labs by a tool call, with verdicts beside them and nothing hidden."""
    found = called(catalog(spark, sf_dir), "query", kind="labs", person="p-2")
    return spark.createDataFrame([(r["lab_result_id"], r.get("value_num"), (r.get("_curation") or {}).get("status")) for r in found], "lab_result_id long, value_num double, status string")


@query("SELECT test, count, latest, latest_at FROM (" + ORACLES["cli_trends"] + ")")
def tool_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V9: one person's trend by a tool call."""
    r = called(catalog(spark, sf_dir), "trends", person="p-2", test="VIEW")
    return spark.createDataFrame([(r["test"], r["count"], r.get("latest"), r.get("latest_at"))], "test string, count long, latest double, latest_at string")


@query("SELECT 'summary' AS kind, text FROM (" + ORACLES["summaries"] + ") WHERE person_id = 2 UNION ALL SELECT 'journal', text FROM (" + registry.ORACLES["journals"] + ") WHERE person_id = 2")
def tool_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One person's summary and journal by tool calls."""
    cat = catalog(spark, sf_dir)
    return spark.createDataFrame([(k, called(cat, f"render_{k}", person="p-2")["markdown"]) for k in ("summary", "journal")], "kind string, text string")


@query(sql.with_views("SELECT slug, full_name FROM person UNION ALL SELECT 'p-2', 'Renamed Two' UNION ALL SELECT 'p-new', 'New Person' UNION ALL SELECT slug, full_name FROM person WHERE slug = 'p-1'", "person"))
def tool_persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persons listed, one edited, one added and one shown by tool calls."""
    cat = catalog(spark, sf_dir)
    found = called(cat, "person_list") + [called(cat, "person_edit", slug="p-2", full_name="Renamed Two")["result"], called(cat, "person_add", slug="P-New", full_name="New Person")["result"], called(cat, "person_show", slug="p-1")]
    return spark.createDataFrame([(r["slug"], r["full_name"]) for r in found], "slug string, full_name string")


@query("SELECT 1::BIGINT AS new, 1::BIGINT AS duplicate, 0::BIGINT AS conflict, 0::BIGINT AS enriched, 'CallError: a resolution needs the words of whoever signs it off' AS refusal, 9::BIGINT AS chars")
def tool_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A submission, an unsigned resolution and a text for a document without one, by tool calls."""
    cat = catalog(spark, sf_dir)
    empty = cat["document"].withColumn("ocr_text", F.when(F.col("document_id") != 5, F.col("ocr_text")))
    cat = cat.with_tables(document=empty)
    row = {"substance": "latex", "criticality": "high"}
    counts = called(cat, "commit_extraction", document_id=5, records={"allergy": [row, row]})["result"]["allergy"]
    server = Server(spark, lambda: cat, lambda new: "snapshot", None, TODAY)
    refusal = server.call("review_conflicts", {"resolve": 1, "keep": "existing"})["content"][0]["text"]
    chars = called(cat, "document_set_text", document_id=5, text="some text")["result"]["chars"]
    return spark.createDataFrame([(counts["new"], counts["duplicate"], counts["conflict"], counts["enriched"], refusal, chars)], "new long, duplicate long, conflict long, enriched long, refusal string, chars long")
