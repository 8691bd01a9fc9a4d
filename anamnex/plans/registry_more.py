"""More registered queries: merges and adopted sources, dictionaries, dates, marks, and verbs over them."""

from __future__ import annotations

import json
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates
from ..functions.names import shown_name
from ..functions.text import load_dictionary
from ..operators import commit, registryops, render
from ..specs import COMPARED
from . import sql
from .bridge import DICTIONARY, catalog, view
from .registry import ORACLES, query
from .registry_fronts import done
from .registry_verbs import _CONFLICTS, NOW, _conflicted, commit_types

_FIRSTS = "firsts AS (SELECT *, row_number() OVER (ORDER BY lab_result_id) AS k FROM (SELECT *, row_number() OVER (PARTITION BY head ORDER BY lab_result_id) AS n FROM open_c) WHERE n = 1)"


@query("SELECT record_type, count(*) FILTER (WHERE outcome = 'new') AS new, count(*) FILTER (WHERE outcome = 'duplicate') AS duplicate, count(*) FILTER (WHERE outcome = 'conflict') AS conflict FROM (" + ORACLES["commit_types"] + ") GROUP BY 1")
def commit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes counted by type."""
    found = commit_types(spark, sf_dir)
    return found.groupBy("record_type").agg(*(F.count_if(F.col("outcome") == o).alias(o) for o in ("new", "duplicate", "conflict")))


@query(sql.with_views(f""", {_CONFLICTS}, {_FIRSTS}
SELECT h.lab_result_id, CASE WHEN k = 2 THEN coalesce(f.value_num, h.value_num) ELSE h.value_num END AS value_num, CASE WHEN k = 2 THEN coalesce(f.value_text, h.value_text) ELSE h.value_text END AS value_text, CASE WHEN k = 2 THEN coalesce(f.flag, h.flag) ELSE h.flag END AS flag,
  CASE WHEN k = 2 THEN coalesce(f.ref_low, h.ref_low) ELSE h.ref_low END AS ref_low, CASE WHEN k <= 2 THEN f.document_id ELSE h.document_id END AS document_id FROM lab_r h JOIN heads ON heads.head = h.lab_result_id LEFT JOIN firsts f ON f.head = h.lab_result_id AND f.k <= 2""", "lab_result"))  # fmt: skip
def merged_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labs after one disputed row without a source took the other's, and one was merged with the incoming values wherever both say something."""
    cat = _conflicted(spark, sf_dir)
    first, second = (r["c"] for r in commit.conflict_families(cat, "lab_result", DICTIONARY).groupBy("anchor_id").agg(F.min("conflict_id").alias("c")).orderBy("c").limit(2).collect())  # two settled by hand
    anchors = {r["conflict_id"]: r["anchor_id"] for r in commit.conflict_families(cat, "lab_result", DICTIONARY).where(F.col("conflict_id").isin(first, second)).collect()}
    cat = cat.with_tables(lab_result=cat["lab_result"].withColumn("document_id", F.when(F.col("lab_result_id") != anchors[first], F.col("document_id"))))
    cat, _ = commit.resolve(cat, first, "existing", dictionary=DICTIONARY, adopt_source=True, now=NOW)
    row = cat["conflict"].where(F.col("conflict_id") == second).first()
    collide = commit.merge_plan("lab_result", json.loads(row["existing_json"]), json.loads(row["incoming_json"]))["collisions"]
    cat, _ = commit.resolve(cat, second, "merge", dictionary=DICTIONARY, fields=dict.fromkeys(collide, "incoming"), now=NOW)
    assert set(collide) <= set(COMPARED["lab_result"])
    return cat["lab_result"].select("lab_result_id", "value_num", "value_text", "flag", "ref_low", "document_id")


@query("SELECT * FROM (VALUES ('synonyms', 'glukose level', 'Glucose'), ('routine', 'x ray', ''), ('display', 'drug a', 'Drug A (own)')) t(kind, name, value)")
def dictionary_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dictionary file: synonyms, routine procedures and names for display, collapsed."""
    with tempfile.NamedTemporaryFile("w", suffix=".toml") as f:
        f.write('[synonyms]\n"Glukose_ Level" = " Glucose "\n[procedures]\nroutine = ["X  Ray", "x ray", ""]\n[medication_display]\n"Drug  A" = "Drug A (own)"\n"Drug B" = " "\n')
        f.flush()
        found = load_dictionary(f.name)
    rows = [("synonyms", k, v) for k, v in found["synonyms"].items()] + [("routine", k, "") for k in found["routine"]] + [("display", k, v) for k, v in found["medication_display"].items()]
    return spark.createDataFrame(rows, "kind string, name string, value string")


@query(sql.with_views("SELECT medication_id, CASE name WHEN 'DRUG 1-URGENT' THEN 'Own Name' WHEN 'DRUG 2-HIGH' THEN 'Drug 2-High' WHEN 'DRUG 3-MEDIUM' THEN 'Drug 3-Medium' WHEN 'DRUG 4-NOT SPECIFIED' THEN 'Drug 4-Not Specified' WHEN 'DRUG 5-LOW' THEN 'Drug 5-Low' END AS shown FROM medication", "medication"))
def overridden_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """names for display, one of them by the dictionary."""
    return view(spark, sf_dir, "medication").select("medication_id", shown_name(F.col("name"), {"drug 1-urgent": "Own Name"}, DICTIONARY).alias("shown"))


@query(sql.with_views("SELECT document_id, doc_date AS kept FROM document", "document"))
def doc_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates of documents, with white space around them or made unreal, as they are stored."""
    value = F.coalesce(F.concat(F.lit("\n "), F.col("doc_date"), F.lit("\t")), F.when(F.col("document_id") % 3 == 0, F.lit("2024-02-30")).otherwise(F.lit("2024-01")))
    return view(spark, sf_dir, "document").select("document_id", dates.doc_date(value).alias("kept"))


@query(sql.with_views("SELECT medication_id, CASE WHEN document_id % 2 = 0 THEN '  (attested by mother 2024-01-01; no source document)' ELSE '' END AS mark FROM medication", "medication"))
def attestation_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """what a document says of rows on someone's word, which have no source."""
    df = view(spark, sf_dir, "medication").select("medication_id", F.when(F.col("document_id") % 2 != 0, F.col("document_id")).alias("document_id"), F.lit("mother").alias("attested_by"), F.lit(" 2024-01-01").alias("attested_on"))
    return df.select("medication_id", render.attested().alias("mark"))


@query("SELECT event_id, nullif(t, '') AS text, TRY_CAST(nullif(t, '') AS DOUBLE) AS number FROM (SELECT event_id, CASE event_type WHEN 'view' THEN '' WHEN 'click' THEN event_type ELSE CAST(event_id AS VARCHAR) || '.5' END AS t FROM events)")
def coerced_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values given as text, as texts and numbers."""
    given = F.when(F.col("event_type") == "view", "").when(F.col("event_type") == "click", F.col("event_type")).otherwise(F.concat(F.col("event_id").cast("string"), F.lit(".5")))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", registryops.coerced(given).alias("v")).select("event_id", "v.text", "v.number")


@query("SELECT count(*) AS checked, count(*) FILTER (WHERE lang NOT IN ('en', 'de')) AS ok, count(*) FILTER (WHERE lang = 'en') AS missing, count(*) FILTER (WHERE lang = 'de') AS mismatched FROM documents")
def blobs_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored content against documents, where one language is missing and another damaged."""
    cat = catalog(spark, sf_dir)
    documents = cat["document"].withColumn("sha256", F.sha2("ocr_text", 256))
    blobs = documents.where("category <> 'en'").select("source_path", F.when(F.col("category") == "de", F.lit("other")).otherwise(F.col("sha256")).alias("sha256"))
    return registryops.blob_checks(cat.with_tables(document=documents), blobs)


# --- verbs


@query(sql.with_views("SELECT document_id, document_id = 5 AS by_hand FROM document", "document"))
def cli_document_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents after one got the text of a file."""
    with tempfile.NamedTemporaryFile("w", suffix=".txt") as f:
        f.write("by hand")
        f.flush()
        cat = done(catalog(spark, sf_dir), ("document-text", "5", f.name, "--force"))
    return cat["document"].select("document_id", (F.col("ocr_text") == "by hand").alias("by_hand"))


@query(sql.with_views("SELECT document_id, CASE document_id WHEN 11 THEN (SELECT max(person_id) + 1 FROM person) ELSE person_id END AS person_id FROM document", "document", "person"))
def cli_document_reassign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owners of documents after one went to a new person."""
    return done(catalog(spark, sf_dir), ("person-add", "p-new", "New Person"), ("document-reassign", "11", "p-new"))["document"].select("document_id", "person_id")


@query(sql.with_views(f", {_CONFLICTS}, {_FIRSTS} SELECT lab_result_id AS conflict_id, CASE WHEN lab_result_id = (SELECT min(lab_result_id) FROM open_c) THEN 'resolved' ELSE 'open' END AS status FROM open_c", "lab_result"))
def cli_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conflicts after the first was settled by a verb."""
    cat = _conflicted(spark, sf_dir)
    first = cat["conflict"].agg(F.min("conflict_id")).first()[0]
    return done(cat, ("resolve", str(first), "incoming", "--note", "seen"))["conflict"].select("conflict_id", "status")


@query("SELECT text FROM (" + ORACLES["briefs"] + ") WHERE appointment_id = (SELECT min(conv_id * 1000 + turn) FROM conversations JOIN customer ON c_custkey = conv_id)")
def tool_brief(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The brief of one appointment by a tool call."""
    from .registry_fronts import called

    cat = catalog(spark, sf_dir)
    first = cat["appointment"].join(cat["person"].select("person_id"), "person_id").agg(F.min("appointment_id")).first()[0]
    return spark.createDataFrame([(called(cat, "render_brief", appointment=first)["markdown"],)], "text string")
