"""Command line over a snapshot store: python -m anamnex.cli --store DIR VERB ...

Reads print JSON rows. Writes are dry runs that print what would change, unless --apply is given, which writes a new
snapshot and makes it the current one.
"""

from __future__ import annotations

import argparse
import datetime as dt
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import load_dictionary
from .operators import clinical, commit, ingest, overlay, registryops, render, search
from .plans import catalog as snapshots
from .sources import decoders
from .specs import FIELDS, TYPES


def say(df: DataFrame) -> int:
    """Rows as JSON lines; they stream to the terminal partition by partition."""
    for line in df.toJSON().toLocalIterator():
        print(line)
    return 0


def values(pairs: list[str], record_type: str) -> dict:
    """FIELD=VALUE pairs by the kinds of a type's fields; an empty value clears a field."""
    out: dict = {}
    for p in pairs:
        name, _, text = p.partition("=")
        if name not in FIELDS[record_type]:
            raise SystemExit(f"{record_type} has no field {name!r}")
        out[name] = None if text == "" else float(text) if FIELDS[record_type][name] == "double" else text
    return out


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="anamnex")
    top.add_argument("--store", required=True)
    top.add_argument("--dictionary")
    top.add_argument("--pdf-reader", help="module:attribute of a reader for PDF files")
    top.add_argument("--apply", action="store_true")
    top.add_argument("--today", default=str(dt.date.today()))
    verbs = top.add_subparsers(dest="verb", required=True)

    def verb(name: str, *args: str, **options) -> None:
        p = verbs.add_parser(name)
        for a in args:
            p.add_argument(a, nargs="+" if a == "fields" else None)
        for o, kind in options.items():
            p.add_argument(f"--{o.replace('_', '-')}", **({"action": "store_true"} if kind is bool else {"type": kind}))

    verb("init")
    verb("labs", "person", test=str, since=str, raw=bool)
    verb("meds", "person", active=bool, raw=bool)
    verb("timeline", "person", since=str)
    verb("trends", "person", "test")
    verb("find", "text", person=str)
    for kind in ("summary", "journal", "curation-record"):
        verb(kind, "person")
    verb("brief", "appointment")
    verb("person-add", "slug", "full_name", dob=str, sex=str)
    verb("person-edit", "slug", full_name=str, dob=str, notes=str)
    verb("person-list", inactive=bool)
    verb("person-show", "slug")
    verb("person-deactivate", "slug", back=bool)
    verb("person-remove", "slug")
    verb("unit-pref", "person", "key", unit=str)
    verb("unit-prefs", "person")
    verb("document-list", person=str)
    verb("document-show", "id")
    verb("document-edit", "id", doc_date=str, category=str, provider=str)
    verb("document-text", "id", "file", force=bool)
    verb("document-reassign", "id", "person")
    verb("document-remove", "id", tombstone=bool, reason=str)
    verb("document-reextract", "path", force=bool, allow_shrink=bool)
    verb("tombstones")
    verb("tombstone-add", "sha256", reason=str, note=str)
    verb("tombstone-remove", "sha256")
    verb("ingest", "path", "person", force=bool, category=str, provider=str)
    verb("study-ingest", "path", "person", "blobs", force=bool, allow_large=bool, category=str, provider=str)
    verb("commit", "type", "json", "document")
    verb("conflicts")
    verb("resolve", "id", "keep", note=str, adopt_source=bool, field_choices=str)
    verb("rekey")
    verb("reaffirm", "map")
    verb("record-edit", "type", "id", "fields", note=str, by=str, identity=bool)
    verb("record-remove", "type", "id")
    verb("record-assert", "type", "person", "fields", by=str, on=str)
    verb("annotate", "type", "base", "status", note=str, row=int, merged_into=str, by=str)
    verb("clear-verdict", "type", "base", row=int)
    verb("verdicts")
    verb("orphans")
    verb("verify", cap=int)
    verb("backup", keep_daily=int, keep_weekly=int)
    verb("restore", "snapshot")
    return top


def committed(spark: SparkSession, cat, path: str, record_type: str, document_id: int, dictionary):
    """Payload rows of a JSON array for one document, through the commit split; positions are those in the array."""
    raw = spark.read.option("wholetext", True).text(path).select(F.posexplode(F.from_json("value", "array<string>")).alias("pos", "json"))
    rows = commit.parsed(raw, record_type)
    bad = rows.where(F.size("errors") > 0).select("errors").head()
    if bad:
        raise commit.ValidationError(bad["errors"][0])
    who = cat["document"].where(F.col("document_id") == document_id).select("person_id").head()
    if who is None or who[0] is None:
        raise commit.ValidationError(f"document {document_id} is not there or belongs to nobody")
    rows = rows.select(F.col("pos").cast("long").alias("pos"), F.lit(who[0]).alias("person_id"), F.lit(document_id).cast("long").alias("document_id"), *FIELDS[record_type])
    return commit.commit(cat, record_type, rows, dictionary)


def successors_of(spark: SparkSession, path: str) -> DataFrame:
    """(record_type, old_base, new_base) of a map file: a JSON array, or the array `orphans` of a report; entries without a successor are passed over."""
    entry = "struct<record_type:string,old_base:string,new_base:string>"
    whole = spark.read.option("wholetext", True).text(path)
    rows = F.coalesce(F.from_json(F.get_json_object("value", "$.orphans"), f"array<{entry}>"), F.from_json("value", f"array<{entry}>"))
    return whole.select(F.inline(rows)).where("record_type IS NOT NULL AND old_base IS NOT NULL AND new_base IS NOT NULL")


def choices(text: str | None) -> dict[str, str] | None:
    """field=existing or field=incoming, between commas."""
    if not text:
        return None
    found = dict(pair.strip().partition("=")[::2] for pair in text.split(","))
    if wrong := sorted(v for v in found.values() if v not in ("existing", "incoming")):
        raise ValueError(f"a field is settled as existing or incoming, not {wrong[0]!r}")
    return found


def reads(cat, a: argparse.Namespace, d) -> dict:
    """What each reading verb shows, as functions that make a DataFrame."""
    return {
        "labs": lambda: clinical.public(overlay.visible(overlay.with_verdict(clinical.labs(cat, a.person, a.test, a.since, d), cat, "lab_result"), a.raw)),
        "meds": lambda: clinical.public(overlay.visible(overlay.with_verdict(clinical.medications(cat, a.person, a.active, a.today), cat, "medication"), a.raw)).withColumn("state", F.when(clinical.is_renewal(), "renewed").when(clinical.is_current(a.today), "current").otherwise("ended")),
        "timeline": lambda: overlay.visible(overlay.with_verdict(clinical.timeline(cat, a.person, a.since), cat)).drop("src", "dedup_base", "record_id"),
        "trends": lambda: clinical.trends(cat, a.test, a.person, d),
        "find": lambda: search.find(cat, a.text, a.person).drop("text"),
        "person-list": lambda: registryops.people(cat, a.inactive),
        "person-show": lambda: registryops.person_detail(cat, a.slug),
        "unit-prefs": lambda: registryops.prefs(cat, a.person),
        "document-list": lambda: registryops.documents(cat, a.person),
        "document-show": lambda: registryops.document_detail(cat, int(a.id)),
        "tombstones": lambda: registryops.tombstones(cat),
        "conflicts": lambda: cat["conflict"].where("status = 'open'").orderBy("conflict_id"),
        "verdicts": lambda: registryops.verdict_list(cat),
        "orphans": lambda: registryops.orphans(cat),
        "verify": lambda: registryops.capped(registryops.verify(cat, d), a.cap or 10),
    }


def texts(cat, a: argparse.Namespace, words: dict) -> dict:
    d = words["synonyms"]
    return {
        "summary": lambda: render.summaries(cat, a.today, a.today, d, words["routine"], words["medication_display"]),
        "journal": lambda: render.journals(cat, a.today),
        "curation-record": lambda: render.curations(cat, a.today),
    }


def run(spark: SparkSession, a: argparse.Namespace) -> int:
    words = load_dictionary(a.dictionary)
    d = words["synonyms"]
    if a.verb == "init":
        from .specs import TABLES, schema_of

        cat = snapshots.Catalog(spark, {n: spark.createDataFrame([], schema_of(n)) for n in (*TYPES, *TABLES)})
        snapshots.snapshot(cat, a.store, snapshots.snapshot_name(dt.datetime.now()))
        return 0
    if a.verb == "restore":
        print(snapshots.restore(spark, a.store, a.snapshot))
        return 0
    cat = snapshots.load(spark, a.store)
    if a.verb == "backup":
        name = snapshots.snapshot_name(dt.datetime.now())
        snapshots.snapshot(cat, a.store, name)
        print(json.dumps({"snapshot": name, "removed": snapshots.rotate(spark, a.store, a.keep_daily or 7, a.keep_weekly or 4, protect=name)}))
        return 0
    if a.verb in (found := reads(cat, a, d)):
        return say(found[a.verb]())
    if a.verb in (found := texts(cat, a, words)):
        print(render.person_text(found[a.verb](), cat, a.person))
        return 0
    if a.verb == "brief":
        row = render.briefs(cat, a.today, a.today, d, int(a.appointment), overrides=words["medication_display"]).head()
        print(row["text"] if row else f"no appointment {a.appointment}")
        return 0 if row else 1
    new, report = written(spark, cat, a, d)
    if report is not None:
        say(report)
    if a.apply:
        name = snapshots.snapshot_name(dt.datetime.now())
        snapshots.snapshot(new, a.store, name)
        print(json.dumps({"snapshot": name}))
    else:
        print("dry run; nothing was written")
    return 0


def written(spark: SparkSession, cat, a: argparse.Namespace, d):
    """The catalog after a write verb, and a report."""
    row = int(getattr(a, "row", None) or 0)
    given = {k: v for k, v in vars(a).items() if v is not None}
    some = lambda *names: {n: given[n] for n in names if n in given}
    if a.verb == "ingest":
        return ingest.ingest(cat, decoders.with_text(decoders.files(spark, a.path), a.pdf_reader), a.person, force=a.force, **some("category", "provider"))
    if a.verb == "study-ingest":
        return ingest.ingest_study(cat, a.person, a.path, a.blobs, force=a.force, allow_large=a.allow_large, **some("category", "provider"))
    if a.verb == "document-reextract":
        return ingest.reextracted(cat, decoders.with_text(decoders.files(spark, a.path), a.pdf_reader), a.force, a.allow_shrink)
    if a.verb == "reaffirm":
        return registryops.reaffirm(cat, successors_of(spark, a.map))
    if a.verb == "commit":
        return committed(spark, cat, a.json, a.type, int(a.document), d)
    if a.verb == "rekey":
        new, changes, clashes = commit.rekey(cat, d)
        say(clashes)
        return new, changes
    if a.verb == "record-assert":
        new, state = registryops.assert_record(cat, a.type, a.person, values(a.fields, a.type), a.by, a.on, d)
        print(state)
        return new, None
    verbs = {
        "person-add": lambda: registryops.add_person(cat, a.slug, a.full_name, **some("dob", "sex")),
        "person-edit": lambda: registryops.edit_person(cat, a.slug, **some("full_name", "dob", "notes")),
        "person-deactivate": lambda: registryops.deactivate_person(cat, a.slug, back=a.back),
        "person-remove": lambda: registryops.remove_person(cat, a.slug),
        "unit-pref": lambda: registryops.set_pref(cat, a.person, a.key, a.unit, d) if a.unit else registryops.clear_pref(cat, a.person, a.key, d),
        "document-edit": lambda: registryops.edit_document(cat, int(a.id), **some("doc_date", "category", "provider")),
        "document-text": lambda: registryops.set_text(cat, int(a.id), open(a.file, encoding="utf-8").read(), a.force),
        "document-reassign": lambda: registryops.reassign(cat, int(a.id), a.person, d)[0],
        "tombstone-add": lambda: registryops.add_tombstone(cat, a.sha256, a.reason, a.note),
        "tombstone-remove": lambda: registryops.lift_tombstone(cat, a.sha256),
        "document-remove": lambda: registryops.remove_document(cat, int(a.id), a.tombstone, a.reason),
        "resolve": lambda: commit.resolve(cat, int(a.id), a.keep, a.note, d, choices(a.field_choices), a.adopt_source)[0],
        "record-edit": lambda: registryops.edit_record(cat, a.type, int(a.id), values(a.fields, a.type), a.note or "", a.by, d, a.identity),
        "record-remove": lambda: registryops.remove_record(cat, a.type, int(a.id), d),
        "annotate": lambda: registryops.annotate(cat, a.type, a.base, a.status, a.note or "", row, a.merged_into, a.by),
        "clear-verdict": lambda: registryops.clear_verdict(cat, a.type, a.base, row),
    }
    return verbs[a.verb](), None


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("anamnex").getOrCreate()
    try:
        return run(spark, a)
    except (LookupError, ValueError) as error:
        print(f"error: {error}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
