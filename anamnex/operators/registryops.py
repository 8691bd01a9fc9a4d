"""Verbs on persons, documents, records, verdicts, tombstones and unit preferences.

Each write verb takes a catalog and returns a new one (with a report where there is something to say); reads return
DataFrames. Nothing is stored until a snapshot is written, so that every verb is its own dry run.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import identity, units
from ..functions.dates import doc_date
from ..functions.plan import settled
from ..functions.text import Dictionary, invisible_trim, key_token
from ..plans.catalog import Catalog
from ..plans.scratch import written
from ..specs import COMPARED, FIELDS, KEYS, STATUSES, TYPES, editable, schema_of
from .clinical import person_id
from .commit import DriftError, _same, drifted, next_ids, now_text, updated, conflict_families
from .overlay import ruled_types, with_verdict


class RefusedError(ValueError):
    """The verb would lose or confuse something; nothing was changed."""


def row_frame(catalog: Catalog, table: str, **values) -> DataFrame:
    schema = schema_of(table)
    return catalog.spark.createDataFrame([tuple(values.get(f.name) for f in schema)], schema)


# --- persons


def add_person(catalog: Catalog, slug: str, full_name: str, **more) -> Catalog:
    slug = slug.strip().lower()
    if catalog["person"].where(F.lower("slug") == slug).head():
        raise RefusedError(f"slug {slug!r} is taken")
    new = row_frame(catalog, "person", person_id=next_ids(catalog["person"], "person_id"), slug=slug, full_name=full_name, **more)
    return catalog.with_tables(person=catalog["person"].unionByName(new))


def edit_person(catalog: Catalog, slug: str, **changes) -> Catalog:
    """Partial update; an empty text clears a field."""
    who = person_id(catalog, slug)
    return catalog.with_tables(person=updated(catalog["person"], F.col("person_id") == who, {k: v if v != "" else None for k, v in changes.items()}))


def deactivate_person(catalog: Catalog, slug: str, now: dt.datetime | None = None, back: bool = False) -> Catalog:
    return edit_person(catalog, slug, deactivated_at="" if back else now_text(now))


def dependents(catalog: Catalog) -> DataFrame:
    """(person_id, table_name) of everything that hangs on a person."""
    out = None
    for t in (*TYPES, "document", "conflict", "person_unit_pref"):
        own = catalog[t].where("person_id IS NOT NULL").select("person_id", F.lit(t).alias("table_name")).distinct()
        out = own if out is None else out.unionByName(own)
    return out


def remove_person(catalog: Catalog, slug: str) -> Catalog:
    who = person_id(catalog, slug)
    held = [r[0] for r in dependents(catalog).where(F.col("person_id") == who).select("table_name").orderBy("table_name").collect()]
    if held:
        raise RefusedError(f"{slug} still has rows in {', '.join(held)}; deactivate instead")
    return catalog.with_tables(person=catalog["person"].where(F.col("person_id") != who))


def people(catalog: Catalog, inactive: bool = False) -> DataFrame:
    df = catalog["person"]
    return (df if inactive else df.where("deactivated_at IS NULL")).orderBy("slug")


def person_detail(catalog: Catalog, slug: str) -> DataFrame:
    """One person with counts of records, and their unit preferences."""
    who = person_id(catalog, slug)
    mine = F.col("person_id") == who
    counts = None
    for t in TYPES:
        own = catalog[t].where(mine).groupBy("person_id").agg(F.count("*").alias("n")).withColumn("t", F.lit(t))
        counts = own if counts is None else counts.unionByName(own)
    counts = counts.groupBy("person_id").pivot("t", list(TYPES)).agg(F.sum("n"))
    prefs_ = catalog["person_unit_pref"].where(mine).groupBy("person_id").agg(F.sort_array(F.collect_list(F.struct("key", "unit"))).alias("unit_prefs"))
    return catalog["person"].where(mine).join(prefs_, "person_id", "left").join(counts, "person_id", "left").na.fill(0, list(TYPES))


# --- documents


def document_detail(catalog: Catalog, document_id: int) -> DataFrame:
    """One document with its text, owner, row counts and the open conflicts that concern it."""
    mine = F.col("document_id") == document_id
    text = catalog["document"].where(mine).select("document_id", "ocr_text")
    counted = documents(catalog.with_tables(document=catalog["document"].where(mine), **{t: catalog[t].where(mine) for t in TYPES}))
    return counted.join(text, "document_id").join(document_conflicts(catalog).where(mine), "document_id", "left")


def record_counts(catalog: Catalog) -> DataFrame:
    """Rows of each type by document."""
    out = None
    for t in TYPES:
        own = catalog[t].where("document_id IS NOT NULL").groupBy("document_id").agg(F.count("*").alias("n")).withColumn("t", F.lit(t))
        out = own if out is None else out.unionByName(own)
    return out.groupBy("document_id").pivot("t", list(TYPES)).agg(F.sum("n"))


def documents(catalog: Catalog, slug: str | None = None) -> DataFrame:
    """Documents with owner and row counts, without their text, newest first."""
    df = catalog["document"]
    if slug is not None:
        df = df.where(F.col("person_id") == person_id(catalog, slug))
    df = df.select(*(c for c in df.columns if c != "ocr_text"), (F.length(F.coalesce("ocr_text", F.lit(""))) > 0).alias("has_ocr_text"), F.length("ocr_text").alias("text_chars"))
    out = df.join(catalog["person"].select("person_id", "slug"), "person_id", "left").join(record_counts(catalog), "document_id", "left").na.fill(0, list(TYPES))
    return out.orderBy(F.desc("document_id"))


def document_conflicts(catalog: Catalog) -> DataFrame:
    """(document_id, conflict_ids) of open conflicts that cite a document or stand against one of its rows."""
    open_ = catalog["conflict"].where("status = 'open'")
    cited = open_.where("document_id IS NOT NULL").select("document_id", "conflict_id")
    anchored = None
    for t in TYPES:
        own = catalog[t].where("document_id IS NOT NULL").select("document_id", F.lit(t).alias("record_type"), "dedup_key")
        anchored = own if anchored is None else anchored.unionByName(own)
    both = cited.unionByName(anchored.join(open_.select("record_type", "dedup_key", "conflict_id"), ["record_type", "dedup_key"]).select("document_id", "conflict_id"))
    return both.groupBy("document_id").agg(F.array_sort(F.collect_set("conflict_id")).alias("conflict_ids"))


def without_text(catalog: Catalog) -> DataFrame:
    """Documents whose text is blank or only invisible characters."""
    return catalog["document"].where(invisible_trim(F.coalesce("ocr_text", F.lit(""))) == "").select("document_id", "person_id").orderBy("document_id")


def set_text(catalog: Catalog, document_id: int, text: str, force: bool = False, source: str = "manual") -> Catalog:
    clean = catalog.spark.range(1).select(invisible_trim(F.lit(text)).alias("t")).first()["t"]
    if not clean:
        raise RefusedError("the text is empty")
    mine = F.col("document_id") == document_id
    if not force and not without_text(catalog).where(mine).head():
        raise RefusedError(f"document {document_id} is not there or has a text")
    return catalog.with_tables(document=updated(catalog["document"], mine, {"ocr_text": text, "text_source": source}))


def edit_document(catalog: Catalog, document_id: int, **changes) -> Catalog:
    if changes.get("doc_date"):
        if not catalog.spark.range(1).select(doc_date(F.lit(changes["doc_date"])).alias("d")).first()["d"]:
            raise RefusedError(f"{changes['doc_date']!r} is no date")
    return catalog.with_tables(document=updated(catalog["document"], F.col("document_id") == document_id, {k: v if v != "" else None for k, v in changes.items()}))


def reassign(catalog: Catalog, document_id: int, slug: str, dictionary: Dictionary = None) -> tuple[Catalog, dict[str, int]]:
    """Move a document and its rows to another person. Refused on open conflicts, drifted keys and taken identities."""
    who, mine = person_id(catalog, slug), F.col("document_id") == document_id
    if document_conflicts(catalog).where(mine).head():
        raise RefusedError("open conflicts concern this document")
    tables, counts = {"document": updated(catalog["document"], mine, {"person_id": who})}, {}
    for t in TYPES:
        rows = catalog[t]
        own = rows.where(mine)
        if own.where(identity.dedup_base(t, dictionary) != F.col("dedup_base")).head():
            raise DriftError(f"{t}: stored keys differ from what the dictionary gives; rekey first")
        moved = updated(own, F.lit(True), {"person_id": who}).withColumn("dedup_base", identity.dedup_base(t, dictionary))
        moved = moved.withColumn("dedup_key", identity.occurrence_key(F.col("dedup_base"), F.col("dedup_occurrence"))).select(*rows.columns)
        rest = rows.where(~F.coalesce(mine, F.lit(False)))
        if moved.join(rest.select("dedup_base"), "dedup_base", "left_semi").head():
            raise RefusedError(f"{t}: {slug} already has one of these facts")
        counts[t] = moved.count()
        tables[t] = rest.unionByName(moved)
    return catalog.with_tables(**tables), counts


def remove_document(catalog: Catalog, document_id: int, tombstone: bool = False, reason: str | None = None, note: str | None = None, now: dt.datetime | None = None) -> Catalog:
    """A document, its rows, their verdicts and its open conflicts go; settled conflicts let go of it; a tombstone may stay."""
    mine = F.col("document_id") == document_id
    doc = catalog["document"].where(mine).select("sha256").head()
    if doc is None:
        raise RefusedError(f"no document {document_id}")
    tables = {"document": catalog["document"].where(~mine)}
    verdicts = catalog["curation"]
    for t in TYPES:
        gone = catalog[t].where(mine & (F.col(f"{t}_id") > 0)).select(F.lit(t).alias("record_type"), F.col(f"{t}_id").alias("record_id"))  # 0 stands for a family
        verdicts = verdicts.join(gone, ["record_type", "record_id"], "left_anti").select(*catalog["curation"].columns)
        tables[t] = catalog[t].where(~F.coalesce(mine, F.lit(False)))
    cited = F.coalesce(mine, F.lit(False))
    conflicts = catalog["conflict"].where(~(cited & (F.col("status") == "open")))
    tables |= {"curation": verdicts, "conflict": updated(conflicts, cited, {"document_id": None})}
    out = catalog.with_tables(**tables)
    return add_tombstone(out, doc["sha256"], reason, note, document_id, now) if tombstone else out


# --- tombstones


def add_tombstone(catalog: Catalog, sha256: str, reason: str | None = None, note: str | None = None, document_id: int | None = None, now: dt.datetime | None = None) -> Catalog:
    sha256 = sha256.strip().lower()
    if len(sha256) != 64 or set(sha256) - set("0123456789abcdef"):
        raise RefusedError("a tombstone needs a SHA-256 in hexadecimal")
    if catalog["document"].where(F.col("sha256") == sha256).head():
        raise RefusedError("a document with this content is live")
    new = row_frame(catalog, "document_tombstone", sha256=sha256, removed_at=now_text(now), reason=reason, note=note, document_id=document_id)
    return catalog.with_tables(document_tombstone=catalog["document_tombstone"].where(F.col("sha256") != sha256).unionByName(new))


def lift_tombstone(catalog: Catalog, sha256: str) -> Catalog:
    return catalog.with_tables(document_tombstone=catalog["document_tombstone"].where(F.col("sha256") != sha256.strip().lower()))


def tombstones(catalog: Catalog) -> DataFrame:
    live = catalog["document"].select("sha256", F.col("document_id").alias("live_document_id"))
    return catalog["document_tombstone"].join(live, "sha256", "left").orderBy(F.desc("removed_at"), "sha256")


# --- unit preferences


def set_pref(catalog: Catalog, slug: str, key: str, unit: str, dictionary: Dictionary = None, now: dt.datetime | None = None) -> Catalog:
    who = person_id(catalog, slug)
    got = catalog.spark.range(1).select(key_token(F.lit(key), dictionary).alias("k"), units.canonical_unit(F.lit(unit)).alias("u")).first()
    if got["u"] is None:
        raise RefusedError(f"unknown unit {unit!r}; known are {', '.join(units.known_units())}")
    new = row_frame(catalog, "person_unit_pref", person_id=who, key=got["k"], unit=got["u"], set_at=now_text(now))
    rest = catalog["person_unit_pref"].where(~((F.col("person_id") == who) & (F.col("key") == got["k"])))
    return catalog.with_tables(person_unit_pref=rest.unionByName(new))


def clear_pref(catalog: Catalog, slug: str, key: str, dictionary: Dictionary = None) -> Catalog:
    who = person_id(catalog, slug)
    return catalog.with_tables(person_unit_pref=catalog["person_unit_pref"].where(~((F.col("person_id") == who) & (F.col("key") == key_token(F.lit(key), dictionary)))))


def prefs(catalog: Catalog, slug: str) -> DataFrame:
    return catalog["person_unit_pref"].where(F.col("person_id") == person_id(catalog, slug)).orderBy("key")


# --- verdicts


def _types(catalog: Catalog, ruled: bool) -> tuple[str, ...]:
    return tuple(t for t in TYPES if t in ruled_types(catalog)) or TYPES[-1:] if ruled else TYPES


def families(catalog: Catalog, ruled: bool = False) -> DataFrame:
    """(record_type, dedup_base, owner, label, family_size): owner and label are those of the first occurrence; ruled: only families that a verdict names, as its own or as those merged into."""
    out = None
    for t in _types(catalog, ruled):
        first = F.struct("dedup_occurrence", f"{t}_id")
        rows = catalog[t]
        if ruled:
            own = catalog["curation"].where(F.col("record_type") == t)
            rows = rows.join(own.select(F.explode(F.array("dedup_base", "merged_into_base")).alias("dedup_base")), "dedup_base", "left_semi")
        own = rows.withColumn("label", identity.row_label(t)).groupBy("dedup_base").agg(F.min_by("person_id", first).alias("owner"), F.min_by("label", first).alias("label"), F.count("*").alias("family_size"))
        own = own.select(F.lit(t).alias("record_type"), "*")
        out = own if out is None else out.unionByName(own)
    return out


def labelled_rows(catalog: Catalog, ruled: bool = False) -> DataFrame:
    """(record_type, record_id, live_base, row_owner, row_label) of every record; ruled: only of those that a verdict names."""
    out = None
    for t in _types(catalog, ruled):
        rows = catalog[t]
        if ruled:
            rows = rows.join(catalog["curation"].where(F.col("record_type") == t).select(F.col("record_id").alias(f"{t}_id")), f"{t}_id", "left_semi")
        own = rows.select(F.lit(t).alias("record_type"), F.col(f"{t}_id").alias("record_id"), F.col("dedup_base").alias("live_base"), F.col("person_id").alias("row_owner"), identity.row_label(t).alias("row_label"))
        out = own if out is None else out.unionByName(own)
    return out


def verdict_list(catalog: Catalog) -> DataFrame:
    """Verdicts with what they rule on, newest first."""
    df = catalog["curation"].join(families(catalog, ruled=True), ["record_type", "dedup_base"], "left").join(labelled_rows(catalog, ruled=True), ["record_type", "record_id"], "left")
    row = F.col("record_id") > 0
    return df.select(
        *catalog["curation"].columns, F.when(row, F.col("row_label")).otherwise(F.col("label")).alias("label"), F.coalesce(F.when(row, F.lit(1)).otherwise(F.col("family_size")), F.lit(0)).alias("family_size"), F.when(row, F.col("row_owner")).otherwise(F.col("owner")).alias("owner")
    ).orderBy(F.desc("created_at"), "record_type", "dedup_base", "record_id")


def orphans(catalog: Catalog, live: DataFrame | None = None) -> DataFrame:
    """Verdicts that point at nothing: a family verdict without a live family, a merge into a family that is gone. live: families(), if at hand."""
    live = (families(catalog, ruled=True) if live is None else live).select("record_type", "dedup_base")
    df = catalog["curation"].join(live.withColumn("here", F.lit(True)), ["record_type", "dedup_base"], "left")
    df = df.join(live.select("record_type", F.col("dedup_base").alias("merged_into_base"), F.lit(True).alias("target")), ["record_type", "merged_into_base"], "left")
    lost = F.when((F.col("record_id") == 0) & F.col("here").isNull(), "no-live-family")
    dangling = F.when(F.col("merged_into_base").isNotNull() & F.col("target").isNull(), "dangling-merge-target")
    return df.withColumn("kinds", F.array_compact(F.array(lost, dangling))).where(F.size("kinds") > 0).select(*catalog["curation"].columns, "kinds")


def stale_breadcrumbs(catalog: Catalog, rows: DataFrame | None = None) -> DataFrame:
    """Row verdicts whose row has moved to another base since. rows: labelled_rows(), if at hand."""
    rows = (labelled_rows(catalog, ruled=True) if rows is None else rows).select("record_type", "record_id", "live_base")
    return catalog["curation"].where("record_id > 0").join(rows, ["record_type", "record_id"]).where("live_base <> dedup_base")


def curation_problems(catalog: Catalog) -> DataFrame:
    """(problem, record_type, record_id, dedup_base) of verdicts that can't be right. Records are met once, and only those that verdicts name go on."""
    v = catalog["curation"]
    odd = v.where(~F.col("record_type").isin(*TYPES)).withColumn("problem", F.lit("unknown type"))
    known = v.where(F.col("record_type").isin(*TYPES))
    rows = written(labelled_rows(catalog, ruled=True).select("record_type", "record_id", "live_base", "row_owner"))
    fams = written(families(catalog, ruled=True).select("record_type", "dedup_base", "owner"))
    missing = known.where("record_id > 0").join(rows, ["record_type", "record_id"], "left_anti").withColumn("problem", F.lit("row is gone"))
    moved = stale_breadcrumbs(catalog, rows).withColumn("problem", F.lit("row has moved"))
    kinds = orphans(catalog, fams).select("*", F.explode("kinds").alias("problem"))
    merged = known.where("merged_into_base IS NOT NULL").join(rows.select("record_type", "record_id", "row_owner"), ["record_type", "record_id"], "left").join(fams.select("record_type", "dedup_base", "owner"), ["record_type", "dedup_base"], "left")
    target = fams.select("record_type", F.col("dedup_base").alias("merged_into_base"), F.col("owner").alias("target_owner"))
    cross = merged.join(target, ["record_type", "merged_into_base"]).where(F.when(F.col("record_id") > 0, F.col("row_owner")).otherwise(F.col("owner")) != F.col("target_owner")).withColumn("problem", F.lit("merged across persons"))
    out = None
    for part in (odd, missing, moved, kinds, cross):
        own = part.select("problem", "record_type", "record_id", "dedup_base")
        out = own if out is None else out.unionByName(own)
    return out


def annotate(catalog: Catalog, record_type: str, base: str, status: str, note: str, record_id: int = 0, merged_into_base: str | None = None, attributed_to: str | None = None, allow_cross_person: bool = False, now: dt.datetime | None = None) -> Catalog:
    """Put a verdict on a family (record_id 0) or one row, in place of any that was there."""
    if record_type not in TYPES or status not in STATUSES:
        raise RefusedError(f"unknown type or status: {record_type}, {status}")
    if not (note or "").strip():
        raise RefusedError("a verdict needs a note")
    if (status == "merged-into") != (merged_into_base is not None):
        raise RefusedError("merged-into needs a target, and nothing else has one")
    mine = F.col("record_type") == record_type
    if record_id:
        row = labelled_rows(catalog).where(mine & (F.col("record_id") == record_id)).head()
        if row is None:
            raise RefusedError(f"no {record_type} {record_id}")
        base, owner = row["live_base"], row["row_owner"]
    else:
        family = families(catalog).where(mine & (F.col("dedup_base") == base)).head()
        if family is None:
            raise RefusedError(f"no live family {base[:12]}")
        owner = family["owner"]
    if merged_into_base is not None:
        target = families(catalog).where(mine & (F.col("dedup_base") == merged_into_base)).head()
        if target is None or (merged_into_base == base and not record_id):
            raise RefusedError("the target is no other live family")
        if target["owner"] != owner and not allow_cross_person:
            raise RefusedError("the target belongs to another person")
    new = row_frame(catalog, "curation", record_type=record_type, dedup_base=base, record_id=record_id, status=status, note=note.strip(), merged_into_base=merged_into_base, attributed_to=attributed_to, created_at=now_text(now))
    return clear_verdict(catalog, record_type, base, record_id).with_tables(curation=clear_verdict(catalog, record_type, base, record_id)["curation"].unionByName(new))


def clear_verdict(catalog: Catalog, record_type: str, base: str, record_id: int = 0) -> Catalog:
    scope = F.col("record_id") == record_id if record_id else (F.col("record_id") == 0) & (F.col("dedup_base") == base)
    return catalog.with_tables(curation=catalog["curation"].where(~((F.col("record_type") == record_type) & scope)))


def refresh_breadcrumbs(catalog: Catalog) -> Catalog:
    """Row verdicts name the base that their row has now."""
    stale = stale_breadcrumbs(catalog).select("record_type", "record_id", F.col("live_base").alias("now_base"))
    df = catalog["curation"].join(stale, ["record_type", "record_id"], "left")
    return catalog.with_tables(curation=df.withColumn("dedup_base", F.coalesce("now_base", "dedup_base")).select(*catalog["curation"].columns))


def reaffirm(catalog: Catalog, successors: DataFrame) -> tuple[Catalog, DataFrame]:
    """Point orphaned verdicts at the families that followed theirs: successors (record_type, old_base, new_base).

    Planned as one batch: of two family verdicts that claim one target, the earlier stays first; a target that is not
    live, or that has a family verdict already, is skipped. Returns the catalog and (record_type, dedup_base, record_id, action).
    """
    lost = orphans(catalog)
    own = successors.select("record_type", F.col("old_base").alias("dedup_base"), F.col("new_base").alias("to_base"))
    merge = successors.select("record_type", F.col("old_base").alias("merged_into_base"), F.col("new_base").alias("to_merge"))
    plan = lost.join(own, ["record_type", "dedup_base"], "left").join(merge, ["record_type", "merged_into_base"], "left")
    live = families(catalog).select("record_type", F.col("dedup_base").alias("to_base"), F.lit(True).alias("live"))
    ruled = catalog["curation"].where("record_id = 0").select("record_type", F.col("dedup_base").alias("to_base"), F.lit(True).alias("ruled"))
    plan = plan.join(live, ["record_type", "to_base"], "left").join(ruled, ["record_type", "to_base"], "left")
    family = (F.col("record_id") == 0) & F.array_contains("kinds", "no-live-family")
    claim = F.row_number().over(Window.partitionBy("record_type", "to_base", family).orderBy("created_at", "dedup_base"))
    move_family = family & F.col("live") & F.col("ruled").isNull() & (F.col("claim") == 1)
    plan = plan.withColumn("claim", claim).withColumn("moves", F.coalesce(move_family, F.lit(False)))
    remerge = F.col("to_merge").isNotNull()
    action = F.when(F.col("moves") | (~family & remerge), "reaffirmed").when(F.col("to_base").isNull() & ~remerge, "listed").otherwise("skipped")
    plan = plan.withColumn("action", action)
    done = plan.where("action = 'reaffirmed'").select("record_type", "dedup_base", "record_id", F.when(F.col("moves"), F.col("to_base")).otherwise(F.col("dedup_base")).alias("b2"), F.coalesce("to_merge", "merged_into_base").alias("m2"), F.lit(True).alias("hit"))
    v = catalog["curation"].join(done, ["record_type", "dedup_base", "record_id"], "left")
    v = v.withColumn("dedup_base", F.coalesce("b2", "dedup_base")).withColumn("merged_into_base", F.when(F.col("hit"), F.col("m2")).otherwise(F.col("merged_into_base")))
    return catalog.with_tables(curation=v.select(*catalog["curation"].columns)), plan.select("record_type", "dedup_base", "record_id", "action")


# --- records


def _one(catalog: Catalog, record_type: str, row_id: int) -> dict:
    row = catalog[record_type].where(F.col(f"{record_type}_id") == row_id).head()
    if row is None:
        raise RefusedError(f"no {record_type} {row_id}")
    return row.asDict()


def remove_record(catalog: Catalog, record_type: str, row_id: int, dictionary: Dictionary = None) -> Catalog:
    """One row and its row verdict go; refused while an open conflict stands against its family."""
    row = _one(catalog, record_type, row_id)
    if conflict_families(catalog, record_type, dictionary).where(F.col("base") == row["dedup_base"]).head():
        raise RefusedError("an open conflict stands against this family")
    mine = (F.col("record_type") == record_type) & (F.col("record_id") == row_id)
    return catalog.with_tables(**{record_type: catalog[record_type].where(F.col(f"{record_type}_id") != row_id), "curation": catalog["curation"].where(~mine)})


def edit_record(catalog: Catalog, record_type: str, row_id: int, changes: dict, note: str, attributed_to: str | None = None, dictionary: Dictionary = None, identity_too: bool = False, now: dt.datetime | None = None) -> Catalog:
    """Change fields of a row, with a ledger entry for each and a mark on the row. Key fields only with identity_too, which moves the row."""
    before = _one(catalog, record_type, row_id)
    allowed = FIELDS[record_type] if identity_too else editable(record_type)
    if wrong := sorted(set(changes) - set(allowed)):
        raise RefusedError(f"not editable: {', '.join(wrong)}")
    changes = {k: None if v == "" else v for k, v in changes.items()}
    changed = {k: v for k, v in changes.items() if before[k] != v}
    if not changed:
        return catalog
    pk, stamp = f"{record_type}_id", now_text(now)
    mine = F.col(pk) == row_id
    table = updated(catalog[record_type], mine, {**changed, "edited_at": stamp, "edited_by": attributed_to})
    if set(changed) & set(KEYS[record_type]):
        table = _moved(catalog, table, record_type, row_id, before, dictionary)
    start = next_ids(catalog["record_edit"], "record_edit_id")
    entries = [
        (start + k, record_type, row_id, before["dedup_base"], f, None if before[f] is None else str(before[f]), None if v is None else str(v), note, attributed_to, stamp) for k, (f, v) in enumerate(sorted(changed.items()))
    ]
    ledger = catalog.spark.createDataFrame(entries, schema_of("record_edit"))
    return catalog.with_tables(**{record_type: table, "record_edit": catalog["record_edit"].unionByName(ledger)})


def _moved(catalog: Catalog, table: DataFrame, record_type: str, row_id: int, before: dict, dictionary: Dictionary) -> DataFrame:
    pk = f"{record_type}_id"
    if catalog[record_type].where((F.col(pk) == row_id) & (identity.dedup_base(record_type, dictionary) != F.col("dedup_base"))).head():
        raise DriftError("the row's key differs from what the dictionary gives; rekey first")
    after = table.where(F.col(pk) == row_id).withColumn("b", identity.dedup_base(record_type, dictionary)).first().asDict()
    family = [r.asDict() for r in catalog[record_type].where((F.col("dedup_base") == after["b"]) & (F.col(pk) != row_id)).collect()]
    if any(_same(record_type, f, after) for f in family):
        raise RefusedError("a row that says the same is already there")
    occurrence = max((f["dedup_occurrence"] for f in family), default=-1) + 1
    mine = F.col(pk) == row_id
    table = updated(table, mine, {"dedup_base": after["b"], "dedup_occurrence": occurrence})
    return table.withColumn("dedup_key", F.when(mine, identity.occurrence_key(F.col("dedup_base"), F.col("dedup_occurrence"))).otherwise(F.col("dedup_key"))).select(*catalog[record_type].columns)


def edits(catalog: Catalog, record_type: str | None = None) -> DataFrame:
    """The ledger, newest first, with the label that its row has now."""
    df = catalog["record_edit"]
    if record_type:
        df = df.where(F.col("record_type") == record_type)
    rows = labelled_rows(catalog).select("record_type", "record_id", F.col("row_label").alias("label"))
    return df.join(rows, ["record_type", "record_id"], "left").orderBy(F.desc("edited_at"), F.desc("record_edit_id"))


def assert_record(catalog: Catalog, record_type: str, slug: str, payload: dict, attributed_to: str, attested_on: str, dictionary: Dictionary = None, now: dt.datetime | None = None) -> tuple[Catalog, str]:
    """A row on someone's word. 'duplicate' if the family holds the same; refused if it holds something else, unless verdicts have freed it."""
    from .commit import ValidationError, errors

    who, pk = person_id(catalog, slug), f"{record_type}_id"
    new = row_frame(catalog, record_type, **payload, person_id=who, attested_by=attributed_to, attested_on=attested_on, attested_at=now_text(now))
    bad = new.select(errors(record_type).alias("e")).first()["e"]
    if bad or set(payload) - set(FIELDS[record_type]):
        raise ValidationError("; ".join(bad) or "unknown fields")
    base = new.select(identity.dedup_base(record_type, dictionary).alias("b")).first()["b"]
    if drifted(catalog, record_type, catalog.spark.createDataFrame([(base,)], "dedup_base string"), dictionary).head():
        raise DriftError("rekey first")
    family = with_verdict(catalog[record_type].where(F.col("dedup_base") == base), catalog, record_type).collect()
    held = [f for f in family if f["_curation"] is None or f["_curation"]["status"] not in ("superseded", "erroneous-in-source", "merged-into", "distinct")]
    whole = {f: payload.get(f) for f in FIELDS[record_type]}
    if any(_same(record_type, f.asDict(), whole) for f in held):
        return catalog, "duplicate"
    if held:
        raise RefusedError("the identity is taken by a row that says something else")
    occurrence = max((f["dedup_occurrence"] for f in family), default=-1) + 1
    new = updated(new, F.lit(True), {pk: next_ids(catalog[record_type], pk), "dedup_base": base, "dedup_occurrence": occurrence})
    new = new.withColumn("dedup_key", identity.occurrence_key(F.col("dedup_base"), F.col("dedup_occurrence"))).select(*catalog[record_type].columns)
    return catalog.with_tables(**{record_type: catalog[record_type].unionByName(new)}), "new"


def attested(catalog: Catalog, superseded: bool = False) -> DataFrame:
    """Rows on someone's word; superseded ones have got a document since."""
    out = None
    for t in TYPES:
        own = catalog[t].where("attested_by IS NOT NULL").select(F.lit(t).alias("record_type"), F.col(f"{t}_id").alias("record_id"), "person_id", "document_id", "attested_by", "attested_on", "attested_at", identity.row_label(t).alias("label"))
        out = own if out is None else out.unionByName(own)
    out = out.withColumn("state", F.when(F.col("document_id").isNull(), "attested").otherwise("superseded"))
    out = out if superseded else out.where("state = 'attested'")
    return out.join(catalog["person"].select("person_id", "slug"), "person_id", "left").orderBy("attested_at", "record_type", "record_id")


def table_counts(catalog: Catalog) -> DataFrame:
    out = None
    for name in sorted(catalog.tables):
        own = catalog[name].agg(F.count("*").alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        out = own if out is None else out.unionByName(own)
    return out


def doubled_keys(rows: DataFrame) -> DataFrame:
    """n, rows that hold one key, of each key that several hold. Keys travel as the 32 bytes that their hex digits stand for; any other key as it is."""
    keys = settled(rows.where("dedup_key IS NOT NULL"), __key=F.col("dedup_key")).select("__key")
    digest = F.when(F.col("__key").rlike("^[0-9a-f]{64}$"), F.unhex("__key"))
    return settled(keys, __digest=digest).groupBy("__digest", F.when(F.col("__digest").isNull(), F.col("__key")).alias("__other")).agg(F.count("*").alias("n")).where("n > 1").select("n")


def verify(catalog: Catalog, dictionary: Dictionary = None) -> DataFrame:
    """(check_name, severity, subject, message) of everything that looks wrong."""
    from .sections import odd_statuses, undated_beside_dated

    ruled = curation_problems(catalog).select(F.lit("curation").alias("check_name"), F.lit("warning").alias("severity"), F.concat_ws(" ", "record_type", F.col("record_id").cast("string")).alias("subject"), F.col("problem").alias("message"))
    meds = odd_statuses(catalog).select(F.lit("medication status"), F.lit("notice"), F.col("medication_id").cast("string"), F.concat(F.lit("status "), "status"))
    conds = undated_beside_dated(catalog, dictionary).select(F.lit("conditions"), F.lit("notice"), F.concat_ws(" ", F.col("person_id").cast("string"), "token"), F.concat(F.col("undated").cast("string"), F.lit(" undated beside "), F.col("dated").cast("string"), F.lit(" dated")))
    doubles = None
    for t in TYPES:
        own = doubled_keys(catalog[t]).select(F.lit("keys"), F.lit("error"), F.lit(t), F.concat(F.lit("key held by "), F.col("n").cast("string"), F.lit(" rows")))
        doubles = own if doubles is None else doubles.union(own)
    return ruled.union(meds).union(conds).union(doubles)


def capped(problems: DataFrame, most: int = 10) -> DataFrame:
    """The first problems of each check, and a row that says how many more there are."""
    place = F.row_number().over(Window.partitionBy("check_name").orderBy("severity", "subject", "message"))
    ranked = problems.withColumn("place", place).withColumn("total", F.count("*").over(Window.partitionBy("check_name")))
    more = F.concat(F.lit("... and "), (F.col("total") - most).cast("string"), F.lit(" more"))
    past = F.col("place") > most
    shown = ranked.where(F.col("place") <= most + 1)
    return shown.select("check_name", "severity", F.when(past, "").otherwise(F.col("subject")).alias("subject"), F.when(past, more).otherwise(F.col("message")).alias("message"), "place").orderBy("check_name", "place").drop("place")


def blob_checks(catalog: Catalog, blobs: DataFrame) -> DataFrame:
    """ok, missing and mismatched blobs of documents; blobs: (source_path, sha256)."""
    have = blobs.select("source_path", F.col("sha256").alias("found"))
    df = catalog["document"].join(have, "source_path", "left")
    return df.agg(F.count("*").alias("checked"), F.count_if(F.col("found") == F.col("sha256")).alias("ok"), F.count_if(F.col("found").isNull()).alias("missing"), F.count_if(F.col("found") != F.col("sha256")).alias("mismatched"))


def coerced(text: Column) -> Column:
    """A field value given as text: empty is null; numbers as numbers, through a struct of both readings."""
    value = F.nullif(text, F.lit(""))
    return F.struct(value.alias("text"), value.try_cast("double").alias("number"))


assert set(COMPARED) == set(TYPES)
