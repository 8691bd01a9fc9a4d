"""From extracted rows to records: validation, the commit split, conflicts and their resolution, rekeying.

Families (rows of one identity) are independent of each other. What depends on the order of submission within a family
is a fold over that family alone, fed by a cogroup on the identity; everything else is column expressions.
"""

from __future__ import annotations

import datetime as dt
import json
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import identity
from ..functions.dates import has_time, is_iso_date
from ..functions.plan import numbered
from ..functions.text import Dictionary, enum_token, is_blank, loose_unit
from ..plans.catalog import Catalog
from ..plans.scratch import written
from ..specs import APPENDIX, COMPARED, DATES, ENUMS, FIELDS, NUMBER, OBS_REQUIRED, OBS_TIMED, REQUIRED, RESOLVING, SPARSE, SYMPTOM, SYMPTOM_RANGE, TYPES, schema_of
from .overlay import VERDICT, with_verdict


class ValidationError(ValueError):
    """Rows break the rules of their type."""


class DriftError(ValueError):
    """Stored keys no longer follow from the dictionary; rekey first."""


class ResolutionError(ValueError):
    """A conflict can't be settled as asked."""


def now_text(now: dt.datetime | None = None) -> str:
    return (now or dt.datetime.now(dt.timezone.utc)).isoformat(timespec="seconds")


# --- validation


def errors(record_type: str) -> Column:
    """Array of what is wrong with a row of payload columns."""
    found: list[Column] = [F.when(F.col(f).isNull(), F.lit(f"{record_type}: missing required field '{f}'")) for f in REQUIRED[record_type]]
    for f in DATES[record_type]:
        found.append(F.when(F.col(f).isNotNull() & ~is_iso_date(F.col(f)), F.concat(F.lit(f"{record_type}.{f}: expected an ISO date, got "), F.col(f))))
    for (kind, f), allowed in ENUMS.items():
        if kind == record_type:
            found.append(F.when(F.col(f).isNotNull() & ~enum_token(F.col(f)).isin(*allowed), F.concat(F.lit(f"{record_type}.{f}: expected one of {', '.join(allowed)}, got "), F.col(f))))
    if record_type == "observation":
        for kind, need in OBS_REQUIRED.items():
            for f in need:
                found.append(F.when((F.col("obs_type") == kind) & is_blank(F.col(f)), F.lit(f"observation: missing required field '{f}' for obs_type='{kind}'")))
        timed = F.col("obs_type").isin(*OBS_TIMED) & F.col("observed_at").isNotNull() & ~has_time(F.col("observed_at"))
        found.append(F.when(timed, F.lit("observation.observed_at: this obs_type requires a time of day")))
        low, high = SYMPTOM_RANGE
        found.append(F.when((F.col("obs_type") == SYMPTOM) & ~F.col("value_num").between(low, high), F.lit(f"observation.value_num: expects a severity in {low:g}-{high:g}")))
    return F.array_compact(F.array(*found))


def parsed(raw: DataFrame, record_type: str, column: str = "json") -> DataFrame:
    """Payload columns and errors of JSON rows; unknown fields and wrong kinds of values are errors."""
    known = F.array(*map(F.lit, FIELDS[record_type]))
    keys = F.coalesce(F.json_object_keys(F.col(column)), F.array().cast("array<string>"))
    unknown = F.array_sort(F.array_except(keys, known))
    odd = F.when(F.size(unknown) > 0, F.concat(F.lit(f"{record_type}: unknown field(s): "), F.array_join(unknown, ", ")))
    value = F.try_parse_json(F.col(column))
    wrong = []
    for f, kind in FIELDS[record_type].items():
        form = F.schema_of_variant(F.try_variant_get(value, f"$.{f}", "variant"))
        fits = form.isin("STRING", "VOID") if kind != NUMBER else form.rlike("^(VOID|BIGINT|DOUBLE|FLOAT|DECIMAL.*)$")
        wrong.append(F.when(form.isNotNull() & ~fits, F.lit(f"{record_type}.{f}: wrong kind of value")))
    df = raw.withColumn("p", F.from_json(column, ", ".join(f"`{n}` {k}" for n, k in FIELDS[record_type].items())))
    df = df.select("*", "p.*").withColumn("errors", F.concat(F.array_compact(F.array(odd, *wrong)), errors(record_type)))
    return df.drop("p")


def clashes(rows: DataFrame, record_type: str, dictionary: Dictionary = None) -> DataFrame:
    """Rows (with person_id and pos) of one identity in one submission that differ from the first of it."""
    order = Window.partitionBy("dedup_base").orderBy("pos")
    fields = [f for f in FIELDS[record_type]]
    df = rows.withColumn("dedup_base", identity.dedup_base(record_type, dictionary))
    df = df.withColumn("first", F.first(F.struct("pos", *fields)).over(order))
    equal = identity.rows_equal(record_type, lambda f: F.col(f"first.{f}"), lambda f: F.col(f))
    return df.where(~equal).select("dedup_base", F.col("first.pos").alias("first_pos"), "pos", identity.identity_label(record_type, dictionary).alias("label"))


def drifted(catalog: Catalog, record_type: str, bases: DataFrame, dictionary: Dictionary = None) -> DataFrame:
    """Stored rows that now belong to one of the bases but hold another base."""
    stored = catalog[record_type].withColumn("now_base", identity.dedup_base(record_type, dictionary))
    return stored.join(bases.select(F.col("dedup_base").alias("now_base")).distinct(), "now_base", "left_semi").where("now_base <> dedup_base")


# --- commit


def _agree(field: str, kind: str, a, b) -> bool:
    if field == "unit":
        return str(a or "").strip().lower() == str(b or "").strip().lower()
    return float(a) == float(b) if kind == NUMBER and a is not None and b is not None else a == b


def _none(v):
    return None if v is None or (isinstance(v, float) and v != v) else v


def _same(record_type: str, stored: dict, incoming: dict) -> bool:
    for f in COMPARED[record_type]:
        a, b = stored.get(f), incoming.get(f)
        if (a is None and b is None) or (record_type in SPARSE and (a is None or b is None)):
            continue
        if not _agree(f, FIELDS[record_type][f], a, b):
            return False
    return True


OUTCOMES = "pos bigint, dedup_base string, outcome string, target_id bigint, gains string, existing_json string"


def outcomes(stored: DataFrame, incoming: DataFrame, record_type: str) -> DataFrame:
    """What becomes of each incoming row (pos, dedup_base, payload): new, duplicate, enriched, promoted or conflict.

    Each row sees what the rows of its family before it did. target_id is the stored row concerned; a row that meets one
    which came in with the same submission has target_id null. Only in sparse types does a row change what the next one
    meets, so only their families are folded in order; the others are joins and aggregates.
    """
    if record_type not in SPARSE:
        return plain_outcomes(stored, incoming, record_type)
    fields, pk = list(FIELDS[record_type]), f"{record_type}_id"
    incoming = incoming.select(*(F.col(c).alias(c) for c in incoming.columns))  # both sides may come from one table

    def fold(old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        family = [{k: _none(v) for k, v in r.items()} for r in old.sort_values(["dedup_occurrence", pk]).to_dict("records")]
        out = []
        for row in new.sort_values("pos").to_dict("records"):
            row = {k: _none(v) for k, v in row.items()}
            pay = {f: row[f] for f in fields}
            base = row["dedup_base"]
            if not family:
                family.append({**pay, pk: None, "attested_by": None, "document_id": row["document_id"]})
                out.append((row["pos"], base, "new", None, None, None))
                continue
            twin = next((f for f in family if _same(record_type, f, pay)), None)
            if twin is None:
                out.append((row["pos"], base, "conflict", family[0][pk], None, json.dumps({f: family[0].get(f) for f in fields})))
                continue
            promoted = twin.get("attested_by") is not None and twin.get("document_id") is None
            gains = {f: pay[f] for f in COMPARED[record_type] if twin.get(f) is None and pay[f] is not None} if record_type in SPARSE else {}
            if promoted:
                twin["document_id"] = row["document_id"]
                out.append((row["pos"], base, "promoted", twin[pk], None, None))
            if gains:
                twin.update(gains)
                out.append((row["pos"], base, "enriched", twin[pk], json.dumps(gains), None))
            elif not promoted:
                out.append((row["pos"], base, "duplicate", twin[pk], None, None))
        frame = pd.DataFrame(out, columns=["pos", "dedup_base", "outcome", "target_id", "gains", "existing_json"])
        frame["target_id"] = frame["target_id"].astype("Int64")
        return frame

    keep = stored.select(pk, "dedup_base", "dedup_occurrence", "document_id", "attested_by", *fields)
    keep = keep.join(incoming.select("dedup_base").distinct(), "dedup_base", "left_semi")
    return keep.groupBy("dedup_base").cogroup(incoming.select("pos", "dedup_base", "document_id", *fields).groupBy("dedup_base")).applyInPandas(fold, OUTCOMES)


def digest(text: Column) -> Column:
    """128 bits of a text's SHA-256: what rows are dealt and compared by in place of long texts."""
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def said(record_type: str) -> Column:
    """A digest of the compared fields; two rows of a type that is not sparse agree if theirs are equal."""
    kinds = FIELDS[record_type]
    same = ((loose_unit(F.col(f)) if f == "unit" else F.col(f).cast("double") + F.lit(0.0) if kinds[f] == NUMBER else F.col(f)).alias(f) for f in COMPARED[record_type])
    return digest(F.to_json(F.struct(*same), {"ignoreNullFields": "false"}))


def plain_outcomes(stored: DataFrame, incoming: DataFrame, record_type: str, *more: str) -> DataFrame:
    """outcomes() where rows agree on all compared fields or not at all, so that a family never changes but by its first row; with more columns of the incoming rows.

    Stored and incoming rows go to their families in one shuffle and are compared by digests. Payloads and further columns
    go with them only where they are asked for.
    """
    fields, pk = list(FIELDS[record_type]), f"{record_type}_id"
    key, none = digest(F.col("dedup_base")).alias("key"), F.lit(None)
    payload = F.struct(*fields).alias("payload")
    unsourced = F.col("attested_by").isNotNull() & F.col("document_id").isNull()
    new = incoming.select(key, said(record_type).alias("says"), F.struct(F.lit(0), F.col("pos").cast("bigint")).alias("at"), F.lit(False).alias("unsourced"), payload, "pos", "dedup_base", *(c for c in more))
    extra = (none.cast(incoming.schema[c].dataType).alias(c) for c in ("pos", "dedup_base", *more))
    old = stored.select(key, said(record_type).alias("says"), F.struct(F.coalesce("dedup_occurrence", F.lit(-1)), F.col(pk).cast("bigint")).alias("at"), unsourced.alias("unsourced"), payload, *extra)
    old, new = (df.withColumn("is_old", F.lit(x)).withColumn("at", F.col("at").cast("struct<occurrence:int,id:bigint>")) for df, x in ((old, True), (new, False)))
    family, twins = Window.partitionBy("key"), Window.partitionBy("key", "says")
    old_at, new_at = F.when(F.col("is_old"), F.col("at")), F.when(~F.col("is_old"), F.col("at"))
    df = old.unionByName(new).select(
        "*", F.min(old_at).over(family).alias("head"), F.min(new_at).over(family).alias("first"), F.min_by("says", new_at).over(family).alias("first_says"), F.min_by("payload", old_at).over(family).alias("head_payload"), F.min_by("payload", new_at).over(family).alias("first_payload"),
        F.min(old_at).over(twins).alias("twin"), F.min_by("unsourced", old_at).over(twins).alias("sourceless"), F.min(new_at).over(twins).alias("sourcing"),
    ).where("NOT is_old")
    fresh, at = F.col("head").isNull(), F.col("at.id")
    outcome = (
        F.when(fresh & (F.col("first.id") == at), "new").when(fresh & (F.col("first_says") == F.col("says")), "duplicate").when(F.col("sourceless") & (F.col("sourcing.id") == at), "promoted")
        .when(F.col("twin").isNotNull(), "duplicate").otherwise("conflict")
    )
    target = F.when(~fresh, F.coalesce("twin.id", "head.id"))
    existing = F.when(outcome == "conflict", F.to_json(F.when(fresh, F.col("first_payload")).otherwise(F.col("head_payload")), {"ignoreNullFields": "false"}))
    return df.select("pos", "dedup_base", outcome.alias("outcome"), target.alias("target_id"), none.cast("string").alias("gains"), existing.alias("existing_json"), *more)


def next_ids(df: DataFrame, pk: str) -> int:
    return (df.agg(F.max(pk)).first()[0] or 0) + 1


def commit(catalog: Catalog, record_type: str, rows: DataFrame, dictionary: Dictionary = None, now: dt.datetime | None = None) -> tuple[Catalog, DataFrame]:
    """Admit payload rows (pos, person_id, document_id, fields), all or none. Returns the catalog and the outcome of each row.

    Raises on rule breaks, on differing rows of one identity in the submission, and on drifted keys.
    """
    sparse = record_type in SPARSE
    bad = rows.select("pos", errors(record_type).alias("e")).where(F.size("e") > 0).orderBy("pos").head()
    if bad:
        raise ValidationError(f"row {bad['pos']}: {bad['e'][0]}")
    incoming = rows.withColumn("dedup_base", identity.dedup_base(record_type, dictionary))
    says = said(record_type)
    differ = sparse or not incoming.groupBy(digest(F.col("dedup_base"))).agg(F.min(says).alias("a"), F.max(says).alias("b")).where("a <> b").isEmpty()
    if differ and (clash := clashes(rows, record_type, dictionary).orderBy("pos").head()):
        raise ValidationError(f"{record_type}: rows {clash['first_pos']} and {clash['pos']} of this submission name the same fact ({clash['label']}) but carry different values")
    moved = catalog[record_type].where(identity.dedup_base(record_type, dictionary) != F.col("dedup_base"))
    if not moved.isEmpty() and drifted(catalog, record_type, incoming, dictionary).head():
        raise DriftError(f"{record_type}: stored keys differ from what the dictionary gives; rekey first")
    stored, pk = catalog[record_type], f"{record_type}_id"
    fields = list(FIELDS[record_type])
    if sparse:
        found = outcomes(stored, incoming, record_type)
        met = incoming.join(found.select("pos", "outcome", "target_id", "existing_json"), "pos")
    else:
        met = written(plain_outcomes(stored, incoming, record_type, *(c for c in incoming.columns if c not in ("pos", "dedup_base"))))
        found = met.select("pos", "dedup_base", "outcome", "target_id", "gains", "existing_json")
    fresh = numbered(met.where("outcome = 'new'").drop("outcome", "target_id", "existing_json", "gains"), pk, next_ids(stored, pk), "pos")
    # a row that enriches one of the same submission adds to it by identity
    gains = found.where("outcome = 'enriched'").select("dedup_base", "target_id", F.from_json("gains", ", ".join(f"`{f}` {FIELDS[record_type][f]}" for f in COMPARED[record_type])).alias("g"))
    picked = [F.first(F.col(f"g.{f}"), ignorenulls=True).alias(f"g_{f}") for f in COMPARED[record_type]]
    promoted = met.where("outcome = 'promoted'").select(F.col("target_id").alias(pk), F.col("document_id").alias("p_document"))
    base = F.col("dedup_base")
    columns = [f.name for f in schema_of(record_type)]
    added = fresh.withColumn("dedup_key", base).withColumn("dedup_occurrence", F.lit(0))
    added = added.select(*((F.col(c) if c in added.columns else F.lit(None)).cast(schema_of(record_type)[c].dataType).alias(c) for c in columns))

    def enriched(df: DataFrame, extra: DataFrame, key: str) -> DataFrame:
        out = df.join(extra, key, "left")
        return out.select(*(F.coalesce(c, f"g_{c}").alias(c) if f"g_{c}" in out.columns else F.col(c) for c in columns))

    old = stored.select(*columns)
    if sparse:
        old = enriched(stored, gains.where("target_id IS NOT NULL").groupBy(F.col("target_id").alias(pk)).agg(*picked), pk)
        added = enriched(added, gains.where("target_id IS NULL").groupBy("dedup_base").agg(*picked), "dedup_base")
    if sparse or not promoted.isEmpty():
        old = old.join(promoted, pk, "left").withColumn("document_id", F.coalesce("document_id", "p_document")).select(*columns)
    conflicts = met.where("outcome = 'conflict'")
    conflicts = numbered(conflicts, "conflict_id", next_ids(catalog["conflict"], "conflict_id"), "pos")
    staged = conflicts.select(
        "conflict_id", F.lit(record_type).alias("record_type"), F.col("dedup_base").alias("dedup_key"), "person_id", "document_id",
        "existing_json", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("incoming_json"), F.lit("open").alias("status"), F.lit(None).cast("string").alias("resolution"),
        F.lit(now_text(now)).alias("detected_at"), F.lit(None).cast("string").alias("resolved_at"),
    )
    return catalog.with_tables(**{record_type: old.unionByName(added), "conflict": catalog["conflict"].unionByName(staged)}), found


def outcome_counts(found: DataFrame) -> DataFrame:
    names = ["new", "duplicate", "enriched", "conflict", "promoted"]
    return found.groupBy().agg(*(F.count_if(F.col("outcome") == n).alias(n) for n in names))


# --- conflicts


def merge_plan(record_type: str, stored: dict, incoming: dict, choices: dict[str, str] | None = None) -> dict[str, list]:
    """Per compared field: taken, preserved, agreed, settled by choice, or colliding."""
    plan: dict = {"taken": {}, "preserved": [], "settled": {}, "collisions": []}
    for f in COMPARED[record_type]:
        a, b, side = stored.get(f), incoming.get(f), (choices or {}).get(f)
        if b is None:
            if a is not None:
                plan["preserved"].append(f)
        elif a is None:
            plan["taken"][f] = b
        elif not _agree(f, FIELDS[record_type][f], a, b):
            if side is None:
                plan["collisions"].append(f)
                continue
            plan["settled"][f] = side
            if side == "incoming":
                plan["taken"][f] = b
            else:
                plan["preserved"].append(f)
    return plan


KEEPS = ("existing", "incoming", "both", "merge")


def conflict_bases(catalog: Catalog, record_type: str, dictionary: Dictionary = None) -> DataFrame:
    """(conflict_id, staged, derived) of open conflicts: the staged key, and the base that the incoming row has now."""
    fields = ", ".join(f"`{n}` {k}" for n, k in FIELDS[record_type].items())
    open_ = catalog["conflict"].where((F.col("record_type") == record_type) & (F.col("status") == "open"))
    now = open_.select("conflict_id", "person_id", F.col("dedup_key").alias("staged"), F.from_json("incoming_json", fields).alias("p")).select("conflict_id", "person_id", "staged", "p.*")
    return now.select("conflict_id", "staged", F.coalesce(identity.dedup_base(record_type, dictionary), "staged").alias("derived"))


def conflict_families(catalog: Catalog, record_type: str, dictionary: Dictionary = None) -> DataFrame:
    """(conflict_id, base, size, anchor_id) of open conflicts: the staged key where rows still live under it, else the base that the incoming row has now."""
    now = conflict_bases(catalog, record_type, dictionary)
    pk = f"{record_type}_id"
    live = catalog[record_type].groupBy("dedup_base").agg(F.count("*").alias("n"), F.min_by(pk, F.struct("dedup_occurrence", pk)).alias("anchor"))
    staged = live.select(F.col("dedup_base").alias("staged"), F.col("n").alias("n1"), F.col("anchor").alias("a1"))
    derived = live.select(F.col("dedup_base").alias("derived"), F.col("n").alias("n2"), F.col("anchor").alias("a2"))
    df = now.join(staged, "staged", "left").join(derived, "derived", "left")
    return df.select("conflict_id", F.when(F.col("n1").isNotNull(), F.col("staged")).otherwise(F.col("derived")).alias("base"), F.coalesce("n1", "n2", F.lit(0)).alias("size"), F.coalesce("a1", "a2").alias("anchor_id"))


def resolve(catalog: Catalog, conflict_id: int, keep: str, note: str | None = None, dictionary: Dictionary = None, fields: dict[str, str] | None = None, adopt_source: bool = False, now: dt.datetime | None = None) -> tuple[Catalog, dict]:
    """Settle one open conflict: keep the existing row, the incoming one, both, or a merge of them."""
    if keep not in KEEPS:
        raise ResolutionError(f"keep must be one of {', '.join(KEEPS)}")
    if fields and keep != "merge":
        raise ResolutionError("choices by field only go with a merge")
    if adopt_source and keep != "existing":
        raise ResolutionError("the source can only be adopted when the existing row is kept")
    row = catalog["conflict"].where(F.col("conflict_id") == conflict_id).head()
    if row is None or row["status"] != "open":
        raise ResolutionError(f"conflict {conflict_id} is {'not there' if row is None else row['status']}")
    t, pk = row["record_type"], f"{row['record_type']}_id"
    incoming = {f: json.loads(row["incoming_json"]).get(f) for f in FIELDS[t]}
    own = catalog.with_tables(conflict=catalog["conflict"].where(F.col("conflict_id") == conflict_id))
    bases = conflict_bases(own, t, dictionary).first()
    own = own.with_tables(**{t: catalog[t].where(F.col("dedup_base").isin(bases["staged"], bases["derived"]))})  # no other family is grouped
    place = conflict_families(own, t, dictionary).first()
    family = [r.asDict() for r in catalog[t].where(F.col("dedup_base") == place["base"]).orderBy("dedup_occurrence", pk).collect()]  # rows of one fact
    out: dict = {"kept": keep, "record_type": t, "row_id": None, "no_op": False, "occurrence": None}
    if keep != "both" and (keep != "existing" or adopt_source) and not family:
        raise ResolutionError(f"conflict {conflict_id} has no live row to apply to")
    changes: dict = {}
    table = catalog[t]
    if keep == "incoming":
        out["row_id"] = family[0][pk]
        changes = {f: incoming[f] for f in COMPARED[t] if t not in SPARSE or incoming[f] is not None} | {"document_id": row["document_id"]}
    elif keep == "merge":
        plan = merge_plan(t, family[0], incoming, fields)
        if plan["collisions"]:
            raise ResolutionError(f"fields still to settle: {', '.join(plan['collisions'])}")
        if stale := sorted(set(fields or {}) - set(plan["settled"])):
            raise ResolutionError(f"nothing to settle in: {', '.join(stale)}")
        out |= {"row_id": family[0][pk], "plan": plan}
        changes = plan["taken"] | {"document_id": row["document_id"]}
    elif keep == "existing" and adopt_source:
        if family[0]["document_id"] is not None:
            raise ResolutionError("the row has a source document already")
        out["row_id"] = family[0][pk]
        changes = {"document_id": row["document_id"]}
    elif keep == "both":
        twin = next((f for f in family if _same(t, f, incoming)), None)
        if twin:
            out |= {"row_id": twin[pk], "no_op": True}
            changes = {f: incoming[f] for f in COMPARED[t] if t in SPARSE and twin.get(f) is None and incoming[f] is not None}
        else:
            occurrence = max((f["dedup_occurrence"] for f in family), default=-1) + 1
            new = catalog.spark.createDataFrame([{**incoming, pk: next_ids(table, pk), "person_id": row["person_id"], "document_id": row["document_id"], "dedup_base": place["base"], "dedup_occurrence": occurrence}], schema_of(t))
            new = new.withColumn("dedup_key", identity.occurrence_key(F.col("dedup_base"), F.col("dedup_occurrence")))
            out |= {"occurrence": occurrence, "row_id": new.first()[pk]}
            table = table.unionByName(new)
    if changes:
        table = updated(table, F.col(pk) == out["row_id"], changes)
    text = f"kept {keep}" + (f": {note}" if note else "")
    settled = updated(catalog["conflict"], F.col("conflict_id") == conflict_id, {"status": "resolved", "resolution": text, "resolved_at": now_text(now)})
    return catalog.with_tables(**{t: table, "conflict": settled}), out


def updated(df: DataFrame, where: Column, changes: dict) -> DataFrame:
    """The table with some columns of the rows concerned set to values."""
    return df.select(*(F.when(where, F.lit(changes[f.name]).cast(f.dataType)).otherwise(F.col(f.name)).alias(f.name) if f.name in changes else F.col(f.name) for f in df.schema))


# --- rekey


def recomputed(catalog: Catalog, record_type: str, dictionary: Dictionary = None) -> DataFrame:
    """Rows with the base and key that they have by today's dictionary."""
    df = catalog[record_type].withColumn("new_base", identity.dedup_base(record_type, dictionary))
    return df.withColumn("new_key", identity.occurrence_key(F.col("new_base"), F.col("dedup_occurrence")))


def collisions(catalog: Catalog, record_type: str, dictionary: Dictionary = None) -> DataFrame:
    """Rows whose new key an earlier row (by id) has claimed: doubled if both say the same, fused otherwise, with the verdicts that may settle it.

    settlement: merged, distinct, contradictory, or null if nothing settles it.
    """
    pk = f"{record_type}_id"
    df = with_verdict(recomputed(catalog, record_type, dictionary), catalog, record_type)
    ruling = F.when(F.col(f"{VERDICT}.status").isin(*RESOLVING), F.when(F.col(f"{VERDICT}.status") == "distinct", "distinct").otherwise("merged"))
    df = df.withColumn("ruling", ruling)
    claim = Window.partitionBy("new_key").orderBy(pk)
    first = F.first(F.struct(pk, "ruling", *COMPARED[record_type])).over(claim)
    df = df.withColumn("first", first).withColumn("__place", F.row_number().over(claim)).where("__place > 1")  # by place: ids may be repeated
    equal = identity.rows_equal(record_type, lambda f: F.col(f"first.{f}"), lambda f: F.col(f))
    a, b = F.col("ruling"), F.col("first.ruling")
    settlement = F.when(a.isNotNull() & b.isNotNull() & (a != b), "contradictory").otherwise(F.coalesce(a, b))
    return df.select(F.lit(record_type).alias("record_type"), F.col(pk).alias("row_id"), F.col(f"first.{pk}").alias("clash_id"), "new_base", "dedup_base", F.when(equal, "doubled").otherwise("fused").alias("kind"), settlement.alias("settlement"))


def requeued(catalog: Catalog, record_type: str, dictionary: Dictionary = None) -> DataFrame:
    """Rows of a type with new_base, new_occurrence and new_key: those that clash (as in collisions()) take the next free occurrences of their family, by id.

    Everything is decided among the rows of one new base, which one shuffle brings together.
    """
    pk = f"{record_type}_id"
    rows = catalog[record_type].withColumn("new_base", identity.dedup_base(record_type, dictionary))
    occurrence = F.coalesce("dedup_occurrence", F.lit(0))  # rows of one base and occurrence have one key
    rows = rows.withColumn("__clash", F.row_number().over(Window.partitionBy("new_base", occurrence).orderBy(pk)) > 1)  # by place: ids may be repeated
    family = Window.partitionBy("new_base")
    top = F.max(F.when(~F.col("__clash"), F.col("dedup_occurrence"))).over(family)
    place = F.count_if("__clash").over(family.orderBy(pk).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("new_occurrence", F.when(F.col("__clash"), F.coalesce(top, F.lit(-1)) + place).otherwise(F.col("dedup_occurrence")).cast("int")).drop("__clash")
    return rows.withColumn("new_key", identity.occurrence_key(F.col("new_base"), F.col("new_occurrence")))


def changes_of(rows: DataFrame, record_type: str) -> DataFrame:
    moved = rows.where("new_key <> dedup_key OR new_base <> dedup_base")
    return moved.select(F.lit(record_type).alias("record_type"), F.col(f"{record_type}_id").alias("row_id"), F.col("dedup_key").alias("old_key"), "new_key", "new_base", "new_occurrence")


def rekey_plan(catalog: Catalog, dictionary: Dictionary = None) -> tuple[DataFrame, DataFrame]:
    """What rekey() would change, and the collisions, without settling anything."""
    changes, clashed = [], []
    for t in TYPES:
        if catalog.has(t):
            clashed.append(collisions(catalog, t, dictionary))
            changes.append(changes_of(requeued(catalog, t, dictionary), t))
    return reduce(DataFrame.unionByName, changes), reduce(DataFrame.unionByName, clashed)


def rekey(catalog: Catalog, dictionary: Dictionary = None) -> tuple[Catalog, DataFrame, DataFrame]:
    """Move all keys to today's dictionary. Returns the catalog, the changes and the collisions.

    A settled clash takes the next free occurrence of its family; family verdicts that settled one become row verdicts.
    A table with an unsettled or contradictory clash is left as it is.
    """
    tables, verdicts = {}, catalog["curation"]
    changes, clashed = rekey_plan(catalog, dictionary)
    open_ = clashed.where("settlement IS NULL OR settlement = 'contradictory'").select("record_type").distinct()
    unsettled = {r[0] for r in open_.collect()}  # a row for each type
    for t in TYPES:
        if not catalog.has(t) or t in unsettled:
            continue
        own = collisions(catalog, t, dictionary)
        new = {"dedup_base": "new_base", "dedup_key": "new_key", "dedup_occurrence": "new_occurrence"}
        rows = requeued(catalog, t, dictionary)
        tables[t] = rows.select(*(F.col(new.get(f.name, f.name)).alias(f.name) for f in schema_of(t)))
        verdicts = narrowed(catalog, verdicts, t, own, tables[t])
    return catalog.with_tables(**tables, curation=verdicts), changes, clashed


def narrowed(catalog: Catalog, verdicts: DataFrame, record_type: str, clashes_: DataFrame, rows: DataFrame) -> DataFrame:
    """Family verdicts that settled a clash, as row verdicts on the rows they covered; rows with a verdict of their own keep it."""
    pk = f"{record_type}_id"
    mine = F.col("record_type") == record_type
    ids = clashes_.select(F.col("row_id").alias(pk)).union(clashes_.select(F.col("clash_id").alias(pk)))
    bases = catalog[record_type].join(ids, pk, "left_semi").select("dedup_base").distinct()
    used = verdicts.where(mine & (F.col("record_id") == 0) & F.col("status").isin(*RESOLVING)).join(bases, "dedup_base", "left_semi")
    taken = verdicts.where(mine & (F.col("record_id") > 0)).select("record_id")
    covered = catalog[record_type].select("dedup_base", F.col(pk).alias("record_id")).join(taken, "record_id", "left_anti")
    now = rows.select(F.col(pk).alias("record_id"), F.col("dedup_base").alias("now_base"))
    made = used.drop("record_id").join(covered, "dedup_base").join(now, "record_id").withColumn("dedup_base", F.col("now_base")).select(*verdicts.columns)
    gone = used.select("record_type", "dedup_base", "record_id")
    return verdicts.join(gone, ["record_type", "dedup_base", "record_id"], "left_anti").select(*made.columns).unionByName(made)


assert set(APPENDIX) < {*RESOLVING, "erroneous-in-source"}
