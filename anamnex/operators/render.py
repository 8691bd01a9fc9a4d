"""Documents as lines: each section is a DataFrame (person_id, section, place, line), and a text is their ordered join.

Lines are columns, so a document for every person is one plan; text() gathers a person's lines into one string.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import units
from ..functions.dates import date_only
from ..functions.names import shown_name
from ..functions.plan import bound, dealt, settled
from ..functions.text import Dictionary, filled, key_token, number_text
from ..plans.catalog import Catalog
from ..specs import APPENDIX, BRIEF_LABS, SELF_REPORTED
from . import sections
from .clinical import is_current, timeline
from .overlay import VERDICT, live, visible, with_verdict
from .registryops import verdict_list

EMPTY = "_none recorded_"


def opt(column: Column | str, before: str = "", after: str = "") -> Column:
    """The text between something, or '' where there is none."""
    column = F.col(column) if isinstance(column, str) else column
    return F.when(filled(column), F.concat(F.lit(before), column, F.lit(after))).otherwise(F.lit(""))


def disputed() -> Column:
    v = F.col(VERDICT)
    return F.when(v["status"] == "disputed", F.concat(F.lit("  [DISPUTED: "), F.coalesce(v["note"], F.lit("")), F.lit("]"))).otherwise(F.lit(""))


def attested() -> Column:
    when = opt(F.trim(F.coalesce("attested_on", F.lit(""))), " ")
    holds = F.col("attested_by").isNotNull() & F.col("document_id").isNull()
    return F.when(holds, F.concat(F.lit("  (attested by "), "attested_by", when, F.lit("; no source document)"))).otherwise(F.lit(""))


def corrected() -> Column:
    when = date_only(F.col("edited_at"))
    return F.when(when == "", F.lit("")).otherwise(F.concat(F.lit("  (corrected"), opt("edited_by", " by "), F.lit(" "), when, F.lit(")")))


def suffixes() -> Column:
    return F.concat(disputed(), attested(), corrected())


def converted(shown: Column, value: Column, unit: Column) -> Column:
    return F.when(shown["converted"], F.concat(F.lit("  [converted from "), number_text(value), F.lit(" "), unit, F.lit("]"))).otherwise(F.lit(""))


def reference_range(low: Column, high: Column) -> Column:
    a, b = number_text(low), number_text(high)
    return F.when(low.isNotNull() & high.isNotNull(), F.concat(F.lit("  (ref "), a, F.lit("-"), b, F.lit(")"))).when(high.isNotNull(), F.concat(F.lit("  (ref <= "), b, F.lit(")"))).when(low.isNotNull(), F.concat(F.lit("  (ref >= "), a, F.lit(")"))).otherwise(F.lit(""))


def severity(value: Column) -> Column:
    return F.when(value % 1 == 0, value.cast("bigint").cast("string")).otherwise(number_text(value))


def dated(column: str) -> Column:
    return F.when(date_only(F.col(column)) == "", F.lit("(undated)")).otherwise(date_only(F.col(column)))


def with_pref(df: DataFrame, catalog: Catalog, name: str, dictionary: Dictionary) -> DataFrame:
    """Append shown: value and unit as the person prefers them."""
    prefs = catalog["person_unit_pref"].select("person_id", F.col("key").alias("pref_key"), F.col("unit").alias("pref"))
    df = settled(df, pref_key=key_token(F.col(name), dictionary), source=units.canonical_unit(F.col("unit")))
    df = df.join(prefs, ["person_id", "pref_key"], "left")
    return settled(df, shown=units.display(F.col("value_num"), F.col("unit"), F.col("pref"), F.col("source")))


def placed(df: DataFrame, section: int, line: Column, *order) -> DataFrame:
    """Lines of a section in order; rows that the order leaves equal go by their line."""
    df = df.withColumn("line", line)
    place = F.row_number().over(Window.partitionBy("person_id").orderBy(*order, "line"))
    return df.select("person_id", F.lit(section).alias("section"), place.alias("place"), "line")


def medication_lines(catalog: Catalog, today, section: int, since: bool, overrides: Dictionary = None, dictionary: Dictionary = None) -> DataFrame:
    df = live(bound(catalog["medication"], "started_on", "ended_on").where(is_current(today)), catalog, "medication")
    line = F.concat(F.lit("- "), F.coalesce(shown_name(F.col("name"), overrides, dictionary), F.lit("")), opt("dose", " "), opt("frequency", " "), opt("started_on", " (since ", ")") if since else F.lit(""), suffixes())
    return placed(df, section, line, F.col("started_on").asc_nulls_last(), "name", "medication_id")


def condition_lines(catalog: Catalog, statuses: tuple[str, ...], section: int, past: bool = False) -> DataFrame:
    over = opt("resolved_on", "  (resolved ", ")") if past else F.lit("")
    line = F.concat(F.lit("- "), "name", opt("onset_on", "  (since ", ")"), over, opt("note", " - "), suffixes())
    return placed(sections.conditions(catalog, statuses), section, line, "name", "condition_id")


def family_lines(catalog: Catalog, section: int) -> DataFrame:
    who = F.when(filled(F.col("relation")), F.col("relation")).otherwise(F.lit("family"))
    return placed(sections.conditions(catalog, ("family-history",)), section, F.concat(F.lit("- "), who, F.lit(": "), "name", suffixes()), "name", "condition_id")


def allergy_lines(catalog: Catalog, section: int) -> DataFrame:
    from ..functions.text import enum_token

    line = F.concat(F.lit("- "), "substance", opt(F.upper("criticality"), " [", "]"), opt("reaction", " - "), opt("noted_on", "  (noted ", ")"), suffixes())
    return placed(sections.allergies(catalog), section, line, enum_token(F.col("criticality")) != "high", "substance", "allergy_id")


def order_lines(catalog: Catalog, section: int, dictionary: Dictionary = None) -> DataFrame:
    df = sections.open_orders(catalog, dictionary=dictionary)
    detail = F.when(filled(F.col("key")), opt("value_text", " - ")).otherwise(F.lit(""))
    more = F.when(F.col("group_count") > 1, F.concat(F.lit("+"), (F.col("group_count") - 1).cast("string"), F.lit(" earlier"), opt("group_first", ", first ")))
    notes = F.concat_ws("; ", F.when(F.col("date") != "", F.concat(F.lit("ordered "), "date")), more)
    line = F.concat(F.lit("- "), "display", detail, opt(notes, "  (", ")"), suffixes())
    return placed(df, section, line, F.col("date") == "", "date", F.lower("display"), "observation_id")


def vital_lines(catalog: Catalog, section: int, dictionary: Dictionary = None) -> DataFrame:
    df = with_pref(sections.latest_vitals(catalog, dictionary=dictionary), catalog, "key", dictionary)
    value = F.when(F.col("value_num").isNotNull(), number_text(F.col("shown.value"))).otherwise(F.coalesce("value_text", F.lit("")))
    when = F.when(filled(F.col("observed_at")), F.concat(F.lit("  ("), date_only(F.col("observed_at")), F.lit(")"))).otherwise(F.lit(""))
    line = F.concat(F.lit("- "), F.coalesce("key", F.lit("")), F.lit(": "), value, opt("shown.unit", " "), when, suffixes(), converted(F.col("shown"), F.col("value_num"), F.col("unit")))
    return placed(df, section, line, "token")


def symptom_lines(catalog: Catalog, today, section: int, dictionary: Dictionary = None) -> DataFrame:
    df = sections.symptoms(catalog, today, dictionary=dictionary)
    n, last, over = F.col("reports"), F.col("latest"), F.col("resolved")
    head = F.concat(F.lit("- "), F.coalesce("label", F.lit("")), F.lit(" - "), n.cast("string"), F.when(n == 1, " report").otherwise(" reports"), F.lit(" in 30d"))
    newest = F.when(last.isNotNull(), F.concat(F.lit(", latest "), date_only(last["observed_at"]), F.when(last["value_num"].isNotNull(), F.concat(F.lit(" (severity "), severity(last["value_num"]), F.lit("/10)"))).otherwise(F.lit("")))).otherwise(F.lit(""))
    ended = F.when(over.isNotNull() & (last.isNull() | (over["ts"] > last["ts"])), F.concat(F.lit("; last reported resolved "), date_only(over["observed_at"]))).otherwise(F.lit(""))
    return placed(df, section, F.concat(head, newest, ended), F.col("sort") == "", F.desc("sort"), "label", "token")


def lab_line(mark: Column, value: Column, unit: Column) -> Column:
    shown = F.trim(F.concat(F.coalesce(number_text(value), F.col("value_text"), F.lit("")), opt(unit, " ")))
    return F.concat(F.lit("- "), date_only(F.col("collected_at")), F.lit("  "), "test_name", F.lit("  "), shown, opt("flag", " [", "]"), mark, suffixes())


def abnormal_lines(catalog: Catalog, today, section: int, dictionary: Dictionary = None) -> DataFrame:
    df = with_pref(sections.abnormal_labs(catalog, today), catalog, "test_name", dictionary)

    def limit(c: str) -> Column:
        return F.when(F.col("shown.converted"), F.round(units.convert(F.col(c), F.col("unit"), F.col("pref"), F.col("source")), 2)).otherwise(F.col(c))

    line = F.concat(lab_line(reference_range(limit("ref_low"), limit("ref_high")), F.col("shown.value"), F.col("shown.unit")), converted(F.col("shown"), F.col("value_num"), F.col("unit")))
    return placed(df, section, line, F.col("collected_at").desc_nulls_last(), F.col("test_name").asc_nulls_first(), F.desc("lab_result_id"))


def procedure_lines(catalog: Catalog, section: int, routine=(), dictionary: Dictionary = None) -> DataFrame:
    """Procedures that are not routine, and a note on how many are."""
    df = sections.procedures(catalog, routine=routine, dictionary=dictionary)
    line = F.concat(F.lit("- "), dated("performed_on"), F.lit("  "), "name", opt("outcome", " - "), opt("provider", "  (", ")"), suffixes())
    kept = placed(df.where("NOT routine"), section, line, date_only(F.col("performed_on")) == "", F.desc("performed_on"), "procedure_id")
    n = F.count("*")
    note = df.where("routine").groupBy("person_id").agg(F.concat(F.lit("_"), n.cast("string"), F.when(n == 1, " routine procedure").otherwise(" routine procedures"), F.lit(" not shown_")).alias("line"))
    return kept.unionByName(note.select("person_id", F.lit(section).alias("section"), F.lit(1 << 30).alias("place"), "line"))


def appointment_lines(catalog: Catalog, today, section: int) -> DataFrame:
    who = F.concat_ws(" ", *(F.when(filled(F.col(c)), F.col(c)) for c in ("provider", "specialty")))
    why = F.when(filled(F.col("reason")), F.col("reason")).otherwise(F.coalesce("summary", F.lit("")))
    detail = F.concat_ws(" - ", F.when(who != "", who), F.when(why != "", why))
    line = F.concat(F.lit("- "), dated("scheduled_for"), F.lit("  "), F.when(detail == "", "appointment").otherwise(detail), suffixes())
    return placed(sections.open_appointments(catalog, today), section, line, F.col("scheduled_for").asc_nulls_last(), "appointment_id")


def conflict_lines(catalog: Catalog, section: int) -> DataFrame:
    df = catalog["conflict"].where("status = 'open' AND person_id IS NOT NULL")
    return placed(df, section, F.concat(F.lit("- conflict #"), F.col("conflict_id").cast("string"), F.lit(" ("), "record_type", F.lit(")")), "conflict_id")


def conflict_warning(catalog: Catalog) -> DataFrame:
    n = F.count("*")
    text = F.concat(F.lit("> [!WARNING]\n> "), n.cast("string"), F.when(n == 1, " open conflict").otherwise(" open conflicts"), F.lit(" - some values below may be superseded."))
    return catalog["conflict"].where("status = 'open' AND person_id IS NOT NULL").groupBy("person_id").agg(text.alias("warning"))


def question_lines(catalog: Catalog, section: int) -> DataFrame:
    """What is disputed, to be asked."""
    df = verdict_list(catalog).where("status = 'disputed' AND owner IS NOT NULL").withColumnRenamed("owner", "person_id")
    label = F.when(filled(F.col("label")), F.col("label")).otherwise(F.lit("(no live rows)"))
    line = F.concat(F.lit("- "), "record_type", F.lit(": "), label, F.lit(" - "), F.coalesce("note", F.lit("")), opt("attributed_to", " (", ")"))
    return placed(df, section, line, "record_type", "dedup_base", "record_id")


def context_lines(catalog: Catalog, section: int, self_reported: bool = False) -> DataFrame:
    """Procedures, then observations, newest first."""
    p = live(catalog["procedure"], catalog, "procedure")
    p = p.select("person_id", F.lit(0).alias("k"), F.coalesce("performed_on", F.lit("")).alias("ts"), F.col("procedure_id").alias("id"), F.concat(F.lit("- "), dated("performed_on"), F.lit("  procedure: "), "name", opt("outcome", " - "), suffixes()).alias("text"))
    o = catalog["observation"] if self_reported else catalog["observation"].where(~F.col("obs_type").isin(*SELF_REPORTED))
    from ..functions.dates import norm_ts

    o = live(o, catalog, "observation")
    value = F.coalesce(number_text(F.col("value_num")), F.col("value_text"))
    said = F.when(value.isNull(), F.lit("")).otherwise(F.concat(F.lit(" = "), value, opt("unit", " ")))
    o = o.select("person_id", F.lit(1).alias("k"), norm_ts(F.col("observed_at")).alias("ts"), F.col("observation_id").alias("id"), F.concat(F.lit("- "), dated("observed_at"), F.lit("  "), "obs_type", opt("key", " "), said, suffixes()).alias("text"))
    return placed(p.unionByName(o), section, F.col("text"), "k", F.desc("ts"), "id")


SUMMARY = ("Active Medications", "Active Problems", "Past Medical History", "Family History", "Allergies", "Orders & Referrals", "Latest Vitals", "Self-Reported Symptoms", "Abnormal Labs (last 12 months)", "Procedures", "Upcoming / Open Appointments")


def summary_lines(catalog: Catalog, today: dt.date | str, dictionary: Dictionary = None, routine=(), overrides: Dictionary = None) -> DataFrame:
    parts = [
        medication_lines(catalog, today, 0, True, overrides, dictionary), condition_lines(catalog, ("active",), 1), condition_lines(catalog, ("resolved", "history"), 2, past=True), family_lines(catalog, 3), allergy_lines(catalog, 4),
        order_lines(catalog, 5, dictionary), vital_lines(catalog, 6, dictionary), symptom_lines(catalog, today, 7, dictionary), abnormal_lines(catalog, today, 8, dictionary), procedure_lines(catalog, 9, routine, dictionary), appointment_lines(catalog, today, 10),
    ]
    return union(parts)


BRIEF = ("Current Medications", f"Recent Labs (last {BRIEF_LABS}, abnormal first)", "Allergies", "Active Problems", "Procedures & Observations", "Open Conflicts", "Questions for the Clinician")


def brief_lines(catalog: Catalog, today: dt.date | str, dictionary: Dictionary = None, recent: int = BRIEF_LABS, self_reported: bool = False, overrides: Dictionary = None) -> DataFrame:
    labs = sections.recent_draws(catalog, limit=recent)
    mark = F.when(sections.is_abnormal(), F.concat(F.lit("  [!]"), reference_range(F.col("ref_low"), F.col("ref_high")))).otherwise(F.lit(""))
    return union([
        medication_lines(catalog, today, 0, False, overrides, dictionary), placed(labs, 1, lab_line(mark, F.col("value_num"), F.col("unit")), "rank"), allergy_lines(catalog, 2), condition_lines(catalog, ("active",), 3),
        context_lines(catalog, 4, self_reported), conflict_lines(catalog, 5), question_lines(catalog, 6),
    ])


def union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def text(lines: DataFrame, headers: DataFrame, titles: tuple[str, ...], optional: tuple[int, ...] = (), empty: dict[int, str] | None = None) -> DataFrame:
    """(person_id, text): header (person_id, header), then all sections; those without lines say so, optional ones are left out."""
    bodies = lines.groupBy("person_id", "section").agg(F.array_join(F.sort_array(F.collect_list(F.struct("place", "line")))["line"], "\n").alias("body"))
    wide = bodies.groupBy("person_id").pivot("section", list(range(len(titles)))).agg(F.first("body"))
    df = headers.join(wide, "person_id", "left")
    parts = []
    for k, title in enumerate(titles):
        body = F.col(f"`{k}`") if k in optional else F.coalesce(F.col(f"`{k}`"), F.lit((empty or {}).get(k, EMPTY)))
        parts.append(F.concat(F.lit(f"## {title}\n\n"), body, F.lit("\n")))
    return df.select("person_id", F.concat(F.rtrim(F.concat_ws("\n", "header", *parts), F.lit("\n ")), F.lit("\n")).alias("text"))


def summary_headers(catalog: Catalog, generated: str) -> DataFrame:
    counts = sections.row_counts(catalog)
    df = catalog["person"].join(counts, "person_id", "left").join(conflict_warning(catalog), "person_id", "left").na.fill(0, [c for c in counts.columns if c != "person_id"])
    names = (("labs", "lab_result"), ("medications", "medication"), ("procedures", "procedure"), ("appointments", "appointment"), ("observations", "observation"), ("conditions", "condition"), ("allergies", "allergy"))
    shown = F.concat_ws(", ", *(F.concat(F.lit(f"{n}="), F.col(t).cast("string")) for n, t in names))
    head = F.concat(F.lit("# Master Summary: "), "full_name", F.lit("\n\n- Person: "), "slug", F.lit("\n- DOB: "), F.when(filled(F.col("dob")), F.col("dob")).otherwise("unknown"), F.lit(f"\n- Generated: {generated} (read-only view of DB state)\n- Source rows: "), shown, F.lit("\n"))
    return df.select("person_id", F.concat_ws("\n", head, F.concat("warning", F.lit("\n"))).alias("header"))


def summaries(catalog: Catalog, today, generated: str, dictionary: Dictionary = None, routine=(), overrides: Dictionary = None) -> DataFrame:
    """The summary of every person."""
    return text(summary_lines(catalog, today, dictionary, routine, overrides), summary_headers(catalog, generated), SUMMARY, optional=(7,), empty={8: "_none flagged_"})


def briefs(catalog: Catalog, today, generated: str, dictionary: Dictionary = None, appointment: int | None = None, **more) -> DataFrame:
    """(appointment_id, person_id, text) for every appointment, or for one, of whose person alone lines are made."""
    own_heads = catalog["appointment"] if appointment is None else catalog["appointment"].where(F.col("appointment_id") == appointment)
    heads = own_heads.join(catalog["person"].select("person_id", "full_name"), "person_id")
    when = F.when(date_only(F.col("scheduled_for")) == "", "unscheduled").otherwise(date_only(F.col("scheduled_for")))

    def known(c: str, other: str) -> Column:
        return F.when(filled(F.col(c)), F.col(c)).otherwise(F.lit(other))

    header = F.concat(
        F.lit("# Appointment Brief: "), "full_name", F.lit(f"\n\n- Generated: {generated} (read-only view of DB state)\n\n## Appointment\n\n- When: "), when, F.lit("\n- Provider: "), known("provider", "unknown"),
        F.lit("\n- Specialty: "), known("specialty", "unknown"), F.lit("\n- Reason: "), known("reason", "(none given)"), F.lit("\n"),
    )
    lines = brief_lines(catalog, today, dictionary, **more)
    if appointment is not None:
        whose = own_heads.where("person_id IS NOT NULL").select("person_id").head()
        lines = lines.where(F.col("person_id") == whose[0] if whose else F.lit(False))
    own = text(lines, heads.select("person_id").distinct().withColumn("header", F.lit("")), BRIEF, optional=(6,), empty={5: "_none_"})
    out = heads.select("appointment_id", "person_id", header.alias("header")).join(own, "person_id")
    return out.select("appointment_id", "person_id", F.concat("header", "text").alias("text"))


def journal_events(catalog: Catalog, since: str | None = None, self_reported: bool = False) -> DataFrame:
    """Events that no verdict hides, with what their lines end in, their place, and whether a new date starts; dealt by person once."""
    events = timeline(catalog, since=since, exclude_obs_types=() if self_reported else SELF_REPORTED)
    own = ["date", "type", "src", "record_id", "document_id", "summary"]
    df = dealt(visible(with_verdict(events, catalog)).select("person_id", *own, suffixes().alias("suffix")), "person_id")
    order = Window.partitionBy("person_id").orderBy(*own)
    return df.withColumn("place", F.row_number().over(order)).withColumn("starts", ~F.col("date").eqNullSafe(F.lag("date").over(order)))


def footnotes(events: DataFrame) -> DataFrame:
    """(person_id, document_id, note_no): documents numbered by first appearance."""
    notes = events.where("document_id IS NOT NULL").groupBy("person_id", "document_id").agg(F.min("place").alias("first"))
    return notes.select("person_id", "document_id", F.row_number().over(Window.partitionBy("person_id").orderBy("first")).alias("note_no"))


def journal_lines(catalog: Catalog, since: str | None = None, self_reported: bool = False) -> tuple[DataFrame, DataFrame]:
    """(person_id, place, line) of events, with headings where the date changes, and of the numbered notes of their documents.

    Events get their note's number where they lie, by the rank of their document's first place among a person's.
    """
    events = journal_events(catalog, since, self_reported)
    first = F.when(F.col("document_id").isNotNull(), F.min("place").over(Window.partitionBy("person_id", "document_id")))
    df = events.withColumn("first", first).withColumn("note_no", F.dense_rank().over(Window.partitionBy("person_id").orderBy(F.col("first").asc_nulls_last())))
    head = F.when(F.col("starts"), F.concat(F.lit("\n## "), "date", F.lit("\n\n"))).otherwise(F.lit(""))
    line = F.concat(head, F.lit("- **"), "type", F.lit("** -- "), F.coalesce("summary", F.lit("")), F.when(F.col("first").isNotNull(), F.concat(F.lit(" [^"), F.col("note_no").cast("string"), F.lit("]"))).otherwise(F.lit("")), "suffix")
    docs = catalog["document"].select("document_id", F.lit(True).alias("known"), "category", "provider", "doc_date", "source_path")
    cited = footnotes(events).join(docs, "document_id", "left")
    number = F.concat(F.lit("document #"), F.col("document_id").cast("string"))
    bits = F.concat_ws(", ", number, *(F.when(filled(F.col(c)), F.concat(F.lit(p), c)) for c, p in (("category", ""), ("provider", ""), ("doc_date", "dated "), ("source_path", "sources/"))))
    citation = F.concat(F.lit("[^"), F.col("note_no").cast("string"), F.lit("]: "), F.when(F.col("known"), bits).otherwise(F.concat(number, F.lit(" (not found)"))))
    return df.select("person_id", "place", line.alias("line")), cited.select("person_id", F.col("note_no").alias("place"), citation.alias("line"))


def joined_lines(lines: DataFrame, name: str) -> DataFrame:
    """A person's lines as one text, in place."""
    held = lines.groupBy("person_id").agg(F.sort_array(F.collect_list(F.struct("place", "line"))).alias("l"))
    return held.select("person_id", F.array_join(F.col("l.line"), "\n").alias(name))


def journals(catalog: Catalog, generated: str, since: str | None = None, self_reported: bool = False) -> DataFrame:
    lines, notes = journal_lines(catalog, since, self_reported)
    head = F.concat(F.lit("# Journal: "), "full_name", F.lit(f"\n\n- Generated: {generated} (read-only view of DB state)\n"))
    df = catalog["person"].select("person_id", "full_name").join(joined_lines(lines, "events"), "person_id", "left").join(joined_lines(notes, "notes"), "person_id", "left")
    body = F.when(F.col("events").isNull(), F.lit("\n_No dated events on record._")).otherwise(F.concat("events", F.coalesce(F.concat(F.lit("\n\n---\n\n"), "notes"), F.lit(""))))
    return df.select("person_id", F.concat(head, body, F.lit("\n")).alias("text"))


def curation_groups(catalog: Catalog) -> DataFrame:
    """Rulings that move facts out of their sections, by person and ruling: verdicts, rows and target lines."""
    v = verdict_list(catalog).where(F.col("status").isin(*APPENDIX) & F.col("owner").isNotNull())
    label = F.when(filled(F.col("label")), F.col("label")).otherwise(F.lit("(no live rows)"))
    n = F.col("family_size")
    scope = F.when(F.col("record_id") > 0, "row").otherwise(F.concat(F.lit("family, "), n.cast("string"), F.when(n == 1, " row").otherwise(" rows")))
    line = F.concat(F.lit("- "), "record_type", F.lit(": "), label, F.lit("  ("), scope, F.lit(")"))
    order = F.struct(F.col("created_at").alias("c"), "record_type", "dedup_base", "record_id", line.alias("line"))
    found = v.groupBy(F.col("owner").alias("person_id"), "status", "merged_into_base", "note", "attributed_to").agg(F.count("*").alias("verdicts"), F.sum("family_size").alias("rows"), F.sort_array(F.collect_list(order)).alias("t"))
    named = F.when((F.col("status") == "merged-into") & F.col("merged_into_base").isNotNull(), F.concat(F.lit("merged into "), F.substring("merged_into_base", 1, 12), F.lit("..."))).otherwise(F.col("status"))
    return found.select("person_id", F.concat(named, opt("attributed_to", " (", ")")).alias("heading"), "note", "verdicts", "rows", F.transform("t", lambda x: x["line"]).alias("targets"))


def curations(catalog: Catalog, generated: str) -> DataFrame:
    """The curation record of every person that has one."""
    g = curation_groups(catalog)

    def counted(n: Column, word: str) -> Column:
        return F.concat(n.cast("string"), F.lit(f" {word}"), F.when(n == 1, "").otherwise("s"))

    note = F.when(filled(F.col("note")), F.concat(F.lit("\n> "), F.regexp_replace("note", "\r?\n", "\n> "), F.lit("\n"))).otherwise(F.lit(""))
    block = F.concat(F.lit("## "), "heading", F.lit("\n\n_"), counted(F.col("verdicts"), "verdict"), F.lit(", "), counted(F.col("rows"), "row"), F.lit("_\n"), note, F.lit("\n"), F.array_join("targets", "\n"), F.lit("\n"))
    g = g.select("person_id", "heading", "verdicts", "rows", block.alias("block"))
    per = g.groupBy("person_id").agg(F.sum("verdicts").alias("v"), F.sum("rows").alias("r"), F.array_join(F.sort_array(F.collect_list("block")), "\n").alias("body"))
    df = per.join(catalog["person"], "person_id")
    head = F.concat(F.lit("# Curation Record: "), "full_name", F.lit("\n\n- Person: "), "slug", F.lit(f"\n- Generated: {generated} (read-only view of DB state)\n- Verdicts: "), F.col("v").cast("string"), F.lit(" covering "), counted(F.col("r"), "row"), F.lit("\n\n"))
    return df.select("person_id", F.concat(head, "body").alias("text"))


def person_text(frame: DataFrame, catalog: Catalog, slug: str) -> str:
    """One person's text; '' if there is none."""
    from .clinical import person_id

    row = frame.where(F.col("person_id") == person_id(catalog, slug)).select("text").head()
    return row[0] if row else ""


def emit(spark, frame: DataFrame, path: str) -> None:
    """Texts as files, partitioned as they come."""
    frame.select("text").write.mode("errorifexists").text(path)


