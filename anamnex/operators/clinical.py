"""Listings, timeline and trends. Every query works for one person or, without a slug, for all at once.

Person ids stay in the result, so that the plan for one and for all is the same but for a pushed-down filter.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import units
from ..functions.dates import date_only, end_of_period, ordinal
from ..functions.plan import settled
from ..functions.text import Dictionary, enum_token, filled, key_token, loose, norm, number_text, stripped
from ..plans.catalog import Catalog
from ..specs import ATTESTATION, EDIT_MARK, INTERNAL, RENEWALS, TERMINAL_MEDS, VITAL
from .overlay import is_appendix, with_verdict


class PersonNotFoundError(LookupError):
    """No person has the slug."""


class AmbiguousTestError(ValueError):
    """A name stands for a lab series and for a vital at once."""


def person_id(catalog: Catalog, slug: str) -> int:
    found = catalog["person"].where(F.lower(F.trim("slug")) == slug.strip().lower()).select("person_id").head()
    if found is None:
        raise PersonNotFoundError(f"no person with slug {slug!r}")
    return found[0]


def rows_of(catalog: Catalog, record_type: str, slug: str | None = None) -> DataFrame:
    df = catalog[record_type]
    return df if slug is None else df.where(F.col("person_id") == person_id(catalog, slug))


def listed(df: DataFrame, slug: str | None, *order) -> DataFrame:
    """In order for one person, as it is shown. Rows of all persons are not sorted: what is made of them orders them within a person."""
    return df if slug is None else df.orderBy(*order)


def public(df: DataFrame) -> DataFrame:
    """Without key machinery."""
    return df.drop(*INTERNAL)


def public_json(df: DataFrame) -> Column:
    """A row as JSON; provenance only where there is some, payload nulls stay as nulls."""
    marks = [c for c in (*ATTESTATION, *EDIT_MARK) if c in df.columns]
    rest = F.to_json(F.struct(*(c for c in df.columns if c not in (*INTERNAL, *marks))), {"ignoreNullFields": "false"})
    some = F.to_json(F.struct(*marks)) if marks else F.lit("{}")
    return F.when(some == "{}", rest).otherwise(F.concat(F.rtrim(rest, F.lit("}")), F.lit(","), F.substr(some, F.lit(2))))


def labs(catalog: Catalog, slug: str | None = None, test: str | None = None, since: str | None = None, dictionary: Dictionary = None) -> DataFrame:
    """Lab rows, oldest first. test: a family of analytes; since: the date part of the text is compared, as in the timeline."""
    df = rows_of(catalog, "lab_result", slug)
    if since:
        df = df.where(date_only(F.col("collected_at")) >= date_only(F.lit(since)))
    if test:
        df = df.where(norm(F.col("test_name"), dictionary) == norm(F.lit(test), dictionary))
    return listed(df, slug, F.col("collected_at").asc_nulls_first(), F.col("test_name").asc_nulls_first(), "lab_result_id")


def is_renewal() -> Column:
    return enum_token(F.col("status_reason")).isin(*RENEWALS)


def is_current(today: dt.date | str) -> Column:
    """Whether a medication course goes on: a renewal does; a past end ends it; a future or unreadable one leaves it to the status."""
    status = F.lower(F.coalesce(stripped(F.col("status")), F.lit("")))
    end = end_of_period(F.col("ended_on"))
    past = F.coalesce(end < F.lit(str(today)).cast("date"), F.lit(False))
    return F.when(is_renewal(), True).when(~filled(F.col("ended_on")), ~status.isin(*TERMINAL_MEDS)).when(past, False).otherwise(status == "active")


def medications(catalog: Catalog, slug: str | None = None, active: bool = False, today: dt.date | str | None = None) -> DataFrame:
    df = rows_of(catalog, "medication", slug)
    if active:
        df = df.where(is_current(today or dt.date.today()))
    return listed(df, slug, F.col("started_on").asc_nulls_last(), F.col("name").asc_nulls_first(), "medication_id")


def _spaced(column: Column, before: str = " ", after: str = "") -> Column:
    """The text with something around it, or '' if there is none."""
    return F.when(filled(column), F.concat(F.lit(before), column, F.lit(after))).otherwise(F.lit(""))


def value_text() -> Column:
    return F.coalesce(number_text(F.col("value_num")), F.col("value_text"))


def _dashed(*parts: Column) -> Column:
    return F.concat_ws(" - ", *(F.when(filled(p), p) for p in parts))


def _events(df: DataFrame, record_type: str, order: int, *specs: tuple[str, Column, Column]) -> DataFrame:
    """A row for each (type, date, summary) whose date there is."""
    made = [F.struct(F.lit(order * 10 + k).alias("src"), when_type.alias("type") if isinstance(when_type, Column) else F.lit(when_type).alias("type"), date_only(when).alias("date"), text.alias("summary")) for k, (when_type, when, text) in enumerate(specs)]
    keep = ["person_id", "document_id", F.lit(record_type).alias("record_type"), F.col(f"{record_type}_id").alias("record_id"), "dedup_base", "attested_by", "attested_on", "edited_at", "edited_by"]
    return df.select(*keep, F.inline(F.filter(F.array(*made), lambda e: e["date"] != "")))


def timeline(catalog: Catalog, slug: str | None = None, since: str | None = None, exclude_obs_types: tuple[str, ...] = ()) -> DataFrame:
    """Dated events of the seven types, oldest first; ties by type, then in the order of sources and ids."""
    rows = {t: rows_of(catalog, t, slug) for t in ("lab_result", "medication", "procedure", "appointment", "observation", "condition", "allergy")}
    if exclude_obs_types:
        rows["observation"] = rows["observation"].where(~F.col("obs_type").isin(*exclude_obs_types))
    value = F.when(value_text().isNull(), F.lit("")).otherwise(F.concat(value_text(), _spaced(F.col("unit"))))
    given = F.when(value == "", F.lit(""))
    lab = F.trim(F.concat(F.coalesce("test_name", F.lit("")), given.otherwise(F.concat(F.lit(" "), value)), _spaced(F.col("flag"), " [", "]")))
    obs = F.trim(F.concat(F.col("obs_type"), _spaced(F.col("key")), given.otherwise(F.concat(F.lit(" = "), value))))
    who = F.concat_ws(" ", *(F.when(filled(F.col(c)), F.col(c)) for c in ("provider", "specialty")))
    visit = _dashed(who, F.when(filled(F.col("reason")), F.col("reason")).otherwise(F.coalesce("summary", F.lit(""))))
    end_type = F.when(is_renewal(), "med-renewal").otherwise("med-stop")
    end_text = F.when(is_renewal(), F.concat(F.lit("renewed "), "name", F.lit(" (authorization period ended)"))).otherwise(F.concat(F.lit("stopped "), "name"))
    family = enum_token(F.col("status")) == "family-history"
    parts = [
        _events(rows["lab_result"], "lab_result", 1, ("lab", F.col("collected_at"), lab)),
        _events(rows["medication"], "medication", 2, ("med-start", F.col("started_on"), F.concat(F.lit("started "), "name", _spaced(F.col("dose")))), (end_type, F.col("ended_on"), end_text)),
        _events(rows["procedure"], "procedure", 3, ("procedure", F.col("performed_on"), F.concat("name", _spaced(F.col("outcome"), " - ")))),
        _events(rows["appointment"], "appointment", 4, ("appointment", F.col("scheduled_for"), F.when(visit == "", "appointment").otherwise(visit))),
        _events(rows["observation"], "observation", 5, ("observation", F.col("observed_at"), obs)),
        _events(rows["condition"].where(~family), "condition", 6, ("condition", F.col("onset_on"), F.concat("name", F.lit(" ("), "status", F.lit(")"))), ("condition-resolved", F.col("resolved_on"), F.concat(F.lit("resolved "), "name"))),
        _events(rows["allergy"], "allergy", 7, ("allergy", F.col("noted_on"), F.concat("substance", F.lit(" allergy")))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    if since:
        out = out.where(F.col("date") >= date_only(F.lit(since)))
    return listed(out, slug, "date", "type", "src", "record_id")


def series(catalog: Catalog, slug: str | None = None) -> DataFrame:
    """All numeric measurements, labs and vitals in one shape."""
    lab = rows_of(catalog, "lab_result", slug).where("value_num IS NOT NULL")
    vital = rows_of(catalog, "observation", slug).where((F.col("obs_type") == VITAL) & F.col("value_num").isNotNull())
    lab = lab.select("person_id", F.lit("lab_result").alias("record_type"), F.col("lab_result_id").alias("record_id"), "dedup_base", "value_num", "unit", F.col("collected_at").alias("at"), F.col("test_name").alias("label"))
    vital = vital.select("person_id", F.lit("observation").alias("record_type"), F.col("observation_id").alias("record_id"), "dedup_base", "value_num", "unit", F.col("observed_at").alias("at"), F.col("key").alias("label"))
    return lab.unionByName(vital)


def trends(catalog: Catalog, test: str, slug: str | None = None, dictionary: Dictionary = None, check_ambiguous: bool = True) -> DataFrame:
    """Statistics of one measurement: a row per person that has it, a sibling of it, or (with a slug) the person asked for.

    Siblings are counted before verdicts, statistics after them and after conversion to the person's unit. Doubles are
    as they come; round them to compare engines. One pass: a name that stands for labs and vitals of one person raises at
    once with a slug (an eager job); without one, that person's row says `ambiguous` and has no statistics.
    """
    target, family = loose(key_token(F.lit(test), dictionary)), loose(norm(F.lit(test), dictionary))
    asked = settled(catalog.spark.range(1).select(), target=target, family=family).first()
    target, family = F.lit(asked["target"]), F.lit(asked["family"])
    points = settled(series(catalog, slug), token=key_token(F.col("label"), dictionary), kin=loose(norm(F.col("label"), dictionary)), source=units.canonical_unit(F.col("unit")))
    points = points.withColumn("match", loose(F.col("token")) == target)
    points = points.where(F.col("match") | (F.col("kin") == family))
    points = with_verdict(points, catalog).withColumn("live", F.col("match") & ~is_appendix())
    prefs = catalog["person_unit_pref"].where(loose(F.col("key")) == target).groupBy("person_id").agg(F.max("unit").alias("pref"))
    points = settled(points.join(prefs, "person_id", "left"), shown=units.display(F.col("value_num"), F.col("unit"), F.col("pref"), F.col("source")))
    live, value, unit = F.col("live"), F.col("shown.value"), F.col("shown.unit")
    day = ordinal(F.col("at"))
    when = F.struct(F.coalesce("at", F.lit("")).alias("at"), F.col("record_id").alias("id"))
    stays = ~(F.col("shown.converted") | F.coalesce(F.col("source") == F.col("pref"), F.lit(False)))

    def if_live(column: Column) -> Column:
        return F.when(live, column)

    at = F.coalesce("at", F.lit(""))
    points = points.withColumn("last_at", F.max(if_live(at)).over(Window.partitionBy("person_id")))
    found = points.groupBy("person_id").agg(
        F.min_by("token", F.when(F.col("match"), F.struct(F.col("record_type") != "lab_result", at, "record_id"))).alias("token"),
        F.count_if(live).alias("count"),
        F.count_if(live & (F.col("record_type") == "lab_result")).alias("labs"),
        F.min(if_live(value)).alias("min"),
        F.max(if_live(value)).alias("max"),
        F.max_by(if_live(value), if_live(when)).alias("latest"),
        F.max_by("at", if_live(when)).alias("latest_at"),
        F.count_if(live & (at == F.col("last_at"))).alias("latest_tie"),
        F.regr_slope(if_live(value), if_live(day)).alias("slope_per_day"),
        F.collect_set(F.when(live & filled(unit), unit)).alias("spellings"),
        F.collect_set(F.when(~F.col("match"), F.col("token"))).alias("other_assays"),
        F.count_if(~F.col("match")).alias("other_assay_count"),
        F.max("pref").alias("canonical_unit"),
        F.count_if(live & F.col("shown.converted")).alias("converted_count"),
        F.when(F.max("pref").isNotNull(), F.count_if(live & stays)).otherwise(F.lit(0)).alias("unconverted_count"),
        F.count_if(F.col("match") & ~live).alias("suppressed_count"),
    )
    both = (F.col("labs") > 0) & (F.col("labs") < F.col("count")) if check_ambiguous else F.lit(False)
    if check_ambiguous and slug is not None and found.where(both).head() is not None:
        raise AmbiguousTestError(f"{test!r} matches both lab results and vital observations")
    found = found.withColumn("ambiguous", both)
    told = lambda c: F.when(~F.col("ambiguous"), F.col(c)).alias(c)
    found = found.select(*(told(c) if c in ("min", "max", "latest", "latest_at", "latest_tie", "slope_per_day") else c for c in found.columns))
    known = F.array_distinct(F.transform("spellings", units.canonical_unit))
    shared = F.when((F.size(known) == 1) & F.element_at(known, 1).isNotNull(), F.element_at(known, 1))
    labelled = F.when(F.col("canonical_unit").isNotNull() & (F.col("unconverted_count") == 0), F.col("canonical_unit")).when(F.size("spellings") == 1, F.element_at("spellings", 1)).when(F.size("spellings") > 1, shared)
    out = found
    if slug is not None:
        who = catalog.spark.createDataFrame([(person_id(catalog, slug),)], "person_id long")
        out = who.join(out, "person_id", "left")
    zero = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("other_assay_count", "converted_count", "unconverted_count", "suppressed_count")]
    return out.select(
        "person_id", F.coalesce("token", target).alias("test"), F.coalesce("count", F.lit(0)).alias("count"), F.when((F.col("count") > 0) & ~F.col("ambiguous"), labelled).alias("unit"), "min", "max", "latest", "latest_at",
        F.coalesce("latest_tie", F.lit(0)).alias("latest_tie"), "slope_per_day", F.array_sort(F.coalesce("other_assays", F.array().cast("array<string>"))).alias("other_assays"), "canonical_unit", *zero,
        F.coalesce("ambiguous", F.lit(False)).alias("ambiguous"),
    )
