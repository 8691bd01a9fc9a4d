"""What documents are made of: problem lists, vitals, symptoms, orders, abnormal labs. For one person or all."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import date_only, full_date, norm_ts
from ..functions.plan import bound, settled
from ..functions.text import Dictionary, enum_token, filled, is_blank, key_token, norm, order_tokens, routine_pattern, stripped
from ..plans.catalog import Catalog
from ..specs import ABNORMAL_MONTHS, LIFECYCLE_MEDS, NORMAL_FLAGS, ORDER, ORDER_NOISE, ORDER_WINDOW, SYMPTOM, SYMPTOM_DAYS, VITAL
from .clinical import listed, rows_of
from .overlay import live


def _day(today: dt.date | str) -> Column:
    return F.lit(str(today)).cast("date")


def conditions(catalog: Catalog, statuses: tuple[str, ...], slug: str | None = None) -> DataFrame:
    df = live(rows_of(catalog, "condition", slug), catalog, "condition")
    return listed(df.where(enum_token(F.col("status")).isin(*statuses)), slug, "name", "condition_id")


def allergies(catalog: Catalog, slug: str | None = None) -> DataFrame:
    df = live(rows_of(catalog, "allergy", slug), catalog, "allergy")
    return listed(df, slug, enum_token(F.col("criticality")) != "high", "substance", "allergy_id")


def _observations(catalog: Catalog, kind: str, slug: str | None) -> DataFrame:
    df = bound(rows_of(catalog, "observation", slug).where(F.col("obs_type") == kind), "observed_at")
    return settled(live(df, catalog, "observation"), ts=norm_ts(F.col("observed_at")))


def latest_vitals(catalog: Catalog, slug: str | None = None, dictionary: Dictionary = None) -> DataFrame:
    """The newest row of each vital."""
    df = _observations(catalog, VITAL, slug).withColumn("token", key_token(F.col("key"), dictionary))
    newest = Window.partitionBy("person_id", "token").orderBy(F.desc("ts"), F.desc("observation_id"))
    return listed(df.withColumn("k", F.row_number().over(newest)).where("k = 1").drop("k"), slug, "token")


def symptoms(catalog: Catalog, today: dt.date | str, slug: str | None = None, dictionary: Dictionary = None) -> DataFrame:
    """Reports of the last days by symptom: how many, the newest, and the newest that says it is over (value 0)."""
    when = full_date(F.col("observed_at"))
    df = _observations(catalog, SYMPTOM, slug).where(when.isNull() | (when >= F.date_sub(_day(today), SYMPTOM_DAYS)))
    at = F.struct("ts", "observation_id")
    over = F.coalesce(F.col("value_num") == 0, F.lit(False))
    kept = F.struct("observed_at", "value_num", "observation_id", "ts")
    found = df.groupBy("person_id", key_token(F.col("key"), dictionary).alias("token")).agg(
        F.max_by("key", at).alias("label"), F.count("*").alias("reports"), F.max("ts").alias("sort"), F.max_by(kept, F.when(~over, at)).alias("latest"), F.max_by(kept, F.when(over, at)).alias("resolved")
    )
    return listed(found, slug, F.col("sort") == "", F.desc("sort"), "label", "token")


def result_index(catalog: Catalog, slug: str | None = None, dictionary: Dictionary = None) -> DataFrame:
    """(person_id, token, day) of the labs that no verdict hides."""
    df = live(bound(rows_of(catalog, "lab_result", slug), "collected_at"), catalog, "lab_result")
    df = settled(df, token=key_token(F.col("test_name"), dictionary), day=full_date(F.col("collected_at"))).select("person_id", "token", "day")
    return df.where("day IS NOT NULL AND token <> ''").distinct()


def open_orders(catalog: Catalog, slug: str | None = None, dictionary: Dictionary = None) -> DataFrame:
    """The newest order of each kind that has no result: neither for the whole nor for every component, from a day before to 30 after."""
    df = _observations(catalog, ORDER, slug)
    own = key_token(F.col("key"), dictionary)
    token = F.when(F.coalesce(own, F.lit("")) != "", own).otherwise(F.coalesce(key_token(F.col("value_text"), dictionary), F.lit("")))
    df = df.withColumn("named", F.coalesce(own, F.lit("")) != "").withColumn("token", token)
    df = df.withColumn("kind", F.when(F.col("token") == "", F.concat(F.lit("#"), F.col("observation_id").cast("string"))).otherwise(F.col("token")))
    by = Window.partitionBy("person_id", "kind")
    newest = by.orderBy(F.desc("ts"), F.desc("observation_id"))
    day_text = F.when(date_only(F.col("observed_at")) != "", date_only(F.col("observed_at")))
    df = df.withColumn("k", F.row_number().over(newest)).withColumn("group_count", F.count("*").over(by))
    df = df.withColumn("group_first", F.min(F.when(F.col("k") > 1, day_text)).over(by)).where("k = 1").drop("k")
    source = F.when(F.col("named"), F.col("key")).otherwise(F.col("value_text"))
    df = df.withColumn("day", full_date(F.col("observed_at"))).withColumn("tokens", F.when(F.col("token") == "", F.array().cast("array<string>")).otherwise(order_tokens(source, ORDER_NOISE, dictionary)))
    need = df.where("day IS NOT NULL AND token <> ''").select("person_id", "observation_id", "day", F.explode(F.array(F.struct(F.lit(0).alias("part"), F.array("token").alias("t")), F.struct(F.lit(1).alias("part"), F.col("tokens").alias("t")))).alias("x"))
    need = need.select("person_id", "observation_id", "day", "x.part", F.explode("x.t").alias("token"))
    have = result_index(catalog, slug, dictionary).withColumnRenamed("day", "lab_day")
    gap = F.datediff("lab_day", "day")
    met = need.join(have, ["person_id", "token"]).where(gap.between(*ORDER_WINDOW)).select("observation_id", "part", "token").distinct().withColumn("ok", F.lit(True))
    state = need.join(met, ["observation_id", "part", "token"], "left").groupBy("observation_id", "part").agg(F.bool_and(F.coalesce("ok", F.lit(False))).alias("all"))
    done = state.where("all").select("observation_id").distinct()
    left = df.join(done, "observation_id", "left_anti")
    shown = F.when(filled(F.col("key")), F.col("key")).when(filled(F.col("value_text")), F.col("value_text")).otherwise(F.lit("(unspecified)"))
    left = left.withColumn("display", shown).withColumn("date", date_only(F.col("observed_at")))
    return listed(left, slug, F.col("date") == "", "date", F.lower("display"), "observation_id")


def is_abnormal() -> Column:
    flag = F.lower(F.coalesce(stripped(F.col("flag")), F.lit("")))
    value = F.col("value_num")
    return ((flag != "") & ~flag.isin(*NORMAL_FLAGS)) | F.coalesce(value < F.col("ref_low"), F.lit(False)) | F.coalesce(value > F.col("ref_high"), F.lit(False))


def abnormal_labs(catalog: Catalog, today: dt.date | str, slug: str | None = None) -> DataFrame:
    """Abnormal labs of the last months; older ones only if they are the first of their spelling, newest first."""
    df = live(bound(rows_of(catalog, "lab_result", slug), "collected_at").where(is_abnormal()), catalog, "lab_result")
    order = [F.col("collected_at").desc_nulls_last(), F.col("test_name").asc_nulls_first(), F.desc("lab_result_id")]
    first = F.row_number().over(Window.partitionBy("person_id", "test_name").orderBy(*order)) == 1
    when = full_date(F.col("collected_at"))
    df = df.withColumn("first", first).where(when.isNull() | (when >= F.add_months(_day(today), -ABNORMAL_MONTHS)) | F.col("first"))
    return listed(df.drop("first"), slug, *order)


def recent_draws(catalog: Catalog, slug: str | None = None, limit: int = 10) -> DataFrame:
    """The newest draws, abnormal rows first within a draw."""
    df = live(rows_of(catalog, "lab_result", slug), catalog, "lab_result")
    order = [F.col("collected_at").desc_nulls_last(), ~is_abnormal(), F.col("test_name").asc_nulls_first(), F.desc("lab_result_id")]
    df = df.withColumn("rank", F.row_number().over(Window.partitionBy("person_id").orderBy(*order)))
    return listed(df.where(F.col("rank") <= max(limit, 0)), slug, "rank")


def procedures(catalog: Catalog, slug: str | None = None, routine=(), dictionary: Dictionary = None) -> DataFrame:
    """Newest first, undated last; routine: whether the name is on the list of routine ones."""
    df = live(rows_of(catalog, "procedure", slug), catalog, "procedure")
    pattern = routine_pattern(routine)
    df = df.withColumn("routine", norm(F.col("name"), dictionary).rlike(pattern) if pattern else F.lit(False))
    return listed(df, slug, date_only(F.col("performed_on")) == "", F.desc("performed_on"), "procedure_id")


def open_appointments(catalog: Catalog, today: dt.date | str, slug: str | None = None) -> DataFrame:
    """Those to come, and those without a summary."""
    df = live(rows_of(catalog, "appointment", slug), catalog, "appointment")
    day = date_only(F.col("scheduled_for"))
    return listed(df.where(((day != "") & (day >= str(today))) | is_blank(F.col("summary"))), slug, F.col("scheduled_for").asc_nulls_last(), "appointment_id")


def row_counts(catalog: Catalog) -> DataFrame:
    """Rows of each type by person, verdicts or not."""
    from ..specs import TYPES

    out = None
    for t in TYPES:
        own = catalog[t].groupBy("person_id").agg(F.count("*").alias("n")).withColumn("record_type", F.lit(t))
        out = own if out is None else out.unionByName(own)
    return out.groupBy("person_id").pivot("record_type", list(TYPES)).agg(F.sum("n")).na.fill(0, list(TYPES))


def odd_statuses(catalog: Catalog) -> DataFrame:
    """Medication statuses that are no state of a course."""
    status = F.lower(F.regexp_replace("status", r"(?U)^\s+|\s+$", ""))
    return catalog["medication"].where(status.isNotNull() & (status != "") & ~status.isin(*LIFECYCLE_MEDS)).select("medication_id", "person_id", "name", "status")


def undated_beside_dated(catalog: Catalog, dictionary: Dictionary = None) -> DataFrame:
    """Conditions of one person, name and subject, of which some have an onset and some none."""
    from ..functions.identity import condition_subject

    dated = date_only(F.col("onset_on")) != ""
    found = catalog["condition"].groupBy("person_id", norm(F.col("name"), dictionary).alias("token"), condition_subject(dictionary).alias("subject"))
    found = found.agg(F.count_if(dated).alias("dated"), F.count_if(~dated).alias("undated"))
    return found.where("dated > 0 AND undated > 0")
