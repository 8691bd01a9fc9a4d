"""Dates as text of three precisions: year, month, day with or without a time. All are Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import squeezed, stripped

_DAY = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
#: The same with nothing after it: a cast then reads what the pattern yyyy-MM-dd does, and costs less.
_CAST_DAY = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z"
_TIME = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}(:?[0-9]{2}(:?[0-9]{2}([.,][0-9]{1,9})?)?)?(Z|[+-][0-9]{2}(:?[0-9]{2})?)?$"


def date_only(value: Column) -> Column:
    """What stands before T or the first space; '' for null."""
    return F.coalesce(F.substring_index(F.replace(stripped(value), F.lit("T"), F.lit(" ")), " ", 1), F.lit(""))


def norm_ts(value: Column) -> Column:
    """Full precision with one spelling of the separator; '' for null."""
    return F.coalesce(squeezed(F.replace(value, F.lit("T"), F.lit(" "))), F.lit(""))


def full_date(value: Column) -> Column:
    """DateType of a value of day precision, null for all else. A plain cast would read 2024 as a day."""
    day = date_only(value)
    return F.when(day.rlike(_CAST_DAY), day.try_cast("date"))


def is_iso_date(value: Column) -> Column:
    """Whether a value is an ISO date of any of the three precisions; times only with days."""
    day = F.substring(value, 1, 10)
    real_day = F.try_to_date(day, "yyyy-MM-dd").isNotNull() & (F.substring(value, 1, 4) != "0000")
    hour, minute = F.regexp_extract(value, r"[T ]([0-9]{2})", 1), F.regexp_extract(value, r"[T ][0-9]{2}:?([0-9]{2})", 1)
    second = F.regexp_extract(value, r"[T ][0-9]{2}:?[0-9]{2}:?([0-9]{2})", 1)
    in_time = (F.coalesce(hour.try_cast("int"), F.lit(0)) < 24) & (F.coalesce(minute.try_cast("int"), F.lit(0)) < 60) & (F.coalesce(second.try_cast("int"), F.lit(0)) < 60)
    month = F.substring(value, 6, 2).try_cast("int").between(1, 12)
    return F.coalesce(
        F.when(value.rlike(r"^[0-9]{4}$"), value != "0000")
        .when(value.rlike(r"^[0-9]{4}-[0-9]{2}$"), month & (F.substring(value, 1, 4) != "0000"))
        .when(value.rlike(_DAY), real_day)
        .when(value.rlike(_TIME), real_day & in_time),
        F.lit(False),
    )


def has_time(value: Column) -> Column:
    return F.coalesce((F.length(value) > 10) & F.substring(value, 11, 1).isin("T", " "), F.lit(False))


def end_of_period(value: Column) -> Column:
    """Last day that a value covers; null if it can't be read."""
    day = date_only(value)
    year = F.when(day.rlike(r"^[0-9]{1,4}$"), F.concat(F.lpad(day, 4, "0"), F.lit("-12-31")).try_cast("date"))
    month = F.when(day.rlike(r"^[0-9]{4}-[0-9]{1,2}\z"), F.last_day(F.concat(day, F.lit("-1")).try_cast("date")))
    return F.coalesce(year, month, F.when(day.rlike(r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}\z"), day.try_cast("date")))


def ordinal(value: Column) -> Column:
    """Days since 1970 of a day-precision value; differs from other day counts by a constant, which no slope sees."""
    return F.unix_date(full_date(value))


def months_before(day: Column, months: int) -> Column:
    return F.add_months(day, -months)


def doc_date(value: Column) -> Column:
    """A document's date: trimmed, real, of day precision; null otherwise."""
    trimmed = F.regexp_replace(value, r"^[\n\r\t ]+|[\n\r\t ]+$", "")
    return F.when(trimmed.rlike(_DAY) & F.try_to_date(trimmed, "yyyy-MM-dd").isNotNull(), trimmed)


def compact_date(value: Column) -> Column:
    """yyyyMMdd to ISO; null if it isn't one."""
    return F.date_format(F.try_to_date(F.substring(value, 1, 8), "yyyyMMdd"), "yyyy-MM-dd")


def leading_digits_date(value: Column) -> Column:
    """Leading digits as a day, month or year, by how many they are."""
    d = F.regexp_extract(F.trim(value), r"^[0-9]+", 0)
    year, month, day = F.substring(d, 1, 4), F.substring(d, 5, 2), F.substring(d, 7, 2)
    return F.when(F.length(d) >= 8, F.concat_ws("-", year, month, day)).when(F.length(d) >= 6, F.concat_ws("-", year, month)).when(F.length(d) >= 4, year)


#: Month names (fixed values).
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")


def dob_renderings(dob: Column) -> Column:
    """Eight spellings of a date of birth; an empty array if there is none."""
    d = full_date(F.substring(F.trim(dob), 1, 10))
    forms = ["yyyy-MM-dd", "MM/dd/yyyy", "M/d/yyyy", "MM-dd-yyyy", "MMMM d, yyyy", "d MMMM yyyy", "MMM d, yyyy", "d MMM yyyy"]
    return F.when(d.isNull(), F.array().cast("array<string>")).otherwise(F.array_distinct(F.array(*(F.date_format(d, f) for f in forms))))
