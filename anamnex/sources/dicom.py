"""Imaging studies: which files are slices, their header tags, and what a study says about itself."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAGIC_AT, MAGIC = 128, b"DICM"
HEADER_BYTES, TAG_CHARS, SERIES_LINES = 1 << 20, 128, 20
#: Tags by name, long value forms, transfer syntaxes.
TAGS = {"study_date": (0x0008, 0x0020), "modality": (0x0008, 0x0060), "study_description": (0x0008, 0x1030), "series_description": (0x0008, 0x103E), "patient_name": (0x0010, 0x0010), "patient_birth_date": (0x0010, 0x0030), "study_uid": (0x0020, 0x000D)}
SYNTAX = (0x0002, 0x0010)
LONG_FORMS = {b"OB", b"OD", b"OF", b"OL", b"OV", b"OW", b"SQ", b"SV", b"UC", b"UN", b"UR", b"UT", b"UV"}
IMPLICIT, EXPLICIT, ENCAPSULATED = "1.2.840.10008.1.2", "1.2.840.10008.1.2.1", "1.2.840.10008.1.2.4"
STOP_GROUP = 0x0021


def is_slice(content: Column) -> Column:
    return F.substring(content, MAGIC_AT + 1, 4) == F.lit(MAGIC)


def tidy(raw: bytes) -> str | None:
    return raw[:TAG_CHARS].decode("latin-1").replace("\0", "").strip() or None


def elements(data: bytes, explicit: bool, wanted: set) -> dict:
    """Values of the wanted tags; reading stops at image groups, undefined lengths and the end."""
    return elements_and_end(data, explicit, wanted)[0]


def elements_and_end(data: bytes, explicit: bool, wanted: set) -> tuple[dict, bool]:
    """elements(), and whether more data could not add to them."""
    found: dict = {}
    at = 0
    while at + 8 <= len(data) and len(found) < len(wanted):
        tag = struct.unpack_from("<HH", data, at)
        if tag[0] >= STOP_GROUP:
            return found, True
        if explicit and data[at + 4 : at + 6] in LONG_FORMS:
            if at + 12 > len(data):
                break
            size, head = struct.unpack_from("<I", data, at + 8)[0], 12
        elif explicit:
            size, head = struct.unpack_from("<H", data, at + 6)[0], 8
        else:
            size, head = struct.unpack_from("<I", data, at + 4)[0], 8
        start = at + head
        if size == 0xFFFFFFFF:
            return found, True
        if start + size > len(data):
            break
        if tag in wanted:
            found[tag] = tidy(data[start : start + size])
        at = start + size
    return found, len(found) == len(wanted)


def value_form(syntax: str | None) -> bool | None:
    """True for explicit, False for implicit little endian, null for what can't be read."""
    if syntax == IMPLICIT:
        return False
    return True if syntax == EXPLICIT or (syntax or "").startswith(ENCAPSULATED) else None


def tags_of(data: bytes) -> dict[str, str]:
    """Header tags by name; none unless the bytes are a slice whose header can be read."""
    return tags_and_end(data)[0]


def tags_and_end(data: bytes) -> tuple[dict[str, str], bool]:
    """tags_of(), and whether more of the file could not add to them."""
    at = MAGIC_AT + len(MAGIC)
    if data[MAGIC_AT:at] != MAGIC or len(data) < at + 12:
        return {}, True
    group, element, form, size = struct.unpack_from("<HH2sH", data, at)
    if (group, element, form, size) != (2, 0, b"UL", 4):
        return {}, True
    meta = struct.unpack_from("<I", data, at + 8)[0]
    body = at + 12 + meta
    if meta > HEADER_BYTES:
        return {}, True
    if body > len(data):
        return {}, False
    explicit = value_form(elements(data[at + 12 : body], True, {SYNTAX}).get(SYNTAX))
    if explicit is None:
        return {}, True
    found, whole = elements_and_end(data[body : body + HEADER_BYTES], explicit, set(TAGS.values()))
    return {n: v for n, t in TAGS.items() if (v := found.get(t))}, whole or len(data) >= body + HEADER_BYTES


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def header_tags(content: pd.Series) -> pd.Series:
    return content.map(lambda c: tags_of(bytes(c)), na_action="ignore")


def slices(files: DataFrame) -> DataFrame:
    """path, directory and tags of the slices among files (path, content); only the header goes to Python."""
    df = files.where(is_slice(F.col("content")))
    head = header_tags(F.substring("content", 1, MAGIC_AT + HEADER_BYTES + (1 << 16)))
    return df.select("path", F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("directory"), head.alias("tags"))


def iso(tag: Column) -> Column:
    from ..functions.dates import compact_date

    return compact_date(tag)


def studies(rows: DataFrame, root: str = "study") -> DataFrame:
    """From slices with a study column: the first slice's tags, the series (by directory) and the number of slices."""
    series = rows.groupBy(root, "directory").agg(F.count("*").alias("slices"), F.min_by(F.col("tags")["series_description"], "path").alias("description"))
    listed = series.groupBy(root).agg(F.sort_array(F.collect_list(F.struct("directory", "description", "slices"))).alias("series"), F.sum("slices").alias("slices"))
    first = rows.groupBy(root).agg(F.min_by("tags", "path").alias("t"))
    tags = [iso(F.col("t")[n]).alias(n) if n.endswith("_date") else F.col("t")[n].alias(n) for n in TAGS if n != "series_description"]
    return first.select(root, *tags).join(listed, root)


def _line(label: str, column: Column) -> Column:
    return F.when(column.isNotNull(), F.concat(F.lit(label), column.cast("string")))


def summary_text(root: Column, n_files: Column) -> Column:
    """What a study says, as text that can be searched; at most SERIES_LINES series are named, the rest are counted."""
    n = F.size("series")
    many = F.when(n > 1, F.concat(F.lit(" in "), n.cast("string"), F.lit(" series"))).otherwise(F.lit(""))
    label = F.transform(F.slice("series", 1, SERIES_LINES), lambda s: F.concat(F.lit("  - "), F.coalesce(s["description"], F.when(s["directory"] != "", s["directory"]), F.lit("(unnamed)")), F.lit(" - "), s["slices"].cast("string"), F.lit(" slices")))
    named = (n > 1) | F.exists("series", lambda s: s["description"].isNotNull())
    more = F.when(n > SERIES_LINES, F.concat(F.lit("  - ... and "), (n - SERIES_LINES).cast("string"), F.lit(" more series")))
    return F.concat_ws(
        "\n", F.concat(F.lit("DICOM study: "), root), _line("modality: ", F.col("modality")), _line("study date: ", F.col("study_date")), _line("study description: ", F.col("study_description")),
        F.when(F.col("slices") > 0, F.concat(F.lit("slices: "), F.col("slices").cast("string"), many)), F.when(named, F.concat_ws("\n", F.lit("series:"), F.array_join(label, "\n"), more)),
        _line("study UID: ", F.col("study_uid")), _line("files packed: ", n_files),
    )


def identity_text() -> Column:
    return F.nullif(F.concat_ws("\n", _line("Patient: ", F.col("patient_name")), _line("DOB: ", F.col("patient_birth_date"))), F.lit(""))


def human_bytes(size: Column) -> Column:
    def shown(amount: Column, form: str, unit: str) -> Column:  # halves go to the even digit
        return F.concat(F.call_function("format_number", amount, F.lit(form)), F.lit(f" {unit}"))

    out = shown(size / float(1 << 40), "0.0", "TiB")
    for k, unit in reversed(list(enumerate(("B", "KiB", "MiB", "GiB")))):
        text = shown(size.cast("double"), "0", "B") if k == 0 else shown(size / float(1 << 10 * k), "0.0", unit)
        out = F.when(size < (1 << 10 * (k + 1)), text).otherwise(out)
    return out
