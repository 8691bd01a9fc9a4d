"""Files to documents: duplicate and tombstone gates, text, owner check, rows. And new text for documents that lack it."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import MONTHS, dob_renderings
from ..functions.plan import let, numbered
from ..functions.text import alnum, invisible_trim, is_blank, name_tokens
from ..plans.catalog import Catalog
from ..plans.scratch import written
from ..specs import schema_of
from .clinical import person_id
from .commit import next_ids, now_text

#: What shows that a text names somebody (fixed values).
ANCHOR = r"(?i)\bpatient\b|\bname\s*:|\bdob\b|\bdate\s+of\s+birth\b|\bbirth\s*date\b|\bmrn\b"
WINDOW = 120
PRIORITY = ("mismatch", "suspect", "match", "unverified")


def trusts_anchors(route: Column) -> Column:
    return route != "native"


def evidence(text: Column, anchor: str = ANCHOR) -> Column:
    """The characters up to half a WINDOW before and after the middle of the first anchor, white space collapsed."""

    def around(parts: Column) -> Column:
        before = F.length(parts[0])
        middle = before + F.floor((F.length(text) - before - F.length(F.get(parts, F.lit(1)))) / 2)
        start = F.greatest(middle - WINDOW // 2, F.lit(0))
        cut = F.substr(text, (start + 1).cast("int"), (middle + WINDOW // 2 - start).cast("int"))
        return F.when(F.size(parts) == 2, F.nullif(F.trim(F.regexp_replace(cut, r"(?U)\s+", " ")), F.lit("")))

    return let(F.split(text, anchor, 2), around)  # searched once


#: The shapes of the spellings of birth dates; texts are searched for each by itself, as they may overlap.
_MONTHS = "(?:" + "|".join(f"{m.lower()}|{m[:3].lower()}" for m in MONTHS) + ")"
DATE_SHAPES = (
    "[0-9]{4}-[0-9]{2}-[0-9]{2}",
    "[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}",
    "[0-9]{2}-[0-9]{2}-[0-9]{4}",
    _MONTHS + " [0-9]{1,2}, [0-9]{4}",
    "[0-9]{1,2} " + _MONTHS + " [0-9]{4}",
)


def spelt_dates(text: Column) -> Column:
    """What looks like a spelling of a date in a text, in lower case, with no digit beside it."""
    found = [F.regexp_extract_all(F.lower(text), F.lit(f"(?<![0-9]){shape}(?![0-9])"), F.lit(0)) for shape in DATE_SHAPES]
    return F.array_distinct(F.concat(*found))


def has_words(plain: Column, tokens: Column) -> Column:
    return F.forall(tokens, lambda t: plain.contains(F.concat(F.lit(" "), t, F.lit(" "))))


def names_person(text: Column, plain: Column, tokens: Column, dobs: Column) -> Column:
    """Whether a text holds all words of a name, or any rendering of a date of birth with no digit beside it."""
    named = (F.size(tokens) > 0) & has_words(plain, tokens)
    padded = F.concat(F.lit(" "), F.lower(text), F.lit(" "))
    born = F.exists(dobs, lambda d: F.regexp_like(padded, F.concat(F.lit(r"(?<![0-9])\Q"), F.lower(d), F.lit(r"\E(?![0-9])"))))
    return F.coalesce(named, F.lit(False)) | F.coalesce(born, F.lit(False))


def first_two(df: DataFrame, *key: str) -> DataFrame:
    """The two smallest persons of each key: one of them is the first person besides the claimed one."""
    order = F.row_number().over(Window.partitionBy(*key).orderBy("person_id"))
    return df.withColumn("__k", order).where("__k <= 2").drop("__k")


def named_others(rest: DataFrame, people: DataFrame) -> DataFrame:
    """(document_id, person_id, slug): persons besides the claimed one all of whose name words stand in the text.

    People of one set of words are one key, under the word that the fewest sets have.
    """
    sets = people.where(F.size("tokens") > 0).select(F.array_sort(F.array_distinct("tokens")).alias("tokens"), "person_id", "slug")
    words = sets.select("tokens").distinct().select("tokens", F.explode("tokens").alias("word"))
    often = words.groupBy("word").agg(F.count("*").alias("n"))
    rarest = words.join(often, "word").groupBy("tokens").agg(F.min_by("word", F.struct("n", "word")).alias("word"))
    keys = first_two(sets, "tokens").join(rarest, "tokens")
    met = rest.select("document_id", "claimed", F.explode(F.array_distinct(F.split(F.trim("plain"), " "))).alias("word")).join(keys, "word")
    met = met.where(~F.col("person_id").eqNullSafe(F.col("claimed"))).select("document_id", "tokens", "person_id", "slug")
    return met.join(rest.select("document_id", "plain"), "document_id").where(has_words(F.col("plain"), F.col("tokens"))).select("document_id", "person_id", "slug")


def born_others(rest: DataFrame, people: DataFrame) -> DataFrame:
    """(document_id, person_id, slug): persons besides the claimed one of whose birth date some spelling stands in the text."""
    days = people.select(F.explode(F.array_distinct(F.transform("dobs", F.lower))).alias("day"), "person_id", "slug")
    met = rest.select("document_id", "claimed", F.explode(spelt_dates(F.col("text"))).alias("day")).join(first_two(days, "day"), "day")
    return met.where(~F.col("person_id").eqNullSafe(F.col("claimed"))).select("document_id", "person_id", "slug")


def owner_checks(docs: DataFrame, roster: DataFrame, anchors: Column | None = None) -> DataFrame:
    """Verdict for each document (document_id, person_id claimed, text): match, mismatch, suspect or unverified, with who and why.

    The claimed owner comes first; only texts that don't name them meet the rest of the roster: by the rarest word of
    a name, and by whole dates of the spellings that birth dates have. Of people who share a name or a date, two are
    enough to find the first besides the claimed one, so that a word or date meets at most two rows of each kind.
    """
    people = roster.select("person_id", "slug", name_tokens(F.col("full_name")).alias("tokens"), dob_renderings(F.col("dob")).alias("dobs"))
    docs = docs.select("*", alnum(F.coalesce("text", F.lit(""))).alias("plain"))
    own = docs.join(people.withColumnRenamed("slug", "claimed_slug"), "person_id", "left")
    own = own.withColumn("is_match", ~is_blank(F.col("text")) & names_person(F.col("text"), F.col("plain"), F.col("tokens"), F.col("dobs")))
    rest = own.where(~F.coalesce("is_match", F.lit(False)) & ~is_blank(F.col("text"))).select("document_id", F.col("person_id").alias("claimed"), "text", "plain")
    others = named_others(rest, people).unionByName(born_others(rest, people)).groupBy("document_id").agg(F.min_by("slug", "person_id").alias("other_slug"))
    named = F.size(F.coalesce("tokens", F.array().cast("array<string>"))) > 0
    said = own.select("document_id", "claimed_slug", "is_match", evidence(F.col("text")).alias("why"), (named & (F.lit(True) if anchors is None else anchors)).alias("anchors"))
    out, why = said.join(others, "document_id", "left"), F.col("why")  # texts stay where they are
    anchored = why.isNotNull() & F.col("anchors")
    verdict = F.when(F.col("is_match"), "match").when(F.col("other_slug").isNotNull(), "mismatch").when(anchored, "suspect").otherwise("unverified")
    who = F.when(F.col("is_match"), F.col("claimed_slug")).otherwise(F.col("other_slug"))
    return out.select("document_id", verdict.alias("verdict"), who.alias("matched_slug"), F.when(verdict != "unverified", why).alias("evidence"))


def strongest(checks: DataFrame, *by: str) -> DataFrame:
    order = F.array_position(F.array(*map(F.lit, PRIORITY)), F.col("verdict"))
    return checks.groupBy(*by).agg(F.min_by(F.struct("verdict", "matched_slug", "evidence"), order).alias("check"))


def ingest(catalog: Catalog, files: DataFrame, slug: str, force: bool = False, tombstone_force: bool = False, now: dt.datetime | None = None, **more) -> tuple[Catalog, DataFrame]:
    """Admit decoded files (path, suffix, sha256, text, route, error). Returns the catalog and the status of each file.

    Statuses: pointer, duplicate (stored already, or the same bytes earlier in the batch), tombstoned, mismatch or
    suspect (unless forced), and new.
    """
    who = person_id(catalog, slug)
    stored = catalog["document"].select("sha256", F.lit(True).alias("stored")).distinct()
    buried = catalog["document_tombstone"].select("sha256", F.lit(True).alias("buried")).distinct()
    df = files.drop("content").join(stored, "sha256", "left").join(buried, "sha256", "left")
    df = df.withColumn("again", F.row_number().over(Window.partitionBy("sha256").orderBy("path")) > 1)
    df = df.withColumn("document_id", F.xxhash64("path")).withColumn("person_id", F.lit(who).cast("long"))
    own = files.select(F.xxhash64("path").alias("document_id"), F.lit(who).cast("long").alias("person_id"), "text", "route")
    checks = owner_checks(own, catalog["person"], trusts_anchors(F.col("route")))
    df = df.join(checks, "document_id", "left")
    status = (
        F.when(F.col("route") == "pointer", "pointer").when(F.col("stored") | F.col("again"), "duplicate").when(F.col("buried") & F.lit(not tombstone_force), "tombstoned")
        .when(F.col("verdict").isin("mismatch", "suspect") & F.lit(not force), F.col("verdict")).otherwise("new")
    )
    df = df.withColumn("status", F.coalesce(status, F.lit("new")))
    start = next_ids(catalog["document"], "document_id")
    new = numbered(df.where("status = 'new'").drop("document_id"), "document_id", start, "path")
    place = F.concat_ws("/", F.substring("sha256", 1, 2), F.concat("sha256", "suffix"))
    made = {
        "document_id": F.col("document_id"), "sha256": F.col("sha256"), "person_id": F.lit(who), "source_path": place, "ocr_text": F.col("text"),
        "ingested_at": F.lit(now_text(now)), "text_source": F.when(F.col("text").isNotNull(), F.col("route")), **{k: F.lit(v) for k, v in more.items()},
    }
    rows = new.select(*(made.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema_of("document")))
    return catalog.with_tables(document=catalog["document"].unionByName(rows)), df.select("path", "sha256", "status", "route", "error", "verdict", "matched_slug", "evidence")


def reextracted(catalog: Catalog, decoded: DataFrame, force: bool = False, allow_shrink: bool = False) -> tuple[Catalog, DataFrame]:
    """New text for documents from decoded blobs (sha256, text, route, error). Returns the catalog and the status of each document.

    Statuses: missing-blob, failed, empty, unchanged, present (has text, not forced), shrunk (would lose text, not allowed), written.
    """
    df = catalog["document"].join(decoded.select("sha256", F.col("text").alias("new_text"), "route", "error", F.lit(True).alias("blob")), "sha256", "left")
    had, new = invisible_trim(F.coalesce("ocr_text", F.lit(""))), invisible_trim(F.coalesce("new_text", F.lit("")))
    status = (
        F.when(F.col("blob").isNull(), "missing-blob").when(F.col("error").isNotNull(), "failed").when(new == "", "empty").when(F.col("new_text") == F.col("ocr_text"), "unchanged")
        .when((had != "") & F.lit(not force), "present").when((F.length(new) < F.length(had)) & F.lit(not allow_shrink), "shrunk").otherwise("written")
    )
    df = df.withColumn("status", status)
    done = F.col("status") == "written"
    rows = df.withColumn("ocr_text", F.when(done, F.col("new_text")).otherwise(F.col("ocr_text"))).withColumn("text_source", F.when(done, F.col("route")).otherwise(F.col("text_source")))
    return catalog.with_tables(document=rows.select(*schema_of("document").names)), df.select("document_id", "status")


class TooLargeError(ValueError):
    """A study is larger than may be packed without being told so."""


#: Bytes of a study that are packed without being asked (fixed value).
MOST_STUDY_BYTES = 4 << 30


def ingest_study(catalog: Catalog, slug: str, root: str, blobs: str, force: bool = False, allow_large: bool = False, tombstone_force: bool = False, most: int = MOST_STUDY_BYTES, now: dt.datetime | None = None, **more) -> tuple[Catalog, DataFrame]:
    """A folder of slices as one document: size gate, header, owner check, canonical archive, duplicate and tombstone gates, row.

    Only slices are packed; the report counts the rest and names what looks like a document. An executor packs the
    archive, which is kept below blobs under its hash if the document is new. Returns the catalog and one row.
    """
    from ..sources import dicom, studies

    spark, name = catalog.spark, root.rstrip("/").rpartition("/")[2]
    found = written(studies.files(spark, root))  # headers are read once
    own = found.where("kind = 'slice'")
    counts = own.agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")).first()
    if not counts["n"]:
        raise ValueError(f"{root} holds no slices")
    if counts["bytes"] > most and not allow_large:
        raise TooLargeError(f"{counts['bytes']} bytes, more than {most}; say that large studies are meant")
    rows = studies.slices(found).withColumn("study", F.lit(name))
    head = dicom.studies(rows).withColumn("n_files", F.lit(counts["n"])).select("study_date", dicom.summary_text(F.col("study"), F.col("n_files")).alias("text"), dicom.identity_text().alias("identity")).first()
    sums = studies.files(spark, root, "path", "name", "length", "kind", "crc").where("kind = 'slice'")
    packed = written(studies.packed(sums.withColumn("study", F.lit(name)), blobs))
    sha = packed.first()["sha256"]
    said, identity = (head["text"], head["identity"]) if head else (f"DICOM study: {name}\nfiles packed: {counts['n']}", None)  # a directory file alone
    text = "\n".join(t for t in (identity, said) if t)
    one = spark.createDataFrame([(root, ".dcm.zip", sha, text, "study", None, None)], "path string, suffix string, sha256 string, text string, route string, error string, content binary")
    after, report = ingest(catalog, one, slug, force, tombstone_force, now, **{"doc_date": head["study_date"] if head else None, **more})
    if report.first()["status"] == "new":
        studies.kept(packed, blobs).count()
    else:
        studies.dropped(packed)
    rest = found.agg(F.sort_array(F.collect_list(F.when(F.col("kind") == "document", F.col("name")))).alias("excluded_documents"), F.count_if(F.col("kind") == "other").alias("excluded_other")).first()
    return after, report.withColumn("excluded_documents", F.array(*map(F.lit, rest["excluded_documents"])).cast("array<string>")).withColumn("excluded_other", F.lit(rest["excluded_other"]))
