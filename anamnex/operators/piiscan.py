"""Line scan for personal data in notes and diffs: slugs, names, dates of birth, and numbers that identify.

Rules look at one line at a time; lines with the allow marker are passed over. The rules for bare slugs and full names
need a table of given names, and full names also a word anywhere in the document that speaks of a person.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ALLOW = "pii-allow"
CONTEXT = r"(?i)\b(patient|person|roster|medication|meds|dob|repro|owner|family|slug|ingest|misfil|archive|record|chart|encounter)"
#: Placeholder identities that may appear (fixed values).
SLUGS = ("jane-doe", "john-doe", "kid-doe", "bob-roe", "john-roe", "robert-roe", "ann-poe", "ann-zed", "jane-smith", "karen-smith", "michael-vu", "alex-carter", "dana-roe", "stranger-sam")
SURNAMES = ("doe", "roe", "poe", "zed", "smith", "vu", "carter", "stranger", "last", "fields")
DOBS = ("1962-03-14", "1971-09-09", "1955-11-02", "1900-03-14", "1990-09-09", "1981-03-07", "1980-01-01", "1890-01-01", "1955-01-02", "1900-01-01", "1981-07-23", "1981-07-13")
#: What each rule finds; group 1 is the match.
PATTERNS = {
    "person-slug": r"(?:--person\s+|person add\s+|add_person\(\s*conn\s*,\s*[\"'])(?![<${])([a-z][a-z0-9-]{2,40})",
    "bare-slug": r"(?<![/._A-Za-z0-9])([a-z]{3,15}-[a-z]{3,15})\b(?![./])",
    "full-name": r"\b([A-Z][a-z]{2,14}(?:\s+[A-Z][a-z]{2,14}){1,3})\b",
    "patient-name": r"(Patient(?:\s+Name)?\s*:\s*[A-Za-z'-]{2,20}\s*[,^]\s*[A-Za-z'-]{2,20})",
    "dob": r"(?i)\b(?:DOB|D\.O\.B\.?|date of birth|birth ?date)\b\s*[:=]?\s*(\d{4}-\d{1,2}-\d{1,2}|\d{1,2}[/-]\d{1,2}[/-]\d{4})",
    "ssn": r"\b(\d{3}-\d{2}-\d{4})\b",
    "mrn": r"(?i)\b(MRN\s*[:=#]\s*[0-9]{4,12})\b",
    "card": r"\b((?:4\d{3}|5[1-5]\d{2}|3[47]\d{2}|6011)[ -]?\d{4}[ -]?\d{4}[ -]?\d{2,4})\b",
    "nhs": r"(?i)\bNHS(?:\s*(?:number|no\.?))?\s*[:=#]?\s*(\d{3}[ -]?\d{3}[ -]?\d{4})\b",
}
#: What a line must hold for a rule to find anything, by rule: a literal or, for "0", any digit. Rules look at no other lines.
NEEDED = {"person-slug": "person", "bare-slug": "-", "patient-name": "Patient", "dob": "0", "ssn": "0", "mrn": "0", "card": "0", "nhs": "0"}


def nhs_valid(found: Column) -> Column:
    """Weighted sum modulo 11 of the first nine digits against the tenth."""
    digits = F.transform(F.split(F.regexp_replace(found, "[^0-9]", ""), ""), lambda d: d.try_cast("int"))
    digits = F.filter(digits, lambda d: d.isNotNull())
    total = F.aggregate(F.transform(F.slice(digits, 1, 9), lambda d, i: d * (10 - i)), F.lit(0), lambda a, x: a + x)
    check = (11 - total % 11) % 11
    return (check != 10) & (check == F.element_at(digits, 10))


def dob_forms(found: Column) -> Column:
    """The ISO dates that a date may mean; day and month are tried both ways."""
    parts = F.transform(F.split(found, "[/-]"), lambda p: F.lpad(p, F.greatest(F.length(p), F.lit(2)), F.lit("0")))
    iso = F.array(F.array_join(parts, "-"))
    a, b, y = (F.element_at(parts, k) for k in (1, 2, 3))
    return F.when(found.rlike(r"^\d{4}-"), iso).otherwise(F.array(F.concat_ws("-", y, a, b), F.concat_ws("-", y, b, a)))


def lines_of(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, line, content, person_doc): a row per line, from 1."""
    whole = docs.select(F.col(doc_id).alias("doc_id"), F.split(F.col(text), r"\r?\n").alias("lines"), F.col(text).rlike(CONTEXT).alias("person_doc"))  # once a document: lines don't carry its text
    df = whole.select("doc_id", F.posexplode("lines").alias("pos", "content"), "person_doc")
    return df.select("doc_id", (F.col("pos") + 1).alias("line"), "content", "person_doc")


def scan_lines(lines: DataFrame, given_names: DataFrame) -> DataFrame:
    """(doc_id, line, rule, match, excerpt) of all findings in lines (doc_id, line, content, person_doc)."""
    clean = F.regexp_replace("content", r"\\[nrt]", "  ")
    kept = lines.where(~F.col("content").contains(ALLOW)).withColumn("clean", clean).withColumn("digits", F.col("clean").rlike("[0-9]"))

    def found_by(rule: str, pattern: str) -> Column:
        word = NEEDED.get(rule)
        asked = F.col("person_doc") if word is None else F.col("digits") if word == "0" else F.col("clean").contains(word)
        return F.when(asked, F.transform(F.regexp_extract_all("clean", F.lit(pattern), 1), _tagged(rule))).otherwise(F.array().cast("array<struct<rule:string,match:string>>"))

    each = F.array(*(found_by(rule, p) for rule, p in PATTERNS.items()))
    found = kept.select("doc_id", "line", "content", "person_doc", F.inline(F.flatten(each)))
    m = F.col("match")
    parts = F.split(m, "-")
    last, name = F.element_at(parts, -1), F.split(m, r"\s+")
    placeholder = F.exists(name, lambda t: F.lower(t).isin(*SURNAMES))
    patient = F.lower(F.regexp_extract(m, r":\s*([A-Za-z'-]{2,20})", 1))
    given = F.when(F.col("rule") == "bare-slug", parts[0]).when(F.col("rule") == "full-name", F.lower(name[0]))
    allowed = F.arrays_overlap(dob_forms(m), F.array(*map(F.lit, DOBS)))
    keep = (
        F.when(F.col("rule") == "person-slug", ~m.isin(*SLUGS) & (F.size(parts) >= 2) & ~last.isin(*SURNAMES))
        .when(F.col("rule") == "bare-slug", ~m.isin(*SLUGS) & ~last.isin(*SURNAMES))
        .when(F.col("rule") == "full-name", F.col("person_doc") & ~placeholder)
        .when(F.col("rule") == "patient-name", ~patient.isin(*SURNAMES))
        .when(F.col("rule") == "dob", ~allowed)
        .when(F.col("rule") == "nhs", nhs_valid(m))
        .otherwise(F.lit(True))
    )
    found = found.withColumn("given", given).where(F.coalesce(keep, F.lit(False)))
    known = given_names.select(F.lower(F.trim(given_names.columns[0])).alias("given")).where("given IS NOT NULL").distinct().withColumn("known", F.lit(True))
    key = F.coalesce("given", F.concat("rule", F.lit(" "), "match"))  # findings that ask for no name meet none, and are dealt evenly
    found = found.withColumn("asks", F.col("given").isNotNull()).withColumn("given", key).join(known, "given", "left").where("known OR NOT asks")
    return found.select("doc_id", "line", "rule", "match", F.substring(F.trim("content"), 1, 160).alias("excerpt"))


def _tagged(rule: str):
    return lambda m: F.struct(F.lit(rule).alias("rule"), m.alias("match"))


def scan(docs: DataFrame, given_names: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Findings in all lines of documents; given_names: a table whose first column lists given names."""
    return scan_lines(lines_of(docs, doc_id, text), given_names)


def added_lines(diffs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Added lines of unified diffs, with their file: (doc_id, file, line, content, person_doc); line numbers are those of the diff."""
    df = lines_of(diffs, doc_id, text)
    name = F.when(F.col("content").startswith("+++ "), F.regexp_replace(F.expr("substring(content, 5)"), r"^b/", ""))
    order = Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("file", F.last(name, ignorenulls=True).over(order))
    added = df.where(F.col("content").startswith("+") & ~F.col("content").startswith("+++"))
    return added.withColumn("content", F.expr("substring(content, 2)"))
