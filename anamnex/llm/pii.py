"""Personal data by anchor expansion.

One Aho-Corasick pass finds anchors: at-signs, plus signs, digits, schemes and cues of identifiers. From each anchor a
deterministic local parser expands to the boundaries and validates. Emails, addresses of machines, card numbers and
phone numbers are exactly the leftmost non-overlapping matches of these patterns, of which failing ones are dropped:

- email `[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+`
- ip `[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)`, parts at most 255
- card `[0-9]([\\x20-]?[0-9])+`, 14 to 19 digits that pass Luhn's test
- phone `\\+[0-9][\\x20().0-9-]+[0-9]`, 10 to 15 digits

Cues add two more kinds: `account` (a number or IBAN after such a word) and `secret` (what a password, token or key is
set to, AWS key ids, and logins inside URLs). Null texts count as empty. Offsets are code points, ends exclusive.
Texts of any length count whole; repeated rows get equal spans; other columns pass through, and input columns with the
name of an output are replaced; an empty table gives an empty one.
"""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import with_columns

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "account", "secret")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
RUN = re.compile(r"[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
ACCOUNT = re.compile(r"(?: (?:no\.?|number|nr\.?|id))?\s{0,2}[:=#]?\s{0,2}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?|[0-9][0-9 -]{4,30}[0-9])(?![A-Za-z0-9])", re.ASCII)
SECRET = re.compile(r"""["']?\s{0,2}[=:]\s{0,2}["']?([A-Za-z0-9+/_.~-]{8,})""")
AWS = re.compile(r"AKIA[0-9A-Z]{16}(?![0-9A-Za-z])")
LOGIN = re.compile(r"://([^\s/:@]+:[^\s/@]+)@")
ACCOUNT_CUES = ("iban", "account", "acct", "konto", "compte", "cuenta", "ssn", "passport")
SECRET_CUES = ("password", "passwd", "token", "secret", "api_key", "apikey", "access_key")

SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
SPANS = T.ArrayType(SPAN)


@lru_cache(maxsize=1)
def anchors() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for word, kind in [("@", "@"), ("+", "+"), ("://", "login"), ("AKIA", "aws"), *((d, "digit") for d in "0123456789")]:
        found.add_word(word, (kind, len(word)))
    for cues, kind in ((ACCOUNT_CUES, "account"), (SECRET_CUES, "secret")):
        for cue in cues:
            for form in {cue, cue.upper(), cue.capitalize()}:
                found.add_word(form, (kind, len(form)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(divmod(2 * int(d), 10)[0] + 2 * int(d) % 10 for d in digits[-2::-2])) % 10 == 0


def find(text: str) -> list[tuple[str, int, int]]:
    """All spans by start, then kind."""
    out: list[tuple[str, int, int]] = []
    after = {"@": 0, "ip": 0, "card": 0, "+": 0, "account": 0, "secret": 0}
    for last, (kind, n) in anchors().iter(text):
        at = last - n + 1
        if kind == "digit":
            if at >= after["ip"]:
                if m := IP.match(text, at):
                    after["ip"] = m.end()
                    if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
                        out.append(("ip", at, m.end()))
                else:
                    after["ip"] = RUN.match(text, at).end()
            if at >= after["card"]:
                if m := CARD.match(text, at):
                    after["card"] = m.end()
                    if m.end() - at <= 37 and 14 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
                        out.append(("card", at, m.end()))
                else:
                    after["card"] = at + 1
        elif kind == "@":
            start = at
            while start > after["@"] and text[start - 1] in LOCAL:
                start -= 1
            if start < at and (m := DOMAIN.match(text, at)):
                out.append(("email", start, m.end()))
                after["@"] = m.end()
        elif kind == "+":
            if at >= after["+"] and (m := PHONE.match(text, at)):
                after["+"] = m.end()
                if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out.append(("phone", at, m.end()))
        elif kind == "account":
            if at >= after["account"] and not text[at - 1 : at].isalnum() and (m := ACCOUNT.match(text, last + 1)):
                after["account"] = m.end()
                out.append(("account", *m.span(1)))
        else:
            m = SECRET.match(text, last + 1) if kind == "secret" else AWS.match(text, at) if kind == "aws" else LOGIN.match(text, at)
            if at >= after["secret"] and m:
                after["secret"] = m.end()
                out.append(("secret", *m.span(0 if kind == "aws" else 1)))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Spans become their kind in brackets; of overlapping ones, the first names the joint span."""
    out, at, open_end = [], 0, -1
    for kind, start, end in spans:
        if start < open_end:
            if end > open_end:
                open_end = at = end
            continue
        out += [text[at:start], f"[{kind.upper()}]"]
        at = open_end = end
    return "".join([*out, text[at:]])


def span_array(found: list[list[tuple[str, int, int]]]) -> pa.Array:
    flat = [s for own in found for s in own]
    kinds, starts, ends = ([s[i] for s in flat] for i in range(3))
    inner = pa.StructArray.from_arrays([pa.array(kinds, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=["kind", "start", "end"])
    offsets = [0]
    for own in found:
        offsets.append(offsets[-1] + len(own))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), inner)


def detect(df: DataFrame, text: str = "text", out: str = "spans") -> DataFrame:
    """Append array<struct<kind, start, end>> of the spans in a text column."""

    def make(column: pa.Array) -> list:
        return [span_array([find(t.as_py() or "") for t in column])]

    return with_columns(df, [text], [T.StructField(out, SPANS)], make)


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """Put kinds in place of the spans; nulls stay null. A column n_chars, where there is one, is set anew."""

    def make(column: pa.Array) -> list:
        return [pa.array([None if (s := t.as_py()) is None else redacted(s, find(s)) for t in column], pa.string())]

    order = df.columns
    done = with_columns(df, [text], [T.StructField(text, T.StringType())], make)
    if "n_chars" in order:
        done = done.withColumn("n_chars", F.coalesce(F.length(text), F.lit(0)).cast(df.schema["n_chars"].dataType))
    return done.select(*(F.col(f"`{c}`") for c in order))


def of_kind(kind: str):
    return lambda s: s["kind"] == kind


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(df: DataFrame, spans: str = "spans") -> DataFrame:
    """doc_id, counts of the four base kinds, a hash of their spans, and all spans as text."""
    own = F.filter(F.col(spans), lambda s: s["kind"].isin(*BASE))
    counts = [F.size(F.filter(F.col(spans), of_kind(k))).cast("long").alias(f"n_{k}") for k in BASE]
    return df.select("doc_id", *counts, F.sha2(joined(own), 256).alias("base_sha256"), joined(F.col(spans)).alias("spans"))
