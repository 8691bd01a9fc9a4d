"""Fill-in-middle transformation: texts cut into units at neighbouring-class boundaries, and their parts put in another order.

A unit grammar is a sequence of alternatives, each a character class, `[A-Za-z]`, or a run of one, `[A-Za-z]+`. The classes
exclude one another and the last takes all other characters. Units matched left to right then begin exactly where two
neighbouring characters don't belong to the same run, which is a zero-width expression of lookarounds: Spark's split by
it gives the units, and nothing of the text is lost. An empty text has no units (split would give one, the empty string).

Every expression is evaluated in the JVM, a row at a time; nothing is shuffled.

Odd rows. A null or empty text has no units and stays as it is, as does a text that holds one of the marks: its form is
plain, and the counts of prefix and middle are null. A null id is hashed as an empty number. A text of any length is cut
whole; its units are an array of the row (about 24 bytes each). Repeated rows give equal rows, empty tables none. Other
columns pass through; those with the name of an output are replaced.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.plan import let, settled

WORDS_AND_OTHERS = "[A-Za-z]+|[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of a hundred texts, those cut; of a hundred cut texts, those whose suffix comes first.
CUT_PERCENT, SUFFIX_FIRST_PERCENT = 90, 20
OUTPUTS = ("n", "form", "prefix_chars", "middle_chars", "output")


def boundary(grammar: str) -> str:
    """The places between the units of a grammar, as a regular expression of width zero: any place with a character on
    both sides, but for those whose neighbours are both of one run's class."""
    alternatives = re.findall(r"(\[(?:\\.|[^\]\\])+\])(\+?)(?:\||$)", grammar)
    if not grammar or "|".join(c + more for c, more in alternatives) != grammar:
        raise ValueError(f"not a sequence of classes and runs of classes: {grammar}")
    runs = "".join(f"(?!(?<={c})(?={c}))" for c, more in alternatives if more)
    return rf"(?s)(?<=.)(?=.){runs}"


def units(text: Column, grammar: str = WORDS_AND_OTHERS) -> Column:
    """The units of a text in order; joined without anything between, they are the text. None for an empty or null text."""
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.array().cast("array<string>")).otherwise(F.split(text, boundary(grammar), -1))


def draws(doc_id: Column, seed: int) -> Column:
    """Four numbers below 2 ** 32 that depend on the id and the seed alone."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return let(digest, lambda d: F.array(*(F.conv(F.substring(d, 8 * k + 1, 8), 16, 10).cast("bigint") for k in range(4))))


def joined(pieces: Column, start: Column, end: Column) -> Column:
    """The units from start (0 for the first) up to, not including, end."""
    return F.array_join(F.slice(pieces, (start + 1).cast("int"), (end - start).cast("int")), "")


def transform(
    df: DataFrame, grammar: str = WORDS_AND_OTHERS, seed: int = 1, cut_percent: int = CUT_PERCENT,
    suffix_first_percent: int = SUFFIX_FIRST_PERCENT, doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Append n (units, long), form (plain, psm or spm), prefix_chars and middle_chars (code points, null where plain) and output.

    Two places are drawn with equal chance among all between units and at both ends; they part prefix, middle and suffix.
    """
    df = df.drop(*(c for c in OUTPUTS if c not in (doc_id, text)))
    kept = [F.col(f"`{c}`") for c in df.columns]
    own = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    df = settled(df, __text=own, __units=units(own, grammar), __h=draws(F.col(f"`{doc_id}`"), seed))
    whole, h = F.col("__text"), [F.col("__h")[k] for k in range(4)]
    n = F.size("__units").cast("bigint")
    plain = (n == 0) | (h[2] % 100 >= cut_percent)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        plain = plain | F.contains(whole, F.lit(mark))
    one, other = h[0] % (n + 1), h[1] % (n + 1)
    form = F.when(plain, "plain").when(h[3] % 100 < suffix_first_percent, "spm").otherwise("psm")
    df = settled(df, __n=n, __form=form, __from=F.least(one, other), __to=F.greatest(one, other))
    cut, zero = F.col("__form") != "plain", F.lit(0)
    part = lambda a, b: F.when(cut, joined(F.col("__units"), a, b))
    df = settled(df, __p=part(zero, F.col("__from")), __m=part(F.col("__from"), F.col("__to")), __s=part(F.col("__to"), F.col("__n")))
    prefix, middle, suffix = (F.concat(F.lit(mark), F.col(c)) for mark, c in ((PREFIX, "__p"), (MIDDLE, "__m"), (SUFFIX, "__s")))
    output = F.when(~cut, whole).when(F.col("__form") == "spm", F.concat(suffix, prefix, middle)).otherwise(F.concat(prefix, suffix, middle))
    return df.select(
        *kept, F.col("__n").alias("n"), F.col("__form").alias("form"), F.length("__p").cast("bigint").alias("prefix_chars"),
        F.length("__m").cast("bigint").alias("middle_chars"), output.alias("output"),
    )


def restored(output: Column, form: Column) -> Column:
    """The text, from an output and its form alone: between its marks, an output holds none."""
    by_mark = lambda p, m, s: let(F.split(output, "<[PSM]>", -1), lambda x: F.concat(x[p], x[m], x[s]))
    return F.when(form == "plain", output).when(form == "psm", by_mark(1, 3, 2)).when(form == "spm", by_mark(2, 3, 1))


def digest(df: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Hashes of the outputs and of the texts that are rebuilt from them."""
    return df.select(
        F.col(f"`{doc_id}`").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )
