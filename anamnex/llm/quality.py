"""Quality rules: counts within a document, and lines that too many documents of its host share.

Each document is measured in one pass over its text: words, symbols, repeated lines and repeated windows of words decide
the base verdict, and its lines, normalised (words joined by single blanks, lower case, runs of digits as one zero), are
hashed together with the host. Then, for each host, the distinct documents that hold a line are counted. Lines above the
limits are boilerplate and are removed; a document of which too little stays is depleted and rejected.

A line is above the limits if more than `least_docs` documents of its host and more than `percent` in a hundred of them
hold it. Copies with the same text are one document here: to take out copies is another operator's work, and a page that
a host serves a thousand times has no more boilerplate in it. Depleted is what lost a line and keeps fewer than
`least_words` words or under half of what it had.

What is counted is shuffled as hashes (16 bytes a line and text), first by line and text, so that a line in a third of all
documents is counted in many tasks; lines and hosts of that kind are joined back by a broadcast of bounded size, and the
rest by shuffles. The measures are written once; texts are not shuffled.

Odd rows. A null text is an empty one: no words, so the base verdict fails. A null host is a host of its own, apart from
the empty name. Null and repeated ids change nothing, since documents are told apart by their texts; repeated rows give
equal rows. A line without a word is no line. A text of any length is measured whole in its task (about 150 bytes a word).
Lines are compared by 128-bit hashes. Of no rows nothing comes back. Other columns, however named, don't matter to `judge`;
`clean` passes them through.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import Scratch, join_classes, slices

WORD_SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Words in a window, and the share of words in repeated ones, in a hundred, above which a document fails.
WINDOW, MOST_REPEATED_PERCENT = 8, 30
LEAST_WORDS = 20
LEAST_DOCS, PERCENT = 10, 1

DIGITS = re.compile("[0-9]+")
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, document binary, lines array<struct<line:binary,words:long>>"


def host_tag(host: str | None) -> bytes:
    return b"" if host is None else b"=" + host.encode()


def normalised(line: str) -> str:
    return DIGITS.sub("0", b" ".join(line.encode().split()).decode().lower())


def line_hash(line: str, tag: bytes) -> bytes:
    """Of a line in a host: a normalised line holds no line feed, so that the two can't run into one another."""
    return hashlib.md5(normalised(line).encode() + b"\n" + tag).digest()


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words that lie in a window of `width` words which is found twice or more, the first included.

    Numbers for windows of 2, 4, 8, ... words come from pairs of numbers for half of each, so that equal ones are equal words.
    """
    first: dict[bytes, int] = {}
    now = np.array([first.setdefault(w, len(first)) for w in words], np.int64)
    if len(first) == len(words) or len(words) <= width:
        return 0
    size = 1
    while size < width:
        step = min(size, width - size)  # the last pair may overlap
        now = np.unique(now[:-step] * len(words) + now[step:], return_inverse=True)[1]
        size += step
    again = np.flatnonzero(np.bincount(now)[now] > 1)
    edges = np.bincount(again, minlength=len(words) + 1) - np.bincount(again + width, minlength=len(words) + 1)
    return int(np.count_nonzero(np.cumsum(edges)))


def measure(text: str, tag: bytes) -> tuple[int, int, int, int, int, bytes, list[dict]]:
    raw = text.encode()
    words = raw.split()  # by the six ASCII characters of WORD_SPACE
    lines = [x for x in text.split("\n") if x.strip(WORD_SPACE)]
    held: dict[bytes, int] = {}
    for x in lines:
        key = line_hash(x, tag)
        held[key] = held.get(key, 0) + len(x.encode().split())
    return (
        len(words), len(text) - sum(map(text.count, WORD_SPACE)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words),
        hashlib.md5(raw).digest(), [{"line": k, "words": n} for k, n in held.items()],
    )


def measured(docs: DataFrame, host: str, text: str, keep: list[str]) -> DataFrame:
    """Columns keep, host and MEASURES; a row per document."""
    source = docs.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{host}`").cast("string").alias("__host"), F.col(f"`{text}`").alias("__text"))
    made = T.StructType.fromDDL("host string, " + MEASURES)
    schema = T.StructType([*source.schema.fields[: len(keep)], *made.fields])
    arrow, n = to_arrow_schema(schema), len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            hosts = b.column(n).to_pylist()
            found = [measure(t or "", host_tag(h)) for h, t in zip(hosts, b.column(n + 1).to_pylist())]
            if found:
                columns = [pa.array(c, f.type) for c, f in zip(zip(*found), list(arrow)[n + 1 :])]
                yield pa.RecordBatch.from_arrays([*(b.column(i).cast(arrow[i].type) for i in range(n)), pa.array([host_tag(h).decode() for h in hosts]), *columns], schema=arrow)

    return source.mapInArrow(run, schema)


def boilerplate(rows: DataFrame, least_docs: int = LEAST_DOCS, percent: float = PERCENT) -> DataFrame:
    """Columns line and docs: the lines above the limits, of measured rows."""
    hosts = rows.groupBy("host").agg(F.count_distinct("document").alias("size"))
    total = hosts.agg(F.sum("size")).first()[0] or 0
    lines = rows.select("host", "document", F.explode("lines.line").alias("line"))
    counted = lines.groupBy("host", "line").agg(F.count_distinct("document").alias("docs")).where(F.col("docs") > least_docs)
    known = join_classes(counted, hosts.where(F.col("size") > least_docs), "host", total)
    return known.where(F.col("docs") * 100 > F.col("size") * percent).select("line", "docs")


def _removed(rows: DataFrame, found: DataFrame, scratch: Scratch) -> DataFrame:
    """row, words_removed and lines_removed (the distinct hashes) of rows with boilerplate."""
    classes = scratch.write(found.withColumnRenamed("docs", "size"))
    total = classes.agg(F.sum("size")).first()[0] or 0
    lines = rows.select("row", F.explode("lines").alias("x")).select("row", "x.*")
    hit = join_classes(lines, classes, "line", total).where(F.col("size").isNotNull())
    return hit.groupBy("row").agg(F.sum("words").alias("words_removed"), F.collect_set("line").alias("lines_removed"))


def _judged(rows: DataFrame, scratch: Scratch, least_docs: int, percent: float, least_words: int) -> DataFrame:
    gone = _removed(rows, boilerplate(rows, least_docs, percent), scratch)
    out = rows.drop("lines", "document").join(gone, "row", "left").withColumn("words_removed", F.coalesce("words_removed", F.lit(0)).cast("bigint"))
    left = F.col("n_words") - F.col("words_removed")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    depleted = (F.col("words_removed") > 0) & ((left < least_words) | (2 * left < F.col("n_words")))
    return out.select("*", failed.alias("base_failed"), depleted.alias("depleted"), (~failed & ~depleted).alias("kept"))


def judge(
    docs: DataFrame, least_docs: int = LEAST_DOCS, percent: float = PERCENT, least_words: int = LEAST_WORDS, doc_id: str = "doc_id", host: str = "source", text: str = "text"
) -> DataFrame:
    """Columns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, words_removed, base_failed, depleted, kept: a row per document."""
    scratch = Scratch(docs.sparkSession)
    rows = measured(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{host}`").alias("h"), F.col(f"`{text}`").alias("t")), "h", "t", ["doc_id"])
    rows = scratch.write(rows.withColumn("row", F.monotonically_increasing_id()))
    measures = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "words_removed"]
    return _judged(rows, scratch, least_docs, percent, least_words).select("doc_id", *measures, "base_failed", "depleted", "kept")


def clean(docs: DataFrame, least_docs: int = LEAST_DOCS, percent: float = PERCENT, least_words: int = LEAST_WORDS, host: str = "source", text: str = "text") -> DataFrame:
    """The documents that are kept, with all their columns, and without their boilerplate lines."""
    scratch = Scratch(docs.sparkSession)
    numbered = scratch.write(docs.select(F.monotonically_increasing_id().alias("__row"), *(F.col(f"`{c}`").alias(f"__c{k}") for k, c in enumerate(docs.columns))))
    at = {c: f"__c{k}" for k, c in enumerate(docs.columns)}
    rows = scratch.write(measured(numbered, at[host], at[text], ["__row"]).withColumnRenamed("__row", "row"))
    judged = _judged(rows, scratch, least_docs, percent, least_words).where("kept").select(F.col("row").alias("__row"), "host", "lines_removed")
    joined = numbered.join(judged, "__row")

    @F.pandas_udf("string")
    def without(texts, tags, gone):
        out = []
        for t, tag, lines in zip(texts, tags, gone):
            drop = set() if lines is None else {bytes(x) for x in lines}
            out.append("\n".join(x for x in t.split("\n") if not x.strip(WORD_SPACE) or line_hash(x, tag.encode()) not in drop) if drop else t)
        return pd.Series(out, dtype=object)

    cleaned = without(F.col(at[text]), F.col("host"), F.col("lines_removed"))
    return joined.select(*((cleaned if c == text else F.col(at[c])).alias(c) for c in docs.columns))
