"""Full-text search: BM25 over all records' text, all tokens required, an underscore word as a phrase, snippets for hits."""

from __future__ import annotations

import math
import re
import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.plan import settled
from ..plans.catalog import Catalog
from ..plans.scratch import written
from .clinical import person_id

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
SNIPPET_TOKENS = 12

#: (table, text columns) of the index.
INDEXED = (
    ("document", ("ocr_text",)), ("lab_result", ("test_name",)), ("medication", ("name",)), ("procedure", ("name",)),
    ("appointment", ("reason", "summary")), ("observation", ("key", "value_text")), ("allergy", ("substance", "reaction")), ("condition", ("name", "note")),
)


def record_text(catalog: Catalog) -> DataFrame:
    """source_table, source_id, person_id, document_id, text of everything that can be searched."""
    out = None
    for table, columns in INDEXED:
        body = F.trim(F.concat_ws(" ", *(F.coalesce(F.col(c), F.lit("")) for c in columns)))
        own = catalog[table].select(F.lit(table).alias("source_table"), F.col(f"{table}_id").alias("source_id"), "person_id", "document_id", body.alias("text"))
        out = own if out is None else out.unionByName(own)
    return out


def _plain_letters() -> dict[str, str]:
    """Composed characters whose base is one other character (lower case, planes 0 and 1)."""
    found = {}
    for code in range(0x80, 0x20000):
        c = chr(code)
        if c.lower() == c and not 0xD800 <= code < 0xE000:
            base = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")
            if len(base) == 1 and base != c:
                found[c] = base
    return found


PLAIN = _plain_letters()
_MARKS = r"\p{Mn}+"


def _is_mark(c: str) -> bool:
    return unicodedata.category(c) == "Mn"


def folded(text: str) -> str:
    """Lower case without diacritics."""
    return "".join(PLAIN.get(c, c) for c in text.lower() if not _is_mark(c))


def folded_column(text: Column) -> Column:
    """As folded(), in the plan; texts of ASCII alone only change case."""
    low = F.lower(text)
    other = F.regexp_replace(F.translate(low, "".join(PLAIN), "".join(PLAIN.values())), _MARKS, "")
    return F.when(low.rlike(r"[^\x00-\x7f]"), other).otherwise(low)


def tokens(text: Column) -> Column:
    """Runs of letters and digits, folded."""
    return F.regexp_extract_all(F.coalesce(folded_column(text), F.lit("")), F.lit(r"([\p{L}\p{N}]+)"), 1)


def phrases(query: str) -> list[list[str]]:
    """Words of a query as token lists: punctuation splits, an underscore makes a phrase. Operators mean nothing."""
    return [p for w in re.findall(r"\w+", query) if (p := re.findall(r"[^\W_]+", folded(w)))]


def hits(own: Column, phrase: list[str]) -> Column:
    """How often the tokens of a phrase stand in a row."""
    if len(phrase) == 1:
        return F.size(F.filter(own, lambda t: t == phrase[0]))

    def begins(t: Column, i: Column) -> Column:
        here = t == phrase[0]
        for k, word in enumerate(phrase[1:], 1):
            here = here & F.coalesce(F.try_element_at(own, i + 1 + k) == word, F.lit(False))
        return here

    return F.size(F.filter(own, begins))


def find(catalog: Catalog, query: str, slug: str | None = None, snippets: bool = True) -> DataFrame:
    """Records that hold every word, best first (rank: smaller is better); ties by table and id. Statistics are of all persons' records."""
    wanted = phrases(query)
    if not wanted:
        return record_text(catalog).where("false").withColumn("rank", F.lit(0.0)).withColumn("slug", F.lit("")).withColumn("snippet", F.lit(""))
    index = settled(record_text(catalog), tokens=tokens(F.col("text")))
    index = settled(index, **{f"tf{k}": hits(F.col("tokens"), p) for k, p in enumerate(wanted)}, len=F.size("tokens")).drop("tokens")
    counted = Observation()
    index = index.observe(counted, F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg_len"), *(F.count(F.when(F.col(f"tf{k}") > 0, 1)).alias(f"df{k}") for k in range(len(wanted))))
    found = written(index.where(" AND ".join(f"tf{k} > 0" for k in range(len(wanted)))))  # texts are read once: statistics are counted on the way
    stats = counted.get
    score = F.lit(0.0)
    for k in range(len(wanted)):
        score = score - bm25(F.col(f"tf{k}"), F.col("len"), stats["n"], stats[f"df{k}"], stats["avg_len"])
    if slug is not None:
        found = found.where(F.col("person_id") == person_id(catalog, slug))
    found = found.join(catalog["person"].select("person_id", "slug"), "person_id")
    out = found.select("source_table", "source_id", "person_id", "document_id", "slug", "text", score.alias("rank"))
    if snippets:
        out = with_snippet(out, wanted)
    return out.orderBy("rank", "source_table", "source_id")


def moved_back(by: int):
    return lambda x: x - by


def bm25(tf: Column, length: Column, n: int, df: int, mean: float | None) -> Column:
    idf = max(LEAST_IDF, math.log((n - df + 0.5) / (df + 0.5))) if n else 0.0
    return F.lit(idf) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.lit(mean or 1.0)))


#: A token with the marks inside it: what tokens() finds in the folded text, found in the text itself.
_TOKEN = r"[\p{L}\p{N}](?:[\p{L}\p{N}]|\p{Mn})*"
#: What stands before a token that begins a sentence.
_SENTENCE_END = r"[.:][ \t\n\r]+\z"
#: A window's points: for a phrase that is in it, for each further place of one, and for a start with a sentence or the text.
PHRASE_POINTS, SENTENCE_POINTS, TEXT_POINTS = 1000, 100, 120


def with_snippet(df: DataFrame, wanted: list[list[str]], text: str = "text", most: int = SNIPPET_TOKENS, out: str = "snippet") -> DataFrame:
    """Append the best window of `most` tokens: hits in brackets, dots where the text goes on.

    Windows that begin at a hit are scored by the phrases in them and then by further hits; so are windows that begin at
    the sentence of a hit, which count a little more. The first of the best is taken. One that begins at a hit is moved
    back, so that its hits stand in the middle. Only what lies within a window is looked at for each, so that the work
    grows with the text and not with the square of its hits. A text without hits gives its first tokens.
    """
    own = [F.col(f"`{c}`") for c in df.columns if c != out]
    df = settled(df, __raw=F.regexp_extract_all(F.coalesce(F.col(f"`{text}`"), F.lit("")), F.lit(f"({_TOKEN})"), 1), __gap=F.split(F.coalesce(F.col(f"`{text}`"), F.lit("")), _TOKEN, -1))
    df = settled(df, __tok=F.transform("__raw", folded_column), __n=F.size("__raw"))
    at = {f"__b{k}": _begins(F.col("__tok"), p) for k, p in enumerate(wanted)}
    df = settled(df, **at)
    longest = max(map(len, wanted))
    sizes = F.transform("__tok", lambda t, i: F.greatest(F.lit(0), *(F.when(F.get(F.col(b), i), F.lit(len(p))).otherwise(0) for b, p in zip(at, wanted))))
    last = F.transform("__tok", lambda t, i: F.coalesce(*(F.when(F.get(F.col(b), i), F.lit(len(p))) for b, p in reversed(list(zip(at, wanted)))), F.lit(0)))  # of several phrases there, the last one's
    df = settled(df, __size=sizes, __last=last, __first=F.filter(F.transform("__tok", lambda t, i: F.when((i == 0) | F.get(F.col("__gap"), i).rlike(_SENTENCE_END), i)), lambda i: i.isNotNull()))

    def points(start: Column) -> Column:
        each = (F.size(F.filter(F.slice(F.col(b), start + 1, most), lambda x: x)) for b in at)
        return reduce(lambda a, n: a + F.when(n > 0, n + PHRASE_POINTS - 1).otherwise(0), each, F.lit(0))

    def centred(i: Column) -> Column:
        """Where the window of the hits that begin with the one at i goes."""
        rest = F.slice(F.col("__last"), i + 1, most)
        end = i + F.aggregate(rest, F.struct(F.lit(0).alias("at"), F.lit(0).alias("end")), lambda a, x: F.struct((a["at"] + 1).alias("at"), F.when(x > 0, a["at"] + x).otherwise(a["end"]).alias("end")))["end"]
        back = F.lit(most) - (end - i)
        return F.greatest(F.lit(0), F.least(i - F.when(back < 0, F.ceil(back / 2)).otherwise(F.floor(back / 2)).cast("int"), F.col("__n") - most))

    place = lambda score, order, start: F.struct(score.cast("int").alias("score"), (-order).cast("int").alias("order"), start.cast("int").alias("start"))
    hits_at = F.filter(F.transform("__size", lambda x, i: F.when(x > 0, i)), lambda i: i.isNotNull())
    direct = F.transform(hits_at, lambda i: place(points(i), 2 * i, centred(i)))

    def of_sentence(f: Column, j: Column) -> Column:
        """The window that begins at a sentence, as met at the sentence's first hit after its first token."""
        end = F.coalesce(F.get(F.col("__first"), j + 1), F.col("__n"))
        inside = F.slice(F.col("__size"), f + 2, F.greatest(end - f - 1, F.lit(0)))
        step = F.array_position(F.transform(inside, lambda x: x > 0), True)
        return F.when(step > 0, place(points(f) + F.when(f == 0, TEXT_POINTS).otherwise(SENTENCE_POINTS), 2 * (f + step) + 1, f))

    sentences = F.when(F.col("__n") > most, F.filter(F.transform("__first", of_sentence), lambda x: x.isNotNull())).otherwise(F.array().cast("array<struct<score:int,order:int,start:int>>"))
    df = settled(df, __from=F.coalesce(F.array_max(F.concat(direct, sentences))["start"], F.lit(0)))
    df = settled(df, __to=F.least(F.col("__from") + most, F.col("__n")))

    def reaches(i: Column, least: int) -> Column:
        """Whether a hit that begins `least` tokens or more before i holds it."""
        found = F.lit(False)
        for d in range(least, longest):
            found = found | F.coalesce(F.get(F.col("__size"), i - d) > d, F.lit(False))
        return found

    begins = lambda i: F.coalesce(F.get(F.col("__size"), i) > 0, F.lit(False)) & ~reaches(i, 1)
    window = F.when(F.col("__to") > F.col("__from"), F.sequence(F.col("__from"), F.col("__to") - 1)).otherwise(F.array().cast("array<int>"))
    df = settled(df, __window=F.transform(window, lambda i: F.struct(i.alias("i"), reaches(i, 0).alias("held"), begins(i).alias("opens"), (~reaches(i + 1, 0) | begins(i + 1) | (i + 1 == F.col("__to"))).alias("ends"))))
    opened = F.filter(F.transform("__window", lambda w: F.when(w["opens"], w["i"])), lambda i: i.isNotNull())
    df = settled(df, __opened=F.array_min(opened))  # hits that began before the window are not marked

    def shown(w: Column) -> Column:
        marked = w["held"] & F.coalesce(F.col("__opened") <= w["i"], F.lit(False))
        before = F.when((w["i"] == F.col("__from")) & (F.col("__from") > 0), "").otherwise(F.get(F.col("__gap"), w["i"]))
        return F.concat(before, F.when(marked & w["opens"], "[").otherwise(""), F.get(F.col("__raw"), w["i"]), F.when(marked & w["ends"], "]").otherwise(""))

    start = F.when(F.col("__from") > 0, "...").otherwise("")
    end = F.when(F.col("__to") < F.col("__n"), "...").otherwise(F.get(F.col("__gap"), F.col("__n")))
    return df.select(*own, F.when(F.col(f"`{text}`").isNotNull(), F.concat(start, F.array_join(F.transform("__window", shown), ""), end)).alias(out))


def _begins(own: Column, phrase: list[str]) -> Column:
    """For each token, whether the phrase begins there."""

    def here(t: Column, i: Column) -> Column:
        found = t == phrase[0]
        for k, word in enumerate(phrase[1:], 1):
            found = found & F.coalesce(F.get(own, i + k) == word, F.lit(False))
        return found

    return F.transform(own, here)
