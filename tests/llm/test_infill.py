"""Fill-in-middle against regular-expression matching and plain Python, on small tables with odd rows."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from anamnex.llm import infill

ODD = [None, "", " ", "a", "ab", "<P>", "x <S> y", "<M", "<P<S", "S><P", "a😀b😀", "日本語 ñandú\x1c\x85\r\n\n", "\n\n", "Ab" * 20_000, ". " * 20_000, "é x", "same text", "same text"]
GRAMMARS = {infill.WORDS_AND_OTHERS: r"[A-Za-z]+|[^A-Za-z]", "[A-Z]+|[a-z]+|[^A-Za-z]+": r"[A-Z]+|[a-z]+|[^A-Za-z]+", r"[\]\n]|[^\]\n]+": r"[\]\n]|[^\]\n]+", r"[\s\S]": r"[\s\S]"}


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n", F.lit("clash")).withColumn("OUTPUT", F.lit(1)).withColumn("__x", F.lit(2)).repartition(3)


def plainly(doc_id, text):
    """The contract in Python: n, form, parts, output."""
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("grammar", GRAMMARS)
def test_units_are_what_the_grammar_matches(spark, grammar):
    r = random.Random(3)
    texts = [t for t in ODD] + ["".join(r.choice("aZ.é日😀 \n]") for _ in range(r.randint(0, 30))) for _ in range(300)]
    for row in frame(spark, texts).select("text", infill.units(F.col("text"), grammar).alias("u")).collect():
        assert row["u"] == re.findall(GRAMMARS[grammar], row["text"] or "")


def test_a_grammar_of_other_things_is_refused():
    for bad in ("abc", "[a]*", "[a]+|", "", "([a])"):
        with pytest.raises(ValueError):
            infill.boundary(bad)


def test_outputs_equal_plain_python(spark, sf_dir):
    r = random.Random(5)
    texts = ODD + ["".join(r.choice("ab <P>SM\n") for _ in range(r.randint(0, 40))) for _ in range(400)] + [x["text"] for x in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    made = infill.transform(frame(spark, texts), seed=1)
    assert sorted(made.columns) == sorted(["doc_id", "text", "__x", "n", "form", "prefix_chars", "middle_chars", "output"])
    rows = made.withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()
    assert len(rows) == len(texts) and {x["form"] for x in rows} == {"plain", "psm", "spm"}
    for x in rows:
        assert (x["n"], x["form"], x["prefix_chars"], x["middle_chars"], x["output"]) == plainly(x["doc_id"], texts[x["doc_id"]])
        assert x["back"] == (texts[x["doc_id"]] or "") and x["text"] == texts[x["doc_id"]]


def test_null_ids_repeats_and_no_rows(spark):
    df = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (7, None), (7, None)], "doc_id long, text string")
    rows = infill.digest(infill.transform(df)).collect()
    assert len(rows) == 4 and len({tuple(r) for r in rows}) == 2
    empty = hashlib.sha256(b"").hexdigest()
    assert [tuple(r) for r in rows if r["doc_id"] == 7] == [(7, 0, "plain", None, None, empty, empty)] * 2
    none = infill.digest(infill.transform(df.limit(0)))
    assert none.count() == 0 and dict(none.dtypes)["n"] == "bigint"


def test_nothing_is_shuffled_and_no_worker_runs(spark, sf_dir):
    plan = infill.digest(infill.transform(spark.read.parquet(f"{sf_dir}/documents.parquet")))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
