"""Quality rules against plain Python over random documents of shared lines, with odd rows."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from anamnex.llm import quality, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_measure(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n_dup = sum(x in lines[:k] for k, x in enumerate(lines))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), n_dup, len(covered)


def plain_normal(line):
    return re.sub("[0-9]+", "0", " ".join(WORD.findall(line)).lower())


def plain_judge(rows, least_docs, percent, least_words=20):
    """Per row of (doc_id, source, text): doc_id, measures, words removed, base_failed, depleted, kept; and cleaned texts of the kept."""
    by_host, holding = defaultdict(set), defaultdict(set)
    for _, source, text in rows:
        by_host[source].add(text or "")
        for x in (text or "").split("\n"):
            holding[source, plain_normal(x)].add(text or "")
    above = {k for k, v in holding.items() if k[1] and len(v) > least_docs and 100 * len(v) > percent * len(by_host[k[0]])}
    out, texts = [], []
    for doc_id, source, text in rows:
        own = plain_measure(text)
        lines = (text or "").split("\n")
        gone = sum(len(WORD.findall(x)) for x in lines if (source, plain_normal(x)) in above)
        failed = own[0] < 20 or 100 * own[4] > 30 * own[0]
        depleted = gone > 0 and (own[0] - gone < least_words or 2 * (own[0] - gone) < own[0])
        out.append((doc_id, *own, gone, failed, depleted, not failed and not depleted))
        if not failed and not depleted:
            texts.append((doc_id, source, "\n".join(x for x in lines if (source, plain_normal(x)) not in above)))
    return sorted(out, key=str), sorted(texts, key=str)


def frame(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    return df.withColumn("lines", F.lit("clash")).withColumn("row", F.lit(1)).withColumn("__row", F.lit(2)).repartition(5)


def sentence(r, n):
    return " ".join("".join(r.choice("abcdeé日😀") for _ in range(r.randint(1, 6))) for _ in range(n))


def corpus(seed, n):
    r = random.Random(seed)
    shared = [sentence(r, r.randint(1, 25)) for _ in range(12)] + ["page 17 of 90", "x"]
    rows = []
    for k in range(n):
        lines = [r.choice(shared) if r.random() < 0.5 else sentence(r, r.randint(0, 30)) for _ in range(r.randint(0, 6))]
        lines = [x.upper() if r.random() < 0.2 else re.sub("17", str(r.randint(1, 99)), x) for x in lines]
        lines += [r.choice([" ", "\t\r", "\x0b", "\x85", "\xa0"])] if r.random() < 0.3 else []
        rows.append((k, r.choice(["hot"] * 6 + ["a", "b", "", None]), "\n".join(lines)))
    return rows + r.sample(rows, n // 10) + [(n + k, "hot", rows[0][2]) for k in range(40)]


ODD = [
    (1, None, None), (None, None, None), (None, "a", ""), (3, "a", " \n\t\n"), (4, "a", "w " * 19), (5, "a", "w%d " * 20 % tuple(range(20))), (6, "", "same line\n" * 200),
    (7, "a", " ".join(f"v{k % 3000}" for k in range(200_000))), (8, "a", "a b c d e f g h " * 2), (9, "a", "#*$%&|<>" * 9 + " é\x1c日 \x85 x\xa0y"), (10, "a\nb", "one\r\ntwo"), (10, "a\nb", "one\r\ntwo"),
]


@pytest.mark.parametrize("seed, least_docs, percent", [(1, 5, 3), (2, 15, 8), (3, 2, 0)])
def test_equal_to_plain_python(spark, seed, least_docs, percent):
    rows = corpus(seed, 250) + ODD
    want, texts = plain_judge(rows, least_docs, percent)
    got = quality.judge(frame(spark, rows), least_docs, percent)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    assert {r[-1] for r in want} == {True, False} and any(r[6] for r in want) and (percent == 8 or any(r[-2] for r in want))
    cleaned = quality.clean(frame(spark, rows), least_docs, percent)
    assert cleaned.columns == ["doc_id", "source", "text", "lines", "row", "__row"]
    assert sorted((tuple(r)[:3] for r in cleaned.collect()), key=str) == texts


def test_random_windows(spark):
    r = random.Random(8)
    for _ in range(400):
        text = " ".join(r.choice("abc") for _ in range(r.randint(0, 60)))
        assert quality.repeated_words(text.encode().split()) == plain_measure(text)[4]
    words = [r.choice("ab").encode() for _ in range(40)]
    for width in (1, 2, 3, 5, 7):
        windows = Counter(tuple(words[i : i + width]) for i in range(len(words) - width + 1))
        want = {j for i in range(len(words) - width + 1) if windows[tuple(words[i : i + width])] > 1 for j in range(i, i + width)}
        assert quality.repeated_words(words, width) == len(want)


def test_hot_lines_and_hosts_go_by_broadcast_with_the_same_result(spark, monkeypatch):
    from anamnex.llm import common

    rows = corpus(5, 300)
    want, _ = plain_judge(rows, 5, 3)
    monkeypatch.setattr(common, "HOT_EDGES", 20)
    monkeypatch.setattr(common, "HOT_SHARE", 1_000_000)
    assert sorted((tuple(r) for r in quality.judge(frame(spark, rows), 5, 3).collect()), key=str) == want


def test_no_rows(spark):
    none = frame(spark, ODD).limit(0)
    assert quality.judge(none).count() == 0 and quality.clean(none).count() == 0


def test_registered_query_equals_plain_python(spark, tmp_path):
    rows = corpus(6, 400) + ODD
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    want, _ = plain_judge(rows, quality.LEAST_DOCS, quality.PERCENT)
    got = queries.op13_quality_rules(spark, str(tmp_path)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "words_removed", "base_failed", "kept")
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted((r[:8] + r[9:] for r in want), key=str)
