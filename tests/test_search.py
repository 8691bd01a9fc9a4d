"""Snippets against SQLite's own, and the segmented index against a plain search over the final records."""

import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from anamnex.operators import search, segments
from anamnex.plans.catalog import SnapshotError

RECORD = "source_table string, source_id long, person_id long, document_id long, text string"


def sqlite_snippets(texts, query):
    """What the full-text engine gives, by row."""
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(k UNINDEXED, body)")
    con.executemany("INSERT INTO t VALUES (?, ?)", list(enumerate(texts)))
    match = " ".join('"' + w + '"' for w in query.split())
    return dict(con.execute("SELECT k, snippet(t, 1, '[', ']', '...', 12) FROM t WHERE t MATCH ?", (match,)).fetchall())


def prose(r, n):
    words = ["alfa", "bravo", "Charlie", "delta", "x", "y2", "cañón", "Über", "no", "so", "we", "it", "on", "up", "at"]
    return "".join(r.choice(words) + r.choice([" ", " ", " ", ", ", ". ", ": ", ".", ":\n", "\t", " - ", ".\r\n"]) for _ in range(n)) + r.choice(["", "end", "!"])


@pytest.mark.parametrize("query", ["alfa", "alfa bravo", "alfa_bravo", "bravo alfa_bravo charlie", "alfa alfa", "x_x y2", "canon UBER", "alfa_bravo_charlie_delta_x_y2_no_so_we_it_on_up_at delta"])
def test_snippets_equal_those_of_the_full_text_engine(spark, query):
    r = random.Random(query)
    texts = [prose(r, r.choice([0, 1, 3, 11, 12, 13, 14, 40, 200])) for _ in range(250)]
    texts += ["alfa " * 300, "bravo " * 30 + "alfa. " + "x " * 30 + "bravo alfa", "(alfa bravo)", " alfa bravo charlie.  Delta x x x x x x y2 y2", "alfa bravo Charlie delta x y2 no so we it on up at delta " * 3]
    wanted = search.phrases(query)
    got = search.with_snippet(spark.createDataFrame(list(enumerate(texts)), "k long, text string"), wanted).collect()
    want = sqlite_snippets(texts, query)
    assert len(got) == len(texts) and want
    assert {x["k"]: x["snippet"] for x in got if x["k"] in want} == want


def test_snippets_of_odd_texts(spark):
    texts = [None, "", "...", "none of it", "alfa " * 60_000, "éalfa alfá x", "\U0001f600 alfa \U0001f600"]
    got = [x["snippet"] for x in search.with_snippet(spark.createDataFrame([(t, "c", 1) for t in texts], "text string, snippet string, __x int"), [["alfa"]]).orderBy(F.length("text")).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [None, "", "...", "none of it", " ".join(["[alfa]"] * 12) + "...", "éalfa [alfá] x", "\U0001f600 [alfa] \U0001f600"]))


def plain_find(records, query):
    """(table, id, person, document) and rank of the records that hold every word."""
    import math
    import re

    wanted = search.phrases(query)
    cut = [(r, re.findall(r"[^\W_]+", search.folded(r[4] or ""))) for r in records]
    n, mean = len(cut), sum(len(t) for _, t in cut) / max(1, len(cut))
    tf = [[sum(t[i : i + len(p)] == p for i in range(len(t))) for p in wanted] for _, t in cut]
    idf = [max(1e-6, math.log((n - d + 0.5) / (d + 0.5))) for k in range(len(wanted)) for d in [sum(x[k] > 0 for x in tf)]]
    return sorted((*r[:4], round(-sum(i * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(t) / mean)) for i, f in zip(idf, x)), 9)) for (r, t), x in zip(cut, tf) if wanted and all(x))


def as_rows(df):
    return sorted((*tuple(r)[:4], round(r["rank"], 9)) for r in df.collect())


def batch(r, n, first):
    return [(r.choice(["document", "allergy"]), first + k, r.randrange(5), r.choice([None, 7]), r.choice([None, "", prose(r, r.randint(1, 40))]) if r.random() < 0.2 else prose(r, r.randint(1, 40))) for k in range(n)]


def test_index_follows_changes(spark, tmp_path):
    r = random.Random(11)
    index = segments.SegmentedIndex(spark, str(tmp_path / "index"), tokens_per_shard=300, fan=2)
    assert index.find("alfa").count() == 0 and index.apply() == {"generation": 0, "segments": []}
    now, first = {}, 0
    for step in range(4):
        new = batch(r, 80 if step == 0 else 20, first)
        first += len(new)
        changed = [(*k, v[2], v[3], prose(r, 9)) for k, v in r.sample(sorted(now.items()), min(len(now), 25))]
        gone = r.sample(sorted(now), min(len(now), 15)) + [("document", 10_000), (None, 3)]
        upserts = spark.createDataFrame(new + changed, RECORD).withColumn("token", F.lit("clash")) if step != 2 else None
        index.apply(upserts, spark.createDataFrame(gone, "source_table string, source_id long"))
        for k in gone:
            now.pop(k, None)
        if step != 2:
            now |= {(x[0], x[1]): x for x in new + changed}
        for query in ("bravo CANON", "alfa_bravo x", *(["absent", "?"] if step == 1 else [])):
            assert as_rows(index.find(query)) == plain_find(list(now.values()), query), (step, query)
        if step in (1, 3):
            before = index.state()
            after = index.merge()
            assert len(after["segments"]) < len(before["segments"]) and sum(s["n"] - s["dead"] for s in after["segments"]) == len(now)
            assert as_rows(index.find("alfa x")) == plain_find(list(now.values()), "alfa x")
    assert index.vacuum() and as_rows(index.find("alfa x", person=2)) == [x for x in plain_find(list(now.values()), "alfa x") if x[2] == 2]


def test_a_change_writes_one_segment_and_a_search_reads_its_shards(spark, tmp_path):
    r = random.Random(2)
    index = segments.SegmentedIndex(spark, str(tmp_path / "index"), tokens_per_shard=100)
    index.apply(spark.createDataFrame(batch(r, 300, 0), RECORD))
    old = {str(p): p.stat().st_mtime_ns for p in (tmp_path / "index").rglob("*.parquet")}
    index.apply(spark.createDataFrame([("document", 5, 1, None, "quux")], RECORD))
    new = {str(p): p.stat().st_mtime_ns for p in (tmp_path / "index").rglob("*.parquet")}
    assert old.items() <= new.items() and all("segment=s0000000002" in p or "/deletes/" in p for p in new.keys() - old.keys())
    state = index.state()
    assert state["segments"][0]["shards"] > 20
    read = {f for s in ("alfa",) for f in index._tables("postings", {state["segments"][0]["id"]: [int(spark.range(1).select(segments.shard_of(F.lit(s), state["segments"][0]["shards"])).first()[0])]}).inputFiles()}
    seen = []
    tables = index._tables
    index._tables = lambda kind, parts: seen.append((kind, parts)) or tables(kind, parts)
    assert index.find("alfa").count() > 0
    assert [k for k, _ in seen] == ["postings"] and sum(len(x) for x in seen[0][1].values()) <= 2 and len(read) < 3


def test_one_of_two_writers_fails_and_repeated_keys_go_together(spark, tmp_path):
    a, b = (segments.SegmentedIndex(spark, str(tmp_path / "index")) for _ in range(2))
    rows = [("procedure", 1, 1, None, "alfa one"), ("procedure", 1, 2, None, "alfa two"), ("procedure", 2, 2, None, None)]
    a.apply(spark.createDataFrame(rows, RECORD))
    assert as_rows(b.find("alfa")) == plain_find(rows, "alfa") and len(as_rows(b.find("alfa"))) == 2
    b.state = lambda state=a.state(): state
    a.apply(spark.createDataFrame([("procedure", 1, 1, None, "bravo")], RECORD))
    with pytest.raises(SnapshotError):
        b._commit(b.state()["generation"] + 1, [])
    assert a.find("alfa").count() == 0 and a.find("bravo").count() == 1
