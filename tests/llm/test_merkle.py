"""Merkle manifest against a plain Python tree, with odd rows, deep trees and tampering."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from anamnex.llm import merkle, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, index int, `order` int"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(doc_id, source, lang, n_chars, text):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def plain_proofs(digests):
    """Root, and for each leaf its list of (left, right)."""
    paths, at, level = [[] for _ in digests], list(range(len(digests))), list(digests)
    while len(level) > 1:
        for path, i in zip(paths, at):
            run = level[i // 16 * 16 : i // 16 * 16 + 16]
            path.append(("".join(run[: i % 16]), "".join(run[i % 16 + 1 :])))
        at = [i // 16 for i in at]
        level = [h(*level[k : k + 16]) for k in range(0, len(level), 16)]
    return level[0], paths


def plain_manifest(rows):
    """Per row of (doc_id, text, lang, source, n_chars): doc_id, leaf, subroot, root, proof, folded, verified; sorted."""
    by_source = {}
    for doc_id, text, lang, source, n_chars, *_ in rows:
        found = text.translate({c: c + 32 for c in range(65, 91)}) if doc_id is not None and text is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0 else text
        own = plain_leaf(doc_id, source, lang, n_chars, text)
        key = (source is not None, (source or "").encode())
        by_source.setdefault(key, []).append(((doc_id is not None, doc_id or 0), own, doc_id, plain_leaf(doc_id, source, lang, n_chars, found)))
    trees = [(k, sorted(v, key=lambda x: x[:2])) for k, v in sorted(by_source.items())]
    made = [plain_proofs([x[1] for x in v]) for _, v in trees]
    root, up = plain_proofs([m[0] for m in made])
    out = []
    for (_, leaves), (subroot, paths), more in zip(trees, made, up):
        for (_, own, doc_id, found), path in zip(leaves, paths):
            folded = found
            for left, right in path + more:
                folded = h(left, folded, right)
            out.append((doc_id, own, subroot, root, h(*(left + right for left, right in path + more)), folded, folded == root))
    return sorted(out, key=str)


def made(spark, rows, tmp_path, parts=5):
    df = spark.createDataFrame(rows, SCHEMA)
    (df.repartition(parts) if rows else df).write.parquet(f"{tmp_path}/documents.parquet")
    return sorted((tuple(r) for r in queries.op11_merkle_manifest(spark, str(tmp_path)).collect()), key=str)


def rows_of(n, seed, sources):
    r = random.Random(seed)
    return [(k, "".join(r.choice("Aa é日\n😀") for _ in range(r.randint(0, 9))), r.choice(["en", None, "d:e"]), r.choice(sources), r.choice([None, 3, -1]), "x", 1, 2) for k in range(n)]


def test_odd_rows(spark, tmp_path):
    rows = [
        (1, None, None, None, None, None, None, None), (2, "", "", "", 0, "", 0, 0), (3, "ABC", "en", "", 3, "", 0, 0), (None, "Null Id", "en", "b", 1, "", 0, 0), (None, "Other", "en", "b", 1, "", 0, 0),
        (4, "same", "en", "b", 4, "", 0, 0), (4, "same", "en", "b", 4, "", 0, 0), (4, "Not The Same", "en", "b", 4, "", 0, 0), (5, "X" * 300_000, "en", "=", 5, "", 0, 0), (-7, "neg", "de", "é", -2, "", 0, 0),
    ]
    assert made(spark, rows, tmp_path) == plain_manifest(rows)


@pytest.mark.parametrize("n, sources", [(1, ["a"]), (16, ["a"]), (17, ["a"]), (257, ["a", "a", None]), (600, [str(k) for k in range(300)])])
def test_sizes_around_whole_runs(spark, tmp_path, n, sources):
    rows = rows_of(n, n, sources)
    assert made(spark, rows, tmp_path) == plain_manifest(rows)


def test_a_hot_source_with_four_levels_and_copied_nodes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(merkle, "MOST_COPIES", 7)
    rows = rows_of(4500, 9, ["hot"] * 4 + ["x", "y", None])
    hot = [(r[0] + 10_000, *r[1:3], "hot", *r[4:]) for r in rows]
    assert sum(r[3] == "hot" for r in rows + hot) > 4096
    assert made(spark, rows + hot, tmp_path, 13) == plain_manifest(rows + hot)


def test_no_rows(spark, tmp_path):
    assert made(spark, [], tmp_path) == []


def test_any_change_is_seen_and_order_is_not(spark, tmp_path):
    rows = rows_of(300, 4, ["a", "b", None])
    root = lambda rows, n: made(spark, rows, tmp_path / n)[0][3]
    first = root(rows, "1")
    assert root(rows[::-1], "2") == first
    changed = [(*rows[0][:1], (rows[0][1] or "") + " ", *rows[0][2:]), *rows[1:]]
    assert len({first, root(changed, "3"), root(rows[1:], "4"), root(rows + rows[:1], "5")}) == 4


def test_a_proof_alone_gives_the_root(spark):
    df = spark.createDataFrame(rows_of(900, 2, ["a", "a", "b", None]), SCHEMA)
    got = merkle.manifest(df, carry={"order": F.col("order")})
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "path", "order"]
    for r in got.collect():
        d = r["leaf"]
        for step in r["path"]:
            d = h(step["left"], d, step["right"])
        assert d == r["root"] and len(r["path"]) <= 4
