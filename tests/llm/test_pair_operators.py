"""Similarity operators, toxicity and the pipeline against brute force, on small tables with odd rows."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from anamnex.llm import ann, common, hnsw, jaccard, neardup, shingles, toxicity


def classes(n, linked):
    """Smallest index that can be reached, by index."""
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def word_sets(texts):
    out = []
    for t in texts:
        w = (t or "").lower().split()
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def corpus():
    r = random.Random(3)
    words = ["w%d" % k for k in range(500)]
    passage = r.sample(words, 60)
    texts = [None, "", "  \n", "one two", "ONE  two", "a b c d e", "x " * 9000]
    for _ in range(25):
        base = [r.choice(words) for _ in range(r.randint(5, 300))]
        texts.append(" ".join(base))
        for _ in range(r.randint(0, 5)):
            copy = list(base)
            for _ in range(r.randint(0, max(1, len(copy) // 30))):
                copy[r.randrange(len(copy))] = r.choice(words)
            texts.append(" ".join(copy))
    texts += [" ".join(r.sample(words, 40) + passage) for _ in range(40)]
    base = [r.choice(words) for _ in range(200)]
    for k in range(60):  # one large group of near copies
        copy = list(base)
        copy[k * 3 % 200] = "edit%d" % k
        texts.append(" ".join(copy))
    return texts + [texts[-1], texts[20], texts[20]]


def brute_links(texts):
    sets = word_sets(texts)
    return [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and sets[b] and 5 * (i := len(sets[a] & sets[b])) >= 4 * (len(sets[a]) + len(sets[b]) - i)]


@pytest.mark.parametrize("block, bucket", [(1024, 512), (7, 10)])
def test_jaccard_join_equals_brute_force(spark, monkeypatch, block, bucket):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "BUCKET", bucket)
    texts = corpus()
    df = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)], "doc_id long, text string, node string").repartition(5)
    rows = {r["doc_id"]: r for r in jaccard.join(df).collect()}
    linked = brute_links(texts)
    label, degree = classes(len(texts), linked), [0] * len(texts)
    for a, b in linked:
        degree[a] += 1
        degree[b] += 1
    assert [(rows[k]["class_id"], rows[k]["n_links"], rows[k]["kept"]) for k in range(len(texts))] == [(label[k], degree[k], label[k] == k) for k in range(len(texts))]


def test_jaccard_empty_and_null_ids(spark):
    assert jaccard.join(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = jaccard.join(spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (None, None)], "doc_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), str(r["class_id"]), r["n_links"]) for r in rows) == [("4", "4", 2), ("4", "4", 2), ("None", "4", 2), ("None", "None", 0)]


def test_jaccard_of_ids_with_several_texts(spark):
    a, b, c = ("%s1 %s2 %s3 %s4 %s5 %s6 %s7 %s8 %s9".replace("%s", x) for x in "abc")
    near = b + " b10"  # five of six shingles
    rows = [(5, a), (5, b), (5, b), (5, near), (6, a.upper()), (7, near), (8, c), (9, ""), (9, ""), (None, c)]
    found = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = sorted((str(r["doc_id"]), str(r["class_id"]), r["n_links"], r["kept"], r["set_key"] is None) for r in found)
    own_a, own_b = ("5", "5", 1, True, False), [("5", "5", 3, k, False) for k in (True, True)]
    rest = [r for r in got if r not in (own_a, *own_b)]
    # of b and near, which are linked, the set of the smaller key is kept
    assert own_a in got and ("6", "5", 1, False, False) in got and ("8", "8", 1, True, False) in got and ("None", "8", 1, False, False) in got
    assert got.count(("9", "9", 0, True, True)) == 2 and ("7", "5", 3, False, False) in got and len(rest) + len(got) > 0
    kept = {r["set_key"] for r in found if r["doc_id"] == 5 and r["kept"]}
    assert len(kept) == 2 and sum(r["doc_id"] == 5 and r["n_links"] == 3 for r in found) == 3


def test_pipeline_drops_only_copies_of_repeated_ids(spark, sf_dir):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    a, b = ("%s1 %s2 %s3 %s4 %s5 %s6 %s7 %s8 %s9".replace("%s", x) for x in "ab")
    rows = [(5, a, "x"), (5, a, "y"), (5, b, "x"), (6, b + " b10", "x"), (7, None, "x"), (7, "", "x"), (8, "p q", "x"), (None, a, "n"), (None, a, "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __key string")
    out = corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir)
    assert out.columns == docs.columns
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in out.collect()) == sorted([("5", a), ("5", b), ("7", ""), ("8", "p q")])  # the nameless copies of a go with it
    assert corpus_pipeline.drop_near_duplicates(spark, docs.limit(0), sf_dir).count() == 0


def test_shingles_equal_tuples():
    texts = [t or "" for t in corpus()] + ["a b c\x1cd e f", "É é ß SS"]
    got, want = shingles.shingle_sets(texts), word_sets(texts)
    assert [len(g) for g in got] == [len(w) for w in want]
    for a in range(0, len(texts), 7):
        for b in range(0, len(texts), 11):
            assert len(np.intersect1d(got[a], got[b])) == len(want[a] & want[b])


def test_long_texts_in_parts_have_the_same_shingles(monkeypatch):
    texts = [t or "" for t in corpus()] + ["ΟΔΟΣ ΣΑΣ " * 50, "w" * 3000, " " * 500]
    want = shingles.shingle_sets(texts)
    monkeypatch.setattr(shingles, "PART", 37)
    got = shingles.shingle_sets(texts)
    assert len(got) == len(want) and all(np.array_equal(a, b) for a, b in zip(got, want))


def test_bayesian_thresholds():
    stops = jaccard.fewest_matches(0.8, 1e-6)
    assert len(stops) == 4 and stops == sorted(stops) and stops[-1] < 0.8 * 64
    same = np.zeros((1, 64), np.uint16)
    assert jaccard.surviving(same, same, stops).all() and not jaccard.surviving(same, same + 1, stops).any()


@pytest.mark.parametrize("hot", [100_000, 0])
def test_components(spark, monkeypatch, hot, tmp_path):
    monkeypatch.setattr(common, "HOT_EDGES", hot)
    r = random.Random(1)
    edges = [(k, k + 1) for k in range(300)] + [(1000, 1000 + k) for k in range(1, 200)] + [(r.randrange(2000, 2200), r.randrange(2000, 2200)) for _ in range(150)] + [(5, 5)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["component"] for r in common.components(df, common.Scratch(spark)).collect()}
    label = classes(2200, edges)
    assert got == {x: label[x] for e in edges if e[0] != e[1] for x in e}
    assert common.components(df.limit(0), common.Scratch(spark)).count() == 0


def vectors(n=700, dim=16):
    r = np.random.default_rng(2)
    x = r.standard_normal((n, dim))
    x[100:160] = x[100] + 0.05 * r.standard_normal((60, dim))
    x[300:310] = x[300]
    x[400] = 3 * x[401]
    return x


def vector_frame(spark, x):
    rows = [(k, [float(c) for c in v], "clash") for k, v in enumerate(x)]
    rows += [(9001, None, ""), (9002, [], ""), (9003, [0.0] * 16, ""), (9004, [1.0, None] + [0.0] * 14, ""), (9005, [float("nan")] * 16, ""), (9006, [float("inf")] + [0.0] * 15, ""), (9007, [1.0, 0.0], ""), (9008, [1.0, 0.01], "")]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, vec string").repartition(4)


@pytest.mark.parametrize("shard_bytes, chunk, hot", [(32 << 20, 8192, 100_000), (6000, 50, 2)])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, shard_bytes, chunk, hot):
    monkeypatch.setattr(neardup, "WIDEST", 64)  # the dense group goes the exact way
    monkeypatch.setattr(neardup, "SHARD_BYTES", shard_bytes)
    monkeypatch.setattr(neardup, "CHUNK", chunk)
    monkeypatch.setattr(common, "HOT_EDGES", hot)
    x = vectors()
    rows = {r["vec_id"]: r for r in neardup.near_duplicates(vector_frame(spark, x)).collect()}
    c = (x @ x.T) / np.sqrt((x * x).sum(1)[:, None] * (x * x).sum(1)[None])
    linked = [(a, b) for a in range(len(x)) for b in range(a) if c[a, b] >= 0.9]
    label = classes(len(x), linked)
    degree = np.bincount([k for e in linked for k in e], minlength=len(x))
    assert [(rows[k]["component_id"], rows[k]["n_links"]) for k in range(len(x))] == list(zip(label, degree.tolist()))
    assert all(rows[k]["n_links"] == 0 and rows[k]["kept"] for k in (9001, 9002, 9003, 9004, 9005, 9006))
    assert rows[9008]["component_id"] == 9007 and rows[9007]["n_links"] == 1
    assert neardup.near_duplicates(vector_frame(spark, x).limit(0)).count() == 0


def test_graph_finds_neighbours():
    x = neardup.unit(np.random.default_rng(5).standard_normal((1500, 24)))
    ids, _ = hnsw.Graph(x).search(x[:200].astype(np.float32), 64)
    true = np.argsort(-(x[:200] @ x.T), 1)[:, :10]
    assert np.mean([len(set(a) & set(b[:64])) for a, b in zip(true, ids)]) >= 9.5


def test_visited_table_of_any_size_finds_the_same():
    """Places that later nodes took over don't let a node into the beam twice."""
    x = neardup.unit(np.random.default_rng(6).standard_normal((3000, 12))).astype(np.float32)
    g, q = hnsw.Graph(x), x[:300]
    ids, sim = g.search(q, 48)
    assert all(len(set(r[r >= 0])) == (r >= 0).sum() for r in ids.tolist() for r in [np.array(r)])
    few = hnsw.cells
    try:
        hnsw.cells = lambda width: 8
        again, same = g.search(q, 48)
    finally:
        hnsw.cells = few
    assert np.array_equal(ids, again) and np.array_equal(sim, same)


def test_link_recall_of_shards_against_brute_force(spark):
    """Sparse links (one a vector, for 2 % of the vectors) through the operator."""
    r = np.random.default_rng(31)
    x = r.standard_normal((6000, 32))
    for k in range(0, 120):
        x[3000 + k] = x[k] + 0.3 * r.standard_normal(32)
    rows = {r["vec_id"]: r["n_links"] for r in neardup.near_duplicates(vector_frame(spark, x)).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    true = ((u @ u.T) >= 0.9).sum(1) - 1
    assert true.sum() > 150 and sum(min(rows[k], true[k]) for k in range(6000)) >= 0.99 * true.sum() and all(rows[k] <= true[k] for k in range(6000))


def test_search_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ann, "ROW_BLOCK", 100)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 3)
    monkeypatch.setattr(ann, "CHUNK", 2)
    x = vectors(600)
    got: dict = {}
    for r in ann.search(vector_frame(spark, x), F.col("vec_id") % 50 == 0, k=10).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 600, 50))
    for q, own in got.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        best = np.lexsort((np.arange(len(x)), d))[:10]
        assert [r[1] for r in sorted(own)] == best.tolist() and np.allclose([r[2] for r in sorted(own)], d[best])
    few = vector_frame(spark, x[:4])
    assert ann.search(few, F.col("vec_id") == 0).count() == 3 and ann.search(few.limit(0), F.col("vec_id") == 0).count() == 0
    two = ann.search(few, F.col("vec_id") == 9007).collect()
    assert [(r["vec_id"], r["rank"]) for r in two] == [(9008, 1)]


def test_scan_recall_after_reranking():
    x = np.random.default_rng(8).standard_normal((6000, 64))
    q = ann.Quantiser(x[:2000], rounds=4)
    codes = q.encode(x)
    near = q.scan(x[:40], codes[:, :16]) + q.scan(x[:40], codes[:, 16:], 1) - (x**2).sum(1) / 2
    hits = 0
    for k in range(40):
        d = ((x - x[k]) ** 2).sum(1)
        hits += len(set(np.argsort(d)[1:11]) & set(np.argsort(-near[k])[: ann.RERANK]))
    assert hits / 400 >= 0.99 and codes.shape == (6000, 32)


def test_search_in_a_large_group_of_near_copies(spark):
    r = np.random.default_rng(12)
    x = r.standard_normal((3000, 64))
    x[:1000] = x[0] + 0.01 * r.standard_normal((1000, 64))
    x[1000:1400] *= np.geomspace(1e-6, 1e6, 400)[:, None]
    rows = ann.search(vector_frame(spark, x), F.col("vec_id") % 50 == 0, k=10).where(f"query_id < {len(x)}").collect()
    for q in range(0, 3000, 50):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        best = np.lexsort((np.arange(len(x)), d))[:10]
        assert [r["vec_id"] for r in sorted((r for r in rows if r["query_id"] == q), key=lambda r: r["rank"])] == best.tolist()


def near_rows(r, n, dim, kinds):
    return (3 * r.standard_normal((kinds, dim)))[r.integers(0, kinds, n)] + r.standard_normal((n, dim))


def test_a_full_block_is_scanned_and_few_rows_are_ranked_exactly():
    r = np.random.default_rng(4)
    x = near_rows(r, ann.ROW_BLOCK, 64, 200)
    q = ann.Quantiser(x[:4000], rounds=3)
    t = pa.table({"vec_id": pa.array(np.arange(len(x))), "vec": pa.array(list(x), pa.list_(pa.float64())), "code": pa.array([c.tobytes() for c in q.encode(x)], pa.binary())})
    block = ann.Block(t, {64: q}, 10, ann.RERANK)
    own = np.arange(0, len(x), 2000)
    got = {}
    for a, b, _ in block.best(own, x[own]):
        got.setdefault(a, []).append(b)
    for k in own:
        d = ((x - x[k]) ** 2).sum(1)
        d[k] = np.inf
        assert got[k] == np.lexsort((np.arange(len(x)), d))[:10].tolist()
    assert block.compared < 0.01 * len(own) * len(x)


@pytest.mark.parametrize("kind, most", [("unit", 0.06), ("gauss", 0.06), ("clustered", 0.06)])
def test_the_codes_and_not_the_exact_way_find_the_neighbours(kind, most):
    """All that is compared in double precision counts, audits too: most of it is never looked at, on unclustered vectors as well."""
    r = np.random.default_rng(6)
    x = near_rows(r, 2500, 64, 40) if kind == "clustered" else r.standard_normal((2500, 64))
    x = x / np.linalg.norm(x, axis=1, keepdims=True) if kind == "unit" else x
    q = ann.Quantiser(x, rounds=4)
    t = pa.table({"vec_id": pa.array(np.arange(len(x))), "vec": pa.array(list(x), pa.list_(pa.float64())), "code": pa.array([c.tobytes() for c in q.encode(x)], pa.binary())})
    block, got = ann.Block(t, {64: q}, 10, ann.RERANK), {}
    own = np.arange(0, len(x), 25)
    for a, b, _ in block.best(own, x[own]):
        got.setdefault(a, []).append(b)
    hits = 0
    for k in own:
        d = ((x - x[k]) ** 2).sum(1)
        d[k] = np.inf
        hits += len(set(got[k]) & set(np.argsort(d)[:10].tolist()))
    assert hits >= 0.995 * 10 * len(own) and block.compared <= most * len(own) * len(x)


def test_an_audit_that_finds_a_nearer_row_widens_the_margin(monkeypatch):
    monkeypatch.setattr(ann, "MARGIN", 1e-6)
    monkeypatch.setattr(ann, "AUDIT", 1)
    r = np.random.default_rng(9)
    x = r.standard_normal((3000, 64))
    q = ann.Quantiser(x[:500], rounds=1)
    t = pa.table({"vec_id": pa.array(np.arange(len(x))), "vec": pa.array(list(x), pa.list_(pa.float64())), "code": pa.array([c.tobytes() for c in q.encode(x)], pa.binary())})
    block, got = ann.Block(t, {64: q}, 10, ann.RERANK), {}
    for a, b, _ in block.best(np.arange(200), x[:200]):
        got.setdefault(a, []).append(b)
    assert block.margin > 1e-6
    for k in range(200):
        d = ((x - x[k]) ** 2).sum(1)
        d[k] = np.inf
        assert got[k] == np.lexsort((np.arange(len(x)), d))[:10].tolist()


def test_repeated_rows_and_ids_of_a_search(spark):
    x = np.eye(4)[[0, 0, 1, 2, 3, 3]] + 1
    rows = [(0, x[0].tolist()), (0, x[1].tolist()), (1, x[2].tolist()), (2, x[3].tolist()), (3, x[4].tolist()), (3, x[5].tolist())]
    got = [(r["query_id"], r["vec_id"]) for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 1).collect()]
    assert sorted(got) == [(1, 0), (1, 0), (1, 2), (1, 3), (1, 3)]


def test_registered_search_over_20k_vectors(spark, tmp_path):
    """op1 as registered, several blocks, against brute force."""
    from anamnex.llm import queries

    x = near_rows(np.random.default_rng(5), 20_000, 32, 50)
    x[7] = 0
    spark.createDataFrame(((k, v.tolist(), 1) for k, v in enumerate(x)), "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {}
    for r in queries.op1_nearest_neighbours(spark, str(tmp_path)).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 20_000, 100))
    for q, own in got.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[[q, 7]] = np.inf
        best = np.lexsort((np.arange(len(x)), d))[:10]
        assert [r[1] for r in sorted(own)] == best.tolist() and np.allclose([r[2] for r in sorted(own)], d[best])


def toxic_corpus(spark):
    r = random.Random(6)
    words = ["thing", "water", "river", "stone", "paper", "green", "house", "garden", "window", "summer"]
    docs, labels = [], []
    for k in range(600):
        own = [r.choice(words) for _ in range(30)]
        bad = k % 6 == 0
        if bad:
            own[r.randrange(30)] = r.choice(["grumble", "snarkish"])
        docs.append((k, " ".join(own), "en"))
        labels.append((k, int(bad), 0))
    docs += [(1000, None, ""), (1001, "", ""), (1002, "the gr|_|mble", ""), (1003, "a s n a r k i s h man", ""), (1004, "gruuuumble gr-u-m-b-l-e", ""), (1005, "5n4rk1sh", ""), (1006, "river $$$ stone%%% green!!!", ""), (1007, "word " * 30000 + "grumble", "")]
    labels += [(None, 1, 0), (3, None, 0), (0, 1, 0)]
    return spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, toxic int, quality int")


def test_toxicity(spark):
    docs, labels = toxic_corpus(spark)
    model = toxicity.learn(docs, labels)
    rows = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    held = range(600)
    assert all((rows[k] >= toxicity.THRESHOLD) == (k % 6 == 0) for k in held)
    assert {k: rows[k] >= toxicity.THRESHOLD for k in (1000, 1001, 1003, 1004, 1005, 1006, 1007)} == {1000: False, 1001: False, 1003: True, 1004: True, 1005: True, 1006: False, 1007: True}
    restored = {r["doc_id"]: r["restored"] for r in toxicity.restore(docs, model.chars).where("doc_id >= 1000 AND doc_id < 1007").collect()}
    assert restored[1005] == "snarkish" and restored[1006] == "river stone green" and restored[1000] == ""
    none = toxicity.learn(docs.limit(0), labels.limit(0))
    assert toxicity.score(docs.limit(1), none).first()["score"] < toxicity.THRESHOLD


def test_toxic_words_in_any_place_of_a_disguise(spark):
    model = toxicity.learn(*toxic_corpus(spark))
    bad = ["r i v e r s n a r k i s h", "g a r d e n g r u m b l e w i n d o w", "s t o n e  g r u m b l e  p a p e r", "thing,snarkish", "river_snarkish", "river.gr-umble,stone", "hey!grumble", "grummble", "snarkiish", "snnarrkish", "w a t e r s n 4 r k 1 s h", "river,5n4rk1sh", ",".join(["river"] * 20 + ["grumble"])]
    good = ["r i v e r s t o n e", "thing,river", "river_stone", "ggreen", "w i n d o w s u m m e r", "1 2 3 4 5", "_ _ _ _ _", "", "a b c"]
    scores = model.scores(bad + good, {})
    assert [t for t, p in zip(bad + good, scores) if p >= toxicity.THRESHOLD] == bad


def test_decoder_equals_all_paths():
    r, counts = random.Random(1), {}
    for w in ["stone", "kiss", "abbot", "beast", "thing", "été"]:
        w = "^^" + w + "^"
        for i in range(len(w) - 2):
            counts[w[i : i + 3]] = counts.get(w[i : i + 3], 0) + 7
    model = toxicity.CharModel.of(counts)

    def cheapest(word, all_letters):
        costs = []
        for path in itertools.product(*toxicity.lattice(word, all_letters)):
            key, cost = "^^", 0.0
            for x, more in path:
                cost += more
                if x:
                    f = x if x in toxicity.LETTERS else toxicity.OTHER
                    cost, key = cost + model.cost(key + f), key[1] + f
            costs.append(cost + model.cost(key + "^"))
        return min(costs)

    for _ in range(1500):
        word = "".join(r.choice("abeiost0123456789@$!|+(-._?é日") for _ in range(r.randint(1, 8)))
        for all_letters in (False, True):
            assert abs(cheapest(word, all_letters) - toxicity.decoded(word, model, all_letters)[0]) < 1e-9
    assert len(toxicity.pieces("i-" * 50_000 + "a-b_c" * 2000)) < 200


def test_marks_and_repeats_of_any_length_are_letters(spark):
    chars = toxicity.learn(*toxic_corpus(spark)).chars
    model = toxicity.Model(chars, {"=dumbass": 0.9, "=kiss": 0.9, "=ki": 0.9, "=ass": 0.9, "4sill": 0.9}, 0.01)
    bad = ["dumba$$", "dumbas$", "$$ki ki$$", "k" + "i" * 60 + "ss", "K" + "i" * 5000 + "ss!!", "k1", "@$$", "s1lly", "s" * 70 + "illy", "kissss,", "k-1-$-$", "x" * 200 + ",ki$$", "s_i_l_l_y"]
    good = ["dumb", "kit", "as", "$100", "a+", "100%", "k" * 5000, "", "$$$", "kill", "1970-01-01"]
    assert [t for t, p in zip(bad + good, model.scores(bad + good, {})) if p >= toxicity.THRESHOLD] == bad
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(bad)], "doc_id long, text string")
    assert {r["score"] >= toxicity.THRESHOLD for r in toxicity.score(docs.union(docs), model).collect()} == {True}
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_copies_do_not_teach(spark):
    """Words that only stand beside the telling word get no weight."""
    own = [[0, 1]] * 30 + [[0]] * 10 + [[2]] * 20
    weights = dict(toxicity.decision_list(own, [1] * 60, 3, 0.1, 5.0))
    assert set(weights) == {0, 2}
    # beside different telling words, a word tells as well; beside one of them alone it doesn't
    own = [[0, 3]] * 20 + [[1, 3]] * 20 + [[0, 4]] * 20 + [[0]] * 30 + [[1]] * 30
    assert set(dict(toxicity.decision_list(own, [1] * 120, 5, 0.1, 5.0, 12.0))) == {0, 1, 3}


def test_beginnings_that_several_words_share(spark):
    chars = toxicity.learn(*toxic_corpus(spark)).chars
    model = toxicity.Model(chars, {"2grumb": 0.9}, 0.01)
    texts = ["grumble", "grumble grumble", "grumble grumbling", "gr-umble, GRUMBLER!", "grumb grumbles", "rumble rumbling"]
    assert [p >= toxicity.THRESHOLD for p in model.scores(texts, {})] == [False, False, True, True, True, False]
    assert toxicity.document_features({"grumble", "grumbling", "x"}) >= {"2grumb", "=x"} and "2grumb" not in toxicity.document_features({"grumble"})


def test_training_never_sees_the_held_out_fold(spark):
    labels = spark.createDataFrame([(k, 1) for k in range(200)], "doc_id long, toxic int")
    ids = toxicity.training_ids(labels, 50)
    assert ids.count() == 50 and ids.where(toxicity.held_out(F.col("doc_id"))).count() == 0


def test_pipeline_decides_null_ids_by_their_sets(spark, sf_dir):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    a, b, c = (" ".join(f"{x}{k}" for k in range(30)) for x in "abc")
    rows = [(1, a), (None, a), (None, a.upper()), (None, b), (None, b), (None, c), (None, ""), (None, ""), (None, None), (2, ""), (3, c + " more"), (3, c + " more")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "x") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, set_key string")
    out = corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir)
    assert out.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) == sorted([(1, a), (None, b), (None, c), (None, ""), (None, ""), (None, None), (2, ""), (3, c + " more")], key=str)


def test_pipeline_of_no_documents(spark, sf_dir, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    for name in ("documents", "labels"):
        df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        (df.limit(0) if name == "documents" else df).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_stages(spark, sf_dir):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = common.Scratch(spark)
    steps = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = scratch.write(stage(spark, steps[-1], sf_dir))
        assert out.columns == docs.columns
        steps.append(out)
    clean = steps[1]
    bad = spark.read.parquet(f"{sf_dir}/labels.parquet").where("toxic = 0").select("doc_id")
    assert docs.join(bad, "doc_id", "left_semi").join(clean, "doc_id", "left_anti").count() <= 0.02 * bad.count() + 1
    texts = [(r["doc_id"], r["text"]) for r in clean.orderBy("doc_id").collect()]
    label = classes(len(texts), brute_links([t for _, t in texts]))
    assert {r["doc_id"] for r in steps[2].collect()} == {texts[k][0] for k in range(len(texts)) if label[k] == k}
    assert {r["doc_id"] for r in steps[3].select("doc_id").collect()} == {r["doc_id"] for r in steps[2].select("doc_id").collect()}
    assert corpus_pipeline.run(spark, sf_dir).select("doc_id").distinct().count() == steps[3].count()
