"""N-gram Jaccard join with Bayesian candidate pruning.

Documents with one set of shingles form a class. Pairs of classes whose sets have a Jaccard similarity of at least
`least` are linked:

1. BANDS bands of ROWS MinHash values put a class into buckets. A pair at 0.8 misses all of them with a probability of
   (1 - 0.8 ** 5) ** 28 < 2e-5. Only buckets of two classes or more go on.
2. In a bucket, the 64 values of a pair's signatures are compared 16 at a time; the pair is dropped as soon as the
   posterior probability (uniform prior) of reaching `least` falls below TOLERANCE. Pairs within what is already
   connected need no comparison, as only the connection counts here. A bucket of more than BUCKET classes is split, and
   its parts meet in pairs, so that no task holds more than two of them.
3. The connected classes form candidate clusters. Each cluster is verified exactly, pair by pair, from the whole texts: in
   blocks of BLOCK classes, by products of 0/1 matrices, so that the pairs never become rows. A class goes into as many
   block pairs as its cluster has blocks.
4. Verified links give the components.

Returned: a row per document row with class_id (the smallest doc_id that can be reached over links, its own included),
n_links (other document rows that are linked directly, those of equal sets included), kept (doc_id = class_id and, where
rows of that id have different sets, the set is the first of them in the class) and set_key (a hash of the set; null if
empty). Null and empty texts and texts of white space have no shingles and link with nothing. Rows with a null id keep a
null class unless their set is also that of a row with an id. Rows of one id and several texts are as many nodes.
Repeated rows are rows of one class, and each is returned. Other columns are not read; very long texts count whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import EDGES, Scratch, chunks, components, groups, join_classes, slices, spanning, with_columns
from .shingles import MinHash, mixed, shingle_sets

LEAST = 0.8
BANDS, ROWS = 28, 5
COMPARED, AT_ONCE, TOLERANCE = 64, 16, 1e-6
BLOCK = 128
#: Classes of a part of a bucket; parts of one bucket meet in pairs, each pair a group of its own.
BUCKET = 512
COLUMNS = 4096


@lru_cache(maxsize=1)
def permutations() -> MinHash:
    return MinHash(BANDS * ROWS)


@lru_cache(maxsize=4)
def fewest_matches(least: float = LEAST, tolerance: float = TOLERANCE) -> list[int]:
    """For each stop, the fewest equal values with which a pair may still reach `least`.

    After m of k equal values, the similarity is Beta(m + 1, k - m + 1), and P(similarity >= x) = P(Binomial(k + 1, x) <= m).
    """
    out = []
    for k in range(AT_ONCE, COMPARED + 1, AT_ONCE):
        tail, m = 0.0, -1
        while tail < tolerance:
            m += 1
            tail += comb(k + 1, m) * least**m * (1 - least) ** (k + 1 - m)
        out.append(m)
    return out


def surviving(a: np.ndarray, b: np.ndarray, stops: list[int]) -> np.ndarray:
    """Which rows of two signature matrices survive all stops."""
    left = np.arange(len(a))
    seen = np.zeros(len(a), np.int32)
    for k, fewest in enumerate(stops):
        at = slice(k * AT_ONCE, (k + 1) * AT_ONCE)
        seen = seen + (a[left, at] == b[left, at]).sum(1)
        good = seen >= fewest
        left, seen = left[good], seen[good]
    out = np.zeros(len(a), bool)
    out[left] = True
    return out


def connected(signs: np.ndarray, stops: list[int]) -> list[tuple[int, int]]:
    """Pairs that connect what surviving pairs connect, in one bucket."""
    groups: list[np.ndarray] = []
    edges: list[tuple[int, int]] = []
    rest = np.arange(len(signs))
    while len(rest):  # each leader takes what survives beside it
        leader = rest[0]
        good = surviving(np.broadcast_to(signs[leader], (len(rest), signs.shape[1])), signs[rest], stops)
        good[0] = True
        edges += [(leader, x) for x in rest[good][1:]]
        groups.append(rest[good])
        rest = rest[~good]
    root = list(range(len(groups)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for i in range(len(groups)):
        for j in range(i + 1, len(groups)):
            if (p := find(i)) == (q := find(j)):
                continue
            a, b = groups[i], groups[j]
            pair = next(((int(x), int(b[hit[0]])) for x in a if len(hit := np.flatnonzero(surviving(np.broadcast_to(signs[x], (len(b), signs.shape[1])), signs[b], stops)))), None)
            if pair:
                edges.append(pair)
                root[q] = p
    return edges


def set_key(shingles: np.ndarray) -> str | None:
    return xxhash.xxh3_128_hexdigest(shingles) if len(shingles) else None


def signatures(df: DataFrame) -> DataFrame:
    """doc_id, key (of the set of shingles; null if empty), sign (64 values of 16 bits), bands."""
    bits = np.arange(1, BANDS + 1, dtype=np.uint64) << np.uint64(58)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = permutations()
        for b in slices(batches):
            texts = [t or "" for t in b.column(1).to_pylist()]
            keys, signs, bands = [], [], []
            for i, j in chunks(texts):
                for s in shingle_sets(texts[i:j]):
                    keys.append(set_key(s))
                    if not len(s):
                        signs.append(None), bands.append(None)
                        continue
                    v = hashes.of(s)
                    signs.append((v[:COMPARED] >> np.uint32(16)).astype(np.uint16).tobytes())
                    h = np.zeros(BANDS, np.uint64)
                    for row in v.reshape(BANDS, ROWS).T:
                        h = mixed(h * np.uint64(31) + row + bits)
                    bands.append(h.view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.string()), pa.array(signs, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "key", "sign", "bands"])

    return df.mapInArrow(run, "doc_id long, key string, sign binary, bands array<long>")


def with_keys(df: DataFrame, text: str = "text", out: str = "set_key") -> DataFrame:
    """Append the hash of a text's set of shingles; null if it has none."""

    def make(column: pa.Array) -> list:
        texts = [t or "" for t in column.to_pylist()]
        return [pa.array([set_key(s) for i, j in chunks(texts) for s in shingle_sets(texts[i:j])], pa.string())]

    return with_columns(df, [text], [T.StructField(out, T.StringType())], make)


def candidate_edges(rows: DataFrame, least: float) -> DataFrame:
    """Edges (a, b) from rows (bucket, i, j, node, sign), one group of (bucket, i, j) next to the other."""
    stops = fewest_matches(least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: set[tuple[int, int]] = set()
        small: list[tuple[int, int, bytes, bytes]] = []

        def settle() -> None:
            if small:
                a, b = (np.frombuffer(b"".join(s[k] for s in small), np.uint16).reshape(-1, COMPARED) for k in (2, 3))
                out.update((s[0], s[1]) for s, good in zip(small, surviving(a, b, stops)) if good)
                small.clear()

        def emit() -> pa.RecordBatch:
            rows = list(out)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for t in groups(batches, 3):
            nodes = t.column(3).to_pylist()
            signs = t.column(4).to_pylist()
            if len(nodes) == 2:
                if nodes[0] != nodes[1]:
                    small.append((*nodes, *signs))
                if len(small) >= 20_000:
                    settle()
            elif len(nodes) > 2:
                matrix = np.frombuffer(b"".join(signs), np.uint16).reshape(-1, COMPARED)
                out.update((nodes[x], nodes[y]) for x, y in connected(matrix, stops) if nodes[x] != nodes[y])
            if len(out) > 50_000:
                yield emit()
        settle()
        yield emit()

    return rows.mapInArrow(run, EDGES)


def links_within(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, least: float) -> np.ndarray:
    """Boolean matrix: which of `left` are linked with which of `right` (indices of sets)."""
    own = np.unique(np.concatenate([left, right]))
    place = {int(x): i for i, x in enumerate(own)}
    sizes = np.array([len(sets[x]) for x in own], np.int64)
    flat = np.concatenate([sets[x] for x in own])
    who = np.repeat(np.arange(len(own)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, who = flat[order], who[order]
    new = np.concatenate([[True], flat[1:] != flat[:-1]])
    column = np.cumsum(new) - 1
    often = np.bincount(column) > 1  # a shingle of one class alone is in no intersection
    keep = often[column]
    who, column = who[keep], (np.cumsum(often) - 1)[column[keep]]
    l, r = np.array([place[int(x)] for x in left]), np.array([place[int(x)] for x in right])
    both = np.zeros((len(l), len(r)), np.float32)
    for c in range(0, int(often.sum()), COLUMNS):
        a, b = np.searchsorted(column, [c, c + COLUMNS])
        m = np.zeros((len(own), COLUMNS), np.float32)
        m[who[a:b], column[a:b] - c] = 1
        both += m[l] @ m[r].T
    both = both.astype(np.int64)
    return both >= np.ceil(least * (sizes[l][:, None] + sizes[r][None, :] - both) - 1e-9)


def verified(rows: DataFrame, least: float) -> DataFrame:
    """From rows (cluster, i, j, block, node, size, key, text): counts (a, null, links) and connecting edges (a, b, null).

    Of the texts of a node's document, the one counts whose set has the node's key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, 3):
            i, j = t.column(1)[0].as_py(), t.column(2)[0].as_py()
            rows, sets, nodes = {}, [], []
            every, texts = list(zip(*(t.column(k).to_pylist() for k in (3, 4, 5, 6)))), t.column(7).to_pylist()
            del t
            for c, d in chunks([x or "" for x in texts]):
                for (block, node, size, key), own in zip(every[c:d], shingle_sets([x or "" for x in texts[c:d]])):
                    if node not in rows and set_key(own) == key:
                        rows[node] = (block, size)
                        sets.append(own)
                        nodes.append(node)
            if not nodes:
                continue
            block = np.array([rows[n][0] for n in nodes])
            size = np.array([rows[n][1] for n in nodes], np.int64)
            left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
            if not len(left) or not len(right):
                continue
            hit = links_within(sets, left, right, least)
            if i == j:
                np.fill_diagonal(hit, False)
            links = np.zeros(len(nodes), np.int64)
            links[left] += hit @ size[right]
            if i != j:
                links[right] += hit.T @ size[left]
            a, b = spanning(hit, left, right)
            n = np.array(nodes, np.int64)
            some = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([n[some], n[a]])), pa.array([None] * len(some) + n[b].tolist(), pa.int64()), pa.array(links[some].tolist() + [None] * len(a), pa.int64())],
                names=["a", "b", "links"],
            )

    return rows.mapInArrow(run, EDGES + ", links long")


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = LEAST) -> DataFrame:
    """doc_id, class_id, n_links, kept for each row of docs."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    made = scratch.write(signatures(own))
    with_set = made.where("key is not null")
    found = with_set.groupBy("key").agg(F.min("doc_id").alias("first"), F.count("*").alias("size"), F.min_by("sign", "doc_id").alias("sign"), F.min_by("bands", "doc_id").alias("bands"))
    found = scratch.write(found)
    # an id of several classes names the first of them by key; the others get numbers from their hash
    shared_ids = found.where("first is not null").groupBy("first").agg(F.count("*").alias("classes"), F.min("key").alias("own_key")).where("classes > 1")
    named = found.join(shared_ids.select("first", "own_key"), "first", "left")
    number = F.when(F.col("own_key").isNull() | (F.col("own_key") == F.col("key")), F.col("first")).otherwise(-(F.shiftrightunsigned(F.xxhash64("key"), 2)) - F.lit(1 << 62))
    classes = named.select("key", "first", F.when(F.col("first").isNotNull(), number).alias("node"), "size", "sign", "bands")
    classes = scratch.write(classes)
    nodes = classes.where("node is not null")

    buckets = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.ceil(F.count("*") / F.lit(BUCKET)).cast("int").alias("parts"), F.count("*").alias("n")).where("n > 1")
    mine = buckets.join(shared, "bucket").groupBy("node").agg(F.collect_list(F.struct("bucket", "parts")).alias("b"))  # at most BANDS each
    rows = nodes.select("node", "sign").join(mine, "node").select("node", "sign", F.inline("b"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("bucket", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "node", "sign")
    rows = rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "node")
    near = scratch.write(candidate_edges(rows, least))
    cluster = scratch.write(components(near, scratch).withColumnRenamed("component", "cluster"))
    scratch.drop(near)

    blocks = cluster.groupBy("cluster").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks"))
    placed = cluster.join(blocks, "cluster").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    placed = placed.join(nodes.select("node", "first", "size", "key"), "node")
    texts = placed.join(own.withColumnRenamed("doc_id", "first"), "first")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    texts = texts.select("cluster", "block", "node", "size", "key", "text", other.alias("other"))
    rows = texts.select("cluster", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "size", "key", "text")
    rows = rows.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j")
    found = scratch.write(verified(rows, least))

    linked = components(found.where("b is not null").select("a", "b"), scratch)
    counts = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    # the smallest id of a component, and the first class with it
    least = linked.join(nodes.select("node", "first", "key"), "node").groupBy("component").agg(F.min(F.struct("first", "key")).alias("least"))
    linked = linked.join(least, "component").select("node", "least")
    final = classes.select("key", "first", "node", "size").join(counts, "node", "left").join(linked, "node", "left")
    least = F.coalesce("least", F.struct("first", "key"))
    final = final.select("key", "size", least["first"].alias("class"), (least["key"] == F.col("key")).alias("head"), (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("links"))
    final = scratch.write(final)
    out = join_classes(made.select("doc_id", "key"), final, "key", final.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0])
    class_id = F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("class"))
    kept = F.coalesce((F.col("doc_id") == class_id) & F.coalesce("head", F.lit(True)), F.lit(False))
    return out.select("doc_id", class_id.alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), kept.alias("kept"), F.col("key").alias("set_key"))
