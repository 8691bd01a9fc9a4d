"""Near-duplicate embeddings: graphs per shard, every shard queried, links verified, components united.

Equal vectors form a class, of which one goes on. Classes are dealt by hash to shards of about SHARD_BYTES, so that a
task's memory does not grow with the table. Each shard is built into a navigable small-world graph, stored as a table.
Every vector then asks every shard of its dimension: a task holds one shard's graph, and queries stream past it, CHUNK at
a time. A graph is copied once for each QUERY_BLOCK queries (and, where shards are few, to keep TASKS tasks busy).

- The beam of a query widens (doubles) while half of what it holds are links, and up to WIDEST.
- Beyond that, or where the audit of a chunk fails at WIDEST, the queries are held against the whole shard in blocks of
  matrix products: dense clusters are exact.
- The audit holds queries of each chunk against the whole shard: a random share (AUDITED_SHARE, at least AUDITED), as
  many as AUDITED with links, and as many whose best find is just below the threshold. Unless they found RECALL of their
  links, other than themselves, the chunk's beams start twice as wide.
- What a beam holds is verified: the cosine in double precision of the original vectors.

As every vector asks every shard, queries grow with the product of rows and shards; that is the method, and the shuffle
of queries is the rows times the number of shards.

Links are counted, with the size of the classes, and reduced to a spanning forest in each chunk before they leave the
task, so that pairs never become rows. Components are united over those forests.

Returned: vec_id, n_links, component_id, kept for every row. Vectors that are null, empty, zero or hold null or
non-finite components link with nothing; a null id has a null component. Vectors of different dimensions don't link.
Rows of one id and several vectors are one node; repeated rows are one row each. Other columns are not read, and an empty
table gives an empty one. Inner products, norms and cosines beyond the range of doubles are
avoided by scaling each vector by its largest component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import EDGES, Scratch, components, groups, join_classes, streamed
from .hnsw import Graph, cells
from .vectors import matrix, usable_rows

LEAST = 0.9
#: float32 beams look a little below the threshold; verification decides.
SLACK = 1e-4
BEAM, WIDEST = 16, 512
AUDITED, AUDITED_SHARE, RECALL = 64, 0.02, 0.999
#: How far below the threshold a best find is worth an audit.
NEAR = 0.05
SHARD_BYTES, LEAST_SHARDS = 32 << 20, 4
QUERY_BLOCK, TASKS, CHUNK = 1_000_000, 16, 8_192
#: Cells of matrices that are held at once.
STEP_CELLS = 1 << 24


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision."""
    a, b = a / np.abs(a).max(1, keepdims=True), b / np.abs(b).max(1, keepdims=True)
    return (a * b).sum(1) / np.sqrt((a * a).sum(1) * (b * b).sum(1))


def graphs(rows: DataFrame) -> DataFrame:
    """From rows (dim, shard, node, vec, size): the same with pos, and links (all levels, a row of the lists after the other)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, 2):
            x = matrix(t["vec"])
            g = Graph(unit(x))
            flat = np.concatenate(g.links, 1)
            n = len(x)
            for a in range(0, n, 4096):
                b = min(n, a + 4096)
                links = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1) * flat.shape[1], pa.int32()), pa.array(flat[a:b].ravel(), pa.int32()))
                part = t.slice(a, b - a)
                columns = [part[c].combine_chunks() for c in ("dim", "shard")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.arange(a, b), pa.int64()), *(part[c].combine_chunks() for c in ("node", "vec", "size")), links], names=["dim", "shard", "pos", "node", "vec", "size", "links"])

    return rows.mapInArrow(run, "dim int, shard int, pos long, node long, vec array<double>, size long, links array<int>")


def levels(flat: np.ndarray) -> list[np.ndarray]:
    """The lists of all levels out of joined rows: the first takes 32, each other 16."""
    from .hnsw import M

    cuts = [2 * M + k * M for k in range((flat.shape[1] - 2 * M) // M + 1)]
    return [np.ascontiguousarray(p) for p in np.split(flat, cuts, 1)[: len(cuts)]]


def exact_links(q: np.ndarray, x: np.ndarray, least: float) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    step = max(1, STEP_CELLS // max(1, len(x)))
    for a in range(0, len(q), step):
        near = q[a : a + step] @ x.T >= least
        out += [np.flatnonzero(r) for r in near]
    return out


def beam_links(g: Graph, q: np.ndarray, least: float, width: int) -> tuple[list[np.ndarray], np.ndarray]:
    """What the beams find at `least` or above, widened as long as links fill them by half, and the best find below it."""
    out: list = [None] * len(q)
    below = np.full(len(q), -np.inf, np.float32)
    todo = np.arange(len(q))
    while len(todo) and width <= WIDEST:
        step = max(8, STEP_CELLS // (4 * cells(width)))
        again = []
        for a in range(0, len(todo), step):
            some = todo[a : a + step]
            ids, sim = g.search(q[some], min(width, max(8, len(g.x))))
            links = sim >= least
            below[some] = np.where(links, -np.inf, sim).max(1)
            for k, i, s in zip(some.tolist(), ids, links):
                if 2 * s.sum() >= width and width < len(g.x):
                    again.append(k)
                else:
                    out[k] = i[s]
        todo, width = np.array(again, int), 2 * width
    if len(todo):
        for k, found in zip(todo.tolist(), exact_links(q[todo], g.x, least)):
            out[k] = found
    return out, below


def audited_links(g: Graph, q: np.ndarray, own: np.ndarray, least: float) -> list[np.ndarray]:
    """Links of queries in a shard; own: a query's own place in it, or -1. A query's own place may be among its links."""
    width = BEAM
    while width <= WIDEST:
        found, below = beam_links(g, q, least, width)
        others = np.array([len(f) - (o in f) if o >= 0 else len(f) for f, o in zip(found, own.tolist())])
        r = np.random.default_rng(5)
        linked, close = np.flatnonzero(others > 0), np.flatnonzero((others == 0) & (below >= least - NEAR))
        some = np.unique(np.concatenate([r.permutation(linked)[:AUDITED], r.permutation(close)[:AUDITED], r.permutation(len(q))[: max(AUDITED, int(len(q) * AUDITED_SHARE))]]))
        true = [t[t != own[k]] for k, t in zip(some, exact_links(q[some], g.x, least))]
        total = sum(map(len, true))
        if sum(len(np.intersect1d(found[k], t)) for k, t in zip(some, true)) >= RECALL * total:
            return found
        width *= 2
    return exact_links(q, g.x, least)


class Shard:
    """A shard's graph, and what its queries find."""

    def __init__(self, t: pa.Table, least: float):
        order = np.argsort(t["pos"].to_numpy())
        self.x, self.size, self.nodes = matrix(t["vec"])[order], t["size"].to_numpy()[order], t["node"].to_numpy()[order]
        flat = t["links"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(self.x), -1)[order]
        self.graph, self.least = Graph.of(unit(self.x), levels(flat)), least
        self.by_node = np.argsort(self.nodes, kind="stable")

    def places(self, own: np.ndarray) -> np.ndarray:
        at = self.by_node[np.minimum(np.searchsorted(self.nodes, own, sorter=self.by_node), len(self.nodes) - 1)]
        return np.where(self.nodes[at] == own, at, -1)

    def answers(self, queries: pa.Table) -> pa.RecordBatch:
        own, raw = queries["node"].to_numpy(), matrix(queries["vec"])
        found = audited_links(self.graph, unit(raw).astype(np.float32), self.places(own), self.least - SLACK)
        counts = np.array([len(f) for f in found])
        left, right = np.repeat(np.arange(len(own)), counts), np.concatenate([*found, np.empty(0, int)]).astype(int)
        good = np.empty(len(left), bool)
        for a in range(0, len(left), 1 << 17):
            at = slice(a, a + (1 << 17))
            good[at] = (cosines(raw[left[at]], self.x[right[at]]) >= self.least) & (own[left[at]] != self.nodes[right[at]])
        left, right = left[good], right[good]
        links = np.bincount(left, self.size[right], len(own)).astype(np.int64)
        a, b = forest(own[left], self.nodes[right])
        some = np.flatnonzero(links)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([own[some], a])), pa.array([None] * len(some) + b.tolist(), pa.int64()), pa.array(links[some].tolist() + [None] * len(a), pa.int64())], names=["a", "b", "links"]
        )


def asked(rows: DataFrame, least: float) -> DataFrame:
    """From rows of graphs (kind 0) and then queries (kind 1) by (dim, shard, block): counts (a, null, links) and edges (a, b, null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from streamed(batches, 3, lambda t: Shard(t, least), CHUNK)

    return rows.mapInArrow(run, EDGES + ", links long")


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Some of the edges, that connect the same."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (p := root.setdefault(x, x)) != x:
            root[x] = root[p]
            x = p
        return x

    keep = []
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        p, q = find(x), find(y)
        if p != q:
            root[q] = p
            keep.append(k)
    return a[keep].astype(np.int64), b[keep].astype(np.int64)


def near_duplicates(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", least: float = LEAST) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of df."""
    scratch = Scratch(df.sparkSession)
    usable = usable_rows(df, vec_id, vector)
    classes = scratch.write(usable.groupBy("vec").agg(F.min("vec_id").alias("node"), F.count("*").alias("size")))
    n, total, held = classes.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum(F.size("vec")), F.lit(0)) * 4).first()
    shards = max(LEAST_SHARDS, -(-held // SHARD_BYTES))
    blocks = max(-(-TASKS // shards), -(-n // QUERY_BLOCK))
    rows = classes.select(F.size("vec").alias("dim"), F.pmod(F.xxhash64("node"), F.lit(shards)).cast("int").alias("shard"), "node", "vec", "size")
    graph = scratch.write(graphs(rows.repartition(shards, "dim", "shard").sortWithinPartitions("dim", "shard", "node")))
    block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    stored = graph.select("dim", "shard", block, F.lit(0).alias("kind"), "pos", "node", "vec", "size", "links")
    query_block = F.pmod(F.xxhash64("node", F.lit("q")), F.lit(blocks)).cast("int").alias("block")
    queries = rows.select("dim", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), query_block, F.lit(1).alias("kind"), F.lit(None).cast("long").alias("pos"), "node", "vec", "size", F.lit(None).cast("array<int>").alias("links"))
    met = stored.unionByName(queries).repartition(shards * blocks * 2, "dim", "shard", "block").sortWithinPartitions("dim", "shard", "block", "kind")
    found = scratch.write(asked(met, least))
    linked = components(found.where("b is not null").select("a", "b"), scratch)
    counts = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    by_class = classes.join(counts, "node", "left").join(linked, "node", "left")
    by_class = by_class.select("vec", "size", F.coalesce("component", "node").alias("component"), (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("links"))
    placed = join_classes(usable, scratch.write(by_class), "vec", total).groupBy("vec_id").agg(F.max("links").alias("links"), F.min("component").alias("component"))
    out = df.select(F.col(vec_id).cast("long").alias("vec_id")).join(placed, "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
