"""Shared helpers: Arrow row maps, lineage cuts in the cluster's shared folder, connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..plans.scratch import fresh_dir

#: Characters of text that a Python worker expands into words at once.
CHUNK_CHARS = 1 << 20
#: Bytes of an Arrow batch that are worked on at once.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Tables written once in the shared folder, so that a lost executor never forces a recomputation from the start."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.n = spark, fresh_dir(spark), 0

    def write(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a table that nothing unevaluated reads any more."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(df._scratch_path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def with_columns(df: DataFrame, inputs: list[str], fields: list[T.StructField], make: Callable[..., list]) -> DataFrame:
    """Append columns that a Python function makes from Arrow batches.

    make(*arrays) gets the input columns of one batch and returns one Arrow array for each field. Input columns
    with the name of a field are replaced; all others pass through untouched.
    """
    names = {f.name for f in fields}
    keep = [c for c in df.columns if c not in names]
    source = df.select(*(F.col(f"`{c}`") for c in keep), *(F.col(f"`{c}`").alias(f"__in_{i}") for i, c in enumerate(inputs)))
    schema = T.StructType([*(df.schema[c] for c in keep), *fields])
    arrow = to_arrow_schema(schema)
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            made = make(*(b.column(n + i) for i in range(len(inputs))))
            arrays = [*(b.column(i) for i in range(n)), *made]
            yield pa.RecordBatch.from_arrays([a.cast(f.type) if a.type != f.type else a for a, f in zip(arrays, arrow)], schema=arrow)

    return source.mapInArrow(run, schema)


def settled(df: DataFrame, name: str, column: Column) -> DataFrame:
    """Append a column that the optimizer can't copy into every place that uses it."""
    return df.select("*", F.explode(F.array(column)).alias(name))


def slices(batches: Iterator[pa.RecordBatch], most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `most` bytes, so that what is made from one stays small."""
    for b in batches:
        rows = max(1, min(b.num_rows, int(b.num_rows * most / max(1, b.nbytes))))
        for a in range(0, b.num_rows, rows):
            yield b.slice(a, rows)


def chunks(texts: list, most: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Bounds of runs of whole texts, of about `most` characters each."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def list_array(values, offsets, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.Table]:
    """Runs of rows with equal first columns; a run may cross batches, and is then held whole."""
    held: list[pa.RecordBatch] = []

    def key(b: pa.RecordBatch, i: int) -> tuple:
        return tuple(b.column(k)[i].as_py() for k in range(n_keys))

    for b in batches:
        if not b.num_rows:
            continue
        change = np.zeros(b.num_rows - 1, bool)
        for k in range(n_keys):
            v = b.column(k).to_numpy(zero_copy_only=False)
            change |= v[1:] != v[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), b.num_rows]
        if held and key(held[-1], held[-1].num_rows - 1) != key(b, 0):
            yield pa.Table.from_batches(held)
            held = []
        for i, j in zip(cuts[:-1], cuts[1:]):
            if held and i:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(i, j - i))
    if held:
        yield pa.Table.from_batches(held)


def runs(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Each batch in pieces of equal first columns, with them; a run of equal ones may come in several pieces."""
    for b in batches:
        if not b.num_rows:
            continue
        change = np.zeros(b.num_rows - 1, bool)
        for k in range(n_keys):
            v = b.column(k).to_numpy(zero_copy_only=False)
            change |= v[1:] != v[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), b.num_rows]
        for i, j in zip(cuts[:-1], cuts[1:]):
            yield tuple(b.column(k)[i].as_py() for k in range(n_keys)), b.slice(i, j - i)


def streamed(batches: Iterator[pa.RecordBatch], n_keys: int, build: Callable, chunk: int) -> Iterator[pa.RecordBatch]:
    """Groups by the first n_keys columns, where rows of kind 0 (the next column) come before those of kind 1.

    Only the first are held whole: build(table) makes of them what answers(table) to the others, about `chunk` rows at a time.
    """
    key, built, count = None, None, 0
    held: list[pa.RecordBatch] = []
    asking: list[pa.RecordBatch] = []
    for (*now, kind), b in runs(batches, n_keys + 1):
        if now != key:
            if asking:
                yield built.answers(pa.Table.from_batches(asking))
            key, built, held, asking, count = now, None, [], [], 0
        if kind == 0:
            held.append(b)
            continue
        if built is None:
            if not held:
                continue
            built, held = build(pa.Table.from_batches(held)), []
        asking.append(b)
        count += b.num_rows
        if count >= chunk:
            yield built.answers(pa.Table.from_batches(asking))
            asking, count = [], 0
    if asking:
        yield built.answers(pa.Table.from_batches(asking))


def spanning(hit: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links in a boolean matrix."""
    root = {int(x): int(x) for x in np.concatenate([left, right])}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    a, b = [], []
    for x, row in zip(left.tolist(), hit):
        for y in right[row].tolist():
            p, q = find(x), find(y)
            if p != q:
                root[q] = p
                a.append(x)
                b.append(y)
    return np.array(a, np.int64), np.array(b, np.int64)


EDGES = "a long, b long"
#: Nodes with more edges than both of these are joined by broadcast; at most 2 * HOT_SHARE nodes can be.
HOT_EDGES, HOT_SHARE = 100_000, 1000


def _with_least(pairs: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """pairs (u, v) joined with least (u, m, n); hubs go by a broadcast of at most 2 * HOT_SHARE rows."""
    bound = max(HOT_EDGES, total // HOT_SHARE)
    hot = [tuple(r) for r in least.where(F.col("n") > bound).select("u", "m").collect()]
    if not hot:
        return pairs.join(least.select("u", "m"), "u")
    few = pairs.sparkSession.createDataFrame(hot, "u long, m long")
    cold = pairs.join(F.broadcast(few.select("u")), "u", "left_anti").join(least.select("u", "m"), "u")
    return cold.unionByName(pairs.join(F.broadcast(few), "u"))


def join_classes(rows: DataFrame, classes: DataFrame, key: str, total: int) -> DataFrame:
    """rows joined (left) with their classes (key, size, ...); total: the sum of sizes. Large classes go by a broadcast of at most 2 * HOT_SHARE rows, so that no task gets all rows of one."""
    bound = max(HOT_EDGES, total // HOT_SHARE)
    hot = classes.where(F.col("size") > bound)
    if hot.isEmpty():
        return rows.join(classes, key, "left")
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(classes.where(F.col("size") <= bound), key, "left")
    return cold.unionByName(rows.join(F.broadcast(hot), key))


def components(edges: DataFrame, scratch: Scratch, most_rounds: int = 60) -> DataFrame:
    """Connected components by alternating large-star and small-star rounds.

    edges: (a long, b long). Returns (node long, component long), where component is the smallest node that can be
    reached; nodes without edges don't appear. Rounds grow with the logarithm of the longest path. Every round's
    edges are written to the shared folder. Null ends and loops are ignored.
    """
    now = scratch.write(edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct())
    mark = None
    for _ in range(most_rounds):
        total = now.count()
        if not total:
            return edges.sparkSession.createDataFrame([], "node long, component long")
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch.write(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")))
        large = scratch.write(_with_least(both, least, total).where("v > u and v <> m").select("v", F.col("m").alias("u")).distinct())
        # each node's smaller neighbours: hand them all to the smallest
        low = large.groupBy("v").agg(F.min("u").alias("m"), F.count("*").alias("n"))
        small = large.join(low.where("n > 1").select("v", "m"), "v").where("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u"))
        new = scratch.write(small.unionByName(low.select("v", F.col("m").alias("u"))).distinct())
        for x in (now, least, large):
            scratch.drop(x)
        now, was = new, mark
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == was:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("u").alias("node")).distinct()
    return now.select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
