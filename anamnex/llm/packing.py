"""Best-fit packing: patterns fitted to the length histogram by non-negative least squares.

1. Documents become pieces of at most `most` tokens: only longer ones are cut, and the first piece takes the odd rest.
2. The histogram of piece lengths (at most `most` counts, whatever the size of the corpus) goes to the driver. Patterns
   of two and three lengths that fill a sequence exactly are enumerated, their repeat counts are fitted by non-negative
   least squares (accelerated projected gradients), rounded down, and held to what the histogram has.
3. What is left is packed best fit, longest first, in groups of equal sequences, so that its cost depends on the number
   of different lengths and not on the number of documents.
4. Pieces of one length are numbered without gathering them: by hash bucket, with the buckets' running totals. The plan
   is a small table of runs (length, first number, sequences, offset), in which each piece finds its place.

Null texts count as empty, an empty one is the end token alone. Equal documents and repeated rows are packed each on its
own. Ids come from the operator of `bpe`, which equals
the tokenizers library; very long texts are encoded in parts that are cut where the tokenizer cuts anyway. Other columns, of
whatever names, are not read; an empty table has no pieces.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import codec
from .common import Scratch, chunks, slices

END_ID = 2
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Rows of one hash bucket when pieces are numbered.
BUCKET_ROWS = 10_000


def encoded(path: str, texts: list[str]) -> Iterator[np.ndarray]:
    """The ids of each text, without special tokens, and the end token."""
    own = codec(path)
    for a, b in chunks(texts):
        ids, at = own.encode_batch(texts[a:b])
        for i, j in zip(at[:-1].tolist(), at[1:].tolist()):
            yield np.append(ids[i:j], END_ID).astype("<u4")


def cut(ids: np.ndarray, most: int) -> Iterator[tuple[int, np.ndarray]]:
    first = len(ids) % most or most
    starts = [0, *range(first, len(ids), most)] if len(ids) > most else [0]
    for a, b in zip(starts, [*starts[1:], len(ids)]):
        yield a, ids[a:b]


def pieces(df: DataFrame, path: str, most: int = 1024, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per piece, with the CRC-32 of its ids, and nth: the place of its document in the task, which tells rows of one id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nth = 0
        for b in slices(batches):
            rows: list[list] = [[] for _ in range(6)]
            docs, texts = b.column(0).to_pylist(), [t or "" for t in b.column(1).to_pylist()]
            for i, ids in zip(docs, encoded(path, texts)):
                for k, (start, part) in enumerate(cut(ids, most)):
                    for column, v in zip(rows, (i, k, start, len(part), zlib.crc32(part), nth)):
                        column.append(v)
                nth += 1
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int32() if k == 1 else pa.int64()) for k, v in enumerate(rows)], names=["doc_id", "piece", "start", "length", "ids_crc32", "nth"])

    return df.select(F.col(doc_id).cast("long"), text).mapInArrow(run, PIECES + ", nth long")


def patterns(have: np.ndarray, most: int) -> np.ndarray:
    """Rows (a, b, c), a >= b >= c, of lengths that occur and add up to `most`; c is 0 in pairs."""
    n = np.flatnonzero(have)
    n = n[n > 0]
    a, b = np.meshgrid(n, n, indexing="ij")
    a, b = a.ravel(), b.ravel()
    c = most - a - b
    good = (a >= b) & (c >= 0) & (c <= b)
    a, b, c = a[good], b[good], c[good]
    keep = (c == 0) | (have[c] > 0)
    return np.stack([a[keep], b[keep], c[keep]], 1)


def nnls(rows: np.ndarray, have: np.ndarray, steps: int = 300) -> np.ndarray:
    """Repeat counts x >= 0 that least-squares fit sum(x * pattern) to the histogram, scaled so that the rare lengths count too."""
    weight = 1 / np.sqrt(np.maximum(have, 1.0))
    weight[0] = 0
    size = len(have)

    def up(x: np.ndarray) -> np.ndarray:
        return sum(np.bincount(rows[:, k], x, size) for k in range(3)) * weight

    def down(r: np.ndarray) -> np.ndarray:
        w = r * weight
        return w[rows[:, 0]] + w[rows[:, 1]] + w[rows[:, 2]]

    goal = have * weight
    v = np.random.default_rng(0).random(len(rows))
    for _ in range(30):  # the largest eigenvalue, for the step
        v = down(up(v))
        top = np.linalg.norm(v)
        v /= max(top, 1e-12)
    x = y = np.zeros(len(rows))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0, y - down(up(y) - goal) / (1.02 * top + 1e-12))
        t, was = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        y = new + (was - 1) / t * (new - x)
        x = new
    return x


def plan(histogram: dict[int, int], most: int = 1024) -> list[tuple[tuple[int, ...], int]]:
    """Groups (lengths of one sequence, number of such sequences) that hold each length exactly as often as it occurs."""
    left = np.zeros(most + 1, np.int64)
    for n, k in histogram.items():
        left[n] = k
    out: list[tuple[tuple[int, ...], int]] = []
    if left[most]:
        out.append(((most,), int(left[most])))
        left[most] = 0
    rows = patterns(left, most)
    if len(rows):
        x = nnls(rows, left.astype(float))
        for k in np.argsort(-x, kind="stable"):
            if x[k] < 1:
                break
            lengths = tuple(int(n) for n in rows[k] if n)
            times = min(int(x[k]), *(int(left[n]) // lengths.count(n) for n in set(lengths)))
            if times > 0:
                out.append((lengths, times))
                for n in lengths:
                    left[n] -= times
    return out + best_fit(left, most)


def best_fit(left: np.ndarray, most: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first, where sequences that hold the same are one group."""
    room: dict[int, list[list]] = defaultdict(list)  # free tokens -> [lengths, times]
    free: list[int] = []
    closed: list[tuple[tuple[int, ...], int]] = []

    def put(lengths: tuple[int, ...], times: int, space: int) -> None:
        if not space:
            closed.append((lengths, times))
            return
        if not room[space]:
            bisect.insort(free, space)
        room[space].append([lengths, times])

    for n in range(most, 0, -1):
        todo = int(left[n])
        while todo:
            at = bisect.bisect_left(free, n)
            if at == len(free):
                each = most // n
                times, rest = divmod(todo, each)
                if times:
                    put((n,) * each, times, most - n * each)
                if rest:
                    put((n,) * rest, 1, most - n * rest)
                break
            space = free[at]
            lengths, times = room[space].pop()
            if not room[space]:
                free.pop(at)
            each = space // n
            full = min(times, todo // each)
            if full:
                put(lengths + (n,) * each, full, space - n * each)
                todo -= full * each
            if full < times:
                if todo:  # fewer than fill one more
                    put(lengths + (n,) * todo, 1, space - n * todo)
                    full, todo = full + 1, 0
                if full < times:
                    put(lengths, times - full, space)
    return closed + [(tuple(lengths), times) for own in room.values() for lengths, times in own]


def runs(groups: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first number, pieces of it in a sequence, first sequence, offset of the first), by length and number."""
    used: dict[int, int] = defaultdict(int)
    out, sequence = [], 0
    for lengths, times in groups:
        at, k = 0, 0
        while k < len(lengths):
            n, same = lengths[k], 1
            while k + same < len(lengths) and lengths[k + same] == n:
                same += 1
            out.append((n, used[n], same, sequence, at))
            used[n] += same * times
            at, k = at + n * same, k + same
        sequence += times
    return sorted(out)


def numbered(df: DataFrame, total: int) -> DataFrame:
    """Append number: 0, 1, ... among the pieces of one length."""
    n = max(1, -(-total // BUCKET_ROWS))
    df = df.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "nth"), F.lit(n)).cast("int"))
    own = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "nth", "ids_crc32")) - 1
    before = df.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    up_to = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select("length", "bucket", F.coalesce(F.sum("n").over(up_to), F.lit(0)).alias("before"))
    return df.withColumn("own", own).join(before, ["length", "bucket"]).withColumn("number", F.col("own") + F.col("before")).drop("own", "before", "bucket")


def pack(df: DataFrame, path: str, most: int = 1024, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns doc_id, piece, start, length, ids_crc32, sequence_id, offset: a row per piece."""
    scratch = Scratch(df.sparkSession)
    cut_up = scratch.write(pieces(df, path, most, doc_id, text))
    histogram = {r["length"]: r["n"] for r in cut_up.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `most` rows
    found = runs(plan(histogram, most))
    table = np.array(found or [(0, 0, 1, 0, 0)], np.int64)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = table[:, 0] << 44 | table[:, 1]
        for b in batches:
            length, number = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("length", "number"))
            at = np.searchsorted(keys, length << 44 | number, "right") - 1
            _, first, same, sequence, offset = table[at].T
            more = number - first
            keep = [b.column(b.schema.get_field_index(c)) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(sequence + more // same), pa.array(offset + more % same * length)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    rows = numbered(cut_up, sum(histogram.values())).withColumn("number", F.col("number").cast("long"))
    return rows.mapInArrow(place, PIECES + ", sequence_id long, offset long")
