"""Nearest neighbours by score-aware anisotropic quantisation.

The squared distance of q and x is |q|^2 - 2 (q.x - |x|^2 / 2), so the nearest vectors are those of the largest inner
product with a known offset. Pairs of dimensions are quantised to four bits. Codes and codebooks minimise
|r|^2 + (eta - 1) (r.x / |x|)^2 of the residual r: the part along the vector, which is what harms large inner products,
weighs eta times as much. What the first codes leave is quantised once more in the same way. A query's inner products with
all codewords are tables; two four-bit codes are one byte, and a scan adds up table entries.

The first codes of every row of a block are scanned. Of the best FIRST by these, the RERANK best by both codes are compared
in double precision; the k-th of these distances is a limit. A row's estimate is off by 2 q.r of what its codes leave, r,
whose norm is known: rows whose estimate by the first codes, less MARGIN times that error's spread 2 |q| |r| / sqrt(d),
is beyond the limit go no further; of the others, those whose estimate by both codes is not beyond it in the same sense are
compared in double precision. No number of rows is fixed for any of this. One query in AUDIT is compared with its whole block as well;
where that finds a nearer row than the scan did, the block's margin is doubled and the queries are asked again, up to
sqrt(d), where the bound holds for every row and the result is that of brute force.

Codebooks are fitted on at most SAMPLE rows (by hash of the id), in a task; every row is encoded and scanned. Rows go to
blocks of bounded size, once for each QUERY_BLOCK queries; queries go to every block and stream past it, so that neither
side is broadcast. Of equal vectors, the eleven of the smallest ids in a block are enough for ten neighbours besides the
query. Queries only meet rows of their own dimension; null ids take no part. Rows of one id are one row each, and none
of them is a neighbour of its own id. Other columns are not read; an empty table has no neighbours.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, groups, slices, streamed
from .vectors import matrix, usable_rows

SAMPLE = 8_192
#: Rows refined for the limit, and rows of these that are compared for it (more than twice the neighbours asked for).
FIRST, RERANK = 256, 24
#: Spreads of the estimate's error within which a row is not passed over, and queries of which one is audited.
MARGIN, AUDIT = 4.5, 128
#: Queries of a copy of the rows, rows of a block, and, where there are few rows, blocks and least rows of one.
QUERY_BLOCK, ROW_BLOCK, TASKS, LEAST_ROWS = 1_000_000, 65_536, 12, 4_096
#: Queries that are scanned at once, and that are gathered before.
AT_ONCE, CHUNK = 32, 4_096
#: Inner products above this share of |q| |x| are the ones that matter.
SHARE = 0.2
CODES, WIDTH = 16, 2
#: Rounding of sums in double precision, as a share of squared norms.
SLACK = 1e-11


class Quantiser:
    def __init__(self, sample: np.ndarray, rounds: int = 5):
        n, self.dim = sample.shape
        self.parts = -(-self.dim // (2 * WIDTH)) * 2  # an even number: two codes make a byte
        self.eta = max(1.0, (self.dim - 1) * SHARE**2 / (1 - SHARE**2))
        x, u = self.split(sample)
        r = np.random.default_rng(3)
        self.layers: list[np.ndarray] = []
        for _ in range(2):  # the second of what the first leaves
            self.books = np.stack([x[r.integers(0, n, CODES), s] for s in range(self.parts)]) + 1e-9 * r.standard_normal((self.parts, CODES, WIDTH))
            for _ in range(rounds):
                self.refit(x, u, self.assign(x, u))
            self.layers.append(self.books)
            x = x - self.books[np.arange(self.parts), self.assign(x, u)]

    @classmethod
    def of(cls, dim: int, books: bytes) -> Quantiser:
        own = cls.__new__(cls)
        own.dim, own.parts = dim, -(-dim // (2 * WIDTH)) * 2
        own.eta = max(1.0, (dim - 1) * SHARE**2 / (1 - SHARE**2))
        own.layers = list(np.frombuffer(books).reshape(2, own.parts, CODES, WIDTH))
        return own

    def to_bytes(self) -> bytes:
        return np.stack(self.layers).tobytes()

    def split(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        wide = np.zeros((len(x), self.parts * WIDTH))
        wide[:, : self.dim] = x
        unit = wide / np.linalg.norm(wide, axis=1, keepdims=True)
        return wide.reshape(len(x), self.parts, WIDTH), unit.reshape(len(x), self.parts, WIDTH)

    def along(self, x: np.ndarray, u: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The residual's part along the vector, by subspace."""
        return ((x - self.books[np.arange(self.parts), codes]) * u).sum(2)

    def assign(self, x: np.ndarray, u: np.ndarray, passes: int = 2) -> np.ndarray:
        codes = np.stack([((x[:, s, None, :] - self.books[s]) ** 2).sum(2).argmin(1) for s in range(self.parts)], 1)
        along = self.along(x, u, codes)
        total = along.sum(1)
        for _ in range(passes):
            for s in range(self.parts):
                r = x[:, s, None, :] - self.books[s]
                own = (r * u[:, s, None, :]).sum(2)
                rest = total - along[:, s]
                best = ((r**2).sum(2) + (self.eta - 1) * (rest[:, None] + own) ** 2).argmin(1)
                codes[:, s] = best
                new = own[np.arange(len(x)), best]
                total, along[:, s] = rest + new, new
        return codes

    def refit(self, x: np.ndarray, u: np.ndarray, codes: np.ndarray) -> None:
        along = self.along(x, u, codes)
        total = along.sum(1)
        for s in range(self.parts):
            rest = total - along[:, s]
            us, xs = u[:, s], x[:, s]
            outer = np.eye(WIDTH) + (self.eta - 1) * us[:, :, None] * us[:, None, :]
            goal = xs + (self.eta - 1) * us * (rest + (xs * us).sum(1))[:, None]
            for c in range(CODES):
                mine = codes[:, s] == c
                if mine.sum() >= WIDTH:
                    self.books[s, c] = np.linalg.lstsq(outer[mine].sum(0), goal[mine].sum(0), rcond=None)[0]

    def encode(self, x: np.ndarray) -> np.ndarray:
        """A byte for each two subspaces, of the first codes and then of the second."""
        if not len(x):
            return np.empty((0, self.parts), np.uint8)
        return np.concatenate([self._encode(x[i : i + 8192]) for i in range(0, len(x), 8192)])

    def _encode(self, x: np.ndarray) -> np.ndarray:
        (x, u), out = self.split(x), []
        for self.books in self.layers:
            codes = self.assign(x, u)
            x = x - self.books[np.arange(self.parts), codes]
            out.append(codes[:, 0::2] | codes[:, 1::2] << 4)
        return np.concatenate(out, 1).astype(np.uint8)

    def tables(self, queries: np.ndarray, layer: int) -> np.ndarray:
        """For each query and byte of a layer, the inner product with the codewords of each value."""
        wide = np.zeros((len(queries), self.parts * WIDTH))
        wide[:, : self.dim] = queries
        each = np.einsum("qsw,scw->qsc", wide.reshape(len(queries), self.parts, WIDTH), self.layers[layer])
        byte = np.arange(256)
        return each[:, 0::2, byte & 15] + each[:, 1::2, byte >> 4]

    def scan(self, queries: np.ndarray, packed: np.ndarray, layer: int = 0) -> np.ndarray:
        """Approximate inner products, a row per query; packed: the bytes of one layer."""
        tables, out = self.tables(queries, layer), np.zeros((len(queries), len(packed)))
        for s in range(self.parts // 2):
            out += tables[:, s][:, packed[:, s]]
        return out

    def left(self, x: np.ndarray, packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Norms of what the first codes leave of the vectors, and of what both do."""
        half, out = self.parts // 2, []
        for k, books in enumerate(self.layers):
            codes = np.empty((len(packed), self.parts), np.uint8)
            own = packed[:, k * half : (k + 1) * half]
            codes[:, 0::2], codes[:, 1::2] = own & 15, own >> 4
            x = x - books[np.arange(self.parts), codes].reshape(len(packed), -1)[:, : self.dim]
            out.append(np.linalg.norm(x, axis=1))
        return out[0], out[1]


def kth(values: np.ndarray, k: int) -> float:
    return np.partition(values, k - 1)[k - 1] if len(values) >= k else np.inf


class Block:
    """Rows of one dimension with their codes, and the nearest of them to queries. compared: rows met in double precision."""

    def __init__(self, t: pa.Table, found: dict[int, Quantiser], k: int, rerank: int):
        ids, x, code = t["vec_id"].to_numpy(), matrix(t["vec"]), t["code"].to_pylist()
        keep = first_of_equal(x, k + 1)
        self.ids, self.x, self.k, self.rerank = ids[keep], x[keep], k, max(rerank, 2 * k + 1)
        own = found.get(x.shape[1])
        if own:
            packed = np.frombuffer(b"".join(code[i] for i in keep), np.uint8).reshape(len(keep), -1)
        else:  # a dimension that the sample did not meet
            own = Quantiser(self.x[:2_000])
            packed = own.encode(self.x)
        self.quantiser, self.margin, self.compared, self.audited = own, min(MARGIN, own.dim**0.5), 0, 0
        self.xx, (self.e1, self.e2) = (self.x**2).sum(1), own.left(self.x, packed)
        self.coarse, self.fine = (np.ascontiguousarray(p) for p in np.split(packed, 2, axis=1))

    def exact(self, at: np.ndarray, q: np.ndarray) -> np.ndarray:
        self.compared += len(at)
        return ((self.x[at] - q) ** 2).sum(1)

    def among(self, q_id: int, q: np.ndarray, inner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and squared distances of rows among which the nearest are. inner: with the first codes."""
        qq, tables = (q**2).sum(), self.quantiser.tables(q[None], 1)[0]
        slack, spread = SLACK * (qq + self.xx), self.margin * 2 * qq**0.5 / self.quantiser.dim**0.5

        def refined(at: np.ndarray) -> np.ndarray:
            more = np.zeros(len(at))
            for s in range(len(tables)):
                more += tables[s][self.fine[at, s]]
            return estimate[at] - 2 * more

        estimate = qq + self.xx - 2 * inner
        first = np.argpartition(estimate, min(FIRST, len(estimate)) - 1)[:FIRST]
        first = first[np.argpartition(refined(first), min(self.rerank, len(first)) - 1)[: self.rerank]]
        far = kth(self.exact(first, q)[self.ids[first] != q_id], self.k)
        at = np.flatnonzero(~(estimate - spread * self.e1 - slack > far))  # what is no number is not passed over
        at = at[~(refined(at) - spread * self.e2[at] - slack[at] > far)]
        return at, self.exact(at, q)

    def best(self, q_ids: np.ndarray, q: np.ndarray) -> list[tuple[int, int, float]]:
        out = []
        for a in range(0, len(q), AT_ONCE):
            out += self._best(q_ids[a : a + AT_ONCE], q[a : a + AT_ONCE])
        return out

    def _best(self, q_ids: np.ndarray, q: np.ndarray) -> list[tuple[int, int, float]]:
        inner = self.quantiser.scan(q, self.coarse)
        while True:
            out, missed = [], False
            for i, q_id in enumerate(q_ids.tolist()):
                at, d = self.among(q_id, q[i], inner[i])
                other = self.ids[at] != q_id
                at, d = at[other], np.sqrt(d[other])
                own = [(q_id, int(self.ids[at[j]]), d[j]) for j in np.lexsort((self.ids[at], d))[: self.k]]
                if self.margin < self.quantiser.dim**0.5 and zlib.crc32(str(q_id).encode()) % AUDIT == 0:
                    self.audited += 1
                    true = kth(np.sqrt(self.exact(np.arange(len(self.x)), q[i]))[self.ids != q_id], self.k)
                    missed = missed or own[-1][2] > true
                out += own
            if not missed:
                return out
            self.margin = min(2 * self.margin, self.quantiser.dim**0.5)

    def answers(self, queries: pa.Table) -> pa.RecordBatch:
        out = self.best(queries["vec_id"].to_numpy(), matrix(queries["vec"]))
        return pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], [pa.int64(), pa.int64(), pa.float64()][c]) for c in range(3)], names=["query_id", "vec_id", "score"])


def quantisers(rows: DataFrame, most: int = SAMPLE) -> dict[int, Quantiser]:
    """By dimension, fitted on at most `most` rows (vec_id, vec) in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, 1):
            own = Quantiser(matrix(t["vec"]))
            yield pa.RecordBatch.from_arrays([pa.array([own.dim], pa.int32()), pa.array([own.to_bytes()], pa.binary())], names=["dim", "books"])

    sample = rows.select(F.size("vec").alias("dim"), "vec_id", "vec").orderBy(F.xxhash64("vec_id"), "vec_id").limit(most)
    fitted = sample.select("dim", "vec").coalesce(1).sortWithinPartitions("dim").mapInArrow(run, "dim int, books binary").collect()  # a row per dimension
    return {r["dim"]: Quantiser.of(r["dim"], r["books"]) for r in fitted}


def index(rows: DataFrame, most: int = SAMPLE) -> tuple[DataFrame, dict[int, Quantiser]]:
    """Append code (binary) to rows (vec_id, vec); the quantisers by dimension, fitted on at most `most` rows."""
    found = quantisers(rows, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            vecs = b.column(1)
            dims = np.diff(vecs.offsets.to_numpy())
            codes: list = [b""] * len(dims)
            for d in np.unique(dims).tolist():
                if d in found:
                    at = np.flatnonzero(dims == d)
                    for i, c in zip(at, found[d].encode(matrix(vecs.take(pa.array(at))))):
                        codes[i] = c.tobytes()
            yield pa.RecordBatch.from_arrays([b.column(0), vecs, pa.array(codes, pa.binary())], names=["vec_id", "vec", "code"])

    return rows.mapInArrow(run, "vec_id long, vec array<double>, code binary"), found


def search(df: DataFrame, queries, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding", rerank: int = RERANK) -> DataFrame:
    """query_id, rank, vec_id, score (distance) of the k nearest other rows; queries: a condition on vec_id."""
    scratch = Scratch(df.sparkSession)
    coded, found = index(usable_rows(df, vec_id, vector))
    rows = scratch.write(coded)
    n, n_queries = rows.agg(F.count("*"), F.count_if(queries)).first()
    n_qb, n_rb = max(1, -(-n_queries // QUERY_BLOCK)), max(-(-n // ROW_BLOCK), min(TASKS, n // LEAST_ROWS), 1)

    def dealt(part: DataFrame, own: str, n_own: int, other: str, n_other: int, kind: int) -> DataFrame:
        mine = F.pmod(F.xxhash64("vec_id", F.lit(own)), F.lit(n_own)).cast("int").alias(own)
        each = F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))).alias(other)
        return part.select(F.size("vec").alias("dim"), mine, each, F.lit(kind).alias("kind"), "vec_id", "vec", "code").select("dim", "qb", "rb", "kind", "vec_id", "vec", "code")

    asking = rows.where(queries).withColumn("code", F.lit(None).cast("binary"))
    both = dealt(rows, "rb", n_rb, "qb", n_qb, 0).unionByName(dealt(asking, "qb", n_qb, "rb", n_rb, 1))
    met = both.repartition("dim", "qb", "rb").sortWithinPartitions("dim", "qb", "rb", "kind", "vec_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from streamed(batches, 3, lambda t: Block(t, found, k, rerank), CHUNK)

    best = met.mapInArrow(run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def first_of_equal(x: np.ndarray, most: int) -> np.ndarray:
    """Rows that have fewer than `most` equal ones before them."""
    if not len(x):
        return np.arange(0)
    whole = np.ascontiguousarray(x).view(np.dtype((np.void, x.shape[1] * x.itemsize))).ravel()
    _, inverse = np.unique(whole, return_inverse=True)
    order = np.argsort(inverse, kind="stable")
    sorted_ = inverse[order]
    start = np.searchsorted(sorted_, sorted_)
    return np.sort(order[np.arange(len(x)) - start < most])
