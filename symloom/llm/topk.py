"""Exact top-k search by inner product over a pivot-distance index.

Vectors become integers, floor(256 x). One more coordinate, sqrt(M - |v|^2) with M the largest squared length, makes
the largest inner product the smallest Euclidean distance, where the triangle inequality holds: a query at distance
d(q, p) from a pivot p is at least |d(q, p) - d(v, p)| from v. The index keys every vector by its nearest pivot and
its distance to it, range-partitioned and sorted by (pivot, distance, id): a pivot that owns a third of all rows, or
a vector that repeats as often, is split over many partitions. It is written to the shared folder.

Each query first searches the batch of index rows that holds it, which gives a score that its k best reach for sure.
Then every cell of a slab of the index meets blocks of queries, nearest cells first. In a cell a query starts at the
annulus (ANNULUS sorted rows) of its own distance to the pivot and expands to both sides; a side stops at the first
annulus whose bound is beyond the query's reach, since those behind it are farther still. The reach shrinks as better
scores come in. Only scores that can be among a query's k best leave a task; a window that keeps k rows before it
shuffles picks the best. Pivots come from a sample of PIVOT_SAMPLE rows (the smallest hashes of ids); the sample steers
the speed only, results are exact. In many dimensions without clusters all distances are alike and no annulus is
beyond the reach: then this is brute force in blocks.

Defined results: vectors that are null or hold a null or non-finite component take no part. Shorter vectors count
as padded with zeros. Rows that repeat an id count each by itself; a query skips all rows of its own id. Ties go to
the smaller id. A query with fewer than k candidates returns them all. Sums beyond 2**53 are formed in int64; a vector
whose squared length is 2**62 or more raises an error, so no sum wraps. Other columns, of any name, don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symloom.llm.common import drop_at_exit, fresh_path, materialize, prepare

K = 5
PIVOTS = 48
PIVOT_SAMPLE = 4096
#: Rows of one annulus, which is bounded as a whole, and queries that a task holds at once.
ANNULUS = 64
QUERY_BLOCK = 2048
#: Index rows of one partition, and of what a task holds at once.
PARTITION_ROWS = 40_000


def _dense(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """int64 rows of a list column, padded with zeros to ``dim``."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if len(n) and (n == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(n), dim), np.int64)
    out[np.arange(dim) < n[:, None]] = flat
    return out


def integers(vectors: DataFrame, vector: str = "embedding", id_: str = "vec_id") -> DataFrame:
    """(vec_id, v array<long>) of the rows that take part."""
    x = F.col(vector)
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e.cast("double")) | (F.abs(e.cast("double")) == float("inf")))
    return vectors.where(x.isNotNull() & F.col(id_).isNotNull()).where(~bad).select(F.col(id_).cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(F.lit(256.0) * e.cast("double")).cast("long")).alias("v"))


class Space:
    """The pivots, the lift and the exact products."""

    def __init__(self, pivots: np.ndarray, dim: int, top: float, widest: int):
        self.dim, self.top, self.exact = dim, top, widest * widest * max(dim, 1) < 1 << 53
        self.pivots = self.lift(pivots) if len(pivots) else np.zeros((1, dim + 1))

    def lift(self, v: np.ndarray) -> np.ndarray:
        f = v.astype(np.float64)
        return np.concatenate([f, np.sqrt(np.maximum(0, self.top - (f * f).sum(1)))[:, None]], 1)

    def to_pivots(self, lifted: np.ndarray) -> np.ndarray:
        sq = (lifted**2).sum(1)[:, None] + (self.pivots**2).sum(1) - 2 * lifted @ self.pivots.T
        return np.sqrt(np.maximum(0, sq))

    def query(self, v: np.ndarray) -> np.ndarray:
        """Distances of queries (lifted by 0) to the pivots."""
        return self.to_pivots(np.concatenate([v.astype(np.float64), np.zeros((len(v), 1))], 1))

    def products(self, q: np.ndarray, v: np.ndarray) -> np.ndarray:
        return (q.astype(np.float64) @ v.astype(np.float64).T).astype(np.int64) if self.exact else q @ v.T

    def reach(self, q: np.ndarray, score: np.ndarray) -> np.ndarray:
        """How far a vector with at least ``score`` can be; a little more, for rounding."""
        f = q.astype(np.float64)
        far = np.sqrt(np.maximum(0, (f * f).sum(1) + self.top - 2 * np.maximum(score, -(2.0**62)))) * (1 + 1e-9) + 1e-3
        return np.where(score <= _NONE, np.inf, far)


_NONE = -(1 << 62)


def farthest(sample: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first pivots, from the sample's first row."""
    if not len(sample):
        return sample
    f = sample.astype(np.float64)
    picked, far = [0], ((f - f[0]) ** 2).sum(1)
    while len(picked) < min(n, len(f)) and far.max() > 0:
        picked.append(int(far.argmax()))
        far = np.minimum(far, ((f - f[picked[-1]]) ** 2).sum(1))
    return sample[picked]


def _merge(best_s: np.ndarray, best_i: np.ndarray, s: np.ndarray, i: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of two lists a row, by score, then the smaller id."""
    s, i = np.concatenate([best_s, s], 1), np.concatenate([best_i, i], 1)
    order = np.lexsort((i, -s), axis=1)[:, :k]
    return np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)


def _best(space: Space, q: np.ndarray, qid: np.ndarray, v: np.ndarray, vid: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of rows ``v`` for each query, without its own id; empty places hold _NONE."""
    s = space.products(q, v)
    s[qid[:, None] == vid] = _NONE
    ids = np.broadcast_to(vid, s.shape)
    if s.shape[1] > 4 * k:  # narrow down without losing ties at the k-th score
        kth = -np.partition(-s, k - 1, axis=1)[:, k - 1]
        wide = int((s >= kth[:, None]).sum(1).max())
        if wide < s.shape[1]:
            at = np.argpartition(-s, wide - 1, axis=1)[:, :wide]
            s, ids = np.take_along_axis(s, at, 1), np.take_along_axis(ids, at, 1)
    empty = np.full((len(q), k), _NONE)
    return _merge(empty, np.full((len(q), k), np.iinfo(np.int64).max), s, ids, k)


@dataclass
class Cell:
    """Index rows of one pivot, sorted by their distance to it."""

    pivot: int
    dist: np.ndarray
    v: np.ndarray
    vid: np.ndarray

    def __post_init__(self) -> None:
        self.starts = np.arange(0, len(self.dist), ANNULUS)
        self.ends = np.minimum(self.starts + ANNULUS, len(self.dist))
        self.lo, self.hi = self.dist[self.starts], self.dist[self.ends - 1]


def cells(pivot: np.ndarray, dist: np.ndarray, v: np.ndarray, vid: np.ndarray) -> list[Cell]:
    ends = [*(np.flatnonzero(np.diff(pivot)) + 1).tolist(), len(pivot)]
    return [Cell(int(pivot[a]), dist[a:e], v[a:e], vid[a:e]) for a, e in zip([0, *ends[:-1]], ends) if e > a]


@dataclass
class Front:
    """A block of queries: what they have found so far and how far they still have to look."""

    space: Space
    q: np.ndarray
    qid: np.ndarray
    floor: np.ndarray
    k: int
    touched: int = 0  # pairs of query and row that were multiplied

    def __post_init__(self) -> None:
        self.to_pivots, self.reach = self.space.query(self.q), self.space.reach(self.q, self.floor)
        self.s, self.i = np.full((len(self.q), self.k), _NONE), np.full((len(self.q), self.k), np.iinfo(np.int64).max)

    def visit(self, cell: Cell, run: int, go: np.ndarray) -> None:
        """Queries ``go`` against one annulus."""
        a, e = cell.starts[run], cell.ends[run]
        self.touched += len(go) * int(e - a)
        s, i = _best(self.space, self.q[go], self.qid[go], cell.v[a:e], cell.vid[a:e], self.k)
        self.s[go], self.i[go] = _merge(self.s[go], self.i[go], s, i, self.k)
        better = go[self.s[go, self.k - 1] > self.floor[go]]
        if len(better):
            self.floor[better] = self.s[better, self.k - 1]
            self.reach[better] = self.space.reach(self.q[better], self.floor[better])

    def expand(self, cell: Cell) -> None:
        """All queries over one cell, from their own annuli outwards until each side stops."""
        d = self.to_pivots[:, cell.pivot]
        own = np.clip(np.searchsorted(cell.lo, d, "right") - 1, 0, len(cell.lo) - 1)
        for step, first in ((1, own), (-1, own - 1)):
            at, live = first.copy(), np.arange(len(d))
            while True:
                live = live[(at[live] >= 0) & (at[live] < len(cell.lo))]
                low = np.maximum(0, np.maximum(cell.lo[at[live]] - d[live], d[live] - cell.hi[at[live]]))
                live = live[low <= self.reach[live]]  # the others have stopped on this side
                if not len(live):
                    break
                order = live[np.argsort(at[live], kind="stable")]
                ends = np.flatnonzero(np.diff(at[order])) + 1
                for go in np.split(order, ends):
                    self.visit(cell, int(at[go[0]]), go)
                at[live] += step

    def search(self, found: list[Cell]) -> None:
        low = np.array([np.maximum(0, np.maximum(c.lo[0] - (d := self.to_pivots[:, c.pivot]), d - c.hi[-1])).mean() for c in found])
        for n in np.argsort(low, kind="stable"):
            self.expand(found[n])


def build(vectors: DataFrame) -> tuple[DataFrame, Space, int]:
    """The index (pivot, dist, vec_id, v) as written to the shared folder, its space, and its rows."""
    spark = vectors.sparkSession
    prepare(spark)
    v = materialize(vectors, "vectors")
    sq = F.aggregate("v", F.lit(0.0), lambda a, e: a + e.cast("double") * e)
    n, dim, top, widest = v.agg(F.count("*"), F.max(F.size("v")), F.max(sq), F.max(F.array_max(F.transform("v", F.abs)))).first()
    if (top or 0) >= 2.0**62:
        raise ValueError("a vector is too long for 64-bit inner products")
    some = v.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOT_SAMPLE).toArrow()
    dim = dim or 0
    space = Space(farthest(_dense(some["v"], dim), PIVOTS) if n else np.zeros((0, 0)), dim, top or 0.0, widest or 0)
    sent = spark.sparkContext.broadcast(space)

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = sent.value.to_pivots(sent.value.lift(_dense(b.column("v"), dim)))
            near = d.argmin(1)
            yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(d)), near]), b.column("vec_id"), b.column("v")], ["pivot", "dist", "vec_id", "v"])

    keyed = v.mapInArrow(key, "pivot int, dist double, vec_id long, v array<long>")
    parts = max(1, -(-n // PARTITION_ROWS))
    keyed = keyed.repartitionByRange(max(parts, min(12, -(-n // 4096) or 1)), "pivot", "dist", "vec_id").sortWithinPartitions("pivot", "dist", "vec_id")
    return materialize(keyed, "index"), space, n


def search(vectors: DataFrame, is_query: Column, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of ``vectors`` (as from ``integers``) for each query row."""
    hits = scanned(vectors, is_query, k).where("query_id is not null").drop("work")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def scanned(vectors: DataFrame, is_query: Column, k: int = K) -> DataFrame:
    """query_id, vec_id, score of what may be among the k best, and for each slab a row whose ``work`` is the number of pairs
    (query, row) that it multiplied."""
    spark = vectors.sparkSession
    index, space, _ = build(vectors)
    sent, dim = spark.sparkContext.broadcast(space), space.dim

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ask = np.flatnonzero(b.column("ask").to_numpy(zero_copy_only=False))
            if not len(ask):
                continue
            v, vid = _dense(b.column("v"), dim), b.column("vec_id").to_numpy()
            s, _ = _best(sent.value, v[ask], vid[ask], v, vid, k)
            yield pa.RecordBatch.from_arrays([pa.array(vid[ask]), b.column("v").take(pa.array(ask)), pa.array(s[:, k - 1])], ["vec_id", "v", "floor"])

    path = fresh_path(spark, "queries")
    index.select("vec_id", "v", is_query.alias("ask")).mapInArrow(first, "vec_id long, v array<long>, floor long").write.parquet(path)
    drop_at_exit(spark, path)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += len(b)
            if n >= PARTITION_ROWS:
                yield from meet(pa.Table.from_batches(held))
                held, n = [], 0
        if n:
            yield from meet(pa.Table.from_batches(held))

    def meet(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        """A slab of the index against all queries."""
        own = cells(rows["pivot"].to_numpy(), rows["dist"].to_numpy(), _dense(rows["v"], dim), rows["vec_id"].to_numpy())
        fs, at = pafs.FileSystem.from_uri(path)
        work = 0
        for q in ds.dataset(at, filesystem=fs, format="parquet").to_batches(batch_size=QUERY_BLOCK):
            if not len(q):
                continue
            front = Front(sent.value, _dense(q.column("v"), dim), q.column("vec_id").to_numpy(), q.column("floor").to_numpy().copy(), k)
            front.search(own)
            work += front.touched
            good = (front.s > _NONE) & (front.s >= front.floor[:, None])
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(front.qid, good.sum(1))), pa.array(front.i[good]), pa.array(front.s[good]), pa.nulls(good.sum(), pa.int64())], names)
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (None, None, None, work)], names)

    names = ["query_id", "vec_id", "score", "work"]
    return index.mapInArrow(scan, "query_id long, vec_id long, score long, work long")


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 5"""
