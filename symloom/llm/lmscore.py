"""Document scores by cross-entropy difference (Moore and Lewis).

Two bigram models, of a target corpus and of the background, share one vocabulary (the pieces of a SentencePiece
model), order and smoothing: absolute discounting interpolated with add-one unigrams,

    P(w | h) = (max(c(hw) - D, 0) + D N(h) P(w)) / c(h),    P(w) = (c(w) + 1) / (n + V),

and P(w | h) = P(w) after an unseen h. The background is all of ``documents``; the target are the documents that a
label marks as good. A document's score is its loss per token under the target model less that under the background
model: the lower, the more like the target. Every text starts after the begin piece.

The models match in vocabulary, order and smoothing, not in size: the background counts all documents, since what is
gathered has to grow with the corpus. The smaller target model leans more on its unigrams; that shifts the scores of
all documents alike and keeps their order. A target document is scored by a model that has counted it.

Every token of every document counts. Tasks count sparse pairs and the sums are combined before and after one shuffle
whose size follows the corpus; the table has a row for each pair that occurs. It is cut into parts of about TABLE_ROWS
rows by a hash of the pair, files in the shared folder. With one part, tasks read it and score whole documents; with more,
the tokens of a document are cut alike and meet their part, each part spread over many tasks whatever its share of
tokens, and the sums are added up. Losses are whole multiples of 1 / UNIT, so sums are exact and the number of parts and
tasks changes no score.

Defined results: a null text counts as empty; documents without tokens have null losses and score. Rows that repeat
count and are scored each by itself. Documents with contradicting labels are no target. Without any target the target
model is the uniform one. Only doc_id and text are read; other columns, of any name, don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symloom.llm.common import drop_at_exit, fresh_path, materialize, mix, prepare, small, texts_of
from symloom.llm.spieces import encoder

BEGIN = 1
DISCOUNT = 0.75
#: Rows of a part of the pair table, which every worker process may hold: 24 bytes each, and twice that while it is read.
TABLE_ROWS = 4_000_000
#: A loss of 1 in the whole numbers that are added up; 2e8 tokens of a document still fit.
UNIT = float(1 << 30)
#: Distinct pairs that a counting task holds before it hands them on.
HELD = 2_000_000


def tokenized(docs: DataFrame, target: DataFrame, model: bytes) -> DataFrame:
    """doc_id, target (boolean), ids (int32 as bytes) of every row, written to the shared folder."""
    spark = docs.sparkSession
    prepare(spark)
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(sent.value)
        for b in batches:
            ids = pa.array([e.packed(t) for t in texts_of(b)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("target"), ids], ["doc_id", "target", "ids"])

    good = target.select(F.col("doc_id").cast("long").alias("doc_id")).distinct().withColumn("_good", F.lit(True))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(small(good, 72), "doc_id", "left").select("doc_id", F.coalesce("_good", F.lit(False)).alias("target"), "text")
    rows = rows.mapInArrow(run, "doc_id long, target boolean, ids binary")
    path = fresh_path(spark, "tokens")
    rows.write.option("compression", "zstd").parquet(path)
    drop_at_exit(spark, path)
    return spark.read.schema(rows.schema).parquet(path)


def _keys(ids: bytes, vocabulary: int) -> np.ndarray:
    """history x vocabulary + token of every token."""
    t = np.frombuffer(ids, np.int32).astype(np.int64)
    return np.concatenate(([BEGIN], t[:-1])) * vocabulary + t if len(t) else t


def pairs(tokens: DataFrame, vocabulary: int) -> DataFrame:
    """key, target, background: the counts of every pair that occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            key, where = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
            return key, *(np.bincount(where, np.concatenate([h[i] for h in held]), len(key)) for i in (1, 2))

        def batch(x: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x[0]), pa.array(x[1].astype(np.int64)), pa.array(x[2].astype(np.int64))], ["key", "target", "background"])

        for b in batches:
            own = {True: [], False: []}
            for ids, good in zip(b.column("ids").to_pylist(), b.column("target").to_pylist()):
                own[good].append(_keys(ids, vocabulary))
            for good, keys in own.items():
                if keys:
                    key, n = np.unique(np.concatenate(keys), return_counts=True)
                    held.append((key, n * good, n))
            if sum(len(h[0]) for h in held) > HELD:
                held = [merged()]
                if len(held[0][0]) > HELD // 2:
                    yield batch(held[0])
                    held = []
        if held:
            yield batch(merged())

    return tokens.select("ids", "target").mapInArrow(run, "key long, target long, background long").groupBy("key").agg(F.sum("target").alias("target"), F.sum("background").alias("background"))


class Margins:
    """Counts of histories and tokens, arrays over the vocabulary, of one model."""

    def __init__(self, vocabulary: int):
        self.c, self.n, self.w = (np.zeros(vocabulary) for _ in range(3))

    def loss(self, key: np.ndarray, count: np.ndarray) -> np.ndarray:
        v = len(self.w)
        h, w = key // v, key % v
        single = (self.w[w] + 1) / (self.w.sum() + v)
        c = self.c[h]
        both = (np.maximum(count - DISCOUNT, 0) + DISCOUNT * self.n[h] * single) / np.maximum(c, 1)
        return -np.log(np.where(c > 0, both, single))


def part_of(key: np.ndarray, parts: int) -> np.ndarray:
    return (mix(key.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)


def table(counts: DataFrame, vocabulary: int, parts: int = 1) -> DataFrame:
    """key, part, target, background: the losses of every pair. The driver gets two rows for each piece, no more."""
    models = [Margins(vocabulary), Margins(vocabulary)]
    names = ("target", "background")
    h, w = F.floor(F.col("key") / vocabulary), F.col("key") % vocabulary
    for r in counts.groupBy(h.alias("h")).agg(*(F.sum(c).alias(f"c{i}") for i, c in enumerate(names)), *(F.sum((F.col(c) > 0).cast("long")).alias(f"n{i}") for i, c in enumerate(names))).collect():
        for i, m in enumerate(models):
            m.c[r["h"]], m.n[r["h"]] = r[f"c{i}"], r[f"n{i}"]
    for r in counts.groupBy(w.alias("w")).agg(*(F.sum(c).alias(f"c{i}") for i, c in enumerate(names))).collect():
        for i, m in enumerate(models):
            m.w[r["w"]] = r[f"c{i}"]
    sent = counts.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = b.column("key").to_numpy()
            losses = [pa.array(np.rint(m.loss(key, b.column(c).to_numpy()) * UNIT).astype(np.int64)) for m, c in zip(sent.value, names)]
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(part_of(key, parts)), *losses], ["key", "part", *names])

    return counts.mapInArrow(run, "key long, part long, target long, background long")


_read: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]] = {}


def _table_of(path: str, part: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and their two losses of one part; a process holds the last one it read."""
    if (path, part) not in _read:
        _read.clear()
        fs, at = pafs.FileSystem.from_uri(f"{path}/part={part}")
        t = ds.dataset(at, filesystem=fs, format="parquet").to_table(["key", "target", "background"])
        key = t["key"].to_numpy()
        order = np.argsort(key)
        _read[path, part] = key[order], np.stack([t[c].to_numpy()[order] for c in ("target", "background")])
    return _read[path, part]


def _sums(keys: list[np.ndarray], path: str, part: int) -> list[np.ndarray]:
    """For each array of pairs the sums of their losses, which are in one part."""
    n = np.array([len(k) for k in keys])
    if not n.sum():
        return [np.zeros(len(keys), np.int64)] * 2
    key, loss = _table_of(path, part)
    at, ends = np.searchsorted(key, np.concatenate(keys)), np.cumsum(n)
    upto = [np.concatenate(([0], np.cumsum(x[at]))) for x in loss]
    return [x[ends] - x[ends - n] for x in upto]


def score(docs: DataFrame, target: DataFrame, model: bytes, table_rows: int = TABLE_ROWS) -> DataFrame:
    """doc_id, n_tokens, loss_target, loss_background, score of every row; ``target`` has the doc_id of good documents."""
    spark = docs.sparkSession
    vocabulary = len(encoder(model).pieces)
    tokens = tokenized(docs, target, model)
    counts = materialize(pairs(tokens, vocabulary), "pairs")
    parts = max(1, -(-counts.count() // table_rows))
    path = fresh_path(spark, "losses")
    table(counts, vocabulary, parts).write.partitionBy("part").parquet(path)
    drop_at_exit(spark, path)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = [_keys(x, vocabulary) for x in b.column("ids").to_pylist()]
            sums = _sums(keys, path, 0)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(k) for k in keys], pa.int64()), *map(pa.array, sums)], ["doc_id", "n_tokens", "t", "b"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each part of each document; the first is there even if it has no token."""
        for b in batches:
            rows = []
            for row, doc, ids in zip(*(b.column(c).to_pylist() for c in ("row", "doc_id", "ids"))):
                key = _keys(ids, vocabulary)
                part = part_of(key, parts)
                order = np.argsort(part, kind="stable")
                ends = np.searchsorted(part[order], np.arange(parts + 1))
                rows += [(p, row, doc, key[order[a:e]].tobytes()) for p, (a, e) in enumerate(zip(ends[:-1], ends[1:])) if e > a or not p]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["part", "row", "doc_id", "pairs"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part = b.column("part").to_numpy()
            ends = [*(np.flatnonzero(np.diff(part)) + 1), len(part)]
            for a, e in zip([0, *ends[:-1]], ends):
                if e > a:
                    own = b.slice(a, e - a)
                    keys = [np.frombuffer(x, np.int64) for x in own.column("pairs").to_pylist()]
                    yield pa.RecordBatch.from_arrays([own.column("row"), own.column("doc_id"), pa.array([len(k) for k in keys], pa.int64()), *map(pa.array, _sums(keys, path, int(part[a])))], ["row", "doc_id", "n_tokens", "t", "b"])

    if parts == 1:
        sums = tokens.select("doc_id", "ids").mapInArrow(whole, "doc_id long, n_tokens long, t long, b long")
    else:
        numbered = materialize(tokens.withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", "ids"), "numbered")
        own = numbered.mapInArrow(cut, "part long, row long, doc_id long, pairs binary")
        # rows of a part go to as many tasks as their hashes give, and a task reads each of its parts once
        own = own.repartition("part", F.pmod(F.xxhash64("row"), F.lit(256))).sortWithinPartitions("part")
        sums = own.mapInArrow(meet, "row long, doc_id long, n_tokens long, t long, b long").groupBy("row", "doc_id").agg(*(F.sum(c).alias(c) for c in ("n_tokens", "t", "b")))
    n = F.nullif(F.col("n_tokens"), F.lit(0)) * F.lit(UNIT)
    return sums.select("doc_id", "n_tokens", (F.col("t") / n).alias("loss_target"), (F.col("b") / n).alias("loss_background"), ((F.col("t") - F.col("b")) / n).alias("score"))
