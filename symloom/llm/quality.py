"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + w.x + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2]): the pairwise interactions of all
features in time linear in the features. Words of the whole text are hashed to 2**BITS columns (logarithmic
counts, unit length); the statistics are shares of character classes, repetition and lengths; metadata is what the
row tells of the text's size in characters, bytes and lines.

Defined results: a null text counts as empty, and an empty one is scored like any other (by the bias and zero
features). With labels of one kind only the score is the share of label 1; with none it is 0.5. Labels that
contradict each other for one document: the smallest counts. Rows that repeat are answered each by itself. Only doc_id and
text are read; other columns, of any name, don't matter and are kept by the filter. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symloom.llm.common import OTHER, SPACE, char_classes, codes, prepare, remainder, sample_per_class, texts_of, word_hashes

BITS = 12
STATS = 17
WIDTH = (1 << BITS) + STATS
FACTORS = 8
#: Bound of the learning sample: this many documents of each label.
PER_LABEL = 2500


def _bytes(c: np.ndarray) -> int:
    """The length in UTF-8."""
    return int(len(c) + (c > 0x7F).sum() + (c > 0x7FF).sum() + (c > 0xFFFF).sum())


def features(text: str, out: np.ndarray) -> None:
    """Fills one row of WIDTH zeros."""
    if not text:
        return
    c = codes(text)
    share = np.bincount(char_classes()[c], minlength=OTHER + 1) / len(c)
    low = codes(text.lower())
    ids = (word_hashes(low, char_classes()[low] != SPACE) >> np.uint64(64 - BITS)).astype(np.int64)
    n = max(1, len(ids))
    count = np.bincount(ids, minlength=1 << BITS)
    x = np.log1p(count).astype(np.float32)
    out[: 1 << BITS] = x / max(1e-9, float(np.sqrt((x * x).sum())))
    again = float((ids[1:] == ids[:-1]).mean()) if len(ids) > 1 else 0.0
    lines = text.count("\n") + 1
    out[1 << BITS :] = [
        *share, again, 1 - (count > 0).sum() / n, count.max() / n, min(2.0, len(c) / n / 10), np.log1p(len(c)) / 12,
        np.log1p(lines) / 8, np.log1p(_bytes(c)) / 12, (c > 127).mean(), text.count("!") / n, text.count("|") / n,
    ]


@dataclass
class Model:
    bias: float
    linear: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def prepare(self, x: np.ndarray) -> np.ndarray:
        x[:, 1 << BITS :] = np.clip((x[:, 1 << BITS :] - self.mean) / self.scale, -8, 8)
        return x

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.bias + x @ self.linear + 0.5 * (((x @ self.factors) ** 2).sum(1) - (x * x) @ (self.factors**2).sum(1))

    def score(self, texts: list[str]) -> np.ndarray:
        out = np.empty(len(texts))
        for at in range(0, len(texts), 256):
            x = np.zeros((len(texts[at : at + 256]), WIDTH), np.float32)
            for i, t in enumerate(texts[at : at + 256]):
                features(t, x[i])
            out[at : at + len(x)] = 1 / (1 + np.exp(-np.clip(self.margin(self.prepare(x)), -30, 30)))
        return out


def solve(x: np.ndarray, y: np.ndarray, epochs: int = 30, seed: int = 7) -> Model:
    """Adam on the logistic loss, in blocks of 256 rows in a fixed shuffle."""
    rng = np.random.default_rng(seed)
    zero = np.zeros(WIDTH, np.float32)
    if not len(y) or y.min() == y.max():
        p = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
        return Model(float(np.log(p / (1 - p))), zero, np.zeros((WIDTH, FACTORS), np.float32), np.zeros(STATS, np.float32), np.ones(STATS, np.float32))
    s = x[:, 1 << BITS :]
    m = Model(0.0, zero.copy(), rng.normal(0, 0.01, (WIDTH, FACTORS)).astype(np.float32), s.mean(0), s.std(0) + 1e-3)
    m.prepare(x)
    state = {k: [0.0, 0.0] for k in ("bias", "linear", "factors")}
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), 256):
            b = order[at : at + 256]
            xb = x[b]
            g = ((1 / (1 + np.exp(-np.clip(m.margin(xb), -30, 30))) - y[b]) / len(b)).astype(np.float32)
            xv = xb @ m.factors
            grads = {"bias": g.sum(), "linear": xb.T @ g + 1e-5 * m.linear, "factors": xb.T @ (g[:, None] * xv) - m.factors * ((xb * xb).T @ g)[:, None] + 1e-4 * m.factors}
            step += 1
            for k, d in grads.items():
                a = state[k]
                a[0], a[1] = 0.9 * a[0] + 0.1 * d, 0.999 * a[1] + 0.001 * d * d
                setattr(m, k, (getattr(m, k) - 0.02 * (a[0] / (1 - 0.9**step)) / (np.sqrt(a[1] / (1 - 0.999**step)) + 1e-8)))
    m.linear, m.factors = m.linear.astype(np.float32), m.factors.astype(np.float32)
    return m


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        packed = []
        for t in texts_of(b):
            x = np.zeros(WIDTH, np.float32)
            features(t, x)
            packed.append(x.astype(np.float16).tobytes())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("quality"), pa.array(packed, pa.binary())], ["doc_id", "quality", "x"])


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learns from labelled documents whose crc32 remainder isn't 1, at most PER_LABEL of each label.

    The driver gets a feature row of 8 kB for each document of that sample, whatever the texts' length.
    """
    prepare(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where(F.col("quality").isin(0, 1))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality")).where(remainder(F.col("doc_id")) != 1)
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    picked = sample_per_class(known.join(ids, "doc_id", "left_semi"), "quality", PER_LABEL).collect()
    if not picked:
        return solve(np.zeros((0, WIDTH), np.float32), np.zeros(0, np.float32))
    chosen = docs.sparkSession.createDataFrame([(r["doc_id"], r["quality"]) for r in picked], "doc_id long, quality int")
    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    rows = some.mapInArrow(_rows, "doc_id long, quality int, x binary").groupBy("doc_id", "quality").agg(F.min("x").alias("x")).collect()
    rows.sort(key=lambda r: r["doc_id"])
    x = np.stack([np.frombuffer(r["x"], np.float16) for r in rows]).astype(np.float32)
    return solve(x, np.array([r["quality"] for r in rows], np.float32))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``."""
    prepare(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = sent.value.score(texts_of(b))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(remainder(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep(docs: DataFrame, model: Model) -> DataFrame:
    """The rows that the model predicts to have label 1. All columns stay."""
    prepare(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(sent.value.score(texts_of(b)) >= 0.5))

    return docs.mapInArrow(run, docs.schema)
