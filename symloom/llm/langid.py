"""Language identification with a string kernel.

The kernel is the blended spectrum of character n-grams (lengths 1 to ``MAX_N``) by presence: each whole text
becomes the set of its hashed n-grams, and k(x, y) = |X and Y| / sqrt(|X| |Y|). A Nystroem map over landmark
documents makes it finite; one-versus-rest kernel ridge regression learns one column for each language.
A batch of texts is scored by two matrix products: presence x landmarks, kernel x weights.

Defined results: a null text, or one without any letter, is ``und`` with score 0; so is every text if there is
nothing to learn from. Ties between languages go to the first in alphabetical order. Rows that repeat count and
are answered each by itself; other columns, of any name, are never read and are kept by the filter. An empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symloom.llm.common import LOWER, UPPER, char_classes, codes, prepare, remainder, sample_per_class, texts_of

MAX_N = 3
BITS = 14
#: Bound of the learning sample: this many documents of each language.
PER_LANGUAGE = 400
#: Landmarks over all languages together, spread evenly; at least 4 of each.
LANDMARKS = 256
#: Scores below this count as a rejection in a filter.
REJECT = 0.3
_SHARP = 6.0
_MIX = np.uint32(2654435761)


def presence(text: str, out: np.ndarray) -> bool:
    """Sets in ``out`` (2**BITS zeros) the buckets of the text's n-grams; False if it has no letter.

    Letters are lower-cased, every run of other characters counts as one blank.
    """
    c = codes(text.lower())
    kind = char_classes()[c]
    letter = (kind == LOWER) | (kind == UPPER)
    if not letter.any():
        return False
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    c = np.where(letter, c, np.uint32(32))[keep]
    c = np.concatenate(([np.uint32(32)], c, [np.uint32(32)])).astype(np.uint32)
    shift = np.uint32(32 - BITS)
    h = c * np.uint32(40503) + np.uint32(1)
    out[(h * _MIX) >> shift] = 1
    for n in range(2, MAX_N + 1):
        h = h[:-1] * np.uint32(16777619) ^ c[n - 1 :]
        out[((h + np.uint32(n)) * _MIX) >> shift] = 1
    return True


@dataclass
class Model:
    langs: list[str]
    landmarks: np.ndarray  # 2**BITS x m, presence over its root length
    weights: np.ndarray  # m x langs

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability-like scores of presence rows ``x``."""
        n = np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))
        s = ((x @ self.landmarks) / n) @ self.weights
        e = np.exp(_SHARP * (s - s.max(1, keepdims=True)))
        return e / e.sum(1, keepdims=True)

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        best, score = ["und"] * len(texts), [0.0] * len(texts)
        for at in range(0, len(texts), 128):
            block = texts[at : at + 128]
            x = np.zeros((len(block), 1 << BITS), np.float32)
            ok = [presence(t, x[i]) for i, t in enumerate(block)]
            p = self.scores(x)
            top = p.argmax(1)
            for i, good in enumerate(ok):
                if good:
                    best[at + i], score[at + i] = self.langs[top[i]], float(p[i, top[i]])
        return best, score


def solve(bits: np.ndarray, y: list[str], ridge: float = 1e-2) -> Model:
    """Nystroem kernel ridge regression on bit sets (uint8 rows) with languages ``y``, in a fixed order.

    Sets are unpacked 256 at a time, so the driver holds kernel rows and landmarks only.
    """

    def unit(some: np.ndarray) -> np.ndarray:
        x = np.unpackbits(some, axis=1).astype(np.float32)
        x /= np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))
        return x

    langs = sorted(set(y))
    of = np.array([langs.index(v) for v in y])
    per = max(4, LANDMARKS // len(langs))
    marks = np.concatenate([np.flatnonzero(of == k)[:per] for k in range(len(langs))])
    lm = np.ascontiguousarray(unit(bits[marks]).T)
    kn = np.concatenate([unit(bits[a : a + 256]) @ lm for a in range(0, len(bits), 256)]).astype(np.float64)
    val, vec = np.linalg.eigh(kn[marks])
    good = val > 1e-6 * val.max()
    root = vec[:, good] / np.sqrt(val[good])
    z = kn @ root
    target = np.where(of[:, None] == np.arange(len(langs)), 1.0, -1.0)
    w = 1.0 / np.bincount(of, minlength=len(langs))[of]  # every language weighs the same
    a = (z * w[:, None]).T @ z + ridge * np.eye(z.shape[1]) / len(langs)
    return Model(langs, lm, (root @ np.linalg.solve(a, (z * w[:, None]).T @ target)).astype(np.float32))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, langs, packed = b.column("doc_id").to_pylist(), b.column("lang").to_pylist(), []
        for t in texts_of(b):
            x = np.zeros(1 << BITS, np.uint8)
            packed.append(np.packbits(x).tobytes() if presence(t, x) else None)
        yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "lang": pa.array(langs, pa.string()), "bits": pa.array(packed, pa.binary())})


def fit(docs: DataFrame) -> Model | None:
    """Learns from ``text`` and ``lang`` of documents whose crc32 remainder isn't 1, at most PER_LANGUAGE of each language.

    The driver gets ids and bit sets of 2 kB for that sample, whatever the texts' length. None if there is nothing.
    """
    prepare(docs.sparkSession)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").where(remainder(F.col("doc_id")) != 1)
    ids = [r[0] for r in sample_per_class(base.where(F.col("text").isNotNull()), "lang", PER_LANGUAGE).select("doc_id").distinct().collect()]
    if not ids:
        return None
    some = base.where(F.col("lang").isNotNull()).join(F.broadcast(docs.sparkSession.createDataFrame([(i,) for i in ids], "doc_id long")), "doc_id")
    rows = some.mapInArrow(_packed, "doc_id long, lang string, bits binary").dropna().groupBy("doc_id", "lang").agg(F.min("bits").alias("bits")).collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r["lang"], r["doc_id"]))
    return solve(np.stack([np.frombuffer(r["bits"], np.uint8) for r in rows]), [r["lang"] for r in rows])


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of ``docs``."""
    prepare(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            lang, score = m.predict(texts_of(b)) if m else (["und"] * len(b), [0.0] * len(b))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(remainder(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def keep(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows whose text has a recognised language: neither ``und`` nor scored below REJECT. All columns stay."""
    prepare(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            lang, score = m.predict(texts_of(b)) if m else (["und"] * len(b), [0.0] * len(b))
            yield b.filter(pa.array([k != "und" and s >= REJECT for k, s in zip(lang, score)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
