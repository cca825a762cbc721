"""What the corpus operators share: the shared folder, cut lineage, size-checked joins, worker set-up."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.storage import drop_at_exit, fresh_path, shared_dir
from symloom.storage import stored as materialize

__all__ = ["drop_at_exit", "fresh_path", "materialize", "shared_dir"]

#: A side of at most this many bytes is broadcast; a larger one is shuffled. Bytes are counted rows times the bytes that
#: a row takes in a hashed relation: its key and its row (8 for each column, strings and binaries besides, rounded up to
#: 8, and 8 of null bits), and 32 for the map's entry.
BROADCAST_BYTES = 32 << 20
#: Rows of text that one Arrow batch carries to a Python worker.
BATCH_ROWS = 512
#: Bytes of such a batch, so that very long texts come a few at a time.
BATCH_BYTES = 32 << 20


def prepare(spark: SparkSession) -> None:
    """Small Arrow batches, and this package on the workers' path where the environment doesn't put it there."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    root = str(Path(__file__).resolve().parents[2])
    sc = spark.sparkContext
    if root in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(sc, "_symloom_shipped", False):
        return
    at = Path(tempfile.mkdtemp(prefix="symloom-code-")) / "symloom.zip"
    with zipfile.ZipFile(at, "w") as z:
        for p in Path(root, "symloom").rglob("*.py"):
            z.write(p, p.relative_to(root))
    sc.addPyFile(str(at))
    sc._symloom_shipped = True


def remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def small(side: DataFrame, row_bytes: int, rows: int | None = None) -> DataFrame:
    """``side`` with a broadcast hint if its counted rows fit ``BROADCAST_BYTES``; else as it is, to be shuffled."""
    rows = side.count() if rows is None else rows
    return F.broadcast(side) if rows * row_bytes <= BROADCAST_BYTES else side


def sample_per_class(rows: DataFrame, label: str, per_class: int) -> DataFrame:
    """At most ``per_class`` ids of each value of ``label``, those with the smallest hash: (doc_id, label).

    Rows are counted for each label; the counts give a limit of the hash that lets a little more than ``per_class``
    through, and only what is below it is made distinct, put in order and cut. Where too few ids come through (ids that
    repeat often), the limit is raised and the pass is made again. So no task sees more than the sample of a label.
    """
    from pyspark.sql import Window

    spark = rows.sparkSession
    rows = rows.select("doc_id", label).where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}
    if not counts:
        return rows.limit(0)
    unit = F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / float(1 << 53)
    limits = {k: min(1.0, (per_class + 8 * per_class**0.5 + 64) / n) for k, n in counts.items()}
    while True:
        most = spark.createDataFrame([(k, x) for k, x in limits.items()], rows.select(F.col(label).alias("_label"), F.lit(0.0).alias("_most")).schema)
        below = rows.join(F.broadcast(most), rows[label] == F.col("_label")).where(unit <= F.col("_most")).select("doc_id", label).distinct()  # a row for each label
        below = materialize(below, "sample")
        got = {r[0]: r[1] for r in below.groupBy(label).count().collect()}
        again = [k for k, x in limits.items() if x < 1 and got.get(k, 0) < per_class]
        if not again:
            break
        limits |= {k: min(1.0, 4 * limits[k]) for k in again}
    order = Window.partitionBy(label).orderBy(F.shiftrightunsigned(F.xxhash64("doc_id"), 11), "doc_id")
    return below.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= per_class).drop("_n")


_classes: np.ndarray | None = None

LOWER, UPPER, DIGIT, SPACE, PUNCT, SYMBOL, OTHER = range(7)


def char_classes() -> np.ndarray:
    """Class of every code point, as one table of 1.1 MB that is made once in a process."""
    global _classes
    if _classes is None:
        import unicodedata

        kinds = {"Lu": UPPER, "Lt": UPPER, "Nd": DIGIT, "Zs": SPACE, "Zl": SPACE, "Zp": SPACE}
        table = np.full(0x110000, OTHER, np.uint8)
        table[0x20000:0x323B0] = LOWER  # ideographs
        for i in range(0x20000):
            c = unicodedata.category(chr(i))
            table[i] = kinds.get(c) if c in kinds else LOWER if c[0] == "L" else PUNCT if c[0] == "P" else SYMBOL if c[0] == "S" else OTHER
        for i in (9, 10, 11, 12, 13):
            table[i] = SPACE
        for c in "#$%&*|@^~<>+=\\":
            table[ord(c)] = SYMBOL
        _classes = table
    return _classes


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """Whole texts of a batch; null becomes empty."""
    return ["" if t is None else t for t in batch.column(name).to_pylist()]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(c: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every maximal run of characters ``c`` that are ``inside``, in order."""
    if not inside.any():
        return np.zeros(0, np.uint64)
    starts = np.flatnonzero(inside & np.concatenate(([True], ~inside[:-1])))
    at = np.flatnonzero(inside)
    first = np.searchsorted(at, starts)
    place = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
    x = c[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + place.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return mix(np.add.reduceat((x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB), first))
