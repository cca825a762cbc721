"""Near-duplicate classes of documents by banded DartMinHash signatures.

A text is the multiset of its adjacent word pairs (words lower-cased, without punctuation; a single word is its own
pair), weighted by count. Its 64 keys each hash ``ROWS`` of 256 signature coordinates; a coordinate serves in two keys, once
with its neighbours and once across. Two texts that share a key are candidates: with similarity s that happens with a
probability of about 1 - (1 - s**8)**64, which is 0.98 at 0.7, 0.9999 at 0.8, 0.004 at 0.3 and 1e-6 at 0.1. A candidate
pair is a link if the similarity that the whole signatures estimate is SIMILARITY or more (256 coordinates, standard
error 0.03). Classes are the connected components of all links; nothing is capped.

A signature is kept as one byte a coordinate, of which the keys are made too. Copies of a text collapse first (a
combinable minimum). The members of a key come sorted to one task, which compares every pair of them and ties each
member to the smallest one that links lead to, so pairs aren't written. A key with more than PART members is cut into
parts of about that size, and each two of its parts meet in a group of their own: no task holds more than two parts,
and the comparisons, which grow with the square of a key's members, are spread over all tasks. Components come from alternating large-star and small-star steps; both are combinable minima plus a
join, each round is written to the shared folder, and rounds grow with the logarithm of the longest chain.

Defined results: a null text counts as empty; texts without any word are linked only to equal texts. Documents with
a null id take no part (class null, no links). Rows that repeat an id and a text are copies of each other. One id with
several texts is judged by each text. An empty table gives no rows. Only ``doc_id`` and ``text`` are read; other columns, of
any name, don't matter.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symloom.llm.common import DIGIT, OTHER, char_classes, codes, drop_at_exit, fresh_path, materialize, mix, prepare, small, texts_of, word_hashes
from symloom.llm.dartminhash import signatures

BANDS, ROWS = 32, 8  # of neighbouring coordinates; as many again go across
#: Estimated similarity from which a candidate pair is a link.
SIMILARITY = 0.6
#: Rows of key members that are compared together, pairs in one step, and members in one part of a key.
MEMBERS, PAIRS, PART = 8192, 16_384, 4096


def elements(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed word pairs of the whole text, and their counts."""
    c = codes(text.lower())
    kind = char_classes()[c]
    h = word_hashes(c, (kind <= DIGIT) | ((kind == OTHER) & (c > 127)))
    if len(h) > 1:
        h = mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])
    e, n = np.unique(h, return_counts=True)
    return e, n.astype(np.float64)


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 63-bit key for each of 2 x ``bands`` groups of coordinates; the group's number is part of it."""
    s = np.concatenate([sig.reshape(bands, rows), sig.reshape(rows, bands).T])
    key = mix(np.arange(1, 2 * bands + 1).astype(np.uint64))
    for i in range(rows):
        key = mix(key * np.uint64(0xBF58476D1CE4E5B9) + s[:, i])
    return (key >> np.uint64(1)).astype(np.int64)


def text_key() -> Column:
    return F.unhex(F.md5(F.coalesce(F.col("text"), F.lit(""))))


def signed(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, text_key, keys (an empty array for a text without words) and sketch of documents with an id."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sigs = signatures([elements(t) for t in texts_of(b)], bands * rows)
            sketches = [None if s is None else s.astype(np.uint8) for s in sigs]
            keys = [[] if s is None else band_keys(s.astype(np.uint64), bands, rows) for s in sketches]
            made = [pa.array(keys, pa.list_(pa.int64())), pa.array([None if s is None else s.tobytes() for s in sketches], pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_key"), *made], ["doc_id", "text_key", "keys", "sketch"])

    rows_ = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_key().alias("text_key")).where("doc_id is not null")
    return rows_.mapInArrow(run, "doc_id long, text_key binary, keys array<long>, sketch binary")


def compare(key: np.ndarray, group: np.ndarray, part: np.ndarray, apart: np.ndarray, sketch: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``sketch`` (rows of equal ``key`` are neighbours) the first row of its key that links lead to, and
    the number of its links. A pair counts in the first of the keys that it shares, which ``group`` says. Rows that are
    ``apart`` only meet rows of another ``part``."""
    start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    size = np.diff(np.append(start, len(key)))
    first = np.repeat(start, size)
    place, end, root = np.arange(len(key)) - first, first + np.repeat(size, size), np.arange(len(key))
    least, lag, links = SIMILARITY * sketch.shape[1], 1, np.zeros(len(key), np.int64)
    late = np.flatnonzero(place >= lag)
    while len(late):
        meets = late[~apart[late] | (part[late] != part[late - lag])]
        for i in range(0, len(meets), PAIRS):
            b = meets[i : i + PAIRS]
            same = sketch[b] == sketch[b - lag]
            near = same.sum(1) >= least
            b, same = b[near], same[near]
            shared = np.concatenate([same.reshape(-1, bands, rows).all(2), same.reshape(-1, rows, bands).all(1)], 1)
            counts = b[shared.argmax(1) == group[b]]
            links[counts] += 1  # no row comes twice at one distance
            links[counts - lag] += 1
            for y in b[root[b] != root[b - lag]].tolist():
                low, high = sorted((root[y - lag], root[y]))
                own = root[first[y] : end[y]]
                own[own == high] = low
        lag += 1
        late = late[place[late] >= lag]
    return root, links


def linked(members: DataFrame, bands: int, rows: int) -> DataFrame:
    """tid, head, n: the members (key, n, group, tid, sketch) that have links in a key, the smallest member of that key (or of
    two of its parts) which their links lead to, and how many links count there."""
    prepare(members.sparkSession)
    parts = F.ceil(F.col("n") / PART).cast("int")
    split = members.withColumn("part", F.pmod(F.xxhash64("key", "tid"), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    # two parts meet in one cell, and each part meets itself
    split = split.withColumns({"cell": F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other")), "apart": F.col("part") != F.col("other")}).drop("n", "other", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def of(t: pa.Table) -> pa.RecordBatch:
            sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(len(t), -1)
            root, n = compare(*(t.column(c).to_numpy() for c in ("cell", "group", "part", "apart")), sketch, bands, rows)
            at = np.flatnonzero((root != np.arange(len(t))) | (n > 0))
            tid = t.column("tid").to_numpy()
            return pa.RecordBatch.from_arrays([pa.array(tid[at]), pa.array(tid[root[at]]), pa.array(n[at])], ["tid", "head", "n"])

        held, n = [], 0
        for b in batches:
            if not len(b):
                continue
            key = b.column("cell").to_numpy()
            n += len(b)
            held.append(b)
            if n >= MEMBERS and (key[0] != key[-1] or held[:-1] and held[-2].column("cell")[-1].as_py() != key[0]):
                cut = int(np.searchsorted(key, key[-1]))  # the last key may go on
                held[-1] = b.slice(0, cut)
                t = pa.Table.from_batches(held)
                held, n = [b.slice(cut)], len(b) - cut
                yield of(t)
        if held:
            yield of(pa.Table.from_batches(held))

    sorted_ = split.repartition("cell").sortWithinPartitions("cell", "tid")
    return sorted_.mapInArrow(run, "tid long, head long, n long")


def components(edges: DataFrame) -> DataFrame:
    """(node, class) of every node of the undirected edges (a, b): class is the component's smallest node."""
    e = materialize(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("v <> u").distinct(), "edges")
    while True:
        # large star: every larger neighbour of a node goes to the node's smallest neighbour (or itself)
        both = e.unionByName(e.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.min("u").alias("m")).select(F.col("v").alias("c"), F.least("v", "m").alias("m"))
        large = both.join(least, both.v == least.c).where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")).distinct()
        # small star: a node and its smaller neighbours go to the smallest of them
        large = materialize(large, "edges")
        least = large.groupBy("v").agg(F.min("u").alias("m")).select(F.col("v").alias("c"), "m")
        step = large.join(least, large.v == least.c)
        star = step.select(F.col("u").alias("v"), F.col("m").alias("u")).unionByName(step.select("v", F.col("m").alias("u"))).where("v <> u").distinct()
        star = materialize(star, "edges")
        same = F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))
        if (star.agg(F.count("*"), same).first()) == (e.agg(F.count("*"), same).first()):
            break
        e = star
    roots = e.select(F.col("u").alias("v")).distinct()
    return e.select(F.col("v").alias("node"), F.col("u").alias("class")).unionByName(roots.select(F.col("v").alias("node"), F.col("v").alias("class")))


def classes(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """The signed documents (doc_id, text_key) and the texts (text_key, node, copies, class_id, class_key, n_links, n_shared_keys);
    class_id and class_key are the id and text of the class's first document."""
    spark = docs.sparkSession
    path = fresh_path(spark, "signed")
    signed(docs, bands, rows).write.parquet(path)
    drop_at_exit(spark, path)
    s = spark.read.parquet(path)
    # a text goes by a number, so that keys and links move as whole numbers
    texts = s.groupBy("text_key").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies"), F.any_value(F.struct("keys", "sketch")).alias("signed"))
    texts = materialize(texts.select(F.monotonically_increasing_id().alias("tid"), "text_key", "node", "copies", "signed.*"), "texts")
    pairs = texts.select(F.posexplode("keys").alias("group", "key"), "tid")
    shared = pairs.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = materialize(pairs.join(shared, "key"), "members")
    shares = members.groupBy("tid").agg(F.count("*").alias("n_shared_keys"))
    tied = materialize(linked(members.join(texts.select("tid", "sketch"), "tid"), bands, rows), "tied")
    links = tied.groupBy("tid").agg(F.sum("n").alias("n_links"))
    found = components(tied.select(F.col("tid").alias("a"), F.col("head").alias("b"))).select(F.col("node").alias("tid"), F.col("class").alias("component"))
    found = materialize(found.join(texts.select("tid", "node", "text_key"), "tid"), "linked")
    # one id may stand for several texts, so the first of a class is the smallest (id, text)
    first = found.groupBy("component").agg(F.min(F.struct("node", "text_key")).alias("first"))
    found = found.select("tid", "component").join(first, "component").select("tid", F.col("first.node").alias("class_id"), F.col("first.text_key").alias("class_key"))
    out = texts.drop("keys", "sketch").join(shares, "tid", "left").join(links, "tid", "left").join(found, "tid", "left")
    out = out.select("text_key", "node", "copies", F.coalesce("class_id", "node").alias("class_id"), F.coalesce("class_key", "text_key").alias("class_key"), *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_links", "n_shared_keys")))
    return s.select("doc_id", "text_key"), materialize(out, "classes")


def near_duplicates(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row for each document: doc_id, class_id (smallest id of its class), n_links (different texts that its text is
    linked with), n_copies (documents with the same text), n_shared_keys (signature keys that its text shares with others)."""
    s, texts = classes(docs, bands, rows)
    out = s.join(texts, "text_key").select("doc_id", "class_id", "n_links", F.col("copies").alias("n_copies"), "n_shared_keys")
    none = docs.where(F.col("doc_id").isNull()).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies"), F.lit(0).cast("long").alias("n_shared_keys"))
    return out.unionByName(none)


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class, that of the smallest id; rows without an id stay. All columns stay.

    Of rows that repeat the kept id and text, the one stays whose other columns come first as JSON text; the smallest is
    found by a combinable aggregate. Texts aren't shuffled while the list of dropped (id, text) pairs fits a broadcast;
    beyond that the join shuffles. Columns of any name may be there.
    """
    s, texts = classes(docs)
    rows = s.groupBy("doc_id", "text_key").agg(F.count("*").alias("n")).join(texts, "text_key")
    out = (F.col("doc_id") != F.col("class_id")) | (F.col("text_key") != F.col("class_key"))
    rows = materialize(rows.select("doc_id", "text_key", "n", out.alias("out")), "verdicts")
    own = uuid.uuid4().hex
    gone, many = (rows.where(which).select(F.col("doc_id").alias(f"id_{own}"), F.col("text_key").alias(f"key_{own}")) for which in ("out", "not out and n > 1"))

    on = (F.col("doc_id").cast("long") == F.col(f"id_{own}")) & (text_key() == F.col(f"key_{own}"))
    kept = docs.join(small(gone, 112), on, "left_anti")
    n = many.count()
    if not n:
        return kept
    names = [f"`{c.replace('`', '``')}`" for c in docs.columns]
    rest = [c for c in names if c not in ("`doc_id`", "`text`")]
    again = kept.join(small(many, 112, n), on)
    whole, order = F.struct(*(F.col(c) for c in names)), F.to_json(F.struct(*(F.col(c) for c in rest)), {"ignoreNullFields": "false"}) if rest else F.lit("")
    once = again.groupBy(f"id_{own}", f"key_{own}").agg(F.min_by(whole, order).alias(own)).select(f"{own}.*")
    return kept.join(small(many, 112, n), on, "left_anti").unionByName(once)
