"""Packing token sequences into length buckets with the least padding.

A document's length is its number of tokens (maximal runs of non-blanks, or a column the caller names); documents
above ``max_len`` are cut into pieces of that length, so the global histogram of piece lengths has at most
``max_len`` bars. Dynamic programming over it finds the ``buckets`` upper bounds for which padding every piece to its
bucket's bound wastes least (ties: the smaller bounds). Inside a bucket, batches hold as many padded pieces as the
token budget allows; all but the last are full. A bucket's order is that of (doc_id, piece, n_tokens) at every size.
Positions in it come from ranks inside ranges of doc_id plus the ranges' offsets, so a bucket that holds most rows is
still numbered by many tasks; where the ranges are cut changes no position.

Pieces that agree in (doc_id, piece, n_tokens) are counted before they are ordered and spread out again after, so an id
that a third of all rows repeat is a few rows in its range.

Defined results: documents without a token (also null texts) have one row of 0 tokens with no bucket, batch or slot.
Rows that repeat are packed each by itself, next to one another. With fewer distinct lengths than buckets, every
length is a bucket. Null ids come first. There is about one range for SHARD_ROWS pieces; all pieces of one id are in one
range. Only doc_id and text are read; other columns, of any name, don't matter. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symloom.llm.common import materialize, small

BUCKETS = 8
MAX_LEN = 4096
TOKEN_BUDGET = 65_536
SHARD_ROWS = 200_000
TOKEN = r"[^ \t\n\r\f\x0B]+"


def tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("long")


def bounds(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """The upper bounds with the least padding; ``lengths`` ascending and distinct."""
    n = len(lengths)
    k = min(buckets, n)
    if not k:
        return []
    c = np.concatenate(([0], np.cumsum(np.array(counts, np.int64))))
    ends = np.array([0, *lengths], np.int64)
    # padding = sum of bound x count less all tokens, which no choice changes
    best = np.full(n + 1, np.iinfo(np.int64).max // 4)
    best[0] = 0
    back = []
    for _ in range(k):
        now, come = np.full(n + 1, np.iinfo(np.int64).max // 4), np.zeros(n + 1, np.int64)
        for j in range(1, n + 1):
            cost = best[:j] + ends[j] * (c[j] - c[:j])
            come[j] = i = int(cost.argmin())
            now[j] = cost[i]
        best = now
        back.append(come)
    out, j = [], n
    for come in reversed(back):
        out.append(int(ends[j]))
        j = int(come[j])
    return out[::-1]


def _range(lens: DataFrame, ranges: int) -> Column:
    """The number of the range of ids that a row is in; ascending with doc_id, nulls first. Ids of documents cut them evenly."""
    cuts = lens.where("n > 0").approxQuantile("doc_id", [i / ranges for i in range(1, ranges)], 0.1 / ranges) if ranges > 1 else []
    cuts = sorted({min(int(c), (1 << 63) - 1) for c in cuts})
    if not cuts:
        return F.lit(0)
    at = F.array(*(F.lit(c).cast("long") for c in cuts))
    return F.coalesce(F.size(F.filter(at, lambda c: c < F.col("doc_id"))), F.lit(0))


def pack(docs: DataFrame, buckets: int = BUCKETS, max_len: int = MAX_LEN, budget: int = TOKEN_BUDGET, length: Column | None = None) -> DataFrame:
    """doc_id, piece, n_tokens, bucket, bucket_len, batch, slot: a row for each piece of each document."""
    n = tokens(F.col("text")) if length is None else length.cast("long")
    lens = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), n.alias("n")), "lengths")
    pieces = lens.select("doc_id", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.col("n") - 1) / max_len)).cast("int"))).alias("piece"), "n")
    pieces = pieces.select("doc_id", "piece", F.least(F.lit(max_len), F.col("n") - F.col("piece") * max_len).cast("long").alias("n_tokens"))
    hist = pieces.where("n_tokens > 0").groupBy("n_tokens").count().orderBy("n_tokens").collect()
    ends = bounds([r[0] for r in hist], [r[1] for r in hist], buckets)
    shards = max(1, -(-sum(r[1] for r in hist) // SHARD_ROWS))
    bucket, bound = F.lit(1), F.lit(None).cast("long")
    for e in ends[:-1]:
        bucket = bucket + (F.col("n_tokens") > e).cast("int")
    for e in reversed(ends):
        bound = F.when(F.col("n_tokens") <= e, F.lit(e).cast("long")).otherwise(bound)
    equal = pieces.where("n_tokens > 0").groupBy("doc_id", "piece", "n_tokens").agg(F.count("*").alias("rows"))
    full = equal.select("*", bucket.alias("bucket"), bound.alias("bucket_len"), _range(lens, shards).alias("shard"))
    full = materialize(full, "pieces")  # read twice
    counted = full.groupBy("bucket", "shard").agg(F.sum("rows").alias("rows"))
    order = Window.partitionBy("bucket").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    before = counted.select("bucket", "shard", F.coalesce(F.sum("rows").over(order), F.lit(0)).alias("before"))
    inside = Window.partitionBy("bucket", "shard").orderBy("doc_id", "piece", "n_tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = full.withColumn("to", F.sum("rows").over(inside)).join(small(before, 112, shards * max(1, len(ends))), ["bucket", "shard"])
    last = F.col("before") + F.col("to") - 1
    at, size = F.col("at"), F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("bucket_len")))
    placed = placed.withColumn("at", F.explode(F.sequence(last - F.col("rows") + 1, last)))
    out = placed.select("doc_id", "piece", "n_tokens", "bucket", "bucket_len", F.floor(at / size).cast("long").alias("batch"), F.pmod(at, size).cast("long").alias("slot"))
    none = pieces.where("n_tokens <= 0").select("doc_id", "piece", F.lit(0).cast("long").alias("n_tokens"), *(F.lit(None).cast(t).alias(c) for c, t in (("bucket", "int"), ("bucket_len", "long"), ("batch", "long"), ("slot", "long"))))
    return out.unionByName(none)


def oracle(buckets: int = BUCKETS, max_len: int = MAX_LEN, budget: int = TOKEN_BUDGET) -> str:
    """DuckDB SQL for ``pack`` over ``documents``: the same recurrence, one CTE a bucket."""
    steps = ["f1 AS MATERIALIZED (SELECT i AS j, l * c AS cost, [l] AS ends FROM h)"]
    for k in range(2, buckets + 1):
        steps.append(
            f"f{k} AS MATERIALIZED (SELECT h.i AS j, f.cost + h.l * (h.c - g.c) AS cost, list_append(f.ends, h.l) AS ends"
            f" FROM h JOIN f{k - 1} f ON f.j < h.i JOIN h g ON g.i = f.j"
            " QUALIFY row_number() OVER (PARTITION BY h.i ORDER BY f.cost + h.l * (h.c - g.c), f.j) = 1)"
        )
    last = " UNION ALL ".join(f"SELECT {k} AS k, ends FROM f{k} WHERE j = (SELECT max(i) FROM h)" for k in range(1, buckets + 1))
    return rf"""
WITH d AS (SELECT doc_id, CAST(coalesce(len(regexp_extract_all(text, '[^ \t\n\r\f\x0B]+')), 0) AS BIGINT) AS n FROM documents),
p AS (SELECT doc_id, CAST(i AS INTEGER) AS piece, CAST(least({max_len}, n - i * {max_len}) AS BIGINT) AS n_tokens
      FROM (SELECT doc_id, n, unnest(range(0, greatest(0, (n - 1) // {max_len}) + 1)) AS i FROM d)),
h AS MATERIALIZED (SELECT row_number() OVER (ORDER BY n_tokens) AS i, n_tokens AS l, CAST(sum(count(*)) OVER (ORDER BY n_tokens) AS BIGINT) AS c
      FROM p WHERE n_tokens > 0 GROUP BY n_tokens),
{", ".join(steps)},
e AS (SELECT ends FROM ({last}) ORDER BY k DESC LIMIT 1),
b AS (SELECT p.*, CAST(1 + len(list_filter(ends, lambda x: x < n_tokens)) AS INTEGER) AS bucket,
      CAST(list_filter(ends, lambda x: x >= n_tokens)[1] AS BIGINT) AS bucket_len FROM p, e WHERE n_tokens > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY doc_id NULLS FIRST, piece, n_tokens) - 1 AS pos, greatest(1, {budget} // bucket_len) AS size FROM b)
SELECT doc_id, piece, n_tokens, bucket, bucket_len, CAST(pos // size AS BIGINT) AS batch, CAST(pos % size AS BIGINT) AS slot FROM r
UNION ALL SELECT doc_id, piece, 0, NULL, NULL, NULL, NULL FROM p WHERE n_tokens <= 0"""
