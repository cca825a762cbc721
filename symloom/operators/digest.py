"""Ranked and budgeted digests."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symloom.functions import scalars as S
from symloom.operators.query import names_match
from symloom.schema import IMPORT_KINDS

_METHODS = ("method", "function", "fn")


def _direct_files() -> Column:
    return F.coalesce(F.col("blast_radius.direct_files"), F.lit(0))


def _definitions(E: DataFrame, include_tests: bool) -> DataFrame:
    rows = E.where(~F.col("kind").isin(*IMPORT_KINDS))
    return rows if include_tests else rows.where(~S.is_test_path(F.col("file")))


def resolve(E: DataFrame, symbol: str, include_tests: bool = True) -> DataFrame:
    """M2: definitions for ``name``, ``Parent::name``, ``file::name`` or ``file::Parent::name``, most used first."""
    parts = symbol.split("::")
    rows = _definitions(E, include_tests).where(F.col("name") == parts[-1])
    rest = parts[:-1]
    if rest and ("/" in rest[0] or "." in rest[0]):
        rows = rows.where((F.col("file") == rest[0]) | F.col("file").endswith(rest[0]))
        rest = rest[1:]
    if rest:
        rows = rows.where(F.col("parent") == "::".join(rest))
    return rows.orderBy(_direct_files().desc(), "line_start", "file", "seq")


def blast_candidates(E: DataFrame, symbol: str, include_tests: bool = False, alternatives: int = 4) -> DataFrame:
    """M1: the definition with the most using files and up to four others; ``place`` 0 is the chosen one."""
    rows = _definitions(E, include_tests).where(F.col("name") == symbol)
    n = F.row_number().over(Window.partitionBy("name").orderBy(_direct_files().desc(), "file", "line_start", "seq"))
    return rows.withColumn("place", n - 1).where(F.col("place") <= alternatives)


def ranked_callers(R: DataFrame, ranks: DataFrame, symbol: str, depth: int = 10) -> DataFrame:
    """M1: callers, one of each (file, line), by the rank of their file; ``skipped`` counts those beyond ``depth``."""
    one = F.row_number().over(Window.partitionBy("file", "line").orderBy("seq"))
    rows = R.where(names_match(F.col("name"), symbol)).withColumn("n", one).where("n = 1").drop("n")
    rows = rows.join(ranks, "file", "left").withColumn("rank", F.coalesce("rank", F.lit(0.0)))
    all_ = rows.agg(F.count("*").alias("total"))
    kept = rows.orderBy(F.desc("rank"), "file", "line")
    kept = kept.limit(depth) if depth else kept
    skipped = F.greatest(F.lit(0).cast("long"), F.col("total") - depth) if depth else F.lit(0).cast("long")
    return kept.crossJoin(F.broadcast(all_)).withColumn("skipped", skipped).drop("total")  # total is one row


def context_callers(R: DataFrame, name: str, include_tests: bool = False, depth: int = 10) -> DataFrame:
    """M3: the first ``depth`` callers in file order, one of each (file, line)."""
    one = F.row_number().over(Window.partitionBy("file", "line").orderBy("seq"))
    rows = R.where(names_match(F.col("name"), name)).withColumn("n", one).where("n = 1").drop("n")
    rows = rows if include_tests else rows.where(~S.is_test_path(F.col("file")))
    rows = rows.orderBy("file", "line")
    return rows.limit(depth) if depth else rows


def context_callees(R: DataFrame, name: str, types: bool, depth: int = 10) -> DataFrame:
    """M3: what ``name`` uses: related types or other callees; the test filter doesn't apply."""
    one = F.row_number().over(Window.partitionBy("file", "line", "name").orderBy("seq"))
    is_type = F.col("kind") == "type_annotation"
    rows = R.where(F.col("caller") == name).withColumn("n", one).where("n = 1").drop("n").where(is_type if types else ~is_type)
    rows = rows.orderBy("file", "line", "name")
    return rows.limit(depth) if depth else rows


def overrides(E: DataFrame, name: str, parent: str, limit: int = 5) -> DataFrame:
    """M4: methods of the same tail in other parents, one of each (file, parent)."""
    rows = E.where(F.col("kind").isin(*_METHODS) & F.col("parent").isNotNull() & (F.col("parent") != parent))
    rows = rows.where(S.tail_segment(F.col("name")) == S.tail_segment(F.lit(name)))
    one = F.row_number().over(Window.partitionBy("file", "parent").orderBy("line_start", "seq"))
    return rows.withColumn("n", one).where("n = 1").drop("n").orderBy("file", "line_start", "seq").limit(limit)


def trim(bundle: dict, budget: int, tokens: Callable[[dict], int]) -> dict:
    """M5: while the rendered bundle is above the budget, alternatives go first, then types, callees, callers (one stays)."""
    bundle = {k: list(v) if isinstance(v, list) else v for k, v in bundle.items()}
    for key, least in (("alternatives", 0), ("types", 0), ("callees", 0), ("callers", 1)):
        while tokens(bundle) > budget and len(bundle.get(key, ())) > least:
            bundle[key].pop()
            bundle[f"{key}_skipped"] = bundle.get(f"{key}_skipped", 0) + 1
    return bundle


def map_files(E: DataFrame, ranks: DataFrame, focus: str | None = None, boost: float = 2.0) -> DataFrame:
    """M6: (file, score), best first; ties by name."""
    times = F.when(F.col("file").startswith(focus), max(1.0, boost)).otherwise(1.0) if focus else F.lit(1.0)
    rows = E.select("file").distinct().join(ranks, "file", "left")
    return rows.select("file", (F.coalesce("rank", F.lit(0.0)) * times).alias("score")).orderBy(F.desc("score"), "file")


def map_entities(E: DataFrame, focus: str | None = None, boost: float = 2.0, depth: int = 5) -> DataFrame:
    """M7: the ``depth`` best entities of each file."""
    v = F.col("visibility")
    visible = F.when(v.isin("public", "pub"), 1.5).when(v.isin("pub(crate)", "crate"), 1.2).otherwise(1.0)
    times = F.when(F.col("file").startswith(focus), max(1.0, boost)).otherwise(1.0) if focus else F.lit(1.0)
    b = F.col("blast_radius")
    score = F.when(b.isNull(), 0.0).otherwise((F.log(b["direct_files"] + 1.0) * 10 + b["direct_callers"]) * visible * times)
    rows = E.where(~F.col("kind").isin(*IMPORT_KINDS)).withColumn("score", score)
    n = F.row_number().over(Window.partitionBy("file").orderBy(F.round("score", 9).desc(), "line_start", "seq"))
    return rows.withColumn("place", n).where(F.col("place") <= depth)


def pack(rows: DataFrame, tokens: Column, order: list[Column | str], budget: int = 4000, start: int = 100) -> DataFrame:
    """M8: the longest prefix that fits the budget; the first row always does.

    A row of at least one token takes one from the budget, so only the top ``budget`` such rows can be in the prefix: a
    bounded top-k comes before the running sum. Rows without tokens aren't bounded that way and are all looked at.
    """
    rows = rows.withColumn("_t", F.coalesce(tokens.cast("long"), F.lit(0)))
    top = rows.where("_t > 0").orderBy(*order).limit(max(1, budget - start + 1))
    w = Window.orderBy(*order)
    running = top.unionByName(rows.where("_t <= 0")).withColumns({"total": F.sum("_t").over(w.rowsBetween(Window.unboundedPreceding, 0)) + start, "place": F.row_number().over(w)})
    return running.where((F.col("total") <= budget) | (F.col("place") == 1)).drop("_t")


def subsystems(communities: DataFrame, shown: DataFrame, top: int = 5) -> DataFrame:
    """Shown files by community: (community, file_count, top files by score, label).

    The label is the directory that all files share, which is what the first and the last directory share; one file is
    labelled by its directory or itself, files without a common directory as cross-cutting. Only ``top`` rows of a
    community are gathered.
    """
    rows = shown.join(communities, "file").withColumn("dir", S.parent_dir(F.col("file")))
    n = F.row_number().over(Window.partitionBy("community").orderBy(F.desc("score"), "file"))
    best = rows.withColumn("n", n).where(F.col("n") <= top).groupBy("community").agg(F.array_sort(F.collect_list(F.struct("n", "file"))).alias("best"))
    parts = F.split("dir", "/")
    g = rows.groupBy("community").agg(F.count("*").alias("file_count"), F.min(parts).alias("lo"), F.max(parts).alias("hi"), F.min("dir").alias("dir"), F.min("file").alias("file"))
    same = F.size(F.filter(F.sequence(F.lit(1), F.size("lo")), lambda i: F.slice("lo", 1, i) == F.slice("hi", 1, i)))
    shared = F.array_join(F.slice("lo", F.lit(1), same), "/")
    label = F.when(F.col("file_count") == 1, F.when(F.col("dir") == "", F.col("file")).otherwise(F.col("dir"))).otherwise(F.when(shared == "", "cross-cutting").otherwise(shared))
    return g.join(best, "community").select("community", "file_count", F.transform("best", lambda x: x["file"]).alias("top"), label.alias("label"))


_encoders: dict[tuple[str, str], object] = {}


def _encoder(ranks_path: str, pattern: str):
    """One encoder of a rank file in a process."""
    if (ranks_path, pattern) not in _encoders:
        import base64

        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[ranks_path, pattern] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encoders[ranks_path, pattern]


def bpe_tokens(texts: DataFrame, column: str, ranks_path: str, pattern: str) -> DataFrame:
    """``tokens`` by byte-level BPE over a rank file (base64 token, rank); null counts as empty."""

    @F.pandas_udf("long")
    def count(s: pd.Series) -> pd.Series:
        e = _encoder(ranks_path, pattern)
        return s.fillna("").map(lambda t: len(e.encode_ordinary(t)))

    return texts.withColumn("tokens", count(F.col(column)))


def median_ratio(pairs: DataFrame) -> DataFrame:
    """The median of control / treatment over pairs whose control wasn't skipped."""
    return pairs.where(F.col("control").isNotNull() & (F.col("treatment") > 0)).agg(F.percentile(F.col("control") / F.col("treatment"), F.lit(0.5)).alias("median_ratio"))


def hot_symbol(E: DataFrame) -> DataFrame:
    """The definition with the most using files; the last of equals."""
    return E.where(~F.col("kind").isin(*IMPORT_KINDS)).orderBy(_direct_files().desc(), F.desc("file"), F.desc("line_start"), F.desc("seq")).limit(1)
