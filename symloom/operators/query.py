"""Point queries over the two relations (Q1-Q21). ``E`` is entities, ``R`` refs; limit 0 means all.

Filters are plain predicates, so they reach the Parquet scan; a limit over an order becomes a bounded top-k. Orders
are total: ``seq`` breaks ties.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from symloom.functions import scalars as S


def _limited(df: DataFrame, order: list[Column | str], limit: int) -> DataFrame:
    df = df.orderBy(*order)
    return df.limit(limit) if limit else df


def _kind(kind: str | None) -> Column:
    return F.lit(True) if kind is None else F.col("kind") == kind


def _prefix(prefix: str | None) -> Column:
    return F.lit(True) if not prefix else F.col("file").startswith(prefix)


def names_match(column: Column, name: str) -> Column:
    """Equal, or ending with ``::name`` where the name has no ``::`` itself. Wildcards are literal."""
    return (column == name) if "::" in name else (column == name) | column.endswith("::" + name)


def callers(R: DataFrame, name: str, kind: str | None = None, limit: int = 0) -> DataFrame:
    """Q1"""
    return _limited(R.where(names_match(F.col("name"), name) & _kind(kind)), ["file", "line", "seq"], limit)


def callees(R: DataFrame, caller: str, kind: str | None = None, limit: int = 0) -> DataFrame:
    """Q2: a null caller never matches, and there is no tail rule."""
    return _limited(R.where((F.col("caller") == caller) & _kind(kind)), ["file", "line", "seq"], limit)


def file_symbols(E: DataFrame, file: str, kind: str | None = None, limit: int = 0, depth: int = 0) -> DataFrame:
    """Q3; depth 1 keeps the top level (Q16)."""
    rows = E.where((F.col("file") == file) & _kind(kind))
    return _limited(rows.where(S.is_top_level(F.col("parent"), F.col("kind"))) if depth == 1 else rows, ["line_start", "seq"], limit)


def children(E: DataFrame, file: str, parent: str, kind: str | None = None, limit: int = 0) -> DataFrame:
    """Q4"""
    return _limited(E.where((F.col("file") == file) & (F.col("parent") == parent) & _kind(kind)), ["line_start", "seq"], limit)


def search_symbols(E: DataFrame, q: str, kind: str | None = None, prefix: str | None = None, limit: int = 0) -> DataFrame:
    """Q5: case-folded substring of the name; an empty needle finds nothing."""
    hit = F.lit(False) if not q else F.lower("name").contains(q.lower())
    return _limited(E.where(hit & _kind(kind) & _prefix(prefix)), ["file", "line_start", "seq"], limit)


def search_files(E: DataFrame, q: str, prefix: str | None = None, limit: int = 0) -> DataFrame:
    """Q6: (path, lang, entity_count) of matching files."""
    hit = F.lit(False) if not q else F.lower("file").contains(q.lower())
    rows = E.where(hit & _prefix(prefix)).groupBy(F.col("file").alias("path")).agg(F.count("*").alias("entity_count"))
    return _limited(rows.select("path", S.lang_for(F.col("path")).alias("lang"), "entity_count"), ["path"], limit)


def scope_of(scope: str) -> str:
    """SC14: an unknown scope means all."""
    return scope if scope in ("symbol", "file") else "all"


def search(E: DataFrame, q: str, scope: str = "symbol", kind: str | None = None, prefix: str | None = None, limit: int = 20) -> DataFrame:
    """Q7: symbols, then files, under one limit: (hit, file, name, entity_kind, line, lang, entity_count)."""
    scope = scope_of(scope)
    none = lambda t: F.lit(None).cast(t)
    s = E.where(F.lit(bool(q)) & F.lower("name").contains(q.lower()) & _kind(kind) & _prefix(prefix)).select(
        F.lit(0).alias("ord"), F.lit("symbol").alias("hit"), "file", "name", F.col("kind").alias("entity_kind"), F.col("line_start").alias("line"), none("string").alias("lang"), none("long").alias("entity_count"), "seq"
    )
    f = search_files(E, q, prefix).select(
        F.lit(1).alias("ord"), F.lit("file").alias("hit"), F.col("path").alias("file"), none("string").alias("name"), none("string").alias("entity_kind"), none("long").alias("line"), "lang", "entity_count", none("long").alias("seq")
    )
    rows = s if scope == "symbol" else f if scope == "file" else s.unionByName(f)
    return _limited(rows, ["ord", "file", F.asc_nulls_first("line"), F.asc_nulls_first("seq")], limit).drop("ord", "seq")


def dedupe_hits(hits: DataFrame) -> DataFrame:
    """Q8: the first row of each (file, name, kind) and how many there were, in order of first sight."""
    key = Window.partitionBy("file", "name", "kind")
    n = F.row_number().over(key.orderBy("line_start", "seq"))
    return hits.withColumns({"n": n, "overloads": F.count("*").over(key)}).where("n = 1").drop("n").orderBy("file", "line_start", "seq")


def dir_overview(E: DataFrame, prefix: str | None = None) -> DataFrame:
    """Q9: (dir, file_count, langs) over distinct files."""
    files = E.where(_prefix(prefix)).select("file").distinct()
    return files.groupBy(S.parent_dir(F.col("file")).alias("dir")).agg(F.count("*").alias("file_count"), F.array_sort(F.collect_set(S.lang_for(F.col("file")))).alias("langs")).orderBy("dir")


def files_capped(E: DataFrame, prefix: str | None = None, cap: int = 0) -> DataFrame:
    """Q10: the first ``cap`` files of each directory by name, with their entities; cap 0 keeps all."""
    files = E.where(_prefix(prefix)).groupBy("file").agg(F.count("*").alias("entity_count")).withColumn("dir", S.parent_dir(F.col("file")))
    if cap:
        n = F.row_number().over(Window.partitionBy("dir").orderBy("file"))
        files = files.withColumn("n", n).where(F.col("n") <= cap).drop("n")
    return files.select("dir", "file", S.lang_for(F.col("file")).alias("lang"), "entity_count").orderBy("dir", "file")


def explore_cap(max_entries: int, dirs: int) -> int:
    """Q11"""
    return max(1, max_entries // max(1, dirs))


def projects() -> list[str]:
    """Q12: there is one, without a name."""
    return [""]


def counts(E: DataFrame, R: DataFrame) -> DataFrame:
    """Q13"""
    return E.agg(F.count("*").alias("entities")).crossJoin(R.agg(F.count("*").alias("refs")))  # one row each


def files(E: DataFrame) -> DataFrame:
    """Q14"""
    return E.select("file").distinct().orderBy("file")


def refs_grouped(R: DataFrame, by: str) -> DataFrame:
    """Q15: counts by file, caller, name or kind; a null caller is ``<top-level>``."""
    if by not in ("file", "caller", "name", "kind"):
        raise ValueError(f"can't group by {by!r}: file, caller, name or kind")
    return R.groupBy(F.coalesce(F.col(by), F.lit("<top-level>")).alias("key")).agg(F.count("*").alias("count")).orderBy("key")


def tail_names(E: DataFrame) -> DataFrame:
    """Q17"""
    return E.select(S.tail_segment(F.col("name")).alias("name"))


def outline(E: DataFrame, prefix: str | None = None) -> DataFrame:
    """Q18: (file, entries) of top-level definitions by line; ``line_end`` is null on one-line entries."""
    e = F.struct(F.col("line_start").alias("line"), "seq", F.when(F.col("line_end") != F.col("line_start"), F.col("line_end")).alias("line_end"), "kind", "name")
    rows = E.where(S.is_top_level(F.col("parent"), F.col("kind")) & _prefix(prefix))
    return rows.groupBy("file").agg(F.array_sort(F.collect_list(e)).alias("entries"), F.count("*").alias("n")).orderBy("file")


def where(E: DataFrame, symbol: str, include_tests: bool = False) -> DataFrame:
    """Q19: definitions whose tail is ``symbol``; one row of each (file, parent, kind), the first, with ``overloads``."""
    rows = E.where((S.tail_segment(F.col("name")) == symbol) & F.col("kind").isin(*S.DEFINITION_KINDS))
    rows = rows if include_tests else rows.where(~S.is_test_path(F.col("file")))
    key = Window.partitionBy("file", "parent", "kind")
    rows = rows.withColumns({"n": F.row_number().over(key.orderBy("line_start", "seq")), "overloads": F.count("*").over(key)}).where("n = 1")
    return rows.select("file", F.lit(symbol).alias("name"), "kind", "parent", F.col("line_start").alias("line"), "line_end", "sig", "visibility", "overloads").orderBy("file", "line", "kind")


def suggest(E: DataFrame, q: str, limit: int = 5) -> DataFrame:
    """Q20: near names by edit distance of the lower-cased tails, at most max(2, half the needle's bytes)."""
    low = q.lower()
    tails = E.select(S.tail_segment(F.col("name")).alias("name")).distinct().where((F.col("name") != "") & (F.lower("name") != low))
    d = F.levenshtein(F.lower("name"), F.lit(low))
    return _limited(tails.withColumn("distance", d).where(F.col("distance") <= max(2, len(low.encode()) // 2)), ["distance", "name"], limit)


_READS = ("select", "with", "from", "values", "table", "describe", "show", "explain")


def sql(spark: SparkSession, statement: str) -> DataFrame:
    """Q21: any query over the views ``entities``, ``refs``, ``rank``, ``blast``; statements that change things are refused."""
    head = statement.lstrip(" \t\r\n(").split(None, 1)
    if not head or head[0].lower() not in _READS:
        raise ValueError("only queries are allowed")
    return spark.sql(statement)


def backend(name: str | None) -> str:
    """Q22: there is one engine; an unknown choice is still an error."""
    if name not in (None, "", "auto", "memory", "db"):
        raise ValueError(f"unknown backend {name!r}")
    return "spark"


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
