"""Version control as tables (S10-S14): the log, changed files and blobs, through Python data sources.

Each source splits its work by commit or path, so blobs are read by many tasks. The executors need the repository at
the same path.
"""

from __future__ import annotations

import subprocess
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def _git(repo: str, *args: str) -> bytes:
    return subprocess.run(["git", "-C", repo, *args], check=True, capture_output=True).stdout


def resolve(repo: str, ref: str) -> str:
    """S14"""
    return _git(repo, "rev-parse", "--verify", f"{ref}^{{commit}}").decode().strip()


def patch(repo: str, spec: str) -> str:
    """The textual patch with its statistics, as a reader would get it."""
    return _git(repo, "diff", "--stat", "--patch", *([spec] if ".." in spec else [spec, "HEAD"])).decode("utf-8", "replace")


def parse_spec(spec: str) -> tuple[str, str]:
    """``a...b`` and ``a..b``; one ref is compared with HEAD."""
    for dots in ("...", ".."):
        a, found, b = spec.partition(dots)
        if found:
            return a or "HEAD", b or "HEAD"
    return spec, "HEAD"


def parse_log(text: str) -> Iterator[tuple[str, str]]:
    """(commit, file) of lines after a ``---<sha>`` marker."""
    commit = None
    for line in text.splitlines():
        line = line.strip()
        if line.startswith("---"):
            commit = line[3:]
        elif line and commit is not None:
            yield commit, line


class _Part(InputPartition):
    def __init__(self, items: list):
        self.items = items


class GitSource(DataSource):
    """``spark.read.format("git")`` with options repo, what (log, changes, blobs), and commits, base and head, ref and paths."""

    @classmethod
    def name(cls) -> str:
        return "git"

    def schema(self) -> str:
        return {"log": "commit string, file string", "changes": "file string, status string", "blobs": "ref string, file string, text string"}[self.options.get("what", "log")]

    def reader(self, schema: object) -> DataSourceReader:
        return _Reader(dict(self.options))


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.o = options
        self.what, self.repo = options.get("what", "log"), options["repo"]

    def partitions(self) -> list[InputPartition]:
        if self.what == "blobs":
            paths = self.o.get("paths", "").split("\n")
            return [_Part(paths[i : i + 64]) for i in range(0, len(paths), 64) if any(paths[i : i + 64])]
        return [_Part([None])]

    def read(self, partition: _Part) -> Iterator[tuple]:
        if self.what == "log":
            out = _git(self.repo, "log", f"-n{int(self.o.get('commits', 500))}", "--name-only", "--pretty=---%H", "--no-renames")
            yield from parse_log(out.decode("utf-8", "replace"))
        elif self.what == "changes":
            out = _git(self.repo, "diff", "--no-renames", "--name-status", self.o["base"], self.o["head"]).decode("utf-8", "replace")
            for line in out.splitlines():
                status, _, file = line.partition("\t")
                if status in ("A", "M", "D"):
                    yield file, status
        else:
            for path, data in _blobs(self.repo, self.o["ref"], [p for p in partition.items if p] if partition else []):  # without paths there is no part
                try:
                    yield self.o["ref"], path, data.decode()
                except UnicodeDecodeError:
                    continue


def _blobs(repo: str, ref: str, paths: list[str]) -> Iterator[tuple[str, bytes]]:
    """The contents of the paths that are files at ``ref``, by one process."""
    if not paths:
        return
    ask = "".join(f"{ref}:{p}\n" for p in paths).encode()
    out, at = subprocess.run(["git", "-C", repo, "cat-file", "--batch"], input=ask, check=True, capture_output=True).stdout, 0
    for path in paths:
        end = out.index(b"\n", at)
        head, at = out[at:end].split(b" "), end + 1
        if head[-1].isdigit():  # <id> <type> <size>; else it is missing
            size = int(head[-1])
            if head[-2] == b"blob":
                yield path, out[at : at + size]
            at += size + 1


def log(spark: SparkSession, repo: str, commits: int = 500) -> DataFrame:
    """(commit, file), distinct."""
    spark.dataSource.register(GitSource)
    return spark.read.format("git").options(repo=repo, what="log", commits=commits).load().distinct()


def changes(spark: SparkSession, repo: str, base: str, head: str) -> DataFrame:
    """S12"""
    spark.dataSource.register(GitSource)
    return spark.read.format("git").options(repo=repo, what="changes", base=base, head=head).load()


def blobs(spark: SparkSession, repo: str, ref: str, paths: list[str]) -> DataFrame:
    """(file, text) at a ref."""
    spark.dataSource.register(GitSource)
    return spark.read.format("git").options(repo=repo, what="blobs", ref=ref, paths="\n".join(paths)).load().select("file", "text")


#: Positions of a stored log in a block, blocks in a block of blocks, and so on.
LOG_BLOCK = 100_000
#: Levels of blocks; over three of them any 64-bit position leaves at most 18,448 rows for one task.
LOG_LEVELS = 3


def _above(heads: DataFrame, level: int = 1) -> DataFrame:
    """(block, carried): the last marker of the blocks before each one, from (block, last), a row each.

    Sparse positions make nearly as many blocks as lines, so blocks go into blocks until few are left for one order.
    """
    from pyspark.sql import Window

    before = lambda w: F.last("last", ignorenulls=True).over(w.orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    if level == LOG_LEVELS:
        return heads.select("block", before(Window).alias("carried"))
    heads = heads.withColumn("outer", F.expr(f"block div {LOG_BLOCK}L"))
    tops = heads.groupBy(F.col("outer").alias("block")).agg(F.max_by("last", F.when(F.col("last").isNotNull(), F.col("block"))).alias("last"))
    tops = _above(tops, level + 1).select(F.col("block").alias("outer"), F.col("carried").alias("start"))
    inner = heads.select("outer", "block", before(Window.partitionBy("outer")).alias("inner"))
    return inner.join(tops, "outer").select("block", F.coalesce("inner", "start").alias("carried"))


def log_lines(lines: DataFrame) -> DataFrame:
    """S11 over a stored log (value, position): each line belongs to the last marker above it.

    The marker is looked for inside a block of positions; what a block starts with comes from the last marker of the
    blocks before it.
    """
    from pyspark.sql import Window

    rows = lines.select("position", F.trim("value").alias("value"), F.expr(f"position div {LOG_BLOCK}L").alias("block"))
    rows = rows.withColumn("marker", F.when(F.col("value").startswith("---"), F.substring("value", 4, 1 << 20)))
    heads = rows.groupBy("block").agg(F.max_by("marker", F.when(F.col("marker").isNotNull(), F.col("position"))).alias("last"))
    above = F.last("marker", ignorenulls=True).over(Window.partitionBy("block").orderBy("position").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("above", above).join(_above(heads), "block").withColumn("commit", F.coalesce("above", "carried"))
    return rows.where("value <> '' and marker is null and commit is not null").select("commit", F.col("value").alias("file")).distinct()
