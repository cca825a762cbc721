"""One object for a source tree: index it, ask about it, compare versions (the commands of the tool as methods)."""

from __future__ import annotations

import os
import shutil
import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.operators import diff, digest, graph, query, review
from symloom.schema import ENTITY_SCHEMA, conform
from symloom.sources import extract, git, jsonl


def reindex(sources: DataFrame, old_hashes: DataFrame | None, old_entities: DataFrame | None, old_refs: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, refs, hashes). Files whose hash is unchanged keep their rows, only others are parsed again."""
    hashes = sources.select("file", F.sha2("text", 256).alias("hash"))
    if old_hashes is None:
        return extract.entities(sources), extract.references(sources), hashes
    same = hashes.join(old_hashes, ["file", "hash"], "left_semi").select("file")
    changed = sources.join(same, "file", "left_anti")
    e = extract.entities(changed).unionByName(conform(old_entities.join(same, "file", "left_semi"), ENTITY_SCHEMA))
    return e, extract.references(changed).unionByName(old_refs.join(same, "file", "left_semi")), hashes


class Project:
    """A tree at ``root`` with its store below ``root``/.symloom (Parquet)."""

    def __init__(self, spark: SparkSession, root: str, store: str | None = None):
        self.spark, self.root = spark, root
        self.store = store or os.path.join(root, ".symloom")

    def _at(self, name: str) -> str:
        return os.path.join(self.store, name)

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self._at(name))

    def indexed(self) -> bool:
        return os.path.exists(self._at("entities/_SUCCESS"))

    def index(self, rank: bool = True) -> None:
        """Extracts what changed, ranks files and fills the blast of every entity; each table is replaced as a whole."""
        sources = extract.discover(self.spark, self.root, extract.ignore_lines(self.root))
        old = [self._read(n) for n in ("hashes", "entities", "refs")] if self.indexed() else [None] * 3
        e, r, h = reindex(sources, *old)
        stage = {"entities": e, "refs": r, "hashes": h}
        for name, df in stage.items():
            df.write.mode("overwrite").parquet(self._at(name + ".new"))
        e, r = self._read("entities.new"), self._read("refs.new")
        if rank:
            graph.apply_blast(e, graph.blast(e, r)).write.mode("overwrite").parquet(self._at("blasted.new"))
            graph.pagerank(e, r).write.mode("overwrite").parquet(self._at("rank.new"))
        for name in (*stage, "rank"):
            made = self._at("blasted.new" if name == "entities" and rank else name + ".new")
            if os.path.exists(made):
                shutil.rmtree(self._at(name), ignore_errors=True)
                os.rename(made, self._at(name))
            elif name == "rank":
                shutil.rmtree(self._at(name), ignore_errors=True)  # it would be that of another index
        jsonl.register(*self.tables(), self.ranks())

    def tables(self) -> tuple[DataFrame, DataFrame]:
        """(entities, refs); a tree that wasn't indexed is indexed first, unless SYMLOOM_AUTO_INDEX is 0."""
        if not self.indexed():
            if os.environ.get("SYMLOOM_AUTO_INDEX") == "0":
                raise ValueError(f"{self.root} isn't indexed")
            self.index()
        return self._read("entities"), self._read("refs")

    def ranks(self) -> DataFrame:
        from symloom.schema import RANK_SCHEMA, empty

        return self._read("rank") if os.path.exists(self._at("rank")) else empty(self.spark, RANK_SCHEMA)

    # point queries: the defaults are those of the commands

    def callers(self, name: str, kind: str | None = None, limit: int = 0) -> DataFrame:
        return query.callers(self.tables()[1], name, kind, limit)

    def callees(self, name: str, kind: str | None = None, limit: int = 0) -> DataFrame:
        return query.callees(self.tables()[1], name, kind, limit)

    def symbols(self, file: str, kind: str | None = None, limit: int = 0, depth: int = 0) -> DataFrame:
        return query.file_symbols(self.tables()[0], file, kind, limit, depth)

    def children(self, file: str, parent: str, kind: str | None = None, limit: int = 0) -> DataFrame:
        return query.children(self.tables()[0], file, parent, kind, limit)

    def search(self, q: str, scope: str = "symbol", kind: str | None = None, prefix: str | None = None, limit: int = 20) -> DataFrame:
        return query.search(self.tables()[0], q, scope, kind, prefix, limit)

    def explore(self, prefix: str | None = None, max_entries: int = 200) -> tuple[DataFrame, DataFrame]:
        e = self.tables()[0]
        dirs = query.dir_overview(e, prefix)
        return dirs, query.files_capped(e, prefix, query.explore_cap(max_entries, dirs.count()))

    def outline(self, prefix: str | None = None) -> DataFrame:
        return query.outline(self.tables()[0], prefix)

    def where(self, symbol: str, include_tests: bool = False) -> DataFrame:
        return query.where(self.tables()[0], symbol, include_tests)

    def suggest(self, q: str, limit: int = 5) -> DataFrame:
        return query.suggest(self.tables()[0], q, limit)

    def sql(self, statement: str) -> DataFrame:
        jsonl.register(*self.tables(), self.ranks())
        return query.sql(self.spark, statement)

    def duplicates(self, min_lines: int = 3, max_group: int = 0) -> DataFrame:
        return graph.duplicates(self.tables()[0], min_lines, max_group)

    def blast(self, symbol: str, depth: int = 10) -> tuple[DataFrame, DataFrame]:
        e, r = self.tables()
        return digest.blast_candidates(e, symbol), digest.ranked_callers(r, self.ranks(), symbol, depth)

    def context(self, symbol: str, budget: int = 1500, depth: int = 10) -> dict | None:
        """M2-M5 as a bundle of rows within the token budget; None if the symbol isn't found."""
        import json

        e, r = self.tables()
        found = digest.resolve(e, symbol).limit(5).collect()
        if not found:
            return None
        chosen = found[0]
        rows = lambda df: [x.asDict(True) for x in df.collect()]
        bundle = {
            "chosen": chosen.asDict(True), "alternatives": [x.asDict(True) for x in found[1:]], "callers": rows(digest.context_callers(r, chosen["name"], depth=depth)),
            "callees": rows(digest.context_callees(r, chosen["name"], False, depth)), "types": rows(digest.context_callees(r, chosen["name"], True, depth)),
            "overrides": rows(digest.overrides(e, chosen["name"], chosen["parent"])) if chosen["parent"] and chosen["kind"] in ("method", "function", "fn") else [],
        }
        return digest.trim(bundle, budget, lambda b: (len(json.dumps(b, default=str).encode()) + 3) // 4)

    def map(self, budget: int = 4000, depth: int = 5, focus: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
        """M6-M9: (files within the budget, their entities, subsystems)."""
        e, r = self.tables()
        files = digest.map_files(e, self.ranks(), focus)
        top = digest.map_entities(e, focus, depth=depth)
        line = F.octet_length(F.coalesce("sig", "name")) + 16
        size = top.groupBy("file").agg(F.sum(line).alias("bytes"))
        sized = files.join(size, "file", "left").withColumn("bytes", F.coalesce("bytes", F.lit(0)) + F.octet_length("file") + 16)
        shown = digest.pack(sized, F.floor((F.col("bytes") + 3) / 4), [F.desc("score"), "file"], budget)
        return shown, top.join(shown.select("file"), "file", "left_semi"), digest.subsystems(graph.communities(e, r), shown)

    def cochange(self, commits: int = 500, min_support: int = 2, max_files: int = 30) -> DataFrame:
        return graph.cochange_pairs(git.log(self.spark, self.root, commits), min_support, max_files)

    def _versions(self, spec: str) -> tuple[DataFrame, DataFrame]:
        """(file, text) of the changed files of known languages at both ends."""
        base, head = (git.resolve(self.root, x) for x in git.parse_spec(spec))
        files = [(r["file"], r["status"]) for r in git.changes(self.spark, self.root, base, head).collect() if not r["file"].startswith(".symloom/")]
        known = [(f, s) for f, s in files if extract.language_of(f)]
        return git.blobs(self.spark, self.root, base, [f for f, s in known if s != "A"]), git.blobs(self.spark, self.root, head, [f for f, s in known if s != "D"])

    def diff(self, spec: str, context: int | None = None) -> DataFrame:
        """Classified changes between two refs, with text changes; only changed files are parsed."""
        return diff_sources(*self._versions(spec), context)

    def review(self, spec: str) -> tuple[DataFrame, DataFrame]:
        """(changes by impact, co-change misses)."""
        changes = self.diff(spec)
        touched = changes.select("file").union(changes.select(F.col("old_file").alias("file")).where("file is not null")).distinct()
        return review.enrich(diff.visible(changes), self.ranks(), self.tables()[0]), review.cochange_misses(touched, self.cochange())

    def benchmark(self, spec: str = "HEAD~1", symbol: str | None = None, most: int = 100, first: int = 20) -> tuple[list[dict], float | None]:
        """Tokens of reading everything (control) against the digest (treatment) for a review, one symbol's context
        and an overview, and the median of their ratios; a control that can't be had is null and doesn't count.

        The symbol is that of M13 unless one is given; its control are the first ``most`` files that define or use it,
        the overview's the first ``first`` files by rank.
        """
        from symloom.plans import report

        e, r = self.tables()
        size = lambda text: (len(text.encode()) + 3) // 4
        out = []
        try:
            changes, misses = self.review(spec)
            patch = git.patch(self.root, spec)
            told = report.review_markdown(report.review_document(changes, review.file_deltas(changes), misses, spec))
            out.append({"name": f"review of {spec}", "control": size(patch), "treatment": size(told)})
        except subprocess.CalledProcessError:
            out.append({"name": f"review of {spec}", "control": None, "treatment": 0})
        hot = digest.hot_symbol(e).first()
        symbol = symbol or (hot and hot["name"])

        def read(files: list[str]) -> int:
            n = 0
            for f in files:
                at = os.path.join(self.root, f)
                n += os.path.getsize(at) if os.path.exists(at) else 0
            return (n + 3) // 4

        if symbol:
            bundle = self.context(symbol)
            own = r.where(query.names_match(F.col("name"), symbol)).select("file").union(e.where(F.col("name") == symbol).select("file")).distinct().orderBy("file").limit(most)
            out.append({"name": f"context of {symbol}", "control": read([x["file"] for x in own.collect()]), "treatment": size(report.context_markdown(bundle)) if bundle else 0})
        top = digest.map_files(e, self.ranks()).limit(first)
        from symloom.plans import render

        out.append({"name": "overview", "control": read([x["file"] for x in top.collect()]), "treatment": size(render.map_markdown(*self.map(2000)))})
        pairs = self.spark.createDataFrame([(x["control"] and float(x["control"]), float(x["treatment"])) for x in out], "control double, treatment double")
        return out, digest.median_ratio(pairs).first()[0]

    def write_map(self, path: str | None = None, **options: object) -> str:
        """K4: the map as a Markdown file; its path."""
        from symloom.plans import render

        path = path or os.path.join(self.root, "SYMLOOM_MAP.md")
        with open(path, "w", encoding="utf-8") as f:
            f.write(render.map_markdown(*self.map(**options)) + "\n")
        return path


def diff_sources(old: DataFrame, new: DataFrame, context: int | None = None) -> DataFrame:
    """S15, S16, V1-V18 over (file, text) of two versions."""
    changes = diff.classify(diff.match(extract.entities(old), extract.entities(new)))
    return diff.token_changes(diff.with_text_changes(changes, old, new, context))


def diff_files(spark: SparkSession, old: str, new: str, context: int | None = None) -> DataFrame:
    """Two files on disk as versions of one, under the new one's path; they must be of one known language."""
    kinds = [extract.language_of(p) for p in (old, new)]
    if None in kinds or kinds[0] != kinds[1]:
        raise ValueError(f"can't compare {old} ({kinds[0]}) with {new} ({kinds[1]})")

    def side(path: str) -> DataFrame:
        with open(path, encoding="utf-8") as f:
            return spark.createDataFrame([(new, f.read())], "file string, text string")

    return diff_sources(side(old), side(new), context)


def diff_texts(spark: SparkSession, old: str, new: str, path: str = "input.json") -> DataFrame:
    """Two texts in memory, as versions of one file."""
    side = lambda t: spark.createDataFrame([(path, t)], "file string, text string")
    return diff_sources(side(old), side(new))


def index_text(spark: SparkSession, text: str, path: str = "input.json") -> DataFrame:
    """S16"""
    return extract.entities(spark.createDataFrame([(path, text)], "file string, text string"))
