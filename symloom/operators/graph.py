"""Graph analytics over references.

Edges come from one equi-join on the name; partial sums combine before the shuffle. PageRank goes through the names and
never expands file pairs; label propagation needs them and is one grouped function, since its updates are sequential
by definition.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symloom.functions import scalars as S
from symloom.schema import IMPORT_KINDS
from symloom.storage import stored


def name_index(E: DataFrame) -> DataFrame:
    """G1: (name, file), distinct; imports count as well."""
    return E.select("name", "file").distinct()


def file_edges(E: DataFrame, R: DataFrame, units: int = 0) -> DataFrame:
    """(src, dst, w). A reference spreads 1/N over the N other files that define its name. With ``units`` weights are
    whole numbers of 1 / units, which add up exactly in any order.

    Equal references collapse to (src, name, count) before they meet the index, so a name that a third of all rows use
    is one row a file.
    """
    uses = R.groupBy(F.col("file").alias("src"), "name").agg(F.count("*").alias("uses"))
    index = name_index(E)
    owners = index.groupBy("name").agg(F.count("*").alias("owners"))
    own = index.select("name", F.col("file").alias("src"), F.lit(1).alias("own"))
    n = uses.join(owners, "name").join(own, ["name", "src"], "left").withColumn("n", F.col("owners") - F.coalesce("own", F.lit(0))).where("n > 0")
    edges = n.select("name", "src", (F.col("uses") / F.col("n")).alias("share")).join(index.withColumnRenamed("file", "dst"), "name").where("src <> dst")
    share = F.rint(F.col("share") * F.lit(float(units))).cast("long") if units else F.col("share")
    return edges.groupBy("src", "dst").agg(F.sum(share).alias("w"))


def undirected_edges(E: DataFrame, R: DataFrame, units: int = 0) -> DataFrame:
    """(lo, hi, w): both directions summed."""
    return file_edges(E, R, units).groupBy(F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi")).agg(F.sum("w").alias("w"))


def nodes(E: DataFrame, R: DataFrame) -> DataFrame:
    return E.select("file").union(R.select("file")).distinct()


#: Rows of the bipartite graph that one task may iterate over, about 40 bytes each.
COMPACT_ROWS = 4_000_000
#: Ranks are whole numbers of this unit, so sums are exact and don't depend on the order or the number of tasks.
UNIT = float(1 << 60)


def bipartite(E: DataFrame, R: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The file graph through name nodes: (src, name, share, own) and (name, dst).

    A file gives each name that others define the share of its references that name it; the name passes it on to each
    owner but the file itself, ``share`` being divided by their number already. ``own`` says that the file is an owner.
    So a name that m files use and n define is m + n rows, not m x n edges.
    """
    uses = R.groupBy(F.col("file").alias("src"), "name").agg(F.count("*").alias("uses"))
    index = name_index(E)
    owners = index.groupBy("name").agg(F.count("*").alias("owners"))
    own = index.select("name", F.col("file").alias("src"), F.lit(True).alias("own"))
    n = uses.join(owners, "name").join(own, ["name", "src"], "left").withColumn("own", F.coalesce("own", F.lit(False)))
    n = n.withColumn("n", F.col("owners") - F.col("own").cast("long")).where("n > 0")
    total = n.groupBy("src").agg(F.sum("uses").alias("total"))  # each reference spreads 1
    out = n.join(total, "src").select("src", "name", (F.col("uses") / (F.col("n") * F.col("total"))).alias("share"), "own")
    return out, index.select("name", F.col("file").alias("dst"))


def pagerank(E: DataFrame, R: DataFrame, damping: float = 0.85, rounds: int = 50, tolerance: float = 1e-6, compact_rows: int = COMPACT_ROWS) -> DataFrame:
    """(file, rank). The mass of files without outgoing edges is shared by all and damped.

    Convergence is looked at after every round; ``tolerance`` 0 runs all rounds. Up to ``compact_rows`` rows of the
    bipartite graph one task runs them; beyond that the loop is distributed and each round is written to the shared
    folder. Ranks are exact multiples of 1 / UNIT, so both ways give the same numbers.
    """
    out, index = bipartite(E, R)
    out, index, files = stored(out, "shares"), stored(index, "owners"), stored(nodes(E, R), "files")
    n = files.count()
    if not n:
        return files.select("file", F.lit(None).cast("double").alias("rank"))
    if out.count() + index.count() + n <= compact_rows:
        return _pagerank_compact(out, index, files, damping, rounds, tolerance)
    return _pagerank_loop(out, index, files, n, damping, rounds, tolerance)


def _pagerank_compact(out: DataFrame, index: DataFrame, files: DataFrame, damping: float, rounds: int, tolerance: float) -> DataFrame:
    import numpy as np

    def add(at: np.ndarray, x: np.ndarray, size: int) -> np.ndarray:
        sums = np.zeros(size, np.int64)
        np.add.at(sums, at, x)
        return sums

    def run(g: pd.DataFrame) -> pd.DataFrame:
        side = g["side"].to_numpy()
        names = np.sort(g.loc[side == 0, "file"].to_numpy(dtype=object))
        n = len(names)
        words, word = np.unique(g.loc[side > 0, "name"].to_numpy(dtype=object).astype(str), return_inverse=True)
        up = side[side > 0] == 1
        file = np.searchsorted(names, g.loc[side > 0, "file"].to_numpy(dtype=object))
        src, via, dst, of = file[up], word[up], file[~up], word[~up]
        share, own = g.loc[side == 1, "share"].to_numpy(dtype=float), g.loc[side == 1, "own"].to_numpy(dtype=bool)
        linked = np.zeros(n, bool)
        linked[src] = True
        rank = np.full(n, int(UNIT) // n, np.int64)
        for _ in range(rounds):
            given = np.rint(rank[src] * share).astype(np.int64)
            flow = add(dst, add(via, given, len(words))[of], n) - add(src[own], given[own], n)
            new = np.rint((1 - damping) * UNIT / n + damping * (flow + rank[~linked].sum() / n)).astype(np.int64)
            delta, rank = int(np.abs(new - rank).sum()), new
            if delta / UNIT < tolerance:
                break
        return pd.DataFrame({"file": names, "rank": rank / UNIT})

    none = lambda t: F.lit(None).cast(t)
    rows = files.select(F.lit(0).alias("side"), "file", none("string").alias("name"), none("double").alias("share"), none("boolean").alias("own"))
    rows = rows.unionByName(out.select(F.lit(1).alias("side"), F.col("src").alias("file"), "name", "share", "own"))
    rows = rows.unionByName(index.select(F.lit(2).alias("side"), F.col("dst").alias("file"), "name", none("double").alias("share"), none("boolean").alias("own")))
    return rows.groupBy(F.lit(0).alias("one")).applyInPandas(run, "file string, rank double")


def _pagerank_loop(out: DataFrame, index: DataFrame, files: DataFrame, n: int, damping: float, rounds: int, tolerance: float) -> DataFrame:
    heads = out.select(F.col("src").alias("file")).distinct().withColumn("linked", F.lit(True))
    rank = stored(files.join(heads, "file", "left").select("file", F.coalesce("linked", F.lit(False)).alias("linked"), F.lit(int(UNIT) // n).alias("rank")), "rank")
    for _ in range(rounds):
        lost = rank.agg(F.coalesce(F.sum(F.when(~F.col("linked"), F.col("rank"))), F.lit(0)).alias("lost"))
        given = out.join(rank.select(F.col("file").alias("src"), "rank"), "src").select("src", "name", "own", F.rint(F.col("rank") * F.col("share")).cast("long").alias("x"))
        come = given.groupBy("name").agg(F.sum("x").alias("x")).join(index, "name").select(F.col("dst").alias("file"), "x")
        back = given.where("own").select(F.col("src").alias("file"), (-F.col("x")).alias("x"))
        flow = come.unionByName(back).groupBy("file").agg(F.sum("x").alias("flow"))
        new = rank.withColumnRenamed("rank", "old").join(flow, "file", "left").crossJoin(F.broadcast(lost))  # lost is one row
        new = new.select("file", "linked", F.rint(F.lit((1 - damping) * UNIT / n) + damping * (F.coalesce("flow", F.lit(0)) + F.col("lost") / F.lit(float(n)))).cast("long").alias("rank"), "old")
        new = stored(new, "rank")
        rank = new.drop("old")
        if tolerance and new.agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0] / UNIT < tolerance:
            break
    return rank.select("file", (F.col("rank") / F.lit(UNIT)).alias("rank"))


def blast_direct(E: DataFrame, R: DataFrame) -> DataFrame:
    """(name, direct_callers, direct_files) of every defined name; exact names only."""
    n = R.groupBy("name").agg(F.count("*").alias("direct_callers"), F.count_distinct("file").alias("direct_files"))
    zero = F.lit(0).cast("long")
    return E.select("name").distinct().join(n, "name", "left").select("name", F.coalesce("direct_callers", zero).alias("direct_callers"), F.coalesce("direct_files", zero).alias("direct_files"))


def blast_transitive(E: DataFrame, R: DataFrame, depth: int = 3) -> DataFrame:
    """(name, transitive_callers): distinct callers within ``depth`` hops, the name itself never counted.

    Names get numbers, and what reaches a name is kept in blocks of 64 callers, a bit each: (at, block, bits). A hop joins
    the calls with their callers' blocks and combines them by bitwise OR, before the shuffle as well. A row holds up to
    64 pairs and never less than one, so dense neighbourhoods cost 1/64 of their pairs and sparse ones no more than them.
    """
    pairs = R.where("caller is not null").select("name", "caller").distinct()
    names = E.select("name").union(pairs.select("name")).union(pairs.select("caller")).distinct()
    ids = stored(names.repartitionByRange("name").sortWithinPartitions("name").withColumn("id", F.monotonically_increasing_id()), "names")
    to = lambda c, new: ids.select(F.col("name").alias(c), F.col("id").alias(new))
    calls = stored(pairs.join(to("name", "at"), "name").join(to("caller", "by"), "caller").select("at", "by"), "calls")
    one = lambda c: F.expr(f"shiftleft(1L, cast({c} & 63 as int))")
    direct = calls.select("at", F.shiftright("by", 6).alias("block"), one("`by`").alias("bits")).groupBy("at", "block").agg(F.bit_or("bits").alias("bits"))
    direct = reach = stored(direct, "hop") if depth else direct.where("false")
    for _ in range(depth - 1):
        further = calls.join(reach.withColumnRenamed("at", "by"), "by").select("at", "block", "bits")
        reach = stored(further.unionByName(direct).groupBy("at", "block").agg(F.bit_or("bits").alias("bits")), "hop")
    others = F.when(F.shiftright("at", 6) == F.col("block"), F.col("bits").bitwiseAND(F.bitwise_not(one("at")))).otherwise(F.col("bits"))
    n = reach.groupBy("at").agg(F.sum(F.bit_count(others)).alias("transitive_callers"))
    seeds = E.select("name").distinct().join(ids, "name").join(n.withColumnRenamed("at", "id"), "id", "left")
    return seeds.select("name", F.coalesce("transitive_callers", F.lit(0)).cast("long").alias("transitive_callers"))


def blast(E: DataFrame, R: DataFrame, depth: int = 3) -> DataFrame:
    """G4 and G5 by name."""
    return blast_direct(E, R).join(blast_transitive(E, R, depth), "name")


def apply_blast(E: DataFrame, blasts: DataFrame) -> DataFrame:
    """``blast_radius`` filled; it depends on the name alone."""
    b = blasts.select("name", F.struct("direct_callers", "direct_files", "transitive_callers").alias("_b"))
    return E.join(b, "name", "left").withColumn("blast_radius", F.coalesce("_b", "blast_radius") if "blast_radius" in E.columns else F.col("_b")).drop("_b").select(*E.columns, *([] if "blast_radius" in E.columns else ["blast_radius"]))


def communities(E: DataFrame, R: DataFrame, rounds: int = 30) -> DataFrame:
    """(file, community). Labels change in place in the order of names, so one task runs the file graph. Weights are
    exact, so ties between labels (the smaller one wins) don't depend on the order of sums."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        names = sorted(g.loc[g["hi"].isna(), "lo"])
        at = {f: i for i, f in enumerate(names)}
        near: list[dict[int, int]] = [{} for _ in names]
        for lo, hi, w in g.loc[g["hi"].notna(), ["lo", "hi", "w"]].sort_values(["lo", "hi"]).itertuples(index=False):
            near[at[lo]][at[hi]] = near[at[hi]][at[lo]] = w
        label = list(range(len(names)))
        for _ in range(rounds):
            changed = False
            for i, around in enumerate(near):
                if not around:
                    continue
                weight: dict[int, int] = {}
                for j in sorted(around):
                    weight[label[j]] = weight.get(label[j], 0) + around[j]
                best = min(weight, key=lambda k: (-weight[k], k))
                if best != label[i]:
                    label[i], changed = best, True
            if not changed:
                break
        compact: dict[int, int] = {}
        return pd.DataFrame({"file": names, "community": [compact.setdefault(x, len(compact)) for x in label]})

    edges = undirected_edges(E, R, 1 << 32).select("lo", "hi", "w")
    rows = edges.unionByName(nodes(E, R).select(F.col("file").alias("lo"), F.lit(None).cast("string").alias("hi"), F.lit(0).cast("long").alias("w")))
    return rows.groupBy(F.lit(0).alias("one")).applyInPandas(run, "file string, community long")


def kept_commits(commits: DataFrame, max_files: int = 30) -> DataFrame:
    """(commit, file), distinct, of commits that touch at most ``max_files`` files."""
    rows = commits.select("commit", "file").distinct()
    small = rows.groupBy("commit").agg(F.count("*").alias("n")).where(F.col("n") <= max_files).select("commit")
    return rows.join(small, "commit", "left_semi")


def cochange_pairs(commits: DataFrame, min_support: int = 2, max_files: int = 30) -> DataFrame:
    """(a, b, weight, support); the filter on a commit's files bounds its pairs by max_files^2 / 2."""
    rows = kept_commits(commits, max_files)
    counts = rows.groupBy("file").agg(F.count("*").alias("n"))
    lists = rows.groupBy("commit").agg(F.array_sort(F.collect_list("file")).alias("files"))
    pairs = lists.select(F.posexplode("files").alias("i", "a"), "files").select("a", F.explode(F.slice("files", F.col("i") + 2, F.size("files"))).alias("b"))
    support = pairs.groupBy("a", "b").agg(F.count("*").alias("support")).where(F.col("support") >= min_support)
    na, nb = counts.select(F.col("file").alias("a"), F.col("n").alias("na")), counts.select(F.col("file").alias("b"), F.col("n").alias("nb"))
    out = support.join(na, "a").join(nb, "b")
    return out.select("a", "b", (F.col("support") / F.sqrt(F.col("na").cast("double") * F.col("nb"))).alias("weight"), "support").orderBy(F.desc("weight"), "a", "b")


def partners(pairs: DataFrame, file: str) -> DataFrame:
    """(partner, weight, support) of one file, strongest first."""
    other = F.when(F.col("a") == file, F.col("b")).otherwise(F.col("a"))
    return pairs.where((F.col("a") == file) | (F.col("b") == file)).select(other.alias("partner"), "weight", "support").orderBy(F.desc("weight"), "partner")


def duplicates(E: DataFrame, min_lines: int = 3, max_group: int = 0) -> DataFrame:
    """Members of groups of equal bodies, a row each: (body_hash, size, lines, file, line_start, line_end, name, kind,
    parent, seq), largest groups first; ``lines`` is that of the group's first member.

    Sizes and first members are combinable, so a body that a third of all rows share is never gathered in one place.
    """
    rows = E.where(~F.col("kind").isin(*IMPORT_KINDS) & F.col("body_hash").isNotNull() & (S.body_length(F.col("line_start"), F.col("line_end")) >= min_lines))
    n = rows.groupBy("body_hash").agg(F.count("*").alias("size"), F.min(F.struct("file", "line_start", "seq", "line_end")).alias("first")).where("size > 1")
    n = n.where(F.col("size") <= max_group) if max_group else n
    n = n.select("body_hash", "size", S.body_length(F.col("first.line_start"), F.col("first.line_end")).alias("lines"), "first")
    out = rows.select("body_hash", "file", "line_start", "line_end", "name", "kind", "parent", "seq").join(n, "body_hash")
    out = out.orderBy(F.desc("size"), F.desc("lines"), "first", "file", "line_start", "seq")
    return out.select("body_hash", "size", "lines", "file", "line_start", "line_end", "name", "kind", "parent", "seq")


def duplicates_totals(E: DataFrame, min_lines: int = 3, max_group: int = 0) -> DataFrame:
    """(scanned, groups, total_clones); scanned counts all entities."""
    rows = E.where(~F.col("kind").isin(*IMPORT_KINDS) & F.col("body_hash").isNotNull() & (S.body_length(F.col("line_start"), F.col("line_end")) >= min_lines))
    n = rows.groupBy("body_hash").agg(F.count("*").alias("size")).where("size > 1")
    n = n.where(F.col("size") <= max_group) if max_group else n
    totals = n.agg(F.count("*").alias("groups"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_clones"))
    return E.agg(F.count("*").alias("scanned")).crossJoin(totals)  # one row each
