"""Comparison of two versions of the entities.

A pass pairs what is left on both sides by a key: of equal keys the old side offers its last row, the new side its
first (by ``seq``), and the join is null-safe. Each pass is written down as it is, so later passes don't repeat it.
Only the fuzzy pass and text comparison leave the JVM, grouped or row by row in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symloom.functions import scalars as S
from symloom.functions import textdiff
from symloom.storage import stored

FUZZY = 0.6
_ENTITY = ("file", "name", "kind", "line_start", "line_end", "parent", "sig", "meta", "body_hash", "sig_hash", "struct_hash", "visibility", "seq")


def _side(rows: DataFrame, key: list[str], last: bool) -> DataFrame:
    """(key columns as _k0.., row): the last or first row of each key; a combinable aggregate, so a frequent key is no hot task."""
    order = F.struct(*(["seq"] if "file" in key else ["file", "seq"]))
    pick = F.max_by if last else F.min_by
    return rows.groupBy(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(key))).agg(pick(F.struct(*_ENTITY), order).alias("row"))


def _pass(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    o, n = _side(old, key, True), _side(new, key, False)
    n = n.select(*(F.col(f"_k{i}").alias(f"_n{i}") for i in range(len(key))), F.col("row").alias("new"))
    on = None
    for i in range(len(key)):
        one = F.col(f"_k{i}").eqNullSafe(F.col(f"_n{i}"))
        on = one if on is None else on & one
    return o.join(n, on).select(F.col("row").alias("old"), "new")


def _left(rows: DataFrame, side: str, *passes: DataFrame) -> DataFrame:
    """What the passes left of one side: one anti-join, however many passes there were."""
    gone = [pairs.select(F.col(f"{side}.file").alias("file"), F.col(f"{side}.seq").alias("seq")) for pairs in passes]
    return rows.join(reduce(DataFrame.unionAll, gone), ["file", "seq"], "left_anti")


def _fuzzy(old: DataFrame, new: DataFrame, least: float) -> DataFrame:
    """V4: one-to-one by name similarity among rows of one file, kind and parent, best pairs first.

    Only groups with rows on both sides are gathered; such a group holds what one parent lost and gained.
    """
    key = ["file", "kind", "parent"]
    both = lambda d, side: d.where("kind <> 'import'").select(*key, F.lit(side).alias("side"), "seq", "name")
    rows = both(old, 0).unionByName(both(new, 1))
    live = rows.groupBy(*key).agg(F.min("side").alias("a"), F.max("side").alias("b")).where("a < b").select(*(F.col(c).alias(f"_{c}") for c in key))
    on = F.col("file").eqNullSafe(F.col("_file")) & F.col("kind").eqNullSafe(F.col("_kind")) & F.col("parent").eqNullSafe(F.col("_parent"))
    rows = rows.join(live, on, "left_semi")

    def run(g: pa.Table) -> pa.Table:
        g = g.sort_by([("side", "ascending"), ("seq", "ascending")])
        seq, name, cut = g["seq"].to_pylist(), g["name"].to_pylist(), g["side"].to_pylist().count(0)
        out = textdiff.best_pairs(name[:cut], name[cut:], least)
        columns = ([g["file"][0].as_py()] * len(out), [seq[i] for i, _, _ in out], [seq[cut + j] for _, j, _ in out], [s for _, _, s in out])
        return pa.table([pa.array(c, kind) for c, kind in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.float64()))], ["file", "old_seq", "new_seq", "confidence"])

    # few bytes may be much to compare, so the tasks aren't merged by bytes
    rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key)
    hit = rows.groupBy(*key).applyInArrow(run, "file string, old_seq long, new_seq long, confidence double")
    o = old.select(F.col("file").alias("_of"), F.col("seq").alias("old_seq"), F.struct(*_ENTITY).alias("old"))
    n = new.select(F.col("file").alias("_nf"), F.col("seq").alias("new_seq"), F.struct(*_ENTITY).alias("new"))
    hit = hit.join(o, (hit.file == o._of) & (hit.old_seq == o.old_seq)).drop("old_seq").join(n, (hit.file == n._nf) & (hit.new_seq == n.new_seq))
    return hit.select("old", "new", "confidence")


def match(old: DataFrame, new: DataFrame, fuzzy: bool = True, least: float = FUZZY) -> DataFrame:
    """V1-V5: (match, old, new, confidence); unchanged entities are left out. ``seq`` is unique in a file and side."""
    old, new = old.select(*_ENTITY), new.select(*_ENTITY)
    found = []
    one = F.lit(1.0)
    exact = stored(_pass(old, new, ["file", "parent", "name"]), "match")
    found.append(exact.where("old.struct_hash <> new.struct_hash").select(F.lit("exact").alias("match"), "old", "new", one.alias("confidence")))
    o, n = _left(old, "old", exact), _left(new, "new", exact)
    moved = stored(_pass(o, n, ["parent", "name"]), "match")
    found.append(moved.select(F.lit("moved").alias("match"), "old", "new", one.alias("confidence")))
    o, n = _left(old, "old", exact, moved), _left(new, "new", exact, moved)
    body = "body_hash is not null and kind <> 'import'"
    renamed = stored(_pass(o.where(body), n.where(body), ["body_hash"]), "match")
    found.append(renamed.select(F.lit("renamed").alias("match"), "old", "new", one.alias("confidence")))
    old, new = stored(_left(old, "old", exact, moved, renamed), "rest"), stored(_left(new, "new", exact, moved, renamed), "rest")
    if fuzzy:
        near = stored(_fuzzy(old, new, least), "match")
        found.append(near.select(F.lit("renamed").alias("match"), "old", "new", "confidence"))
        old, new = _left(old, "old", near), _left(new, "new", near)
    e = F.struct(*_ENTITY)
    none = F.lit(None).cast(exact.schema["old"].dataType)
    found.append(old.select(F.lit("removed").alias("match"), e.alias("old"), none.alias("new"), one.alias("confidence")))
    found.append(new.select(F.lit("added").alias("match"), none.alias("old"), e.alias("new"), one.alias("confidence")))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def _public(side: str) -> Column:
    """V8"""
    return F.col(f"{side}.parent").isNull() & (F.col(f"{side}.kind") != "import")


def classify(matches: DataFrame) -> DataFrame:
    """Change, name, kind, file, old_file, old_name, sig_changed, body_changed, breaking, reason, line, old, new."""
    m = F.col("match")
    sig = ~F.col("old.sig_hash").eqNullSafe(F.col("new.sig_hash"))
    body = ~F.col("old.body_hash").eqNullSafe(F.col("new.body_hash"))
    both = m.isin("exact", "moved") & (sig | body)
    change = F.when(m == "exact", F.when(sig | body, "modified").otherwise("formatting_only")).otherwise(m)
    public = _public("old")
    breaking = F.when(m.isin("removed", "renamed"), public).when(m.isin("exact", "moved"), public & sig).otherwise(False)
    of = lambda c: F.coalesce(F.col(f"new.{c}"), F.col(f"old.{c}"))
    reason = F.when(m == "removed", "public entity removed").when(m == "renamed", "public entity renamed").when(m == "moved", "moved with signature change").otherwise("public signature changed")
    old_file = F.when((m == "moved") | ((m == "renamed") & (F.col("old.file") != F.col("new.file"))), F.col("old.file"))
    return matches.select(
        change.alias("change"), of("name").alias("name"), of("kind").alias("kind"), of("file").alias("file"), old_file.alias("old_file"),
        F.when(m == "renamed", F.col("old.name")).alias("old_name"), F.when(both, sig).alias("sig_changed"), F.when(both, body).alias("body_changed"),
        breaking.alias("breaking"), F.when(breaking, reason).alias("reason"), of("line_start").alias("line"), "old", "new", "confidence",
    )


def summary(diffs: DataFrame) -> DataFrame:
    """V9: one row of counts and whether anything breaks."""
    kinds = ("added", "removed", "modified", "moved", "renamed", "formatting_only")
    return diffs.agg(*(F.count_if(F.col("change") == k).alias(k) for k in kinds), F.coalesce(F.bool_or("breaking"), F.lit(False)).alias("has_breaking"))


def patterns(diffs: DataFrame) -> DataFrame:
    """(change, base, file_count, entity_count) of changes that repeat over two files or more."""
    rows = diffs.where("change <> 'formatting_only'").groupBy("change", S.base_name(F.col("name")).alias("base"))
    return rows.agg(F.count_distinct("file").alias("file_count"), F.count("*").alias("entity_count")).where("file_count >= 2").orderBy(F.desc("file_count"), "change", "base")


def visible(diffs: DataFrame) -> DataFrame:
    """Without derived entities and without JSON parents whose children changed; same-file moves become modified."""
    derived = F.array_contains(F.coalesce("new.meta", F.array()), "derived") | F.array_contains(F.coalesce("old.meta", F.array()), "derived")
    rows = diffs.where(~F.coalesce(derived, F.lit(False)))
    parents = rows.select("file", F.coalesce(F.when(F.col("new").isNotNull(), F.col("new.parent")).otherwise(F.col("old.parent"))).alias("name")).where("name is not null").distinct()
    is_parent = F.col("file").endswith(".json") & F.col("kind").isin("object", "array")
    rows = rows.where(~is_parent).unionByName(rows.where(is_parent).join(parents, ["file", "name"], "left_anti").select(*rows.columns))
    cross = (F.col("change") == "moved") & F.coalesce(F.col("old_file") != F.col("file"), F.lit(False))
    return rows.withColumns({"cross_file_move": cross, "change": F.when((F.col("change") == "moved") & ~cross, "modified").otherwise(F.col("change"))})


def moves(shown: DataFrame) -> DataFrame:
    """Cross-file moves with their confidence."""
    s, b = F.col("sig_changed"), F.col("body_changed")
    sure = F.when(s.isNull() & b.isNull() | (~s & ~b), 1.0).when(s != b, 0.8).otherwise(0.6)
    return shown.where("cross_file_move").select("name", "kind", F.col("old_file").alias("from_file"), F.col("file").alias("to_file"), F.col("old.line_start").alias("from_line"), F.col("new.line_start").alias("to_line"), "breaking", sure.alias("confidence"))


def file_sections(shown: DataFrame) -> DataFrame:
    """Counts by file, without cross-file moves."""
    kinds = ("added", "removed", "modified", "renamed", "formatting_only")
    rows = shown.where("not cross_file_move").groupBy("file")
    return rows.agg(*(F.count_if(F.col("change") == k).alias(k) for k in kinds), F.count_if("breaking").alias("breaking")).orderBy("file")


def breaking_callers(shown: DataFrame, R: DataFrame, limit: int = 100) -> DataFrame:
    """Breaking entries with their first ``limit`` callers: how many are in changed files, and the list of the others
    as (file, line, name).

    Callers match on the name or its ``::`` tail, which is an equi-join on the name as written or on that tail. The
    references are counted by key and file first: those in files behind a key's ``limit``-th reference never move.
    """
    shown = stored(shown.select("name", "kind", "file", "line", "reason", "breaking"), "shown")
    bad = shown.where("breaking").drop("breaking")
    touched = shown.select(F.col("file").alias("caller_file")).distinct().withColumn("in_diff", F.lit(True))
    told = (F.col("file").alias("caller_file"), F.col("line").alias("at"), "seq", F.coalesce("caller", F.lit("")).alias("by"))
    whole = R.select(F.col("name").alias("key"), *told)
    tails = R.where(F.col("name").contains("::")).select(S.qualified_tail(F.col("name")).alias("key"), *told)
    uses = whole.unionByName(tails)
    before = F.coalesce(F.sum("n").over(Window.partitionBy("key").orderBy("caller_file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = uses.groupBy("key", "caller_file").agg(F.count("*").alias("n")).join(bad.select(F.col("name").alias("key")).distinct(), "key", "left_semi")
    first = stored(first.withColumn("before", before).where(F.col("before") < limit).select(F.col("key").alias("_key"), F.col("caller_file").alias("_file")), "callers")
    uses = uses.join(first, (F.col("key") == F.col("_key")) & F.col("caller_file").eqNullSafe(F.col("_file")), "left_semi")
    n = F.row_number().over(Window.partitionBy("key").orderBy("caller_file", "at", "seq"))
    uses = uses.withColumn("n", n).where(F.col("n") <= limit).join(touched, "caller_file", "left").groupBy("key")
    other = F.when(F.col("in_diff").isNull(), F.struct("n", F.col("caller_file").alias("file"), F.col("at").alias("line"), F.col("by").alias("name")))
    uses = uses.agg(F.count_if("in_diff").alias("callers_in_diff"), F.array_sort(F.collect_list(other)).alias("others"))
    out = bad.join(uses, bad.name == uses.key, "left")
    external = F.transform(F.coalesce("others", F.array().cast("array<struct<n:int,file:string,line:bigint,name:string>>")), lambda x: F.struct(x["file"].alias("file"), x["line"].alias("line"), x["name"].alias("name")))
    return out.select("name", "kind", "file", "line", "reason", F.coalesce("callers_in_diff", F.lit(0).cast("long")).alias("callers_in_diff"), F.size(external).cast("long").alias("external_callers"), external.alias("external"))


def groups(shown: DataFrame, pats: DataFrame) -> DataFrame:
    """(by, key, entities, files, label): members of patterns, then the rest by file; formatting drops out only there.

    A pattern is labelled by its name and files, a file by its first three entities.
    """
    rows = shown.where("not cross_file_move").withColumn("base", S.base_name(F.col("name")))
    # a moved row that stays in its file is shown as modified, but its pattern is that of the move
    original = F.when((F.col("change") == "modified") & F.col("old_file").isNotNull(), "moved").otherwise(F.col("change"))
    rows = rows.withColumn("as_change", original).join(pats.select(F.col("change").alias("as_change"), "base", F.lit(True).alias("hit")), ["as_change", "base"], "left")
    a = rows.where("hit").groupBy("as_change", "base").agg(F.count("*").alias("entities"), F.count_distinct("file").alias("files"))
    a = a.select(F.lit("pattern").alias("by"), F.concat_ws(":", "as_change", "base").alias("key"), "entities", "files", F.format_string("%s (pattern across %d files)", "base", "files").alias("label"))
    n = F.row_number().over(Window.partitionBy("file").orderBy("line", "name", "change"))
    b = rows.where("hit is null and change <> 'formatting_only'").withColumn("n", n).groupBy("file")
    b = b.agg(F.count("*").alias("entities"), F.array_sort(F.collect_list(F.when(F.col("n") <= 3, F.struct("n", "name")))).alias("first"))
    names = F.array_join(F.transform("first", lambda x: x["name"]), ", ")
    more = F.when(F.col("entities") > 3, F.format_string(" +%d more", F.col("entities") - 3)).otherwise("")
    b = b.select(F.lit("file").alias("by"), F.col("file").alias("key"), "entities", F.lit(1).cast("long").alias("files"), F.concat(names, more, F.lit(" in "), "file").alias("label"))
    return a.unionByName(b).orderBy(F.desc("entities"), "by", "key")


_LINES = "array<struct<kind: string, text: string>>"


#: Bytes of text whose results are Python objects at a time; a single row may be larger.
PIECE_BYTES = 1 << 20


def _told(rows: list[tuple[str, str]] | None, value: str) -> list[dict] | None:
    return None if rows is None else [{"kind": k, value: t} for k, t in rows]


def _listed(value: str) -> pa.DataType:
    return pa.list_(pa.struct([("kind", pa.string()), (value, pa.string())]))


def _by_pieces(one: Callable[[str | None, str | None], object], a: pa.Array, b: pa.Array, kind: pa.DataType) -> pa.Array:
    """``one`` of each pair of texts. A batch may hold thousands of long texts: only a piece of it is Python objects at a
    time, the rest stays packed."""
    parts, row, size = [], [], 0
    for x, y in zip(a, b):
        x, y = x.as_py(), y.as_py()
        row.append(one(x, y))
        size += len(x or "") + len(y or "")
        if size >= PIECE_BYTES:
            parts.append(pa.array(row, kind))
            row, size = [], 0
    return pa.concat_arrays([*parts, pa.array(row, kind)])


def _with_texts(diffs: DataFrame, old_sources: DataFrame, new_sources: DataFrame) -> DataFrame:
    """Adds the text of both entities as _a and _b, cut out in the JVM; null where a side is missing."""

    def cut(side: str) -> Column:
        lines = F.split(F.regexp_replace(F.col(f"{side}_text"), r"\r?\n$", ""), r"\r?\n")
        start = F.greatest(F.lit(1).cast("long"), F.col(f"{side}.line_start")).cast("int")
        size = F.greatest(F.lit(0).cast("long"), F.col(f"{side}.line_end") - start + 1).cast("int")
        return F.array_join(F.slice(lines, start, size), "\n")

    o = old_sources.select(F.col("file").alias("_of"), F.col("text").alias("old_text"))
    n = new_sources.select(F.col("file").alias("_nf"), F.col("text").alias("new_text"))
    rows = diffs.join(o, F.col("old.file") == F.col("_of"), "left").join(n, F.col("new.file") == F.col("_nf"), "left")
    return rows.withColumns({"_a": cut("old"), "_b": cut("new")}).drop("_of", "_nf", "old_text", "new_text")


def with_text_changes(diffs: DataFrame, old_sources: DataFrame, new_sources: DataFrame, context: int | None = None) -> DataFrame:
    """Adds ``lines`` and ``details`` of each pair, from (file, text) of both versions; only the entities'
    texts go to Python."""
    rows = _with_texts(diffs, old_sources, new_sources)

    @F.arrow_udf(f"struct<lines: {_LINES}, details: {_LINES.replace('text', 'description')}>")
    def compare(a: pa.Array, b: pa.Array) -> pa.Array:
        def one(x: str | None, y: str | None) -> dict:
            d = textdiff.line_diff(x, y, context)
            plain = d if context is None else textdiff.line_diff(x, y)
            return {"lines": _told(d, "text"), "details": _told(textdiff.change_details(plain), "description")}

        return _by_pieces(one, a, b, pa.struct([("lines", _listed("text")), ("details", _listed("description"))]))

    rows = rows.withColumn("_c", compare("_a", "_b"))
    return rows.select(*diffs.columns, F.col("_c.lines").alias("lines"), F.col("_c.details").alias("details"))


def with_snippets(diffs: DataFrame, old_sources: DataFrame, new_sources: DataFrame, context: int = 3) -> DataFrame:
    """Adds ``snippet`` (base, head, language, kind, hunks) of every pair but those that differ in formatting only.

    The kind says what to show: the signature, the hunks (diff), or both texts (full).
    """
    rows = _with_texts(diffs, old_sources, new_sources)

    @F.arrow_udf(_LINES)
    def hunks(a: pa.Array, b: pa.Array) -> pa.Array:
        return _by_pieces(lambda x, y: _told(textdiff.line_diff(x, y, context), "text"), a, b, _listed("text"))

    sig, body = F.coalesce("sig_changed", F.lit(False)), F.coalesce("body_changed", F.lit(False))
    kind = F.when(sig & ~body, "signature").when(body & ~sig, "diff").otherwise("full")
    language = F.coalesce(S.lang_for(F.col("new.file")), F.regexp_extract("new.file", "[^.]*$", 0))
    there = F.col("_a").isNotNull() & F.col("_b").isNotNull() & (F.col("change") != "formatting_only")
    snippet = F.struct(F.col("_a").alias("base"), F.col("_b").alias("head"), language.alias("language"), kind.alias("kind"), hunks("_a", "_b").alias("hunks"))
    return rows.withColumn("snippet", F.when(there, snippet)).drop("_a", "_b")


def token_changes(with_details: DataFrame) -> DataFrame:
    """Details without those about lines and comments."""
    return with_details.withColumn("token_changes", F.filter("details", lambda d: ~d["kind"].isin("line_added", "line_removed", "comment")))


def report(shown: DataFrame, pats: DataFrame) -> DataFrame:
    """One row of counts and the sentence that says them: patterns, moves, then changes by kind."""
    kinds = (("added", "added"), ("modified", "modified"), ("removed", "removed"), ("renamed", "renamed"), ("formatting_only", "formatting only"))
    here = ~F.col("cross_file_move")
    n = shown.agg(*(F.count_if(here & (F.col("change") == k)).alias(k) for k, _ in kinds), F.count_if("cross_file_move").alias("moves"), F.count_distinct("file").alias("files_changed"), F.count_if("breaking").alias("breaking"))
    n = n.crossJoin(pats.agg(F.count("*").alias("patterns")))  # one row each
    some = lambda c, form: F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(form), F.when(F.col(c) == 1, "").otherwise("s") if form.startswith((" cross", " entity")) else F.lit("")))
    counts = F.concat_ws(", ", some("patterns", " cross-file pattern"), some("moves", " entity move"), *(some(k, f" {w}") for k, w in kinds))
    text = F.when(counts == "", "No structural changes.").otherwise(F.concat(counts, F.when(F.col("breaking") > 0, " with breaking changes").otherwise(""), F.lit(".")))
    return n.withColumn("natural_language", text)


def summary_line(pats: list, breaking: list, sections: list[tuple[str, list[str]]]) -> str | None:
    """What matters most on one line, from collected rows: two patterns, two breaking entries, else names by file."""
    parts = [f"{p['base']} {p['change']} across {p['file_count']} files" for p in pats[:2]]
    parts += [f"{b['name']} ({b['reason']})" for b in breaking[:2]]
    parts += [f"+{len(breaking) - 2} more breaking"] if len(breaking) > 2 else []
    if not parts:
        parts = [f"{', '.join(names[:3])} in {file}" for file, names in sections[:3] if names]
    return "; ".join(parts) or None
