"""Operators on small relations with known answers, and invariants."""

import random

import pytest
from pyspark.sql import functions as F

from symloom import project
from symloom.functions import scalars as S
from symloom.functions import textdiff
from symloom.operators import diff, digest, fingerprint, graph, query, review
from symloom.plans import render
from symloom.schema import ENTITY_SCHEMA, PAIR_SCHEMA, REF_SCHEMA, conform
from symloom.sources import extract, git, jsonl


def ents(spark, rows):
    """(file, name, extra) with the usual defaults; seq counts rows."""
    full = []
    for i, (file, name, *extra) in enumerate(rows):
        r = dict(file=file, name=name, kind="function", line_start=1, line_end=2, parent=None, sig=None, meta=None, body_hash=None, sig_hash=None, struct_hash="deadbeef", visibility=None, rank=None, blast_radius=None, seq=i)
        full.append(tuple({**r, **(extra[0] if extra else {})}.values()))
    return spark.createDataFrame(full, ENTITY_SCHEMA)


def refs(spark, rows):
    """(file, caller, name, extra)"""
    full = []
    for i, (file, caller, name, *extra) in enumerate(rows):
        full.append(tuple({**dict(file=file, caller=caller, name=name, kind="call", line=1, seq=i), **(extra[0] if extra else {})}.values()))
    return spark.createDataFrame(full, REF_SCHEMA)


def col(df, *names):
    return [tuple(r[n] for n in names) if len(names) > 1 else r[names[0]] for r in df.collect()]


def scalar(spark, f, *values):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "x string").select(f(F.col("x"))).collect()]


# --- scalars


def test_scalars(spark):
    assert scalar(spark, S.tail_segment, "a::b", "a.b", "c", "a.b::c.d", "x.") == ["b", "b", "c", "d", ""]
    assert scalar(spark, S.qualified_tail, "a::b::c", "a.b", None) == ["c", None, None]
    assert scalar(spark, S.parent_dir, "a/b/c.rs", "c.rs", "/x") == ["a/b", "", ""]
    assert scalar(spark, S.lang_for, "a.b/c", "x.rs", "x.h++", "x.mdx", "x", "x.YML", "x.yml") == [None, "rust", "cpp", None, None, None, "yaml"]
    assert scalar(spark, S.collapse, " a \n\t b ", "") == ["a b", ""]
    assert scalar(spark, lambda c: S.truncate(c, 5), "abcdef", "abcde") == ["abcde...", "abcde"]
    assert scalar(spark, lambda c: S.truncate(c, 5, "…", 4), "abcdef") == ["abcd…"]
    assert scalar(spark, S.tidy_parens, "f( a, b, )", "f(a,)") == ["f(a, b)", "f(a)"]
    assert scalar(spark, S.token_estimate, "", "abc", "abcde", "éé") == [0, 1, 2, 1]
    assert scalar(spark, S.is_number, "1", "-1.5e3", "x", "1.", ".5") == [True, True, False, True, True]
    assert scalar(spark, S.is_string_literal, '"a"', "'a'", "a") == [True, True, False]
    assert scalar(spark, S.is_identifier, "a.b_c", "", "a b") == [True, False, False]
    assert scalar(spark, S.is_comment, "  // x", "a // x", "* x") == [True, False, True]
    assert scalar(spark, S.normal_kind, "trait_impl", "field", "procedure", "class") == ["impl", "property", "function", "class"]
    assert scalar(spark, S.cell, None, "x") == ["", "x"]


@pytest.mark.parametrize("path,want", [("tests/a.rs", True), ("a/test/b.py", True), ("a\\tests\\b.c", True), ("src/__tests__/x.js", True), ("a_test.go", True), ("a.spec.tsx", True), ("FooTest.java", True), ("TestFoo.java", True), ("test_a.py", True), ("x_spec.rb", True), ("src/attestation.rs", False), ("src/latest.py", False), ("contest/engine.ts", False), ("test_a.js", False), ("a_test.tsx", False)])
def test_test_paths(spark, path, want):
    assert scalar(spark, S.is_test_path, path) == [want]


def test_fingerprints(spark):
    one = lambda f, *v: scalar(spark, f, *v)
    a, b, c = one(fingerprint.body_hash, "x = 1\n\n# note\n  y  =  2\n", "x = 1\ny = 2", '"""doc\nmore"""\nx = 1\ny = 2')
    assert a == b == c and len(a) == 16
    assert one(fingerprint.body_hash, "# only\n\n", '"""one line"""\nx')[0] is None
    r, s = one(fingerprint.body_hash_raw, "# a\n\n b", "# a\nb")
    assert r == s and r != one(fingerprint.body_hash_raw, "b")[0] and one(fingerprint.body_hash_raw, " \n")[0] is None
    assert one(fingerprint.sig_hash, "f( a )  ", None)[1] is None and one(fingerprint.sig_hash, "f a")[0] == one(fingerprint.sig_hash, " f \n a ")[0]
    texts = ["x = 1\n\n# note\n y\n", '"""d\n"""\nz', "'''one'''\nq\n"]
    assert one(fingerprint.body_hash, *texts) == [extract.body_hash(t.split("\n")) for t in texts]
    d = spark.createDataFrame([("a\nb\nc", 2, 3)], "t string, s long, e long").select(fingerprint.struct_hash(F.col("t"), F.col("s"), F.col("e")), fingerprint.short(F.lit("b\nc"))).first()
    assert d[0] == d[1]


# --- point queries


def test_callers_and_callees(spark):
    r = refs(spark, [("b.rs", "m", "foo"), ("a.rs", None, "crate::x::foo"), ("a.rs", "m", "foo_bar", {"kind": "import"}), ("a.rs", "n", "x_foo"), ("c.rs", "m", "crate::foo", {"line": 9})])
    assert col(query.callers(r, "foo"), "file", "name") == [("a.rs", "crate::x::foo"), ("b.rs", "foo"), ("c.rs", "crate::foo")]
    assert col(query.callers(r, "crate::foo"), "file") == ["c.rs"] and col(query.callers(r, "foo", limit=1), "file") == ["a.rs"]
    assert query.callers(r, "fo_").count() == 0 and query.callers(r, "foo", "import").count() == 0
    assert col(query.callees(r, "m"), "name") == ["foo_bar", "foo", "crate::foo"] and query.callees(r, "").count() == 0
    assert col(query.refs_grouped(r, "caller"), "key", "count") == [("<top-level>", 1), ("m", 3), ("n", 1)]
    with pytest.raises(ValueError):
        query.refs_grouped(r, "line")


def test_search(spark):
    e = ents(spark, [("src/a.rs", "Alpha"), ("src/b.py", "alphabet", {"kind": "class"}), ("lib/alp.go", "x"), ("src/a.rs", "Alpha", {"line_start": 7})])
    assert query.search(e, "").count() == 0 and query.search(e, "ALPHA").count() == 3 and query.search(e, "alpha", limit=1).count() == 1
    assert col(query.search(e, "alpha", kind="class"), "name") == ["alphabet"] and query.search(e, "alpha", prefix="lib/").count() == 0
    assert col(query.search(e, "alp", scope="file"), "file", "lang", "entity_count") == [("lib/alp.go", "go", 1)]
    assert col(query.search(e, "alp", scope="what", limit=4), "hit") == ["symbol"] * 3 + ["file"] and query.search(e, "alp", scope="all", limit=2).count() == 2
    assert col(query.dedupe_hits(query.search_symbols(e, "alpha")), "name", "overloads") == [("Alpha", 2), ("alphabet", 1)]
    assert query.search_symbols(e, "a_p").count() == 0  # wildcards are literal


def test_directories_and_outline(spark):
    e = ents(spark, [("d/a.rs", "A", {"kind": "class", "line_end": 1}), ("d/b.py", "b"), ("d/c.py", "c"), ("top.go", "t", {"parent": "P"}), ("d/a.rs", "B", {"line_start": 0})])
    assert col(query.dir_overview(e), "dir", "file_count", "langs") == [("", 1, ["go"]), ("d", 3, ["python", "rust"])]
    assert col(query.files_capped(e, cap=2), "file") == ["top.go", "d/a.rs", "d/b.py"] and query.files_capped(e).count() == 4
    rows = query.outline(e).collect()
    assert [r["file"] for r in rows] == ["d/a.rs", "d/b.py", "d/c.py"] and [x["name"] for x in rows[0]["entries"]] == ["B", "A"] and rows[0]["entries"][1]["line_end"] is None
    assert col(query.file_symbols(e, "d/a.rs"), "name") == ["B", "A"] and query.file_symbols(e, "top.go", depth=1).count() == 0
    assert col(query.children(e, "top.go", "P"), "name") == ["t"] and col(query.files(e), "file") == ["d/a.rs", "d/b.py", "d/c.py", "top.go"]
    assert query.explore_cap(10, 3) == 3 and query.explore_cap(1, 5) == 1 and query.projects() == [""] and query.counts(e, refs(spark, [])).first() == (5, 0)


def test_where_and_suggest(spark):
    e = ents(spark, [("a.rs", "T.run", {"kind": "method", "parent": "T"}), ("a.rs", "T.run", {"kind": "method", "parent": "T", "line_start": 5}), ("a.rs", "U.run", {"kind": "method", "parent": "U", "line_start": 9}), ("tests/a.rs", "run"), ("b.rs", "run", {"kind": "constant"}), ("c.rs", "runs")])
    assert col(query.where(e, "run"), "file", "parent", "line", "overloads") == [("a.rs", "T", 1, 2), ("a.rs", "U", 9, 1)]
    assert query.where(e, "run", include_tests=True).count() == 3
    assert col(query.suggest(e, "RUN"), "name", "distance") == [("runs", 1)] and query.suggest(e, "zzzzzzzz").count() == 0


def test_sql_reads_only(spark):
    jsonl.register(ents(spark, [("a", "x"), ("b", "x")]), refs(spark, [("a", None, "x")]))
    assert query.sql(spark, "SELECT e.file, count(r.name) n FROM entities e LEFT JOIN refs r ON e.name = r.name GROUP BY ROLLUP (e.file)").count() == 3
    assert query.sql(spark, "select * from rank").count() == 0 and query.sql(spark, "select direct_files from blast").count() == 2
    for bad in ("DROP VIEW refs", "", "insert into refs values (1)"):
        with pytest.raises(ValueError):
            query.sql(spark, bad)
    with pytest.raises(ValueError):
        query.backend("nope")
    assert query.backend("memory") == "spark"


# --- graph


def ranks(spark, e, r, **kw):
    return {x["file"]: x["rank"] for x in graph.pagerank(ents(spark, e), refs(spark, r), **kw).collect()}


def test_pagerank(spark):
    assert ranks(spark, [], []) == {}
    assert ranks(spark, [("a", "foo"), ("b", "bar")], []) == {"a": 0.5, "b": 0.5}
    e = [("popular", "foo"), ("unused", "_"), ("a", "x"), ("b", "y")]
    got = ranks(spark, e, [("a", "x", "foo"), ("b", "y", "foo")])
    assert got["popular"] > got["a"] and got["popular"] > got["unused"]
    e = [("a", "Config"), ("b", "Config"), ("c", "user")]
    got = ranks(spark, e, [("c", "user", "Config")])
    assert got["a"] == pytest.approx(got["b"]) and got["a"] > got["c"] and sum(got.values()) == pytest.approx(1)
    loop = ranks(spark, [("a", "foo"), ("b", "bar")], [("a", "foo", "foo")])
    assert loop == {"a": 0.5, "b": 0.5}


@pytest.mark.parametrize("settings", [{}, {"tolerance": 0, "rounds": 7}])
def test_pagerank_is_the_same_at_every_size(spark, settings):
    rng = random.Random(1)
    e = [(f"f{i}", f"n{i % 7}") for i in range(20)]
    r = [(f"f{rng.randrange(15)}", None, f"n{rng.randrange(7)}") for _ in range(60)]
    a, b = ranks(spark, e, r, **settings), ranks(spark, e, r, compact_rows=0, **settings)
    assert a == b and sum(b.values()) == pytest.approx(1)
    edges, files = graph.file_edges(ents(spark, e), refs(spark, r)).collect(), sorted(a)
    out = {f: sum(w for s, _, w in edges if s == f) for f in files}
    rank = dict.fromkeys(files, 1 / len(files))
    for _ in range(settings.get("rounds", 50)):
        flow = {f: sum(rank[s] * w / out[s] for s, d, w in edges if d == f) for f in files}
        new = {f: 0.15 / len(files) + 0.85 * (flow[f] + sum(rank[x] for x in files if not out[x]) / len(files)) for f in files}
        done = sum(abs(new[f] - rank[f]) for f in files) < settings.get("tolerance", 1e-6)
        rank = new
        if done:
            break
    assert all(a[f] == pytest.approx(rank[f], abs=1e-12) for f in files)


def test_edges_split_over_other_files(spark):
    e = ents(spark, [("a", "x"), ("b", "x"), ("c", "x"), ("c", "y")])
    r = refs(spark, [("a", None, "x"), ("a", None, "x"), ("d", None, "x"), ("c", None, "y")])
    got = {(s, d): w for s, d, w in col(graph.file_edges(e, r), "src", "dst", "w")}
    assert got == {("a", "b"): 1.0, ("a", "c"): 1.0, **{("d", k): pytest.approx(1 / 3) for k in "abc"}}
    assert set(col(graph.undirected_edges(e, r), "lo", "hi")) == {("a", "b"), ("a", "c"), ("a", "d"), ("b", "d"), ("c", "d")}


def test_blast(spark):
    e = ents(spark, [("a", "leaf"), ("a", "lonely"), ("b", "leaf")])
    r = refs(spark, [("f", "worker", "leaf"), ("g", "helper", "worker"), ("g", "main", "helper"), ("h", "top", "main"), ("f", "worker", "leaf"), ("z", None, "leaf")])
    got = {n: (d, f, t) for n, d, f, t in col(graph.blast(e, r), "name", "direct_callers", "direct_files", "transitive_callers")}
    assert got == {"leaf": (3, 2, 3), "lonely": (0, 0, 0)}
    for depth, n in ((0, 0), (1, 1), (2, 2), (9, 4)):
        assert dict(col(graph.blast_transitive(e, r, depth), "name", "transitive_callers"))["leaf"] == n
    cycle = refs(spark, [("f", "a", "b"), ("f", "b", "c"), ("f", "c", "a")])
    assert col(graph.blast_transitive(ents(spark, [("f", "a")]), cycle), "transitive_callers") == [2]
    applied = graph.apply_blast(e, graph.blast(e, r))
    assert applied.columns == e.columns and applied.where("name = 'leaf'").select("blast_radius.direct_callers").distinct().count() == 1


def groups(spark, e, r):
    out = {}
    for f, c in col(graph.communities(ents(spark, e), refs(spark, r)), "file", "community"):
        out.setdefault(c, set()).add(f)
    return out


def test_communities(spark):
    assert groups(spark, [("a", "x"), ("b", "y"), ("c", "z")], []) == {0: {"a"}, 1: {"b"}, 2: {"c"}}
    tri = [("a", "sa"), ("b", "sb"), ("c", "sc"), ("lonely", "lo")]
    assert groups(spark, tri, [(f, None, n) for f in "abc" for n in ("sa", "sb", "sc") if n[1] != f]) == {0: {"a", "b", "c"}, 1: {"lonely"}}
    e = [(f"x{i}", f"f{i}") for i in "123"] + [(f"y{i}", f"g{i}") for i in "123"]
    ring = [("x1", None, "f2"), ("x2", None, "f3"), ("x3", None, "f1"), ("y1", None, "g2"), ("y2", None, "g3"), ("y3", None, "g1")]
    assert sorted(map(sorted, groups(spark, e, ring).values())) == [["x1", "x2", "x3"], ["y1", "y2", "y3"]]


def test_subsystems(spark):
    sets = [["top.rs"], ["a/b.rs"], ["src/p/a.rs", "src/p/q/b.rs"], ["top.rs", "else/x.rs"], [f"s/x{i}/f.rs" for i in range(8)], ["ab/x", "abc/y"]]
    own = spark.createDataFrame([(f"{f}#{c}" if "/" not in f else f, c) for c, fs in enumerate(sets) for f in fs], "file string, community long")
    shown = own.select("file", F.length("file").cast("double").alias("score"))
    got = {r["community"]: r for r in digest.subsystems(own, shown).collect()}
    assert [got[c]["label"] for c in range(6)] == ["top.rs#0", "a", "src/p", "cross-cutting", "s", "cross-cutting"]
    assert got[4]["file_count"] == 8 and got[4]["top"] == [f"s/x{i}/f.rs" for i in range(5)] and got[2]["top"] == ["src/p/q/b.rs", "src/p/a.rs"]


def test_cochange(spark):
    c = spark.createDataFrame([("1", "a"), ("1", "b"), ("2", "a"), ("2", "b"), ("2", "b"), ("3", "a"), ("3", "c"), *[("big", f"z{i}") for i in range(50)]], "commit string, file string")
    rows = graph.cochange_pairs(c, min_support=1).collect()
    assert tuple(rows[0]) == ("a", "b", pytest.approx(0.8164965809277261), 2) and tuple(rows[1])[:2] == ("a", "c") and len(rows) == 2
    assert graph.cochange_pairs(c.where("commit <> '1'")).count() == 0
    assert col(graph.partners(graph.cochange_pairs(c, 1), "a"), "partner") == ["b", "c"]
    misses = review.cochange_misses(spark.createDataFrame([("a",)], "file string"), graph.cochange_pairs(c, 1), least=0.6)
    assert col(misses, "file", "expected_partner") == [("a", "b")]


def test_duplicates(spark):
    body = lambda h, n=5, **k: {"body_hash": h, "line_end": n, **k}
    e = ents(spark, [("a", "f", body("h1")), ("b", "g", body("h1")), ("c", "s", body("h2", 2)), ("d", "s", body("h2", 2)), ("e", "i", body("h3", kind="import")), ("f", "i", body("h3", kind="import")), ("g", "n", body(None)), ("a", "x", body("h4")), ("b", "x", body("h4")), ("c", "x", body("h4"))])
    assert col(graph.duplicates(e), "body_hash", "size", "lines", "file") == [("h4", 3, 5, "a"), ("h4", 3, 5, "b"), ("h4", 3, 5, "c"), ("h1", 2, 5, "a"), ("h1", 2, 5, "b")]
    assert col(graph.duplicates(e, max_group=2), "body_hash") == ["h1", "h1"] and graph.duplicates(e, min_lines=2).count() == 7
    assert tuple(graph.duplicates_totals(e).first()) == (10, 2, 5)


# --- digests


def test_context(spark):
    blast = lambda n: {"blast_radius": (n, n, 0)}
    e = ents(spark, [("a/x.rs", "run", blast(1)), ("b/y.rs", "run", {**blast(5), "parent": "P", "line_start": 9}), ("c.rs", "run", {"kind": "import"}), ("tests/t.rs", "run"), ("d.rs", "Q.run", {"kind": "method", "parent": "Q"}), ("e.rs", "R.run", {"kind": "method", "parent": "R"})])
    assert col(digest.resolve(e, "run"), "file") == ["b/y.rs", "a/x.rs", "tests/t.rs"] and col(digest.resolve(e, "P::run"), "file") == ["b/y.rs"]
    assert col(digest.resolve(e, "x.rs::run"), "file") == ["a/x.rs"] and col(digest.resolve(e, "y.rs::P::run"), "file") == ["b/y.rs"]
    assert col(digest.blast_candidates(e, "run").orderBy("place"), "file", "place") == [("b/y.rs", 0), ("a/x.rs", 1)]
    assert col(digest.overrides(e, "Q.run", "Q"), "parent") == ["P", "R"] and col(digest.hot_symbol(e), "file") == ["b/y.rs"]
    r = refs(spark, [("z.rs", "m", "run"), ("z.rs", "m", "x::run"), ("tests/q.rs", "m", "run"), ("a.rs", "run", "T", {"kind": "type_annotation"}), ("a.rs", "run", "go"), ("a.rs", "run", "go")])
    assert col(digest.context_callers(r, "run"), "file") == ["z.rs"] and col(digest.context_callees(r, "run", False), "name") == ["go"] and col(digest.context_callees(r, "run", True), "name") == ["T"]
    rk = spark.createDataFrame([("z.rs", 0.9)], "file string, rank double")
    assert col(digest.ranked_callers(r, rk, "run", 1), "file", "skipped") == [("z.rs", 1)] and digest.ranked_callers(r, rk, "run", 0).count() == 2


def test_trim():
    b = {"alternatives": [1, 2], "types": [1], "callees": [1, 2], "callers": [1, 2, 3], "overrides": [1]}
    size = lambda x: sum(len(v) for v in x.values() if isinstance(v, list))
    out = digest.trim(b, 5, size)
    assert (out["alternatives"], out["types"], out["callees"], out["callers"]) == ([], [], [1], [1, 2, 3]) and out["callees_skipped"] == 1
    assert digest.trim(b, 0, size)["callers"] == [1] and b["alternatives"] == [1, 2]


def test_map(spark):
    e = ents(spark, [("a", "x", {"blast_radius": (3, 2, 0), "visibility": "public"}), ("a", "y", {"blast_radius": (9, 1, 0)}), ("b", "z")])
    assert col(digest.map_entities(e, depth=1), "file", "name") == [("a", "x"), ("b", "z")]
    rk = spark.createDataFrame([("a", 0.4), ("b", 0.4)], "file string, rank double")
    assert col(digest.map_files(e, rk), "file") == ["a", "b"] and col(digest.map_files(e, rk, "b"), "file", "score") == [("b", 0.8), ("a", 0.4)]
    rows = spark.createDataFrame([(1, 50), (2, 60), (3, 1)], "i int, t long")
    assert col(digest.pack(rows, F.col("t"), ["i"], 200), "i") == [1] and col(digest.pack(rows, F.col("t"), ["i"], 10), "i") == [1]
    assert col(digest.pack(rows, F.col("t"), ["i"], 211), "i") == [1, 2, 3]
    import public_tokenizers

    counted = digest.bpe_tokens(spark.createDataFrame([("hello world",), (None,), ("x" * 5000,)], "t string"), "t", public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    assert [r["tokens"] for r in counted.collect()][:2] == [2, 0] and counted.agg(F.max("tokens")).first()[0] > 100
    pairs = spark.createDataFrame([(10.0, 1.0), (30.0, 1.0), (None, 1.0), (4.0, 2.0), (8.0, 2.0)], "control double, treatment double")
    assert digest.median_ratio(pairs).first()[0] == 7.0


# --- version diff


def matched(spark, old, new, **kw):
    rows = diff.match(ents(spark, old), ents(spark, new), **kw).collect()
    return sorted((r["match"], r["old"] and r["old"]["name"], r["new"] and r["new"]["name"], r["old"] and r["old"]["file"], r["new"] and r["new"]["file"]) for r in rows)


H = lambda b, s="sh", st="st", **k: {"body_hash": b, "sig_hash": s, "struct_hash": st, **k}


@pytest.mark.parametrize(
    "old,new,want",
    [
        ([("a", "foo", H("b1"))], [("a", "foo", H("b2", st="s2"))], [("exact", "foo", "foo", "a", "a")]),
        ([("a", "foo", H("b1"))], [("b", "foo", H("b1"))], [("moved", "foo", "foo", "a", "b")]),
        ([("a", "foo", H("b1"))], [("a", "bar", H("b1"))], [("renamed", "foo", "bar", "a", "a")]),
        ([("a", "foo", H("b1"))], [("a", "bar", H("b2"))], [("added", None, "bar", None, "a"), ("removed", "foo", None, "a", None)]),
        ([("a", "os", H("b1", kind="import"))], [("a", "sys", H("b1", kind="import"))], [("added", None, "sys", None, "a"), ("removed", "os", None, "a", None)]),
        ([("a", "x", H("b"))], [("a", "x", H("b"))], []),
        ([("a", "THREAD_STORAGE_KEY", H(None))], [("a", "THREAD_STORAGE_PREFIX", H("q"))], [("renamed", "THREAD_STORAGE_KEY", "THREAD_STORAGE_PREFIX", "a", "a")]),
        ([("a", "process_payment", H("b1"))], [("a", "calculate_tax", H("b2"))], [("added", None, "calculate_tax", None, "a"), ("removed", "process_payment", None, "a", None)]),
        ([("a", "load_a", H("b1"))], [("b", "load_b", H("b2"))], [("added", None, "load_b", None, "b"), ("removed", "load_a", None, "a", None)]),
        ([("a", "load_a", H("b1", parent="P"))], [("a", "load_b", H("b2", parent="Q"))], [("added", None, "load_b", None, "a"), ("removed", "load_a", None, "a", None)]),
        ([("a", "load_a", H("b1", kind="class"))], [("a", "load_b", H("b2"))], [("added", None, "load_b", None, "a"), ("removed", "load_a", None, "a", None)]),
        ([("a", "text", H("1", st="1", parent="body")), ("a", "text", H("2", st="2", parent="header"))], [("a", "text", H("3", st="3", parent="body")), ("a", "text", H("4", st="4", parent="header"))], [("exact", "text", "text", "a", "a")] * 2),
        ([("a", "f", H("1", st="1")), ("a", "f", H("2", st="2"))], [("a", "f", H("9", st="9"))], [("exact", "f", "f", "a", "a"), ("removed", "f", None, "a", None)]),
    ],
)
def test_match(spark, old, new, want):
    assert matched(spark, old, new) == want


def test_match_last_old_first_new(spark):
    rows = diff.match(ents(spark, [("a", "f", H("1", st="1")), ("a", "f", H("2", st="2"))]), ents(spark, [("a", "f", H("3", st="3")), ("a", "f", H("4", st="4"))])).collect()
    assert sorted((r["match"], r["old"]["seq"], r["new"]["seq"]) for r in rows) == [("exact", 1, 0), ("moved", 0, 1)]


def test_fuzzy_is_one_to_one(spark):
    old = [("a", f"handler_{i}", H(f"o{i}")) for i in range(4)]
    new = [("a", f"handler_{i}x", H(f"n{i}")) for i in range(3)]
    got = matched(spark, old, new)
    renamed = [g for g in got if g[0] == "renamed"]
    assert len(renamed) == 3 and len({g[1] for g in renamed}) == 3 and [g for g in got if g[0] == "removed"] == [("removed", "handler_3", None, "a", None)]
    assert all(g[1] + "x" == g[2] for g in renamed)


def test_classify_and_reports(spark):
    old = [("a", "sig", H("b", "s1", "1")), ("a", "fmt", H("b3", st="1")), ("a", "gone", H("b4")), ("a", "mv", H("b5")), ("c", "x.one", H("p", "s", "1", parent="x")), ("d", "y.one", H("q", "s", "1", parent="y")), ("a", "imp", H("i", kind="import"))]
    new = [("a", "sig", H("b", "s2", "2")), ("a", "fmt", H("b3", st="2")), ("e", "mv", H("b5")), ("a", "fresh", H("zz")), ("c", "x.one", H("p2", "s", "2", parent="x")), ("d", "y.one", H("q2", "s", "2", parent="y"))]
    d = diff.classify(diff.match(ents(spark, old), ents(spark, new)))
    rows = {r["name"]: r for r in d.collect()}
    assert {n: (r["change"], r["breaking"], r["reason"]) for n, r in rows.items()} == {"sig": ("modified", True, "public signature changed"), "fmt": ("formatting_only", False, None), "gone": ("removed", True, "public entity removed"), "mv": ("moved", False, None), "fresh": ("added", False, None), "x.one": ("modified", False, None), "y.one": ("modified", False, None), "imp": ("removed", False, None)}
    assert rows["sig"]["sig_changed"] is True and rows["sig"]["body_changed"] is False and rows["mv"]["sig_changed"] is None and rows["mv"]["old_file"] == "a"
    assert diff.summary(d).first().asDict() == {"added": 1, "removed": 2, "modified": 3, "moved": 1, "renamed": 0, "formatting_only": 1, "has_breaking": True}
    assert col(diff.patterns(d), "change", "base", "file_count", "entity_count") == [("modified", "one", 2, 2)]
    v = diff.visible(d)
    assert col(diff.moves(v), "name", "from_file", "to_file", "confidence") == [("mv", "a", "e", 1.0)]
    assert {r["file"]: r["modified"] for r in diff.file_sections(v).collect()} == {"a": 1, "c": 1, "d": 1}
    assert col(diff.groups(v, diff.patterns(d)), "by", "key", "entities") == [("file", "a", 4), ("pattern", "modified:one", 2)]
    r = refs(spark, [("a", None, "sig"), ("out", None, "m::sig"), ("out", None, "other")])
    got = {x["name"]: (x["callers_in_diff"], x["external_callers"]) for x in diff.breaking_callers(v, r).collect()}
    assert got == {"sig": (1, 1), "gone": (0, 0)}
    rk = spark.createDataFrame([("a", 0.5)], "file string, rank double")
    e = ents(spark, [("a", "sig", {"blast_radius": (4, 3, 0)})])
    w = review.enrich(v, rk, e)
    assert w.first()["name"] == "sig" and w.first()["impact"] == pytest.approx(0.5 * (1 + 1.3862943611) * 3) and review.most_impactful(w, 2).count() == 2
    assert review.file_deltas(w).first()["file"] == "a"
    assert "BREAKING" in render.diff_text(diff.file_sections(v), v) and render.markdown(rk).startswith("| file | rank |") and render.to_json(rk) == '[{"file": "a", "rank": 0.5}]'
    assert render.cell("abcdef", 4) == "abc…" and render.cell(None) == "" and render.cell(b"x") == "<blob>" and "file" in render.table(rk)


def test_derived_and_json_parents_are_hidden(spark):
    old = [("a.json", "body", H("1", st="1", kind="object")), ("a.json", "text", H("2", st="2", parent="body")), ("a.json", "_p", H("3", st="3", meta=["derived"]))]
    new = [("a.json", "body", H("1x", st="1x", kind="object")), ("a.json", "text", H("2x", st="2x", parent="body")), ("a.json", "_p", H("3x", st="3x", meta=["derived"]))]
    assert col(diff.visible(diff.classify(diff.match(ents(spark, old), ents(spark, new)))), "name") == ["text"]


def test_json_texts_end_to_end(spark):
    old = '{\n "body": {\n  "text": "a",\n  "_parsed": "a"\n },\n "buttons": [\n  {"text": "x"}\n ]\n}'
    got = project.diff_texts(spark, old, old.replace('"a"', '"b"'))
    assert {r["name"] for r in diff.visible(got).collect()} == {"text"}
    row = got.where("name = 'text'").first()
    assert [tuple(x) for x in row["lines"]] == [("removed", '  "text": "a",'), ("added", '  "text": "b",')] and row["details"][0]["kind"] == "value_changed"
    assert project.index_text(spark, '{"a": 1}').count() == 1


# --- texts


def test_text_functions():
    assert textdiff.name_similarity("kitten", "sitting") == pytest.approx(8 / 13, abs=1e-6) and textdiff.name_similarity("", "a") == 0
    assert textdiff.line_diff("a\nb\nc", "a\nx\nc") == [("removed", "b"), ("added", "x")] and textdiff.line_diff("a", "a") is None
    long = [str(i) for i in range(20)]
    other = long[:3] + ["new"] + long[3:15] + long[16:]
    hunks = textdiff.line_diff("\n".join(long), "\n".join(other), 1)
    assert hunks == [("context", "2"), ("added", "new"), ("context", "3"), ("separator", "⋯"), ("context", "14"), ("removed", "15"), ("context", "16")]
    assert textdiff.pair_lines(["a b c", "q"], ["a b d", "z"]) == [("a b c", "a b d")]
    assert textdiff.change_details([("removed", "x = 1"), ("added", "x = 2")]) == [("value_changed", "x = 1 → x = 2")]
    assert textdiff.change_details([("removed", "# a b"), ("added", "# a c")]) == [("comment", "comment updated")]
    assert textdiff.change_details([("added", "brand new line")]) == [("line_added", "+ brand new line")]
    assert textdiff.change_details([("removed", "foo"), ("added", "fob")]) == [("identifier_changed", "foo → fob")]
    assert textdiff.entity_text("a\nb\nc\n", 2, 3) == "b\nc"


@pytest.mark.parametrize("cells", [4_000_000, 6])
def test_edit_scripts_rebuild_both_sides(monkeypatch, cells):
    monkeypatch.setattr(textdiff, "TABLE_CELLS", cells)
    rng = random.Random(3)
    for _ in range(150):
        a, b = ([rng.choice("abc") for _ in range(rng.randrange(9))] for _ in range(2))
        ops = textdiff.script(a, b)
        assert [a[i] for o, i, _ in ops if o != "+"] == a and [b[j] for o, _, j in ops if o != "-"] == b
        assert sum(o == "=" for o, _, _ in ops) == textdiff.lcs(a, b)


# --- sources and sinks


def test_json_lines_round_trip(spark, tmp_path):
    e = ents(spark, [("a", "x", {"visibility": "private", "meta": ["m"], "blast_radius": (0, 0, 0)}), ("b", "y", {"visibility": "public", "blast_radius": (1, 1, 0)})])
    jsonl.write_entities(e, str(tmp_path / "entities.jsonl"))
    text = "".join(p.read_text() for p in (tmp_path / "entities.jsonl").glob("part-*"))
    assert "private" not in text and "null" not in text and text.count("blast_radius") == 1
    back = jsonl.read_entities(spark, str(tmp_path / "entities.jsonl")).orderBy("file").collect()
    assert back[0]["meta"] == ["m"] and back[0]["visibility"] is None and back[1]["blast_radius"]["direct_callers"] == 1
    assert jsonl.read_refs(spark, str(tmp_path / "refs.jsonl")).schema == REF_SCHEMA
    jsonl.write_refs(refs(spark, []), str(tmp_path / "refs.jsonl"))
    assert not (tmp_path / "refs.jsonl").exists()
    (tmp_path / "refs.jsonl").write_text('{"file":"a","name":"x","ref_kind":"call","line":1}\n{"file":"b","name":"y","kind":"import","line":2}\n')
    assert sorted(col(jsonl.read_refs(spark, str(tmp_path / "refs.jsonl")), "kind")) == ["call", "import"]
    store = tmp_path / "store"
    store.mkdir()
    for _ in range(2):
        a, b = jsonl.materialize(spark, str(tmp_path), str(store))
        assert (a.count(), b.count()) == (2, 2)
    (tmp_path / "refs.jsonl").write_text('{"file":"a","name":"x","kind":"call","line":1}\n')
    assert jsonl.materialize(spark, str(tmp_path), str(store))[1].count() == 1
    (tmp_path / "bad").write_text('{"file": "a"\n{"file":"b","name":"y","kind":"call","line":2}\n')
    assert jsonl.read_refs(spark, str(tmp_path / "bad"), strict=False).count() == 1
    with pytest.raises(Exception):
        jsonl.read_refs(spark, str(tmp_path / "bad")).collect()
    jsonl.write_manifest(str(tmp_path / "rank.json"), {"version": 1}, "ranks", {"a": 0.5})
    assert col(jsonl.read_ranks(spark, str(tmp_path / "rank.json")), "file", "rank") == [("a", 0.5)]
    jsonl.write_manifest(str(tmp_path / "co.json"), {}, "pairs", [{"a": "x", "b": "y", "weight": 0.5, "support": 2}])
    assert jsonl.read_pairs(spark, str(tmp_path / "co.json")).first()["support"] == 2 and jsonl.read_pairs(spark, str(tmp_path / "no")).schema == PAIR_SCHEMA
    assert "struct_hash" not in jsonl.hits_json(e).first()[0] and "struct_hash" in jsonl.hits_json(e, True).first()[0]


def test_log_parsing(spark, monkeypatch):
    text = "---abc\n\na.rs\nb.rs\n---def\na.rs\n"
    assert list(git.parse_log(text)) == [("abc", "a.rs"), ("abc", "b.rs"), ("def", "a.rs")]
    lines = spark.createDataFrame(list(enumerate(text.split("\n"))), "position long, value string")
    for size in (git.LOG_BLOCK, 2, 1):
        monkeypatch.setattr(git, "LOG_BLOCK", size)
        assert sorted(col(git.log_lines(lines), "commit", "file")) == [("abc", "a.rs"), ("abc", "b.rs"), ("def", "a.rs")]
    assert git.parse_spec("a...b") == ("a", "b") and git.parse_spec("a..b") == ("a", "b") and git.parse_spec("x") == ("x", "HEAD")


def test_project_end_to_end(spark, tmp_path):
    import subprocess

    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    run("init", "-q")
    (tmp_path / "app.py").write_text("def process(a):\n    return helper(a) + 1\n\ndef total(x):\n    return x\n")
    (tmp_path / "lib.py").write_text("def helper(a):\n    return a\n")
    run("add", "."), run("commit", "-qm", "one")
    (tmp_path / "app.py").write_text("def execute(a, b):\n    return helper(a) + 1\n\ndef total(x):\n    return  x\n\ndef audit():\n    process(1)\n")
    run("add", "."), run("commit", "-qm", "two")
    p = project.Project(spark, str(tmp_path))
    assert col(p.callers("helper"), "caller") == ["execute"] and p.indexed()
    assert p.ranks().count() == 2 and p.context("nothing") is None and p.context("helper")["callers"]
    got = {r["name"]: r["change"] for r in p.diff("HEAD~1..HEAD").collect()}
    assert got == {"execute": "renamed", "total": "formatting_only", "audit": "added"}
    changes, misses = p.review("HEAD~1")
    assert changes.first()["name"] in got and misses.count() == 0 and p.cochange(min_support=1).count() == 1
    (tmp_path / "lib.py").write_text("def helper2(a):\n    return a\n")
    p.index()
    assert sorted(col(p.tables()[0], "name")) == ["audit", "execute", "helper2", "total"] and p.sql("select count(*) from refs").first()[0] == 2
    files, entities, subsystems = p.map()
    assert files.count() == 2 and "# Map" in render.map_markdown(files, entities, subsystems)


def test_streaming_ingest(spark, tmp_path):
    from symloom.streaming import ingest

    spark.createDataFrame([("a.py", "def f():\n    pass\n")], "file string, text string").write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        ingest.start(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert col(spark.read.parquet(str(tmp_path / "out")), "name") == ["f"]


def test_conform(spark):
    df = conform(spark.createDataFrame([("a", 1)], "file string, extra int"), REF_SCHEMA)
    assert df.schema == REF_SCHEMA and df.first()["file"] == "a"


def test_sparse_log_leaves_few_blocks_for_one_order(spark, monkeypatch):
    """a block for each line, as positions far apart make them, is put in one order only above blocks of blocks."""
    monkeypatch.setattr(git, "LOG_BLOCK", 10)
    inner, tops = git._above, []
    monkeypatch.setattr(git, "_above", lambda heads, level=1: (tops.append(heads.count()), inner(heads, level))[1])
    text = [f"---c{i // 7}" if i % 7 == 3 else f"f{i}" for i in range(2000)]
    lines = spark.createDataFrame([(i * 11, x) for i, x in enumerate(text)], "position long, value string")
    assert sorted(col(git.log_lines(lines), "commit", "file")) == sorted(set(git.parse_log("\n".join(text))))
    assert len(tops) == git.LOG_LEVELS and tops[0] == 2000 and tops[-1] <= 22000 // 10**git.LOG_LEVELS + 1


def test_best_pairs_compare_equal_names_once(monkeypatch):
    """F8: the same pairs as all rows against all, by as many comparisons as there are pairs of different names."""
    import random

    from symloom.functions import textdiff

    draw = random.Random(3)
    for k in range(300):
        a, b = ([("ab" * 3 + "cd")[draw.randint(0, 7) :][: draw.randint(0, 5)] for _ in range(draw.randint(0, 14))] for _ in range(2))
        least = (0.6, 0.0, 0.5)[k % 3]
        want, used_a, used_b = [], set(), set()
        for s, i, j in sorted(((s, i, j) for i, x in enumerate(a) for j, y in enumerate(b) if (s := textdiff.name_similarity(x, y)) >= least), key=lambda t: (-t[0], t[1], t[2])):
            if i not in used_a and j not in used_b:
                used_a.add(i)
                used_b.add(j)
                want.append((i, j, s))
        assert textdiff.best_pairs(a, b, least) == want
    calls, inner = [], textdiff.name_similarity
    monkeypatch.setattr(textdiff, "name_similarity", lambda x, y: (calls.append(1), inner(x, y))[1])
    pairs = textdiff.best_pairs(["load_file", "save_file", "x"] * 400, ["load_files", "saved_file"] * 500, 0.6)
    assert len(calls) <= 6 and len(pairs) == 800


def test_texts_are_compared_in_pieces(monkeypatch):
    """results of a batch don't pile up as Python objects."""
    import pyarrow as pa

    built, inner = [], pa.array
    monkeypatch.setattr(diff, "PIECE_BYTES", 8)
    monkeypatch.setattr(pa, "array", lambda x, *k: (built.append(len(x)), inner(x, *k))[1])
    a, b = inner(["abcd", None, "x", "", "long text"] * 20), inner(["abcd", "y", None, "", "other text"] * 20)
    got = diff._by_pieces(lambda x, y: [{"kind": x, "text": y}], a, b, diff._listed("text"))
    assert got.to_pylist() == [[{"kind": x, "text": y}] for x, y in zip(a.to_pylist(), b.to_pylist())]
    assert max(built) <= 5 and sum(built) == 100


def test_callers_behind_the_limit_are_not_ordered(spark):
    """of many callers of a name only those in the first files go to the window; results are those of all of them."""
    old = [("a", "used", {"sig_hash": "1", "struct_hash": "1"}), ("a", "gone", {"sig_hash": "2", "struct_hash": "2"})]
    new = [("a", "used", {"sig_hash": "1x", "struct_hash": "1x"})]
    v = diff.visible(diff.classify(diff.match(ents(spark, old), ents(spark, new))))
    rng = random.Random(3)
    uses = [(rng.choice(["a", *(f"f{i:02}" for i in range(40))]), f"c{i}", rng.choice(["used", "m::used", "other"])) for i in range(3000)]
    r = conform(spark.createDataFrame([(f, c, n, "call", (i * 7) % 50, i) for i, (f, c, n) in enumerate(uses)], "file string, caller string, name string, kind string, line long, seq long"), REF_SCHEMA)
    for limit in (1, 70, 100, 5000):
        out = diff.breaking_callers(v, r, limit)
        got = {x["name"]: (x["callers_in_diff"], [tuple(y) for y in x["external"]]) for x in out.collect()}
        first = sorted((f, (i * 7) % 50, i, c) for i, (f, c, n) in enumerate(uses) if n.endswith("used"))[:limit]
        assert got == {"used": (sum(f == "a" for f, *_ in first), [(f, line, c) for f, line, _, c in first if f != "a"]), "gone": (0, [])}
        plan = str(out._jdf.queryExecution().optimizedPlan())
        assert "LeftSemi, ((" in plan and plan.count("Window [") == 1  # the references are cut down before their window


def test_fuzzy_tasks_are_not_merged(spark, monkeypatch):
    """a few small groups, each much to compare, stay in tasks of their own; what passes left is found by one anti-join a side."""
    seen, real = [], diff.stored

    def stored(df, name):
        q = df._jdf.queryExecution()
        seen.append((str(q.optimizedPlan()).count("Join LeftAnti"), "REPARTITION_BY_NUM" in str(q.executedPlan())))
        return real(df, name)

    monkeypatch.setattr(diff, "stored", stored)
    old = [(f"f{i}", f"load_{i}", {"struct_hash": str(i)}) for i in range(8)]
    new = [(f"f{i}", f"loads_{i}", {"struct_hash": str(i)}) for i in range(8)]
    got = diff.match(ents(spark, old), ents(spark, new))
    assert got.where("match = 'renamed'").count() == 8
    assert seen == [(0, False), (2, False), (2, False), (1, False), (1, False), (0, True)]
