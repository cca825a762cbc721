"""Registered queries over the whole tables, against brute force."""

from collections import defaultdict

from pyspark.sql import functions as F

from symloom.operators import diff, fingerprint
from symloom.plans import catalog
from symloom.plans import project as P

DATA = "/root/testdata/sf0.001"


def test_graph_queries_read_all_references(spark):
    names = [r["name"] for r in P.entities(spark, DATA).select("name").distinct().collect()]
    uses = P.refs(spark, DATA).select("name", "caller", "file").collect()
    callers, files, count = defaultdict(set), defaultdict(set), defaultdict(int)
    for r in uses:
        count[r["name"]] += 1
        files[r["name"]].add(r["file"])
        if r["caller"] is not None:
            callers[r["name"]].add(r["caller"])
    want = {}
    for n in names:
        seen, front = set(), {n}
        for _ in range(3):
            front = set().union(*(callers[x] for x in front))
            seen |= front
        want[n] = (count[n], len(files[n]), len(seen - {n}))
    got = {r["name"]: (r["direct_callers"], r["direct_files"], r["transitive_callers"]) for r in catalog.QUERIES["g06_blast_applied"](spark, DATA).collect()}
    assert got == want and sum(count.values()) == P.table(spark, DATA, "lineitem").count()
    assert {r["name"]: r["transitive_callers"] for r in catalog.QUERIES["g05_blast_transitive"](spark, DATA).collect()} == {n: x[2] for n, x in want.items()}


def test_version_queries_run_the_fuzzy_pass(spark):
    fuzzy = sorted((r["old_name"], r["new_name"]) for r in catalog.QUERIES["v04_fuzzy_renames"](spark, DATA).collect())
    classified = catalog.QUERIES["v07_classified"](spark, DATA).collect()
    renamed = sorted((r["old_name"], r["name"]) for r in classified if r["change"] == "renamed")
    plain = diff.match(P.entities(spark, DATA), P.newer(spark, DATA), fuzzy=False).where("match = 'renamed'").count()
    assert renamed == fuzzy and plain < len(fuzzy)
    summary = catalog.QUERIES["v09_summary"](spark, DATA).first()
    for kind in ("added", "removed", "modified", "moved", "renamed", "formatting_only"):
        assert summary[kind] == sum(r["change"] == kind for r in classified)
    assert {r["name"] for r in catalog.QUERIES["w01_review_enriched"](spark, DATA).collect() if r["change"] == "renamed"} == {n for _, n in fuzzy}


def test_body_hash_sql_folds_docstrings(spark, tmp_path):
    import duckdb

    texts = [(1, 'a = 1\n"""doc\nstring"""\nb = 2'), (2, "a = 1\n# c\n\nb = 2"), (3, "x ''' y"), (4, None), (5, "'''one'''\n  z\r\n'''open\nq"), (6, "")]
    spark.createDataFrame(texts, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    duck = duckdb.connect()
    duck.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    got = sorted(map(tuple, catalog.QUERIES["h02_body_hash"](spark, str(tmp_path)).collect()))
    assert got == sorted(duck.execute(catalog.ORACLES["h02_body_hash"]).fetchall()) and len(got) == 6


def test_no_document_is_left_out_of_the_body_hash(spark, tmp_path):
    texts = [(1, 'a = 1\n"""doc\nstring"""\nb = 2'), (2, "a = 1\nb = 2"), (3, "x '\'\'' y")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["body_hash"] for r in catalog.QUERIES["h02_body_hash"](spark, str(tmp_path)).collect()}
    assert got == {r[0]: r[1] for r in df.select("doc_id", fingerprint.body_hash(F.col("text"))).collect()} and sorted(got) == [1, 2, 3] and got[1] == got[2]


def test_script_blocks_are_the_extractors(spark, tmp_path):
    pages = [(1, "<p>\n<SCRIPT lang='ts'>\nlet a\n</SCRIPT>\n<script>b()</script>"), (2, "<scripted>no</scripted>"), (3, None)]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(map(tuple, catalog.QUERIES["x11_script_blocks"](spark, str(tmp_path)).collect()))
    assert got == [(1, "javascript", 5), (1, "typescript", 2)]


def test_extractors_spread_the_files_and_parse_each_once(spark, tmp_path):
    """a table in one file is no single task, whatever its size on disk."""
    from symloom.plans import generated

    few = generated.FILES_PER_TASK
    rows = spark.range(2 * few + 1).selectExpr("id as p_partkey", "'blue widget' as p_name")
    rows.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    for name in ("x10_csharp", "h05_signatures"):
        df = catalog.queries()[name](spark, str(tmp_path))
        assert df.rdd.getNumPartitions() == 3
        assert df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    sizes = [n for n, in generated._sources(spark, str(tmp_path), "go", "x").groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert sum(sizes) == 2 * few + 1 and max(sizes) < 1.2 * few


def test_references_are_sorted_as_numbers_with_the_same_rows(spark, monkeypatch):
    """names and files go through the shuffles as numbers; the rows and their order are those of the texts."""
    narrow = P._sorted_refs(spark, DATA)
    below = str(narrow._jdf.queryExecution().optimizedPlan()).split("RepartitionByExpression")[0]
    assert "Sort [n#" in below and "name#" not in below[below.index("Sort [n#") :].split("\n")[0]
    got = [tuple(r) for r in narrow.collect()]
    monkeypatch.setattr(P, "DICTIONARY", 0)
    plain = P._sorted_refs(spark, DATA)
    assert "Sort [n#" not in str(plain._jdf.queryExecution().optimizedPlan())
    assert sorted(map(repr, got)) == sorted(map(repr, (tuple(r) for r in plain.collect())))
    places = [(r[2], r[0], r[5]) for r in got]
    assert places == sorted(places)


def test_references_are_cut_without_samples(spark, monkeypatch):
    """the tasks that order the references follow from counts, so their rows aren't made twice; names, files and rows of
    one file are split alike, in one order."""
    monkeypatch.setattr(P, "TASK_ROWS", 3_000)
    rows = P._sorted_refs(spark, DATA)
    assert "rangepartitioning" not in str(rows._jdf.queryExecution().executedPlan())
    sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id().alias("task")).count().collect()]
    assert len(sizes) > 1 and max(sizes) < 2 * P.TASK_ROWS
    places = [(r["name"], r["file"], r["seq"]) for r in rows.collect()]
    assert places == sorted(places)


def test_one_name_in_one_file_is_cut_by_rows(spark, monkeypatch):
    """neither a name nor a file that all rows share is left to one task."""
    monkeypatch.setattr(P, "TASK_ROWS", 100)
    rows = spark.range(1000).selectExpr("1L AS l_partkey", "id AS l_orderkey", "1 AS l_linenumber")
    part = spark.sql("SELECT 1L AS p_partkey, 0 AS n, 0 AS f")
    task, tasks = P._places(rows, part, 1, 1)
    used = rows.selectExpr("0 AS n", "0 AS f", "l_orderkey * 100000000 + l_partkey * 100 + l_linenumber AS seq").orderBy("seq").select(task.alias("t"))
    got = [r["t"] for r in used.collect()]
    assert tasks == 10 and got == sorted(got) and {got.count(t) for t in range(10)} == {100}


def test_entities_are_hashed_behind_their_order(spark):
    """the rows that are sampled and ordered have no hashes yet."""
    seen = []
    P_stored = P.stored
    try:
        P.stored = lambda df, name: seen.append(df) or df
        P.entities(spark, DATA + "/.")
    finally:
        P.stored = P_stored
    plan = str(seen[0]._jdf.queryExecution().optimizedPlan())
    assert "sha2" in plan.split("RepartitionByExpression")[0] and "sha2" not in plan.split("RepartitionByExpression")[1]
