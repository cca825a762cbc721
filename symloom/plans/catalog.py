"""The registered queries over the driver's tables, and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.functions import scalars as S
from symloom.operators import diff, digest, fingerprint, graph, query, review
from symloom.plans import project as P
from symloom.sources import documents, extract

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SYMBOL, PREFIX, FILE = "blue_widget_1", "src/Brand#1", "src/Brand#11/STANDARD.rs"
TAIL = r"regexp_extract(name, '([^:.]*)$', 1)"
DIR = "regexp_extract(file, '^(?s)(.*)/[^/]*$', 1)"
LANG = "CASE regexp_extract(file, '[^.]*$') WHEN 'rs' THEN 'rust' WHEN 'py' THEN 'python' END"
_DEFS = "(" + ", ".join(f"'{k}'" for k in S.DEFINITION_KINDS) + ")"
_TOP = "parent IS NULL AND kind IN (" + ", ".join(f"'{k}'" for k in S.OUTLINE_KINDS) + ")"


def reg(name: str, oracle: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from symloom.plans import generated  # noqa: F401, its queries register themselves

    return QUERIES


def oracle_sql() -> dict[str, str]:
    queries()
    return ORACLES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Callers of the most used name, counted by file."""
    r = P.refs(spark, sf_dir)
    top = r.groupBy("name").count().orderBy(F.desc("count"), "name").limit(1).first()[0]
    return query.refs_grouped(query.callers(r, top), "file")


# --- Q: point queries

_REF = ("file", "caller", "name", "kind", "line")
_ENT = ("file", "name", "kind", "line_start", "line_end", "parent", "sig", "visibility")


def _any(spark: SparkSession, d: str) -> str:
    """A name that exists at every size: that of part 1."""
    return P.entities(spark, d).where("seq = 1").first()["name"]


_ANY = "(SELECT name FROM E WHERE seq = 1)"


@reg("q01_callers", f"WITH {P.E}, {P.R} SELECT file, caller, name, kind, line FROM R WHERE name = {_ANY} OR ends_with(name, '::' || {_ANY})")
def _(s, d):
    return query.callers(P.refs(s, d), _any(s, d)).select(*_REF)


@reg("q01_callers_kind", f"WITH {P.E}, {P.R} SELECT file, caller, name, kind, line FROM R WHERE name = {_ANY} AND kind = 'call'")
def _(s, d):
    return query.callers(P.refs(s, d), _any(s, d), "call").select(*_REF)


@reg("q02_callees", f"WITH {P.E}, {P.R} SELECT file, caller, name, kind, line FROM R WHERE caller = {_ANY}")
def _(s, d):
    return query.callees(P.refs(s, d), _any(s, d)).select(*_REF)


_ANYFILE = "(SELECT file FROM E WHERE seq = 1)"


@reg("q03_file_symbols", f"WITH {P.E} SELECT file, name, kind, line_start, line_end, parent, sig, visibility FROM E WHERE file = {_ANYFILE}")
def _(s, d):
    e = P.entities(s, d)
    return query.file_symbols(e, e.where("seq = 1").first()["file"]).select(*_ENT)


@reg("q04_children", f"WITH {P.E} SELECT file, name, kind, line_start, line_end, parent, sig, visibility FROM E WHERE file = (SELECT file FROM E WHERE seq = 3) AND parent = (SELECT parent FROM E WHERE seq = 3)")
def _(s, d):
    e = P.entities(s, d)
    one = e.where("seq = 3").first()
    return query.children(e, one["file"], one["parent"]).select(*_ENT)


@reg("q05_search_symbols", f"WITH {P.E} SELECT file, name, kind, line_start, line_end, parent, sig, visibility FROM E WHERE contains(lower(name), 'e_1') AND kind = 'class' AND starts_with(file, '{PREFIX}') ORDER BY file, line_start, seq LIMIT 40")
def _(s, d):
    return query.search_symbols(P.entities(s, d), "E_1", "class", PREFIX, 40).select(*_ENT)


@reg("q06_search_files", f"WITH {P.E} SELECT file AS path, {LANG} AS lang, count(*) AS entity_count FROM E WHERE contains(lower(file), 'brand#2') GROUP BY file")
def _(s, d):
    return query.search_files(P.entities(s, d), "BRAND#2")


@reg("q07_search_all", f"""WITH {P.E}, h AS (
SELECT 0 AS ord, 'symbol' AS hit, file, name, kind AS entity_kind, line_start AS line, NULL AS lang, NULL AS entity_count, seq FROM E WHERE contains(lower(name), 'r') AND file LIKE 'src/Brand#1%'
UNION ALL SELECT 1, 'file', file, NULL, NULL, NULL, {LANG}, count(*), NULL FROM E WHERE contains(lower(file), 'r') AND file LIKE 'src/Brand#1%' GROUP BY file)
SELECT hit, file, name, entity_kind, line, lang, CAST(entity_count AS BIGINT) AS entity_count FROM h""")
def _(s, d):
    return query.search(P.entities(s, d), "R", "anything", prefix=PREFIX, limit=0)


@reg("q08_search_dedupe", f"""WITH {P.E} SELECT file, name, kind, line_start, count(*) OVER k AS overloads FROM E WHERE contains(lower(name), '_7')
WINDOW k AS (PARTITION BY file, name, kind) QUALIFY row_number() OVER (PARTITION BY file, name, kind ORDER BY line_start, seq) = 1""")
def _(s, d):
    return query.dedupe_hits(query.search_symbols(P.entities(s, d), "_7")).select("file", "name", "kind", "line_start", "overloads")


@reg("q09_dir_overview", f"WITH {P.E} SELECT dir, count(*) AS file_count, array_to_string(list_sort(list_distinct(list(lang))), ',') AS langs FROM (SELECT DISTINCT file, {DIR} AS dir, {LANG} AS lang FROM E) GROUP BY dir")
def _(s, d):
    return query.dir_overview(P.entities(s, d)).withColumn("langs", F.array_join("langs", ","))


@reg("q10_files_capped", f"WITH {P.E} SELECT dir, file, {LANG} AS lang, n AS entity_count FROM (SELECT file, {DIR} AS dir, count(*) AS n FROM E GROUP BY file) QUALIFY row_number() OVER (PARTITION BY dir ORDER BY file) <= 2")
def _(s, d):
    return query.files_capped(P.entities(s, d), cap=2)


@reg("q13_counts", f"WITH {P.E}, {P.R} SELECT (SELECT count(*) FROM E) AS entities, (SELECT count(*) FROM R) AS refs")
def _(s, d):
    return query.counts(P.entities(s, d), P.refs(s, d))


@reg("q14_files", f"WITH {P.E} SELECT DISTINCT file FROM E")
def _(s, d):
    return query.files(P.entities(s, d))


for _by in ("file", "caller", "name", "kind"):
    reg(f"q15_refs_by_{_by}", f"WITH {P.R} SELECT coalesce({_by}, '<top-level>') AS key, count(*) AS count FROM R GROUP BY 1")(lambda s, d, by=_by: query.refs_grouped(P.refs(s, d), by))


@reg("q16_top_level", f"WITH {P.E} SELECT file, name, kind, line_start FROM E WHERE file = {_ANYFILE} AND {_TOP}")
def _(s, d):
    e = P.entities(s, d)
    return query.file_symbols(e, e.where("seq = 1").first()["file"], depth=1).select("file", "name", "kind", "line_start")


@reg("q17_tail_names", f"WITH {P.E} SELECT {TAIL} AS name FROM E")
def _(s, d):
    return query.tail_names(P.entities(s, d))


@reg("q18_outline", f"""WITH {P.E} SELECT file, count(*) AS n, string_agg(line_start || ':' || coalesce(CAST(CASE WHEN line_end <> line_start THEN line_end END AS STRING), '') || ':' || kind || ':' || name, ',' ORDER BY line_start, seq) AS entries FROM E WHERE {_TOP} GROUP BY file""")
def _(s, d):
    return query.outline(P.entities(s, d)).withColumn("entries", F.expr("array_join(transform(entries, x -> x.line || ':' || coalesce(cast(x.line_end as string), '') || ':' || x.kind || ':' || x.name), ',')"))


@reg("q19_where", f"""WITH {P.E} SELECT file, {_ANY} AS name, kind, parent, line_start AS line, line_end, sig, visibility, count(*) OVER (PARTITION BY file, parent, kind) AS overloads
FROM E WHERE {TAIL} = {_ANY} AND kind IN {_DEFS} QUALIFY row_number() OVER (PARTITION BY file, parent, kind ORDER BY line_start, seq) = 1""")
def _(s, d):
    return query.where(P.entities(s, d), _any(s, d))


@reg("q20_suggest", f"WITH {P.E}, q AS (SELECT {_ANY} || 'x' AS q), t AS (SELECT DISTINCT {TAIL} AS name FROM E) SELECT name, CAST(levenshtein(lower(name), lower(q)) AS INTEGER) AS distance FROM t, q WHERE name <> '' AND levenshtein(lower(name), lower(q)) <= greatest(2, strlen(q) // 2) AND lower(name) <> lower(q) ORDER BY distance, name LIMIT 9")
def _(s, d):
    return query.suggest(P.entities(s, d), _any(s, d) + "x", 9)


_ADHOC = """SELECT coalesce(e.kind, 'all') AS kind, CAST(sum(u.n) AS BIGINT) AS uses, count(DISTINCT e.file) AS files,
CAST(max(u.n) FILTER (WHERE e.visibility = 'public') AS BIGINT) AS top_public FROM {e} e
JOIN (SELECT name, count(*) AS n FROM {r} WHERE caller IS NOT NULL GROUP BY name) u ON u.name = e.name GROUP BY ROLLUP (e.kind)"""


@reg("q21_sql_adhoc", f"WITH {P.E}, {P.R} " + _ADHOC.format(e="E", r="R"))
def _(s, d):
    P.entities(s, d).createOrReplaceTempView("entities")
    P.refs(s, d).createOrReplaceTempView("refs")
    return query.sql(s, _ADHOC.format(e="entities", r="refs"))


# --- G: graph

_EDGES = """idx AS (SELECT DISTINCT name, file FROM E), uses AS (SELECT file AS src, name, count(*) AS u FROM R GROUP BY ALL),
tgt AS (SELECT src, uses.name, u, idx.file AS dst, count(*) OVER (PARTITION BY src, uses.name) AS n FROM uses JOIN idx ON uses.name = idx.name AND idx.file <> src),
W AS MATERIALIZED (SELECT src, dst, sum(u * 1.0e0 / n) AS w FROM tgt GROUP BY src, dst)"""
_ROUND6 = lambda df, *cols: df.withColumns({c: F.round(c, 6) for c in cols})


@reg("g01_name_index", f"WITH {P.E} SELECT DISTINCT name, file FROM E")
def _(s, d):
    return graph.name_index(P.entities(s, d))


@reg("g02_file_edges", f"WITH {P.E}, {P.R}, {_EDGES} SELECT src, dst, round(w, 6) AS w FROM W")
def _(s, d):
    return _ROUND6(graph.file_edges(P.entities(s, d), P.refs(s, d)), "w")


def _pagerank_oracle(rounds: int = 20) -> str:
    steps = ["p0 AS MATERIALIZED (SELECT file, 1.0e0 / n AS r FROM nd, cnt)"]
    for i in range(1, rounds + 1):
        steps.append(
            f"p{i} AS MATERIALIZED (SELECT nd.file, 0.15e0 / n + 0.85e0 * (coalesce(f.v, 0) + coalesce((SELECT sum(r) FROM p{i - 1} WHERE file NOT IN (SELECT src FROM W)), 0) / n) AS r"
            f" FROM nd CROSS JOIN cnt LEFT JOIN (SELECT dst, sum(r * w / t) AS v FROM W JOIN tot USING (src) JOIN p{i - 1} ON file = src GROUP BY dst) f ON f.dst = nd.file)"
        )
    return f"""WITH {P.E}, {P.R}, {_EDGES}, nd AS MATERIALIZED (SELECT file FROM E UNION SELECT file FROM R), cnt AS (SELECT count(*) AS n FROM nd),
tot AS MATERIALIZED (SELECT src, sum(w) AS t FROM W GROUP BY src), {", ".join(steps)} SELECT file, round(r, 6) AS rank FROM p{rounds}"""


@reg("g03_pagerank", _pagerank_oracle())
def _(s, d):
    return _ROUND6(graph.pagerank(P.entities(s, d), P.refs(s, d), rounds=20, tolerance=0), "rank")


@reg("g04_blast_direct", f"WITH {P.E}, {P.R} SELECT e.name, count(R.name) AS direct_callers, count(DISTINCT R.file) AS direct_files FROM (SELECT DISTINCT name FROM E) e LEFT JOIN R ON R.name = e.name GROUP BY e.name")
def _(s, d):
    return graph.blast_direct(P.entities(s, d), P.refs(s, d))


_BFS = """b AS MATERIALIZED (SELECT DISTINCT name AS node, caller FROM R WHERE caller IS NOT NULL), s0 AS (SELECT DISTINCT name AS seed, name AS node FROM E),
s1 AS MATERIALIZED (SELECT DISTINCT seed, caller AS node FROM s0 JOIN b USING (node)), s2 AS MATERIALIZED (SELECT DISTINCT seed, caller AS node FROM s1 JOIN b USING (node)),
s3 AS (SELECT DISTINCT seed, caller AS node FROM s2 JOIN b USING (node)), reach AS (SELECT * FROM s1 UNION SELECT * FROM s2 UNION SELECT * FROM s3),
T AS MATERIALIZED (SELECT s0.seed AS name, count(reach.node) AS transitive_callers FROM s0 LEFT JOIN reach ON reach.seed = s0.seed AND reach.node <> s0.seed GROUP BY s0.seed)"""


@reg("g05_blast_transitive", f"WITH {P.E}, {P.R}, {_BFS} SELECT name, transitive_callers FROM T")
def _(s, d):
    return graph.blast_transitive(P.entities(s, d), P.refs(s, d))


_BLAST = f"{_BFS}, D AS MATERIALIZED (SELECT e.name, count(R.name) AS dc, count(DISTINCT R.file) AS df FROM (SELECT DISTINCT name FROM E) e LEFT JOIN R ON R.name = e.name GROUP BY e.name)"


def _with_blast(s, d):
    e = P.entities(s, d)
    return graph.apply_blast(e, graph.blast(e, P.refs(s, d)))


@reg("g06_blast_applied", f"WITH {P.E}, {P.R}, {_BLAST} SELECT file, E.name, seq, dc AS direct_callers, df AS direct_files, transitive_callers FROM E JOIN D ON D.name = E.name JOIN T ON T.name = E.name")
def _(s, d):
    return _with_blast(s, d).select("file", "name", "seq", "blast_radius.*")


@reg("g07_undirected_edges", f"WITH {P.E}, {P.R}, {_EDGES} SELECT least(src, dst) AS lo, greatest(src, dst) AS hi, round(sum(w), 6) AS w FROM W GROUP BY 1, 2")
def _(s, d):
    return _ROUND6(graph.undirected_edges(P.entities(s, d), P.refs(s, d)), "w")


# One file a step: its neighbours' labels are weighed, the heaviest (then smallest) is taken, until a round changes nothing.
_LABELS = """idx AS (SELECT DISTINCT name, file FROM E), uses AS (SELECT file AS src, name, count(*) AS u FROM R GROUP BY ALL),
tgt AS (SELECT src, u, idx.file AS dst, count(*) OVER (PARTITION BY src, uses.name) AS n FROM uses JOIN idx ON uses.name = idx.name AND idx.file <> src),
UE AS (SELECT least(src, dst) AS lo, greatest(src, dst) AS hi, CAST(sum(CAST(round_even(u * 1.0e0 / n * 4294967296, 0) AS BIGINT)) AS BIGINT) AS w FROM tgt GROUP BY 1, 2),
nd AS MATERIALIZED (SELECT file, row_number() OVER (ORDER BY file) - 1 AS i FROM (SELECT file FROM E UNION SELECT file FROM R)), cnt AS MATERIALIZED (SELECT count(*) AS n FROM nd),
nb AS MATERIALIZED (SELECT x.i, list({'j': y.i, 'w': w}) AS l FROM (SELECT lo, hi, w FROM UE UNION ALL SELECT hi, lo, w FROM UE) JOIN nd x ON x.file = lo JOIN nd y ON y.file = hi GROUP BY x.i),
LP AS (SELECT 0 AS step, n, range(n) AS lab, true AS changed FROM cnt UNION ALL SELECT step + 1, n, CASE WHEN best = lab[i + 1] THEN lab ELSE list_concat(list_append(lab[1 : i], best), lab[i + 2 :]) END, (i > 0 AND changed) OR best <> lab[i + 1]
FROM (SELECT step, n, i, lab, changed, coalesce((list_sort(list_transform(list_distinct(near), lambda y: {'w': -list_sum(list_transform(list_filter(l, lambda x: lab[x.j + 1] = y), lambda x: x.w)), 'y': y}))[1]).y, lab[i + 1]) AS best
FROM (SELECT step, n, step % n AS i, lab, changed, nb.l, list_transform(nb.l, lambda x: lab[x.j + 1]) AS near FROM LP LEFT JOIN nb ON nb.i = step % n WHERE step < 30 * n AND NOT (step > 0 AND step % n = 0 AND NOT changed)))),
fin AS (SELECT lab FROM LP ORDER BY step DESC LIMIT 1), lbl AS (SELECT file, i, lab[i + 1] AS label FROM nd, fin), fst AS (SELECT label, min(i) AS i0 FROM lbl GROUP BY label),
CM AS MATERIALIZED (SELECT file, CAST(dense_rank() OVER (ORDER BY i0) - 1 AS BIGINT) AS community FROM lbl JOIN fst USING (label))"""


@reg("g08_communities", f"WITH RECURSIVE {P.E}, {P.R}, {_LABELS} SELECT file, community FROM CM")
def _(s, d):
    return graph.communities(P.entities(s, d), P.refs(s, d))


def _pairs_sql(cap: int, support: int = 2) -> str:
    return f"""K AS MATERIALIZED (SELECT * FROM C WHERE commit IN (SELECT commit FROM C GROUP BY commit HAVING count(*) <= {cap})),
n AS (SELECT file, count(*) AS n FROM K GROUP BY file),
PR AS MATERIALIZED (SELECT x.file AS a, y.file AS b, count(*) AS support FROM K x JOIN K y ON x.commit = y.commit AND x.file < y.file GROUP BY 1, 2 HAVING count(*) >= {support}),
PW AS MATERIALIZED (SELECT a, b, support / sqrt(na.n * 1.0e0 * nb.n) AS weight, support FROM PR JOIN n na ON na.file = a JOIN n nb ON nb.file = b)"""


@reg("g11_cochange_pairs", f"WITH {P.COMMITS}, {_pairs_sql(30)} SELECT a, b, round(weight, 6) AS weight, support FROM PW")
def _(s, d):
    return _ROUND6(graph.cochange_pairs(P.commits(s, d)), "weight")


@reg("g12_commit_filter", f"WITH {P.COMMITS}, {_pairs_sql(3)} SELECT commit, file FROM K")
def _(s, d):
    return graph.kept_commits(P.commits(s, d), 3)


@reg("g13_partners", f"WITH {P.E}, {P.FILE_COMMITS}, {_pairs_sql(30)} SELECT CASE WHEN a = {_ANYFILE} THEN b ELSE a END AS partner, round(weight, 6) AS weight, support FROM PW WHERE a = {_ANYFILE} OR b = {_ANYFILE}")
def _(s, d):
    return _ROUND6(graph.partners(graph.cochange_pairs(P.file_commits(s, d)), P.entities(s, d).where("seq = 1").first()["file"]), "weight")


_DUP = "kind NOT IN ('import','use','package') AND body_hash IS NOT NULL AND line_end - line_start + 1 >= 3"


@reg("g14_duplicates", f"""WITH {P.E}, m AS (SELECT *, line_end - line_start + 1 AS n, count(*) OVER (PARTITION BY body_hash) AS size FROM E WHERE {_DUP})
SELECT body_hash, size, first_value(n) OVER (PARTITION BY body_hash ORDER BY file, line_start, seq) AS lines, file, line_start, line_end, name, kind, parent, seq FROM m WHERE size > 1""")
def _(s, d):
    return graph.duplicates(P.entities(s, d))


@reg("g15_duplicates_totals", f"WITH {P.E}, g AS (SELECT count(*) AS n FROM E WHERE {_DUP} GROUP BY body_hash HAVING count(*) > 1) SELECT (SELECT count(*) FROM E) AS scanned, count(*) AS groups, CAST(coalesce(sum(n), 0) AS BIGINT) AS total_clones FROM g")
def _(s, d):
    return graph.duplicates_totals(P.entities(s, d))


# --- M: digests

_RANKS = "RK AS (SELECT file, 1.0e0 / (1 + strlen(file) + count(*)) AS rank FROM E GROUP BY file)"


def _ranks(s, d):
    """A stand-in with exact values; the real rank is g03."""
    return P.entities(s, d).groupBy("file").agg((F.lit(1.0) / (1 + F.octet_length("file") + F.count("*"))).alias("rank"))


@reg("m01_blast_candidates", f"WITH {P.E}, {P.R}, {_BLAST} SELECT file, E.name, line_start, CAST(row_number() OVER (ORDER BY df DESC, file, line_start, seq) - 1 AS INTEGER) AS place FROM E JOIN D ON D.name = E.name WHERE E.name = {_ANY} AND kind <> 'import' QUALIFY place <= 4")
def _(s, d):
    return digest.blast_candidates(_with_blast(s, d), _any(s, d)).select("file", "name", "line_start", "place")


@reg("m01_blast_report", f"""WITH {P.E}, {P.R}, {_RANKS}, u AS (SELECT * FROM R WHERE name = {_ANY} QUALIFY row_number() OVER (PARTITION BY file, line ORDER BY seq) = 1),
v AS (SELECT u.file, line, coalesce(rank, 0) AS rank FROM u LEFT JOIN RK ON RK.file = u.file)
SELECT file, line, round(rank, 6) AS rank, greatest(0, (SELECT count(*) FROM v) - 10) AS skipped FROM v ORDER BY v.rank DESC, file, line LIMIT 10""")
def _(s, d):
    return _ROUND6(digest.ranked_callers(P.refs(s, d), _ranks(s, d), _any(s, d)).select("file", "line", "rank", "skipped"), "rank")


@reg("m02_resolve", f"WITH {P.E} SELECT file, name, line_start FROM E WHERE name = {_ANY} AND kind <> 'import'")
def _(s, d):
    return digest.resolve(P.entities(s, d), _any(s, d)).select("file", "name", "line_start")


@reg("m03_context_callers", f"WITH {P.E}, {P.R} SELECT file, line FROM (SELECT DISTINCT file, line FROM R WHERE name = {_ANY}) ORDER BY file, line LIMIT 10")
def _(s, d):
    return digest.context_callers(P.refs(s, d), _any(s, d)).select("file", "line")


@reg("m03_context_types", f"WITH {P.E}, {P.R}, u AS (SELECT * FROM R WHERE caller = {_ANY} QUALIFY row_number() OVER (PARTITION BY file, line, name ORDER BY seq) = 1) SELECT file, line, name FROM u WHERE kind = 'type_annotation'")
def _(s, d):
    return digest.context_callees(P.refs(s, d), _any(s, d), types=True, depth=0).select("file", "line", "name")


def _ninth(s: SparkSession, d: str) -> str:
    return P.entities(s, d).where("seq = 9").first()["name"]


@reg("m04_overrides", f"""WITH {P.E}, o AS (SELECT * FROM E WHERE kind IN ('method','function','fn') AND parent IS NOT NULL AND parent <> (SELECT p_brand FROM part WHERE p_partkey = 9) AND {TAIL} = (SELECT name FROM E WHERE seq = 9)
QUALIFY row_number() OVER (PARTITION BY file, parent ORDER BY line_start, seq) = 1) SELECT file, name, parent, line_start FROM o ORDER BY file, line_start, seq LIMIT 5""")
def _(s, d):
    one = P.table(s, d, "part").where("p_partkey = 9").first()
    return digest.overrides(P.entities(s, d), _ninth(s, d), one["p_brand"]).select("file", "name", "parent", "line_start")


_SCORE = f"rank * CASE WHEN starts_with(file, '{PREFIX}') THEN 2.0e0 ELSE 1.0e0 END"


@reg("m06_map_files", f"WITH {P.E}, {_RANKS} SELECT file, round({_SCORE}, 6) AS score FROM RK")
def _(s, d):
    return _ROUND6(digest.map_files(P.entities(s, d), _ranks(s, d), PREFIX), "score")


@reg("m07_map_entities", f"""WITH {P.E}, {P.R}, {_BLAST}, v AS (SELECT file, E.name, line_start, seq,
(ln(df + 1.0e0) * 10 + dc) * CASE visibility WHEN 'public' THEN 1.5e0 ELSE 1.0e0 END * CASE WHEN starts_with(file, '{PREFIX}') THEN 2.0e0 ELSE 1.0e0 END AS score FROM E JOIN D ON D.name = E.name WHERE kind <> 'import')
SELECT file, name, line_start, round(score, 6) AS score FROM v QUALIFY row_number() OVER (PARTITION BY file ORDER BY round(score, 9) DESC, line_start, seq) <= 5""")
def _(s, d):
    return _ROUND6(digest.map_entities(_with_blast(s, d), PREFIX).select("file", "name", "line_start", "score"), "score")


@reg("m08_map_packed", """WITH t AS (SELECT conv_id, turn, (strlen(text) + 3) // 4 AS tokens FROM conversations),
r AS (SELECT conv_id, turn, tokens, 100 + sum(tokens) OVER w AS total, row_number() OVER w AS place FROM t WINDOW w AS (ORDER BY conv_id, turn, tokens))
SELECT conv_id, turn, CAST(total AS BIGINT) AS total FROM r WHERE total <= 4000 OR place = 1""")
def _(s, d):
    rows = P.table(s, d, "conversations").select("conv_id", "turn", S.token_estimate(F.col("text")).alias("tokens"))
    return digest.pack(rows, F.col("tokens"), ["conv_id", "turn", "tokens"]).select("conv_id", "turn", "total")


_M09 = f"""WITH RECURSIVE {P.E}, {P.R}, {_LABELS}, {_RANKS}, sc AS (SELECT file, rank AS score, (strlen(file) + 3) // 4 + 40 AS t FROM RK),
run AS (SELECT *, 100 + sum(t) OVER w AS total, row_number() OVER w AS place FROM sc WINDOW w AS (ORDER BY score DESC, file)), shown AS (SELECT run.file, score, community, string_split(regexp_extract(run.file, '^(.*)/[^/]*$', 1), '/') AS dir FROM run JOIN CM ON CM.file = run.file WHERE total <= 4000 OR place = 1),
g AS (SELECT community, count(*) AS n, min(dir) AS lo, max(dir) AS hi, min(file) AS one, list(file ORDER BY score DESC, file)[1:5] AS top FROM shown GROUP BY community),
lb AS (SELECT *, array_to_string(lo[1 : len(list_filter(range(1, len(lo) + 1), lambda i: lo[1 : i] = hi[1 : i]))], '/') AS common FROM g)
SELECT community, n AS file_count, array_to_string(top, ',') AS top, CASE WHEN n = 1 AND array_to_string(lo, '/') = '' THEN one WHEN n = 1 THEN array_to_string(lo, '/') WHEN common = '' THEN 'cross-cutting' ELSE common END AS label FROM lb"""


@reg("m09_subsystems", _M09)
def _(s, d):
    e = P.entities(s, d)
    shown = digest.pack(digest.map_files(e, _ranks(s, d)), S.token_estimate(F.col("file")) + 40, [F.desc("score"), "file"])
    return digest.subsystems(graph.communities(e, P.refs(s, d)), shown).select("community", "file_count", F.array_join("top", ",").alias("top"), "label")


@reg("m10_token_estimate", "SELECT doc_id, CAST((strlen(text) + 3) // 4 AS BIGINT) AS tokens FROM documents")
def _(s, d):
    return P.table(s, d, "documents").select("doc_id", S.token_estimate(F.col("text")).alias("tokens"))


@reg("m12_median_ratio", "SELECT round(quantile_cont(p_retailprice / p_size, 0.5), 6) AS median_ratio FROM part")
def _(s, d):
    pairs = P.table(s, d, "part").select(F.col("p_retailprice").alias("control"), F.col("p_size").alias("treatment"))
    return _ROUND6(digest.median_ratio(pairs), "median_ratio")


@reg("m13_hot_symbol", f"WITH {P.E}, {P.R}, {_BLAST} SELECT file, E.name, line_start FROM E JOIN D ON D.name = E.name WHERE kind <> 'import' ORDER BY df DESC, file DESC, line_start DESC, seq DESC LIMIT 1")
def _(s, d):
    return digest.hot_symbol(_with_blast(s, d)).select("file", "name", "line_start")


# --- V: version diff


#: Enough for the tables here: what is left of a file's kind and parent is a few names.
FUZZY_ROUNDS = 8


def _match_oracle() -> str:
    out, old, new = [], "E", "N"
    for i, (key, kind, extra) in enumerate((("file,parent,name", "exact", ""), ("parent,name", "moved", ""), ("body_hash", "renamed", " WHERE body_hash IS NOT NULL AND kind <> 'import'")), 1):
        on = " AND ".join(f"o.{k} IS NOT DISTINCT FROM n.{k}" for k in key.split(","))
        out.append(
            f"o{i} AS (SELECT * FROM {old}{extra} QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY file DESC, seq DESC) = 1), n{i} AS (SELECT * FROM {new}{extra} QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY file, seq) = 1),"
            f"m{i} AS MATERIALIZED (SELECT '{kind}' AS match, o AS old, n AS new FROM o{i} o JOIN n{i} n ON {on}),"
            f"eo{i} AS MATERIALIZED (SELECT * FROM {old} e WHERE NOT EXISTS (SELECT 1 FROM m{i} WHERE m{i}.old.seq = e.seq AND m{i}.old.file = e.file)), en{i} AS MATERIALIZED (SELECT * FROM {new} e WHERE NOT EXISTS (SELECT 1 FROM m{i} WHERE m{i}.new.seq = e.seq AND m{i}.new.file = e.file))"
        )
        old, new = f"eo{i}", f"en{i}"
    # longest common subsequences in bit rows, then the best pairs of both sides, round by round
    out.append(
        "Q AS MATERIALIZED (SELECT o AS old, n AS new, o.seq AS x, n.seq AS y, o.name AS a, n.name AS b FROM eo3 o JOIN en3 n ON o.file = n.file AND o.kind = n.kind AND o.parent IS NOT DISTINCT FROM n.parent WHERE o.kind <> 'import'),"
        "LC AS (SELECT x, y, a, b, 0 AS i, (CAST(1 AS BIGINT) << length(a)) - 1 AS v FROM Q UNION ALL SELECT x, y, a, b, i + 1, ((v + (v & m)) | (v - (v & m))) & ((CAST(1 AS BIGINT) << length(a)) - 1)"
        " FROM (SELECT *, CAST(list_sum(list_transform(range(length(a)), lambda k: CASE WHEN a[k + 1] = b[i + 1] THEN CAST(1 AS BIGINT) << k ELSE 0 END)) AS BIGINT) AS m FROM LC WHERE i < length(b))),"
        "G0 AS MATERIALIZED (SELECT x, y, s FROM (SELECT x, y, CAST(CAST(2 * (length(a) - bit_count(v)) AS FLOAT) / CAST(length(a) + length(b) AS FLOAT) AS DOUBLE) AS s FROM LC WHERE i = length(b)) WHERE s >= 0.6)"
    )
    for i in range(1, FUZZY_ROUNDS + 1):
        out.append(
            f"T{i} AS MATERIALIZED (SELECT * FROM G{i - 1} QUALIFY row_number() OVER (PARTITION BY x ORDER BY s DESC, y) = 1 AND row_number() OVER (PARTITION BY y ORDER BY s DESC, x) = 1),"
            f"G{i} AS MATERIALIZED (SELECT * FROM G{i - 1} WHERE x NOT IN (SELECT x FROM T{i}) AND y NOT IN (SELECT y FROM T{i}))"
        )
    out.append(f"FZ AS ({' UNION ALL '.join(f'SELECT * FROM T{i}' for i in range(1, FUZZY_ROUNDS + 1))}), m4 AS MATERIALIZED (SELECT 'renamed' AS match, old, new, s FROM FZ JOIN Q USING (x, y))")
    return ", ".join(out) + """, M AS (SELECT *, 1.0e0 AS confidence FROM m1 WHERE old.struct_hash <> new.struct_hash UNION ALL SELECT *, 1.0e0 FROM m2 UNION ALL SELECT *, 1.0e0 FROM m3 UNION ALL SELECT * FROM m4
UNION ALL SELECT 'removed', e, NULL, 1.0e0 FROM eo3 e WHERE seq NOT IN (SELECT x FROM FZ) UNION ALL SELECT 'added', NULL, e, 1.0e0 FROM en3 e WHERE seq NOT IN (SELECT y FROM FZ)),
F1 AS (SELECT *, old.sig_hash IS DISTINCT FROM new.sig_hash AS sc, old.body_hash IS DISTINCT FROM new.body_hash AS bc, coalesce(old.parent IS NULL AND old.kind <> 'import', false) AS pub FROM M),
DF AS MATERIALIZED (SELECT CASE WHEN match = 'exact' THEN CASE WHEN sc OR bc THEN 'modified' ELSE 'formatting_only' END ELSE match END AS change,
coalesce(new.name, old.name) AS name, coalesce(new.kind, old.kind) AS kind, coalesce(new.file, old.file) AS file, CASE WHEN match = 'moved' OR (match = 'renamed' AND old.file <> new.file) THEN old.file END AS old_file,
CASE WHEN match = 'renamed' THEN old.name END AS old_name, CASE WHEN match IN ('exact','moved') AND (sc OR bc) THEN sc END AS sig_changed, CASE WHEN match IN ('exact','moved') AND (sc OR bc) THEN bc END AS body_changed,
CASE WHEN match IN ('removed','renamed') THEN pub WHEN match IN ('exact','moved') THEN pub AND sc ELSE false END AS breaking, coalesce(new.line_start, old.line_start) AS line, match, old, new FROM F1),
DR AS (SELECT *, CASE WHEN breaking THEN CASE match WHEN 'removed' THEN 'public entity removed' WHEN 'renamed' THEN 'public entity renamed' WHEN 'moved' THEN 'moved with signature change' ELSE 'public signature changed' END END AS reason FROM DF),
SH AS MATERIALIZED (SELECT *, change = 'moved' AND coalesce(old_file <> file, false) AS cross_file_move FROM DR),
SV AS MATERIALIZED (SELECT * EXCLUDE (change), CASE WHEN change = 'moved' AND NOT cross_file_move THEN 'modified' ELSE change END AS change, change AS as_change FROM SH)"""


_DIFF = f"WITH RECURSIVE {P.VERSIONS}, {_match_oracle()}"


def _diffs(s, d):
    return diff.classify(diff.match(P.entities(s, d), P.newer(s, d)))


@reg("v05_entity_match", _DIFF + " SELECT match, old.file AS old_file, old.seq AS old_seq, new.file AS new_file, new.seq AS new_seq FROM M")
def _(s, d):
    m = diff.match(P.entities(s, d), P.newer(s, d))
    return m.select("match", F.col("old.file").alias("old_file"), F.col("old.seq").alias("old_seq"), F.col("new.file").alias("new_file"), F.col("new.seq").alias("new_seq"))


_CLASS = ("change", "name", "kind", "file", "old_file", "old_name", "sig_changed", "body_changed", "breaking", "reason", "line")


@reg("v07_classified", _DIFF + f" SELECT {', '.join(_CLASS)} FROM DR")
def _(s, d):
    return _diffs(s, d).select(*_CLASS)


@reg("v09_summary", _DIFF + " SELECT " + ", ".join(f"count(*) FILTER (WHERE change = '{k}') AS {k}" for k in ("added", "removed", "modified", "moved", "renamed", "formatting_only")) + ", coalesce(bool_or(breaking), false) AS has_breaking FROM DR")
def _(s, d):
    return diff.summary(_diffs(s, d))


_PAT = "PT AS MATERIALIZED (SELECT change, regexp_extract(name, '[^.]*$') AS base, count(DISTINCT file) AS file_count, count(*) AS entity_count FROM DR WHERE change <> 'formatting_only' GROUP BY 1, 2 HAVING count(DISTINCT file) >= 2)"


@reg("v10_patterns", _DIFF + f", {_PAT} SELECT * FROM PT")
def _(s, d):
    return diff.patterns(_diffs(s, d))


@reg("v16_file_sections", _DIFF + " SELECT file, " + ", ".join(f"count(*) FILTER (WHERE change = '{k}') AS {k}" for k in ("added", "removed", "modified", "renamed", "formatting_only")) + ", count(*) FILTER (WHERE breaking) AS breaking FROM SV WHERE NOT cross_file_move GROUP BY file")
def _(s, d):
    return diff.file_sections(diff.visible(_diffs(s, d)))


@reg("v16_moves", _DIFF + """ SELECT name, kind, old_file AS from_file, file AS to_file, old.line_start AS from_line, new.line_start AS to_line, breaking,
CASE WHEN (sig_changed IS NULL AND body_changed IS NULL) OR (NOT sig_changed AND NOT body_changed) THEN 1.0e0 WHEN sig_changed <> body_changed THEN 0.8e0 ELSE 0.6e0 END AS confidence FROM SV WHERE cross_file_move""")
def _(s, d):
    return diff.moves(diff.visible(_diffs(s, d)))


@reg("v21_breaking_callers", f"""WITH RECURSIVE {P.VERSIONS}, {_match_oracle()}, {P.R}, u AS (SELECT R.name, R.file, R.line, R.seq, coalesce(R.caller, '') AS who, R.file IN (SELECT file FROM SV) AS inside FROM R WHERE R.name IN (SELECT name FROM SV WHERE breaking) QUALIFY row_number() OVER (PARTITION BY R.name ORDER BY R.file, line, seq) <= 100),
c AS (SELECT name, count(*) FILTER (WHERE inside) AS i, count(*) FILTER (WHERE NOT inside) AS x, string_agg(file || ':' || line || ':' || who, ',' ORDER BY file, line, seq) FILTER (WHERE NOT inside) AS l FROM u GROUP BY name)
SELECT SV.name, kind, file, line, reason, coalesce(i, 0) AS callers_in_diff, coalesce(x, 0) AS external_callers, coalesce(l, '') AS external FROM SV LEFT JOIN c ON c.name = SV.name WHERE breaking""")
def _(s, d):
    rows = diff.breaking_callers(diff.visible(_diffs(s, d)), P.refs(s, d))
    return rows.withColumn("external", F.expr("array_join(transform(external, x -> x.file || ':' || x.line || ':' || x.name), ',')"))


@reg("v22_groups", _DIFF + f""", {_PAT}, g AS (SELECT SV.*, regexp_extract(name, '[^.]*$') AS base, PT.change IS NOT NULL AS hit FROM SV LEFT JOIN PT ON PT.change = as_change AND PT.base = regexp_extract(name, '[^.]*$') WHERE NOT cross_file_move)
SELECT 'pattern' AS by, as_change || ':' || base AS key, count(*) AS entities, count(DISTINCT file) AS files, base || ' (pattern across ' || count(DISTINCT file) || ' files)' AS label FROM g WHERE hit GROUP BY as_change, base
UNION ALL SELECT 'file', file, count(*), 1, array_to_string(list(name ORDER BY line, name, change)[1:3], ', ') || CASE WHEN count(*) > 3 THEN ' +' || (count(*) - 3) || ' more' ELSE '' END || ' in ' || file FROM g WHERE NOT hit AND change <> 'formatting_only' GROUP BY file""")
def _(s, d):
    d_ = _diffs(s, d)
    return diff.groups(diff.visible(d_), diff.patterns(d_))


@reg("v20_report", _DIFF + f""", {_PAT}, cn AS (SELECT count(*) FILTER (WHERE NOT cross_file_move AND change = 'added') AS added, count(*) FILTER (WHERE NOT cross_file_move AND change = 'modified') AS modified, count(*) FILTER (WHERE NOT cross_file_move AND change = 'removed') AS removed,
count(*) FILTER (WHERE NOT cross_file_move AND change = 'renamed') AS renamed, count(*) FILTER (WHERE NOT cross_file_move AND change = 'formatting_only') AS formatting_only, count(*) FILTER (WHERE cross_file_move) AS moves, count(DISTINCT file) AS files_changed, count(*) FILTER (WHERE breaking) AS breaking, (SELECT count(*) FROM PT) AS patterns FROM SV)
SELECT *, CASE WHEN added + modified + removed + renamed + formatting_only + moves + patterns = 0 THEN 'No structural changes.' ELSE concat_ws(', ', CASE WHEN patterns > 0 THEN patterns || ' cross-file pattern' || CASE WHEN patterns = 1 THEN '' ELSE 's' END END,
CASE WHEN moves > 0 THEN moves || ' entity move' || CASE WHEN moves = 1 THEN '' ELSE 's' END END, CASE WHEN added > 0 THEN added || ' added' END, CASE WHEN modified > 0 THEN modified || ' modified' END, CASE WHEN removed > 0 THEN removed || ' removed' END, CASE WHEN renamed > 0 THEN renamed || ' renamed' END,
CASE WHEN formatting_only > 0 THEN formatting_only || ' formatting only' END) || CASE WHEN breaking > 0 THEN ' with breaking changes' ELSE '' END || '.' END AS natural_language FROM cn""")
def _(s, d):
    d_ = _diffs(s, d)
    return diff.report(diff.visible(d_), diff.patterns(d_))


@reg("v04_fuzzy_renames", _DIFF + " SELECT old.name AS old_name, new.name AS new_name, round(confidence, 6) AS confidence FROM M WHERE match = 'renamed'")
def _(s, d):
    m = diff.match(P.entities(s, d), P.newer(s, d))
    return m.where("match = 'renamed'").select(F.col("old.name").alias("old_name"), F.col("new.name").alias("new_name"), F.round("confidence", 6).alias("confidence"))


def _versions_of_text(s, d):
    """Documents as a file each, and an edited copy of them."""
    old = P.table(s, d, "documents").select(F.concat(F.lit("d"), F.col("doc_id")).alias("file"), F.replace("text", F.lit(". "), F.lit(".\n")).alias("text"))
    new = old.withColumn("text", F.regexp_replace("text", r"\bthe\b", "The"))
    e = F.struct(F.col("file"), F.lit(1).cast("long").alias("line_start"), F.size(F.split("text", "\n")).cast("long").alias("line_end"))
    return old.select(e.alias("old"), e.alias("new"), "file"), old, new


# Each line with the word is removed and added again; no other line can match it.
_V11 = r"""WITH l AS (SELECT 'd' || doc_id AS file, string_split(regexp_replace(regexp_replace(replace(text, '. ', '.' || chr(10)), '\r?\n$', ''), '\r\n', chr(10), 'g'), chr(10)) AS l FROM documents),
c AS (SELECT file, list_filter(l, lambda x: regexp_matches(x, '\bthe\b')) AS gone FROM l)
SELECT file, CASE WHEN len(gone) > 0 THEN len(gone) END AS removed, CASE WHEN len(gone) > 0 THEN len(gone) END AS added, CASE WHEN len(gone) > 0 THEN sha256(array_to_string(gone, chr(10))) END AS text FROM c"""


@reg("v11_line_diff", _V11)
def _(s, d):
    rows, old, new = _versions_of_text(s, d)
    lines = diff.with_text_changes(rows, old, new).select("file", "lines")
    n = lambda k: F.size(F.filter("lines", lambda x: x["kind"] == k)).cast("long").alias(k)
    gone = F.transform(F.filter("lines", lambda x: x["kind"] == "removed"), lambda x: x["text"])
    return lines.select("file", n("removed"), n("added"), F.sha2(F.array_join(gone, "\n"), 256).alias("text"))


@reg("v12_hunks")
def _(s, d):
    rows, old, new = _versions_of_text(s, d)
    return diff.with_text_changes(rows, old, new, context=1).select("file", F.size("lines").alias("lines"))


_V19 = r"""WITH l AS (SELECT 'd' || doc_id AS file, regexp_replace(regexp_replace(replace(text, '. ', '.' || chr(10)), '\r?\n$', ''), '\r\n', chr(10), 'g') AS base FROM documents)
SELECT file, sha256(base) AS base, sha256(regexp_replace(base, '\bthe\b', 'The', 'g')) AS head, file AS language, 'diff' AS kind FROM l"""


@reg("v19_snippets", _V19)
def _(s, d):
    rows, old, new = _versions_of_text(s, d)
    rows = rows.withColumns({"sig_changed": F.lit(False), "body_changed": F.lit(True), "change": F.lit("modified")})
    x = F.col("snippet")
    return diff.with_snippets(rows, old, new).select("file", F.sha2(x["base"], 256).alias("base"), F.sha2(x["head"], 256).alias("head"), x["language"].alias("language"), x["kind"].alias("kind"))


@reg("v15_change_details")
def _(s, d):
    rows, old, new = _versions_of_text(s, d)
    out = diff.token_changes(diff.with_text_changes(rows, old, new))
    return out.select("file", F.explode("token_changes").alias("t")).groupBy("t.kind").agg(F.count("*").alias("n"))


# --- W: review


def _enriched(s, d):
    return review.enrich(diff.visible(_diffs(s, d)), _ranks(s, d), _with_blast(s, d))


_ENRICH = f"""WITH RECURSIVE {P.VERSIONS}, {_match_oracle()}, {P.R}, {_BLAST}, {_RANKS}, bk AS MATERIALIZED (SELECT file, E.name, parent, any_value(dc) AS dc, any_value(df) AS df FROM E JOIN D ON D.name = E.name GROUP BY 1, 2, 3),
EN AS MATERIALIZED (SELECT SV.*, coalesce(b.df, c.df, 0) AS direct_files, coalesce(b.dc, c.dc, 0) AS direct_callers, coalesce(rank, 0) AS rank,
coalesce(rank, 0) * (ln(1 + coalesce(b.df, c.df, 0)) + 1) * CASE WHEN breaking THEN 3.0e0 ELSE 1.0e0 END AS impact
FROM SV LEFT JOIN RK ON RK.file = SV.file LEFT JOIN bk b ON b.file = new.file AND b.name = new.name AND b.parent IS NOT DISTINCT FROM new.parent
LEFT JOIN bk c ON c.file = old.file AND c.name = old.name AND c.parent IS NOT DISTINCT FROM old.parent)"""


@reg("w01_review_enriched", _ENRICH + " SELECT change, name, file, line, direct_files, direct_callers, round(impact, 6) AS impact FROM EN")
def _(s, d):
    return _ROUND6(_enriched(s, d).select("change", "name", "file", "line", "direct_files", "direct_callers", "impact"), "impact")


@reg("w02_most_impactful", _ENRICH + " SELECT change, name, file, line, round(impact, 6) AS impact FROM EN WHERE kind <> 'import' ORDER BY round(EN.impact, 12) DESC, file, line, name, change LIMIT 5")
def _(s, d):
    return _ROUND6(review.most_impactful(_enriched(s, d)).select("change", "name", "file", "line", "impact"), "impact")


@reg("w03_file_deltas", _ENRICH + " SELECT file, round(max(rank), 6) AS rank, count(*) AS changes, count(*) FILTER (WHERE breaking) AS breaking FROM EN GROUP BY file")
def _(s, d):
    return _ROUND6(review.file_deltas(_enriched(s, d)), "rank")


@reg("w04_cochange_misses", f"""WITH {P.COMMITS}, {_pairs_sql(30)}, t AS (SELECT DISTINCT file FROM C WHERE CAST(substr(file, 2) AS BIGINT) % 3 = 0),
b AS (SELECT a AS file, b AS partner, weight, support FROM PW UNION ALL SELECT b, a, weight, support FROM PW),
top AS (SELECT * FROM b WHERE file IN (SELECT file FROM t) QUALIFY row_number() OVER (PARTITION BY file ORDER BY round(weight, 12) DESC, partner) <= 3)
SELECT file, partner AS expected_partner, round(weight, 6) AS weight, support FROM top WHERE weight >= 0.05 AND partner NOT IN (SELECT file FROM t)""")
def _(s, d):
    c = P.commits(s, d)
    return _ROUND6(review.cochange_misses(c.where(F.substring("file", 2, 9).cast("long") % 3 == 0), graph.cochange_pairs(c), least=0.05), "weight")


# --- H and SC: fingerprints and scalars

_WS = r"[ \t\n\r\f\x0B]+"


@reg("h03_body_hash_raw", rf"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '{_WS}', ' ', 'g'))), lambda x: x <> '') AS l FROM documents)
SELECT doc_id, CASE WHEN len(l) > 0 THEN substr(sha256(array_to_string(l, chr(10))), 1, 16) END AS body_hash FROM l""")
def _(s, d):
    return P.table(s, d, "documents").select("doc_id", fingerprint.body_hash_raw(F.col("text")).alias("body_hash"))


# A line's number of triple quotes at its start decides the fold: a recursion over the lines of texts that hold any.
_H2 = (
    r"""WITH RECURSIVE l AS (SELECT doc_id, list_transform(string_split(regexp_replace(text, '\r\n', chr(10), 'g'), chr(10)), lambda x: trim(regexp_replace(x, '%s', ' ', 'g'))) AS l FROM documents),
p AS (SELECT *, contains(array_to_string(l, chr(10)), repeat(chr(34), 3)) OR contains(array_to_string(l, chr(10)), repeat(chr(39), 3)) AS quoted FROM l),
f AS (SELECT doc_id, l, 0 AS i, '' AS o, CAST([] AS VARCHAR[]) AS kept FROM p WHERE quoted
UNION ALL SELECT doc_id, l, i + 1, CASE WHEN o <> '' THEN CASE WHEN contains(x, o) THEN '' ELSE o END WHEN q <> '' AND contains(substr(x, 4), q) THEN '' ELSE q END,
CASE WHEN o <> '' OR q <> '' OR x = '' OR regexp_matches(x, '^(//|#|/\*|\*)') THEN kept ELSE list_append(kept, x) END
FROM (SELECT *, l[i + 1] AS x, CASE WHEN starts_with(l[i + 1], repeat(chr(34), 3)) THEN repeat(chr(34), 3) WHEN starts_with(l[i + 1], repeat(chr(39), 3)) THEN repeat(chr(39), 3) ELSE '' END AS q FROM f WHERE i < len(l))),
k AS (SELECT doc_id, kept FROM f WHERE i = len(l) UNION ALL SELECT doc_id, list_filter(l, lambda x: x <> '' AND NOT regexp_matches(x, '^(//|#|/\*|\*)')) FROM p WHERE quoted IS DISTINCT FROM true)
SELECT doc_id, CASE WHEN len(kept) > 0 THEN substr(sha256(array_to_string(kept, chr(10))), 1, 16) END AS body_hash FROM k"""
    % _WS
)


@reg("h02_body_hash", _H2)
def _(s, d):
    return P.table(s, d, "documents").select("doc_id", fingerprint.body_hash(F.col("text")).alias("body_hash"))


@reg("h04_sig_hash", f"WITH {P.E} SELECT seq, substr(sha256(trim(regexp_replace(sig, '{_WS}', ' ', 'g'))), 1, 16) AS sig_hash FROM E")
def _(s, d):
    return P.entities(s, d).select("seq", fingerprint.sig_hash(F.col("sig")).alias("sig_hash"))


@reg("h07_file_hash", "SELECT doc_id, sha256(text) AS file_hash FROM documents")
def _(s, d):
    return P.table(s, d, "documents").select("doc_id", fingerprint.file_hash(F.col("text")).alias("file_hash"))


@reg("sc_tail_segment", r"SELECT page_id, regexp_extract(url, '([^:.]*)$', 1) AS tail FROM pages")
def _(s, d):
    return P.table(s, d, "pages").select("page_id", S.tail_segment(F.col("url")).alias("tail"))


@reg("sc_parent_dir", "SELECT page_id, regexp_extract(url, '^(?s)(.*)/[^/]*$', 1) AS dir FROM pages")
def _(s, d):
    return P.table(s, d, "pages").select("page_id", S.parent_dir(F.col("url")).alias("dir"))


@reg("sc_lang_for", f"WITH {P.E} SELECT seq, {LANG} AS lang FROM E")
def _(s, d):
    return P.entities(s, d).select("seq", S.lang_for(F.col("file")).alias("lang"))


@reg("sc_is_test_path", f"WITH {P.E}, f AS (SELECT seq, CASE seq % 4 WHEN 0 THEN 'tests/' || file WHEN 1 THEN replace(file, '.rs', '_test.rs') WHEN 2 THEN replace(file, '/', '\\') ELSE file END AS file FROM E) SELECT seq, starts_with(file, 'tests/') OR ends_with(file, '_test.rs') AS test FROM f")
def _(s, d):
    f = F.expr(r"CASE seq % 4 WHEN 0 THEN 'tests/' || file WHEN 1 THEN replace(file, '.rs', '_test.rs') WHEN 2 THEN replace(file, '/', '\\') ELSE file END")
    return P.entities(s, d).select("seq", S.is_test_path(f).alias("test"))


# --- X: extractors


@reg("x12_json_entities", """SELECT 'events/' || event_id || '.json' AS file, k.key AS name, 'property' AS kind, CAST(1 AS BIGINT) AS line_start FROM events, (SELECT unnest(json_keys(CAST(props AS JSON))) AS key, event_id AS id FROM events) k WHERE k.id = event_id""")
def _(s, d):
    src = P.table(s, d, "events").select(F.concat(F.lit("events/"), F.col("event_id"), F.lit(".json")).alias("file"), F.col("props").alias("text"))
    return extract.entities(src).select("file", "name", "kind", "line_start")


_X11 = r"""WITH p AS (SELECT page_id, string_split(regexp_replace(coalesce(html, ''), '(?is)(<script\b[^>]*>.*?</script\s*>)', chr(1) || '\1' || chr(1), 'g'), chr(1)) AS s FROM pages),
m AS (SELECT page_id, s[2 * i] AS t, array_to_string(s[1 : 2 * i - 1], '') AS before FROM (SELECT page_id, s, unnest(range(1, len(s) // 2 + 1)) AS i FROM p)),
h AS (SELECT page_id, before || regexp_extract(t, '(?i)^<script\b[^>]*>') AS upto, regexp_extract(t, '(?i)^<script\b[^>]*>') AS tag FROM m)
SELECT page_id, CASE WHEN regexp_matches(tag, '(?i)lang\s*=\s*[\x22\x27]?(ts|tsx|typescript)\b') THEN 'typescript' ELSE 'javascript' END AS language, CAST(1 + length(upto) - length(replace(upto, chr(10), '')) AS BIGINT) AS line FROM h"""


@reg("x11_script_blocks", _X11)
def _(s, d):
    def run(batches):
        for b in batches:
            rows = [(i, language, before + 1) for i, t in zip(b.column("page_id").to_pylist(), b.column("html").to_pylist()) for language, _, before in documents.script_blocks(t or "", "html")]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.int64()))], ["page_id", "language", "line"])

    return P.table(s, d, "pages").select(F.col("page_id").cast("long").alias("page_id"), "html").mapInArrow(run, "page_id long, language string, line long")


_X11_CALLS = _X11[: _X11.index("SELECT page_id, CASE WHEN regexp_matches(tag")].rstrip().removesuffix(",") + r""",
b AS (SELECT page_id, before || regexp_extract(t, '(?i)^<script\b[^>]*>') AS upto, string_split(regexp_replace(t, '(?is)(^<script\b[^>]*>|</script\s*>$)', '', 'g'), chr(10)) AS l FROM m),
c AS (SELECT page_id, length(upto) - length(replace(upto, chr(10), '')) + i AS line, regexp_extract_all(l[i], '([A-Za-z_]\w*)\(', 1) AS names FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM b))
SELECT 'p' || page_id || '.html' AS file, unnest(names) AS name, 'call' AS kind, CAST(line AS BIGINT) AS line FROM c"""


@reg("x11_sfc_refs", _X11_CALLS)
def _(s, d):
    src = P.table(s, d, "pages").select(F.concat(F.lit("p"), F.col("page_id"), F.lit(".html")).alias("file"), F.col("html").alias("text"))
    return extract.references(src).select("file", "name", "kind", "line")


@reg("x15_markdown_entities")
def _(s, d):
    src = P.table(s, d, "documents").select(F.concat(F.lit("d"), F.col("doc_id"), F.lit(".md")).alias("file"), "text")
    return extract.entities(src).select("file", "name", "kind", "line_start", "line_end")
