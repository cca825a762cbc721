"""The driver's tables seen as entities, references, commits and versions, so that every operator has data and an oracle.

Each projection is a list of SQL expressions that Spark and DuckDB both understand (``{sha}`` is the one that differs).
"""

from __future__ import annotations

import json
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.schema import ENTITY_SCHEMA, REF_SCHEMA, conform
from symloom.storage import stored

_NAME = "replace(p_name, ' ', '_') || '_' || CAST(p_partkey % 10 AS STRING)"
_FILE = "'src/' || p_brand || '/' || replace(p_type, ' ', '_') || CASE WHEN p_partkey % 4 = 0 THEN '.py' ELSE '.rs' END"
_KINDS = ["function", "method", "class", "struct", "enum", "interface", "constant", "import"]
_KIND = "CASE p_size % 8 " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(_KINDS)) + " END"

ENTITY = {
    "file": _FILE,
    "name": _NAME,
    "kind": _KIND,
    "line_start": "p_partkey",
    "line_end": "p_partkey + p_size % 12",
    "parent": "CASE WHEN p_partkey % 3 = 0 THEN p_brand END",
    "sig": f"CASE WHEN p_size % 8 <> 7 THEN {_NAME} || '(' || CAST(p_size AS STRING) || ')' END",
    "body_hash": "CASE WHEN p_partkey % 5 <> 4 THEN substr({sha}(p_name || CAST(p_size % 4 AS STRING)), 1, 16) END",
    "sig_hash": f"CASE WHEN p_size % 8 <> 7 THEN substr({{sha}}({_NAME} || CAST(p_size AS STRING)), 1, 16) END",
    "struct_hash": "substr({sha}(p_name || CAST(p_partkey AS STRING)), 1, 16)",
    "visibility": "CASE p_partkey % 4 WHEN 0 THEN 'public' WHEN 1 THEN 'internal' WHEN 2 THEN 'private' END",
    "seq": "p_partkey",
}
_ORDER = "PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice"
REF = {
    "file": f"coalesce(lag({_FILE}) OVER ({_ORDER}), {_FILE})",
    "caller": f"lag({_NAME}) OVER ({_ORDER})",
    "name": _NAME,
    "kind": "CASE l_returnflag WHEN 'R' THEN 'call' WHEN 'A' THEN 'type_annotation' ELSE 'instantiation' END",
    "line": "CAST(l_linenumber AS BIGINT)",
    "seq": "l_orderkey * 100000000 + l_partkey * 100 + l_linenumber",
}
#: The newer version: by key some rows go, others are renamed, moved, changed or reformatted.
NEWER = {
    "file": "CASE WHEN seq % 13 = 0 THEN replace(file, '/', '/new/') ELSE file END",
    "name": "CASE WHEN seq % 11 = 0 THEN name || '_v2' ELSE name END",
    "kind": "kind",
    "line_start": "line_start",
    "line_end": "line_end",
    "parent": "parent",
    "sig": "sig",
    "body_hash": "CASE WHEN seq % 23 = 0 THEN 'b' || struct_hash ELSE body_hash END",
    "sig_hash": "CASE WHEN seq % 17 = 0 THEN 's' || struct_hash ELSE sig_hash END",
    "struct_hash": "CASE WHEN seq % 17 = 0 OR seq % 19 = 0 OR seq % 23 = 0 THEN 'n' || struct_hash ELSE struct_hash END",
    "visibility": "visibility",
    "seq": "seq",
}
ADDED = NEWER | {"file": "file", "name": "name || '_new'", "body_hash": "CAST(NULL AS STRING)", "seq": "seq + 100000000"}


def _sql(columns: dict[str, str], sha: str) -> list[str]:
    return [f"{e.replace('{sha}', sha)} AS {c}" for c, e in columns.items()]


def _spark(columns: dict[str, str]) -> list[str]:
    out = []
    for c, e in columns.items():
        # sha2 takes the length as a second argument
        while "{sha}(" in e:
            at = e.index("{sha}(")
            depth, i = 1, at + 6
            while depth:
                depth += {"(": 1, ")": -1}.get(e[i], 0)
                i += 1
            e = e[:at] + "sha2(" + e[at + 6 : i - 1] + ", 256)" + e[i:]
        out.append(f"{e} AS {c}")
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_store: dict[tuple[str, str, str], DataFrame] = {}


def _once(spark: SparkSession, sf_dir: str, name: str, make) -> DataFrame:
    """The relation as an index keeps it: written once by an application, then only read."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _store:
        _store[key] = stored(make(), name)
    return _store[key]


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sorted by file."""
    order = (F.expr(ENTITY["file"]), F.expr(ENTITY["seq"]))
    # the table's own columns are ordered, for which they are sampled first; hashes are made once, behind it
    rows = lambda: table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size").repartitionByRange(*order).sortWithinPartitions(*order)
    return _once(spark, sf_dir, "entities", lambda: conform(rows().selectExpr(*_spark(ENTITY)), ENTITY_SCHEMA))


#: Distinct names, or files, up to which references are ordered by numbers that stand for them.
DICTIONARY = 10_000
#: References that one task orders, about.
TASK_ROWS = 500_000


def _refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    rows = table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).selectExpr(*_spark(REF))
    return conform(rows, REF_SCHEMA)


def _texts(spark: SparkSession, sf_dir: str, expression: str) -> list[str] | None:
    """The sorted texts of an expression over ``part``; none if there are more than ``DICTIONARY``."""
    rows = table(spark, sf_dir, "part").selectExpr(f"{expression} AS x").where("x is not null").distinct()
    texts = [r[0] for r in rows.limit(DICTIONARY + 1).collect()]
    return sorted(texts, key=lambda x: x.encode()) if len(texts) <= DICTIONARY else None


def _places(line: DataFrame, part: DataFrame, names: int, files: int) -> tuple[F.Column, int]:
    """(task of a row with ``n``, ``f`` and ``seq``, tasks): rows by (n, f, seq) cut into equal tasks.

    The cuts come from the counts of names and of files and the range of ``seq``, so nothing is sampled, for which all rows
    would be made twice. A missing text counts as the last. Rounding keeps order, so the tasks follow one another.
    """
    used = line.join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.coalesce("n", F.lit(names)).alias("n"), F.coalesce("f", F.lit(files)).alias("f"), F.expr(REF["seq"]).alias("seq"))
    found = used.groupingSets([["n"], ["f"]], "n", "f").agg(F.count("*").alias("rows"), F.min("seq").alias("lo"), F.max("seq").alias("hi")).collect()
    by_name, by_file = [0] * (names + 1), [0] * (files + 1)
    for r in found:
        if r["n"] is not None:
            by_name[r["n"]] = r["rows"]
        else:
            by_file[r["f"]] = r["rows"]
    total = sum(by_name)
    if total <= TASK_ROWS:
        return F.lit(0), 1
    lo, hi = min(r["lo"] for r in found), max(r["hi"] for r in found)
    share = [x / total for x in by_file]
    starts, below = [0, *accumulate(by_name)], [0.0, *accumulate(share)]
    at = lambda values, kind, x, last: F.get(F.from_json(F.lit(json.dumps(values)), f"array<{kind}>"), F.coalesce(x, F.lit(last)))
    of_file = at(below, "double", "f", files) + at(share, "double", "f", files) * ((F.col("seq") - lo) / float(hi - lo + 1))
    place = at(starts, "double", "n", names) + at(by_name, "double", "n", names) * F.least(of_file, F.lit(1.0))
    tasks = -(-total // TASK_ROWS)
    return F.least(F.floor(place / float(TASK_ROWS)), F.lit(tasks - 1)).cast("int"), tasks


def _sorted_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References by (name, file, seq). Few names and files go through the shuffles and sorts as their places in the
    sorted lists of them, which gives the same order in narrow rows."""
    names, files = _texts(spark, sf_dir, _NAME), _texts(spark, sf_dir, _FILE)
    if names is None or files is None:
        return _refs(spark, sf_dir).repartitionByRange("name", "file", "seq").sortWithinPartitions("name", "file", "seq")
    listed = lambda texts: F.from_json(F.lit(json.dumps(texts)), "array<string>")  # noqa: E731, a constant of the plan
    numbers = lambda texts, x, n: F.broadcast(spark.range(1).select(F.posexplode(listed(texts)).alias(n, x)))  # noqa: E731, at most DICTIONARY rows
    part = table(spark, sf_dir, "part").selectExpr("p_partkey", f"{_NAME} AS name", f"{_FILE} AS file")
    part = part.join(numbers(names, "name", "n"), "name", "left").join(numbers(files, "file", "f"), "file", "left").select("p_partkey", "n", "f")
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_returnflag", "l_shipdate")
    rows = line.join(part, F.col("l_partkey") == F.col("p_partkey"))
    rows = rows.selectExpr(f"coalesce(lag(f) OVER ({_ORDER}), f) AS f", f"lag(n) OVER ({_ORDER}) AS c", "n", "l_returnflag", "l_linenumber", f"{REF['seq']} AS seq")
    task, tasks = _places(line, part, len(names), len(files))
    rows = rows.repartitionById(tasks, task).sortWithinPartitions(F.asc_nulls_last("n"), F.asc_nulls_last("f"), "seq")
    text = lambda texts, x: F.get(listed(texts), F.col(x))
    rows = rows.select(text(files, "f").alias("file"), text(names, "c").alias("caller"), text(names, "n").alias("name"), F.expr(REF["kind"]).alias("kind"), F.expr(REF["line"]).alias("line"), "seq")
    return conform(rows, REF_SCHEMA)


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sorted by name, so a lookup reads few row groups; a name that fills many rows is split over partitions."""
    return _once(spark, sf_dir, "refs", lambda: _sorted_refs(spark, sf_dir))


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("commit"), F.format_string("p%05d", "l_partkey").alias("file"))


def file_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as commits that touch the parts' files."""
    part = table(spark, sf_dir, "part").selectExpr("p_partkey", f"{_FILE} AS file")
    return table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").cast("string").alias("commit"), "file")


def newer(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = entities(spark, sf_dir)
    return conform(e.where("seq % 7 <> 0").selectExpr(*_spark(NEWER)).unionByName(e.where("seq % 29 = 0").selectExpr(*_spark(ADDED))), ENTITY_SCHEMA)


E = f"E AS (SELECT {', '.join(_sql(ENTITY, 'sha256'))} FROM part)"
_JOINED = "(SELECT l.*, p.p_partkey, p.p_name, p.p_brand, p.p_type FROM lineitem l JOIN part p ON l_partkey = p_partkey)"
R = f"R AS (SELECT {', '.join(_sql(REF, 'sha256'))} FROM {_JOINED})"
COMMITS = "C AS (SELECT DISTINCT CAST(l_orderkey AS STRING) AS commit, printf('p%05d', l_partkey) AS file FROM lineitem)"
FILE_COMMITS = f"C AS (SELECT DISTINCT CAST(l_orderkey AS STRING) AS commit, {_FILE} AS file FROM lineitem JOIN part ON l_partkey = p_partkey)"
VERSIONS = f"{E}, N AS (SELECT {', '.join(_sql(NEWER, 'sha256'))} FROM E WHERE seq % 7 <> 0 UNION ALL SELECT {', '.join(_sql(ADDED, 'sha256'))} FROM E WHERE seq % 29 = 0)"
