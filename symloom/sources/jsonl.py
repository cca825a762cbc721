"""Stored relations: JSON lines and Parquet (S4-S9, K1-K4), always with a fixed schema, never inferred."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.schema import ENTITY_SCHEMA, PAIR_SCHEMA, RANK_SCHEMA, REF_SCHEMA, conform, empty

ENTITIES, REFS, RANK, COCHANGE, STAMP = "entities.jsonl", "refs.jsonl", "rank.json", "cochange.json", "stamp.json"


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm)


def read_entities(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """S4; a broken line is an error, or skipped where not strict (incremental loads)."""
    rows = spark.read.schema(ENTITY_SCHEMA).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)
    # what was left out on writing: "private" and all-zero blasts
    return rows


def read_refs(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """``kind`` or, in old files, ``ref_kind``; a missing file is an empty table."""
    if not _exists(spark, path):
        return empty(spark, REF_SCHEMA)
    from pyspark.sql.types import StringType, StructType

    schema = StructType(list(REF_SCHEMA)).add("ref_kind", StringType())
    rows = spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)
    return conform(rows.withColumn("kind", F.coalesce("kind", "ref_kind")), REF_SCHEMA)


def write_entities(E: DataFrame, path: str) -> None:
    """K1: one JSON object a line; nulls, "private" and all-zero blasts are left out."""
    b = F.col("blast_radius")
    some = (b["direct_callers"] > 0) | (b["direct_files"] > 0) | (b["transitive_callers"] > 0)
    rows = conform(E, ENTITY_SCHEMA).withColumns({"visibility": F.when(F.col("visibility") != "private", F.col("visibility")), "blast_radius": F.when(some, b)})
    rows.write.mode("overwrite").option("ignoreNullFields", "true").json(path)


def write_refs(R: DataFrame, path: str) -> None:
    """K1: only written if there are any."""
    if not R.isEmpty():
        conform(R, REF_SCHEMA).write.mode("overwrite").option("ignoreNullFields", "true").json(path)


def hits_json(E: DataFrame, with_hashes: bool = False) -> DataFrame:
    """K5: one JSON document a row, without hashes unless asked for."""
    return (E if with_hashes else E.drop("body_hash", "sig_hash", "struct_hash", "seq")).select(F.to_json(F.struct("*"), {"ignoreNullFields": "true"}).alias("value"))


def read_ranks(spark: SparkSession, path: str) -> DataFrame:
    """(file, rank) of a manifest {..., "ranks": {file: rank}}; missing means empty."""
    if not _exists(spark, path):
        return empty(spark, RANK_SCHEMA)
    rows = spark.read.schema("ranks map<string, double>").option("multiLine", "true").json(path)
    return rows.select(F.explode("ranks").alias("file", "rank"))


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """S9"""
    if not _exists(spark, path):
        return empty(spark, PAIR_SCHEMA)
    rows = spark.read.schema("pairs array<struct<a: string, b: string, weight: double, support: bigint>>").option("multiLine", "true").json(path)
    return rows.select(F.explode("pairs").alias("p")).select("p.*")


def write_manifest(path: str, header: dict, name: str, rows: dict | list) -> None:
    """K2, K3: a small manifest in one local file; for a store of any size write Parquet instead. Without rows an old
    manifest goes, so that none is left that doesn't fit its store."""
    if not rows:
        if os.path.exists(path):
            os.remove(path)
        return
    with open(path, "w") as f:
        json.dump(header | {name: rows}, f)


def stamp(folder: str) -> dict:
    """Sizes and times of the stored lines."""
    out = {}
    for name in (ENTITIES, REFS):
        p = os.path.join(folder, name)
        parts = [os.path.join(p, x) for x in sorted(os.listdir(p))] if os.path.isdir(p) else [p] if os.path.exists(p) else []
        parts = [x for x in parts if not os.path.basename(x).startswith((".", "_"))]
        out[name] = [sum(os.path.getsize(x) for x in parts), max((int(os.path.getmtime(x) * 1000) for x in parts), default=0)]
    return out


def materialize(spark: SparkSession, folder: str, store: str) -> tuple[DataFrame, DataFrame]:
    """Parquet copies of the lines, rebuilt when the stamp differs; sorted by name so that statistics prune."""
    at = os.path.join(store, STAMP)
    now = stamp(folder)
    if not os.path.exists(at) or json.load(open(at)) != now:
        read_entities(spark, os.path.join(folder, ENTITIES)).sortWithinPartitions("name").write.mode("overwrite").parquet(os.path.join(store, "entities"))
        read_refs(spark, os.path.join(folder, REFS)).sortWithinPartitions("name").write.mode("overwrite").parquet(os.path.join(store, "refs"))
        with open(at, "w") as f:
            json.dump(now, f)
    return spark.read.schema(ENTITY_SCHEMA).parquet(os.path.join(store, "entities")), spark.read.schema(REF_SCHEMA).parquet(os.path.join(store, "refs"))


def register(E: DataFrame, R: DataFrame, ranks: DataFrame | None = None) -> None:
    """The views that SQL sees: entities, refs, rank and blast."""
    spark = E.sparkSession
    E.createOrReplaceTempView("entities")
    R.createOrReplaceTempView("refs")
    (ranks if ranks is not None else empty(spark, RANK_SCHEMA)).createOrReplaceTempView("rank")
    E.select("file", "name", "parent", "blast_radius.*").createOrReplaceTempView("blast")
