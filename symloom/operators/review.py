"""Review: changes joined with rank, impact and co-change history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def enrich(diffs: DataFrame, ranks: DataFrame, E: DataFrame, breaking_boost: float = 3.0) -> DataFrame:
    """impact = rank (ln(1 + direct files) + 1), three times that if it breaks; blast by the new key, else the old one."""
    blast = E.where("blast_radius is not null").groupBy("file", "name", "parent").agg(F.first("blast_radius").alias("b"))
    rows = diffs.join(ranks, "file", "left").withColumn("rank", F.coalesce("rank", F.lit(0.0)))
    for side in ("new", "old"):
        k = blast.select(F.col("file").alias("_f"), F.col("name").alias("_n"), F.col("parent").alias("_p"), F.col("b").alias(f"_{side}"))
        on = (F.col(f"{side}.file") == F.col("_f")) & (F.col(f"{side}.name") == F.col("_n")) & F.col(f"{side}.parent").eqNullSafe(F.col("_p"))
        rows = rows.join(k, on, "left").drop("_f", "_n", "_p")
    files = F.coalesce(F.col("_new.direct_files"), F.col("_old.direct_files"), F.lit(0))
    callers = F.coalesce(F.col("_new.direct_callers"), F.col("_old.direct_callers"), F.lit(0))
    impact = F.col("rank") * (F.log1p(files) + 1.0) * F.when(F.col("breaking"), breaking_boost).otherwise(1.0)
    rows = rows.withColumns({"direct_files": files.cast("long"), "direct_callers": callers.cast("long"), "impact": impact}).drop("_new", "_old")
    return rows.orderBy(F.round("impact", 12).desc(), "file", "line", "name", "change")


def most_impactful(enriched: DataFrame, top: int = 5) -> DataFrame:
    """W2"""
    return enriched.where("kind <> 'import'").orderBy(F.round("impact", 12).desc(), "file", "line", "name", "change").limit(top)


def file_deltas(enriched: DataFrame) -> DataFrame:
    """Counts by file, best ranked first."""
    g = enriched.groupBy("file").agg(F.max("rank").alias("rank"), F.count("*").alias("changes"), F.count_if("breaking").alias("breaking"))
    return g.orderBy(F.round("rank", 12).desc(), "file")


def cochange_misses(touched: DataFrame, pairs: DataFrame, top: int = 3, least: float = 0.3) -> DataFrame:
    """(file, expected_partner, weight, support): of each touched file's first partners those that weren't touched."""
    both = pairs.select(F.col("a").alias("file"), F.col("b").alias("partner"), "weight", "support").unionByName(pairs.select(F.col("b").alias("file"), F.col("a").alias("partner"), "weight", "support"))
    t = touched.select("file").distinct()
    n = F.row_number().over(Window.partitionBy("file").orderBy(F.round("weight", 12).desc(), "partner"))
    rows = both.join(t, "file", "left_semi").withColumn("n", n).where((F.col("n") <= top) & (F.col("weight") >= least))
    rows = rows.join(t.withColumnRenamed("file", "partner"), "partner", "left_anti")
    return rows.select("file", F.col("partner").alias("expected_partner"), "weight", "support").orderBy(F.round("weight", 12).desc(), "file", "expected_partner")
