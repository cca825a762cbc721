"""From raw documents to packed batches: language ID, quality, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and all but the last return the
columns of ``documents``. Classifiers are learnt from the stage's own input. ORACLE_SQL is None: kernels, a trained
model and signatures have no SQL form; tests/llm compares ``run`` with the stages applied one by one by brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from symloom.llm import common, dedup, langid, packing, quality


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language isn't recognised: null texts, those without a letter, and low scores.

    Each row is judged by its text alone, so rows that repeat stay or go together. Without any row to learn from all go;
    an empty table stays empty. Columns of any name are kept as they are.
    """
    return langid.keep(docs, langid.fit(docs))


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier takes for junk.

    Each row is judged by its text alone, a null text like an empty one; ties (a score of 0.5, as without any label) stay.
    An empty table stays empty. Columns of any name are kept as they are.
    """
    return quality.keep(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near-duplicates: the smallest id, and of rows that repeat it the first by content.

    Null texts count as empty and are copies of each other; rows without an id stay. An empty table stays empty. Columns of
    any name are kept as they are.
    """
    return dedup.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts every remaining document into length buckets and batches, in the order of ids.

    Rows that repeat are packed each by itself; texts without a token have a row without bucket. An empty table gives no
    rows.
    """
    return packing.pack(docs)


STAGES = [("language", language), ("quality", good), ("near_duplicates", near_duplicates), ("packing", pack)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
