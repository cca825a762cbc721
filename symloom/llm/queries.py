"""The registered queries of this subpackage: each applies one operator, with its production parameters, to a whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.llm import dedup, langid, lmscore, media, packing, quality, spieces, topk, urlrules, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(topk.integers(_table(spark, sf_dir, "embeddings")), F.col("vec_id") % 50 == 0)


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op4_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digests(_table(spark, sf_dir, "documents"))


def op5_urlrules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrules.judge(_table(spark, sf_dir, "pages")).drop("candidates")


def _pieces(model: str | None) -> bytes:
    with open(model or public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return f.read()


def op6_sentencepiece(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    """``model`` is the path of a SentencePiece model file."""
    return spieces.digests(_table(spark, sf_dir, "documents"), _pieces(model), with_spans=True)


def op7_lmscore(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    """The target are documents whose labels say quality 1 and not toxic."""
    good = _table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t")).where("q = 1 and t = 0")
    return lmscore.score(_table(spark, sf_dir, "documents"), good, _pieces(model))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.predict(docs, quality.fit(docs, _table(spark, sf_dir, "labels")))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.fit(docs))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_topk, op2_minhash, op3_packing, op4_audio, op5_urlrules, op6_sentencepiece, op7_lmscore, op8_warc, op9_quality, op10_langid)}

ORACLES: dict[str, str] = {"op1_topk": topk.ORACLE, "op3_packing": packing.oracle(), "op5_urlrules": urlrules.oracle()}
