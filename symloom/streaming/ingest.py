"""Incremental extraction of a growing folder of source rows (an extra; batch re-indexing is ``project.reindex``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from symloom.sources import extract


def entities_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Entities of (file, text) Parquet files that arrive in ``folder``."""
    return extract.entities(spark.readStream.schema("file string, text string").parquet(folder))


def start(spark: SparkSession, folder: str, store: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Appends each micro-batch to ``store``, partitioned by its number so that a repeated batch replaces itself."""

    def upsert(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{store}/batch={number}")

    writer = entities_stream(spark, folder).writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
