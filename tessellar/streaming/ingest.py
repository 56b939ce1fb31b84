"""Incremental ingestion: new files only, exactly once into upserted tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellar.functions.scalars import content_key, url_key
from tessellar.sources.sinks import merge_into


def new_documents(spark: SparkSession, path: str, schema: str, per_batch: int = 100) -> DataFrame:
    """Stream of the documents in new JSON files of a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).json(path)


def keyed(docs: DataFrame) -> DataFrame:
    """Address and content keys, for dedup state."""
    return docs.withColumn("url_key", url_key(F.col("url"))).withColumn("content_key", content_key(F.col("text")))


def ingest(stream: DataFrame, name: str, table: str, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] = lambda df: df) -> int:
    """Upsert all available input into a table; returns the number of batches.

    Offsets advance only when a batch has been written, and upserts are idempotent, so a
    batch that is repeated after a failure changes nothing.
    """
    done: list[int] = []

    def write(batch: DataFrame, no: int) -> None:
        if not batch.isEmpty():
            merge_into(batch.sparkSession, name, table, prepare(batch))
        done.append(no)

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return len(done)


def checkpoint_status(log: DataFrame) -> DataFrame:
    """Totals a source from its audit rows (source, fetched, new, duplicate, failed) and the last success."""
    return log.groupBy("source").agg(*[F.sum(c).alias(c) for c in ("fetched", "new", "duplicate", "failed")], F.max(F.when(F.col("failed") == 0, F.col("at"))).alias("last_success"))
