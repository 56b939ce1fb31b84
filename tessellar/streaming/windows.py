"""Structured Streaming counterparts of the batch windows, over the events table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellar.operators.settle import shared_folder


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a file stream with event time (``ts`` without zone is read as UTC)."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet*").parquet(sf_dir)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, size: str = "1 hour", late: str = "10 minutes", *keys: str) -> DataFrame:
    """Counts by window and key; rows later than the watermark are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), *keys).agg(F.count("*").alias("n"))


def sliding(events: DataFrame, size: str = "30 days", step: str = "1 day", late: str = "1 hour", *keys: str) -> DataFrame:
    """Look-back counts, a row a step."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size, step), *keys).agg(F.count("*").alias("n"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour", *keys: str) -> DataFrame:
    """Sessions that end after a gap."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), *keys).agg(F.count("*").alias("n"))


def deduplicate(events: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """First row of a key within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def drain(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Run a stream over all available input and return its result, a table in the shared folder."""
    spark = stream.sparkSession
    path = f"{shared_folder(spark)}/streams/{uuid.uuid4().hex}"
    kept: list[int] = []

    def put(batch: DataFrame, no: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{path}/rows")
        kept.append(no)

    run = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").foreachBatch(put).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows") if kept else spark.createDataFrame([], stream.schema)


def hourly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by hour and type, through a stream."""
    rows = drain(tumbling(event_stream(spark, sf_dir), "1 hour", "10 minutes", "event_type"))
    return rows.select(F.col("window.start").alias("hour"), "event_type", "n")


def deduplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First event of a user and type within a day's watermark, counted by type."""
    rows = drain(deduplicate(event_stream(spark, sf_dir), ["user_id", "event_type"]), "append")
    return rows.groupBy("event_type").agg(F.count("*").alias("n"))
