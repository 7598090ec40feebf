"""Streams of events and traces (extension: the workbench itself only reads logs again and again)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import TRACE


def trace_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """New JSON-lines trace files as they come; the checkpoint of the query remembers what was read."""
    return spark.readStream.schema(TRACE).option("maxFilesPerTrigger", files_per_batch).json(path)


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    return spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """event_type, start, n, total by windows of event time."""
    return (
        events.withWatermark("ts", late).groupBy("event_type", F.window("ts", width).alias("w"))
        .agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("event_type", F.col("w.start").alias("start"), "n", "total")
    )


def sliding(events: DataFrame, width: str = "1 hour", step: str = "15 minutes", late: str = "10 minutes") -> DataFrame:
    return (
        events.withWatermark("ts", late).groupBy("event_type", F.window("ts", width, step).alias("w"))
        .agg(F.count("*").alias("n")).select("event_type", F.col("w.start").alias("start"), "n")
    )


def sessions(events: DataFrame, gap: str = "2 hours", late: str = "10 minutes") -> DataFrame:
    return (
        events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w"))
        .agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
    )


def once(events: DataFrame, key: str = "event_id", late: str = "1 hour") -> DataFrame:
    """Each key once, as long as its copies come within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def running_costs(trace: DataFrame) -> DataFrame:
    """caller, calls, retries, cost so far (complete or update mode)."""
    return trace.groupBy("caller").agg(F.count("*").alias("calls"), F.sum(F.coalesce(F.col("is_retry").cast("int"), F.lit(0))).alias("retries"), F.sum("cost_usd").alias("cost"))


def drain(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Everything that is there now, written as Parquet with exactly-once files, then stop."""
    q = stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
