"""Streams of events and logs; the reference has none, so the semantics are Spark's own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def tail(spark: SparkSession, folder: str, schema: str = EVENT, files_per_batch: int = 100) -> DataFrame:
    """A stream over Parquet files as they arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def windowed(events: DataFrame, late: str = "1 hour", size: str = "1 day") -> DataFrame:
    """Events per tumbling window and type: n and total; events later than `late` are left out of a stream."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).where("at is not null")
    timed = timed.withWatermark("at", late) if events.isStreaming else timed
    g = timed.groupBy(F.window("at", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("since"), "event_type", "n", F.round("total", 4).alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of each user, ended by a gap: since, until and n."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).where("at is not null and user_id is not null")
    timed = timed.withWatermark("at", late) if events.isStreaming else timed
    g = timed.groupBy(F.session_window("at", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return g.select("user_id", F.col("w.start").alias("since"), F.col("w.end").alias("until"), "n")


def first_seen(events: DataFrame, key: str = "event_id", late: str = "1 hour") -> DataFrame:
    """Each event once: repeats within the watermark are dropped; an event without a time can't be placed and is left out."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).where("at is not null")
    return timed.withWatermark("at", late).dropDuplicatesWithinWatermark([key]) if events.isStreaming else timed.dropDuplicates([key])
