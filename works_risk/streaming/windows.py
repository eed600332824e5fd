"""Request counts over event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

WATERMARK = "10 minutes"


def windowed_counts(events: DataFrame, size: str = "60 seconds", slide: str = "10 seconds", late: str = WATERMARK) -> DataFrame:
    """Requests per key and sliding window; rows later than the watermark are dropped. Works on streams and tables."""
    window = F.window("ts", size, slide)
    return (
        events.withWatermark("ts", late)
        .groupBy("key", window.alias("w"))
        .agg(F.count(F.lit(1)).alias("requests"))
        .select("key", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "requests")
    )


def write_updates(counts: DataFrame, out: str, checkpoint: str) -> DataStreamWriter:
    """Write every batch's changed windows under its batch number, so a repeated batch replaces itself."""

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return (
        counts.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(store)
    )


def latest_counts(spark: SparkSession, out: str) -> DataFrame:
    """The newest count of every window."""
    return (
        spark.read.parquet(out)
        .groupBy("key", "window_start", "window_end")
        .agg(F.max_by("requests", "batch").alias("requests"))
    )
