"""Rolling request counts per key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_MICROS = 1_000_000


def rolling_counts(requests: DataFrame, window_seconds: int = 60, limit: int = 10) -> DataFrame:
    """Requests of the same key less than ``window_seconds`` before each request, itself included.

    ``requests`` has ``key, ts, seq``; ``seq`` orders requests of one instant. Requests fold to one row per key and instant before
    anything is windowed. Time is cut into slices as long as the window and every instant is also shown to the next slice, so
    one busy key spreads over its slices; its requests are numbered and answered by key and instant, never by key.
    """
    span = window_seconds * _MICROS
    timed = requests.withColumn("_t", F.unix_micros(F.col("ts").cast("timestamp")))
    instants = timed.groupBy("key", "_t").agg(F.count(F.lit(1)).alias("n"))
    slice_of = F.floor(F.col("_t") / span)
    shown = instants.withColumn("_in", F.explode(F.array(slice_of, slice_of + 1))).withColumn("_own", F.col("_in") == slice_of)
    lane = Window.partitionBy("key", "_in").orderBy("_t").rangeBetween(-(span - 1), Window.currentRow)
    upto = shown.withColumn("upto", F.sum("n").over(lane)).filter("_own")
    found = upto.select(F.col("key").alias("_key"), F.col("_t").alias("_at"), "n", "upto")
    met = timed.join(found, F.col("key").eqNullSafe(F.col("_key")) & F.col("_t").eqNullSafe(F.col("_at")), "left")
    place = F.row_number().over(Window.partitionBy("key", "_t").orderBy("seq"))
    recent = F.col("upto") - F.col("n") + place
    counted = met.withColumn("recent", recent.cast("bigint"))
    return counted.withColumn("allowed", F.col("recent") <= limit).select(*requests.columns, "recent", "allowed")
