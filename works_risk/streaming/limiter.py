"""The request limiter as a stream: state per key, folded to instants."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

_MICROS = 1_000_000
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Limiter(StatefulProcessor):
    """Counts requests of a key in a rolling window.

    State is one number per instant of the last window, however many requests an instant has. An event-time timer drops what
    has left the window, and with the last instant the key itself. A request that comes after later ones of its key, but within
    the watermark, is counted at its own time among what is known; answers that were given stay. Requests later than the
    watermark are dropped. The requests of one key in one trigger meet in one task.
    """

    def __init__(self, window_seconds: int, limit: int):
        self.span, self.limit = window_seconds * _MICROS, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.instants = handle.getMapState("instants", "t long", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        asked = pd.concat(list(rows), ignore_index=True).sort_values(["t", "seq"], kind="stable")
        held = dict(sorted((int(t), int(n)) for (t,), (n,) in self.instants.iterator()))
        known, counts = np.array(list(held), np.int64), np.concatenate([[0], np.cumsum(list(held.values()))]).astype(np.int64)
        t = asked["t"].to_numpy(np.int64)
        left = t - self.span  # what is this old has left the window
        before = counts[np.searchsorted(known, t, "right")] - counts[np.searchsorted(known, left, "right")]
        recent = before + np.arange(1, len(t) + 1) - np.searchsorted(t, left, "right")
        for at, n in zip(*np.unique(t, return_counts=True), strict=True):
            self.instants.updateValue((int(at),), (held.get(int(at), 0) + int(n),))
        self.handle.registerTimer(int(-(-(t[-1] + self.span) // 1000)))
        yield pd.DataFrame({"key": key[0], "seq": asked["seq"].to_numpy(), "recent": recent, "allowed": recent <= self.limit})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        before = timerValues.getCurrentWatermarkInMs() * 1000 - self.span
        for (t,), _ in list(self.instants.iterator()):
            if t <= before:
                self.instants.removeKey((t,))
        return iter(())

    def close(self) -> None:
        pass


def limited(requests: DataFrame, window_seconds: int = 60, limit: int = 10, late: str = "10 minutes") -> DataFrame:
    """``key, seq, recent, allowed`` of a stream of requests ``key, ts, seq``: how many of the key came less than
    ``window_seconds`` before, the request included. The session needs the state store ``STORE``."""
    types = dict(requests.dtypes)
    timed = requests.withWatermark("ts", late).select("key", "seq", "ts", F.unix_micros("ts").alias("t"))
    return timed.groupBy("key").transformWithStateInPandas(
        Limiter(window_seconds, limit), f"key {types['key']}, seq {types['seq']}, recent bigint, allowed boolean", "Append", "EventTime"
    )


def write_answers(answers: DataFrame, out: str, checkpoint: str) -> DataStreamWriter:
    """Write every batch's answers under its batch number, so a repeated batch replaces itself."""

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return (
        answers.writeStream.outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(store)
    )


def use_state_store(spark: SparkSession) -> None:
    spark.conf.set(PROVIDER, STORE)
