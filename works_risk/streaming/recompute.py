"""Run the job again whenever new extract files arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from works_risk.functions.vectors import EmbedMany, hashed_trigrams
from works_risk.params import Params
from works_risk.plans.job import run_extracts
from works_risk.sources.runs import newest


def recompute_on_arrival(
    spark: SparkSession,
    folder: str,
    out: str,
    checkpoint: str,
    params: Params,
    embed_many: EmbedMany | None = hashed_trigrams,
    dossier_limit: int | None = None,
    after: Callable[[DataFrame, int], None] | None = None,
    multi_line: bool = False,
    tolerant: bool = False,
) -> StreamingQuery:
    """Watch ``folder`` for deliveries; each batch of arrivals recomputes all tables under ``out/run=<batch>``.

    Extracts have fixed names, so every delivery comes in a folder of its own, ``delivery=<id>``: a file that is sent again is a
    new path and starts a run, in which the newest file of each role counts. The stream carries names and sizes of files, not
    their contents. The job reads the extracts itself, so a repeated batch gives the same tables in the same place. Each run goes
    on from the one before: only blocks of works that a delivery touches are embedded and compared again.
    """
    arrivals = (
        spark.readStream.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.{csv,csv.gz}")
        .schema("path string, modificationTime timestamp, length bigint, content binary")
        .load(folder)
        .select("path", "length")
    )

    def run(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        since = next((run for n in range(number - 1, -1, -1) if (run := newest(spark, f"{out}/run={n}"))), None)
        result = run_extracts(
            spark, folder, f"{out}/run={number}", params, embed_many, dossier_limit, None, multi_line, tolerant, since=since
        )
        if after is not None:
            after(result.flags, number)

    return (
        arrivals.writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(run)
        .start()
    )
