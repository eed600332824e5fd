"""Writers of the job's outputs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from works_risk.operators.aggregate import rank_order
from works_risk.operators.duplicates import Sweep
from works_risk.operators.search import risk_order
from works_risk.sources.files import open_output


def write_flags(flags: DataFrame, path: str, csv_path: str | None = None) -> None:
    """Flags sorted by risk, as Parquet and on request as CSV."""
    flags.orderBy(*risk_order()).write.mode("overwrite").parquet(path)
    if csv_path:
        stored = flags.sparkSession.read.parquet(path)
        stored.orderBy(*risk_order()).write.mode("overwrite").option("header", True).csv(csv_path)


def write_mps(mps: DataFrame, path: str) -> None:
    """The ranked roll-up; the worst-offender report reads the same table."""
    mps.orderBy(*rank_order()).write.mode("overwrite").parquet(path)


def write_pair_set(pairs: DataFrame, path: str) -> None:
    pairs.write.mode("overwrite").partitionBy("split").parquet(path)


def write_sweep(sweep: DataFrame, path: str) -> None:
    sweep.write.mode("overwrite").partitionBy("model").parquet(path)


def write_links(found: Sweep, path: str) -> None:
    """A sweep as it is stored: works with their texts, and links between texts by model."""
    found.works.write.mode("overwrite").parquet(f"{path}/works")
    found.links.write.mode("overwrite").partitionBy("model").parquet(f"{path}/links")


def write_metrics(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def write_dossiers(dossiers: DataFrame, path: str) -> None:
    """The dossier table: one row per work. Dossiers that share a description are small next to each other."""
    dossiers.write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_dossier_files(dossiers: DataFrame, folder: str) -> None:
    """``works/<name>.md`` for each work plus an index, for a limited number of dossiers.

    Tasks write the files, each under its final name and with the same content however often it runs. For all works use
    ``write_dossiers``: one file per work would swamp the file system.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, text in zip(batch["file_name"], batch["dossier_md"], strict=True):
                with open_output(f"{folder}/works/{name}") as out:
                    out.write(text.encode())
            yield pd.DataFrame({"files": [len(batch)]})

    dossiers.select("file_name", "dossier_md").mapInPandas(write, "files bigint").agg(F.sum("files")).collect()
    count = dossiers.count()
    header = dossiers.sparkSession.createDataFrame([(-1, f"# Flagged-work dossiers ({count})\n")], "at int, value string")
    lines = dossiers.select((F.lit(100) - F.col("risk_score")).alias("at"), "work_id", F.col("index_line").alias("value"))
    index = header.withColumn("work_id", F.lit("")).unionByName(lines).orderBy("at", "work_id").select("value")
    index.coalesce(1).write.mode("overwrite").text(f"{folder}/index")
