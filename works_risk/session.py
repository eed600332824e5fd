"""Session settings and durable intermediate results."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


# Rows that a Python worker is handed at a time, where the session keeps Spark's default: texts and vectors are long.
BATCH_ROWS = 1_000
# A task of a spread table should not get more than this by Spark's estimate.
SPREAD_BYTES = 256 << 20
# An estimate may be far too high.
MOST_TASKS = 4_096


def local_session(cores: str = "8", app: str = "works-risk") -> SparkSession:
    """A session for tests and the bench. On a cluster, pass your own session instead."""
    return ship(
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "128k")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the Python workers, once per application. ``--py-files`` does the same at submit time."""
    context = spark.sparkContext
    name = Path(__file__).parent.name
    if not any(f.endswith(f"/{name}.zip") for f in context.listFiles):
        folder = tempfile.mkdtemp(prefix="works-risk-package-")
        root = Path(__file__).parent.parent
        context.addPyFile(shutil.make_archive(f"{folder}/{name}", "zip", root, name))
    return spark


def small_batches(spark: SparkSession) -> None:
    """Bound what a Python worker holds at a time by rows; with Spark's default a batch grows with the partition up to 10,000."""
    name, default = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"
    if spark.conf.get(name, default) == default:
        spark.conf.set(name, BATCH_ROWS)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables, as the session names it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if named:
        return named
    if context.getCheckpointDir():
        return context.getCheckpointDir()
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    made = tempfile.mkdtemp(prefix="works-risk-")
    context.setCheckpointDir(made)
    return made


def settle(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint, so later passes neither recompute nor move rows."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def spread_tasks(spark: SparkSession) -> int:
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Spread rows before a step that costs compute rather than bytes.

    Adaptive execution sizes partitions by bytes, which would leave a small table to a few tasks: it goes to all cores.
    A table that fills them anyway is left to the advisory partition size, and its large partitions split.
    """
    tasks = spread_tasks(df.sparkSession)
    estimate = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if estimate > tasks * SPREAD_BYTES:
        return df.hint("rebalance", *keys)
    return df.repartition(tasks, *keys)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """By keys that few rows share, to all cores and to as many tasks as the size asks for. A join or grouping by them stays there."""
    estimate = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(min(MOST_TASKS, max(spread_tasks(df.sparkSession), estimate // SPREAD_BYTES + 1)), *keys)


def spread_if_few(settled: DataFrame, *keys: str) -> DataFrame:
    """As ``spread``, for a settled table, and only when it has fewer partitions than there are cores."""
    few = settled.rdd.getNumPartitions() < settled.sparkSession.sparkContext.defaultParallelism
    return spread(settled, *keys) if few else settled


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder for one written table."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
