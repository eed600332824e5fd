"""Pages of a table that is written in order: each page is read from the files that hold it.

The table is written once, sorted over the whole cluster, with a small table beside it: of every file the number of rows before
it, its own number of rows and its first row's keys. A page then needs one lookup and the files it lies in, however deep
it is; nothing is sorted or counted again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MOST_ROWS = 500


@dataclass(frozen=True)
class Pages:
    """A table written in order, with its offsets: file, before, rows."""

    spark: SparkSession
    path: str
    total: int

    def _offsets(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/offsets")

    def files(self, number: int, size: int) -> list[tuple[str, int]]:
        """The files that page ``number`` lies in, at most as many as it has rows, with the rows before each."""
        if number < 1 or not 1 <= size <= MOST_ROWS:
            raise ValueError(f"page must be >= 1 and page size within 1..{MOST_ROWS}")
        start = (number - 1) * size
        within = (F.col("before") < start + size) & (F.col("before") + F.col("rows") > start)
        return [(r["file"], r["before"]) for r in self._offsets().filter(within).orderBy("before").collect()]

    def page(self, number: int, size: int, order: list[Column]) -> DataFrame:
        """Rows ``[(number-1)*size, number*size)`` in ``order``, the one the table was written in."""
        found = self.files(number, size)
        schema = self.spark.read.parquet(f"{self.path}/rows").schema
        if not found:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(*[f"{self.path}/rows/{name}" for name, _ in found])
        return rows.orderBy(*order).offset((number - 1) * size - found[0][1]).limit(size)


def write(df: DataFrame, order: list[Column], path: str, rows_per_file: int = 100_000) -> Pages:
    """Write ``df`` in ``order``, which should end in a unique key, in files of at most ``rows_per_file`` rows."""
    spark = df.sparkSession
    df.orderBy(*order).write.option("maxRecordsPerFile", rows_per_file).parquet(f"{path}/rows")
    stored = spark.read.parquet(f"{path}/rows")
    # Files are named by range partition and, within one, in the order they were written.
    counted = stored.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count(F.lit(1)).alias("rows"))
    place = F.struct(
        F.regexp_extract("file", r"^part-(\d+)", 1).cast("int").alias("part"), F.regexp_extract("file", r"-c(\d+)\.", 1).cast("int").alias("piece")
    )
    earlier = Window.orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    # One row per file.
    counted.select("file", "rows", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("before")).write.parquet(f"{path}/offsets")
    return load(spark, path)


def load(spark: SparkSession, path: str) -> Pages:
    """Pages written by ``write``."""
    total = spark.read.parquet(f"{path}/offsets").agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n")).first()["n"]
    return Pages(spark, path, total)
