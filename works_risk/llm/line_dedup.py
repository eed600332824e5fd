"""Line dedup: overlapping windows of three lines, found again anywhere, are removed where they come later.

A text splits at line feeds. Lines are compared without the blanks around them, blank lines are skipped, and every
three consecutive other lines are a window. Windows are hashed and counted over all documents; the first one in the order
(doc_id, hash of the text, place) stays, and every later one marks its three lines. Marks of overlapping windows merge, and
marked lines leave; all other lines, blank ones too, stay as they were.

Only (hash, document, place) rows move until the end. A window that many documents share is one key: its first place
is found by a partial minimum, and it comes back to its rows by a broadcast of the few hot keys (``lookup.attach``).
Everything is column expressions.

Defined results: a null text stays null; a text of fewer than three lines that are not blank stays; a text
whose lines are all marked becomes empty. Rows with equal doc_id and text are one document: both keep what one of them
would. A null doc_id comes first. Other columns pass through; those named like an output column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from works_risk.operators.lookup import attach
from works_risk.llm.quality_rules import _let as let
from works_risk.session import scratch

WINDOW = 3
BLANKS = " \t\r"
OUTPUT = ("n_lines", "n_removed")


def _solid(text: Column) -> Column:
    """The lines that are not blank: (t, the line without blanks around it; i, its place among all lines)."""
    placed = F.transform(F.split(text, "\n"), lambda line, i: F.struct(F.btrim(line, F.lit(BLANKS)).alias("t"), i.alias("i")))
    return F.filter(placed, lambda x: x.getField("t") != "")


def windows(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per window: h (128 bits of hash as text), doc_id, th (hash of the text), k (number of its first line)."""

    def hashed(lines: Column) -> Column:
        def one(k: Column) -> Column:
            parts = [F.get(lines, k + j).getField("t") for j in range(WINDOW)]
            h = F.concat_ws(".", F.hex(F.xxhash64(*parts)), F.hex(F.xxhash64(F.lit("second"), *parts)))
            return F.struct(h.alias("h"), k.alias("k"))

        return F.when(F.size(lines) >= WINDOW, F.transform(F.sequence(F.lit(0), F.size(lines) - WINDOW), one))

    made = docs.filter(F.col(text).isNotNull()).select(
        "doc_id", F.xxhash64(text).alias("th"), F.explode(let(_solid(F.col(text)), hashed)).alias("w")
    )
    return made.select("w.h", "doc_id", "th", "w.k")


def _keep(text: Column, starts: Column) -> Column:
    """(number of lines, number removed, the other lines) of a text, given the windows to remove."""

    def cut(lines: Column) -> Column:
        def without(solid: Column) -> Column:
            marked = F.array_distinct(
                F.flatten(F.transform(starts, lambda k: F.array(*[F.get(solid, k + j).getField("i") for j in range(WINDOW)])))
            )
            kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), marked)
            return F.struct(
                F.size(marked).cast("long").alias("n_removed"),
                F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n").alias("text"),
            )

        return let(_solid(text), without)

    return let(F.split(text, "\n"), cut)


def dedup(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with repeated windows removed from the text, and ``n_lines`` (before) and ``n_removed``."""
    spark = docs.sparkSession
    stored = scratch(spark, "line-windows")
    windows(docs, text).write.parquet(stored)
    found = spark.read.parquet(stored)
    place = F.struct("doc_id", "th", "k")
    repeated = found.groupBy("h").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    kept_first = scratch(spark, "line-firsts")
    repeated.write.parquet(kept_first)
    seen = attach(found, spark.read.parquet(kept_first), "h", F.xxhash64("doc_id", "th", "k"))
    later = seen.filter(F.col("first").isNotNull() & (place > F.col("first")))
    marks = later.groupBy(F.col("doc_id").alias("_id"), F.col("th").alias("_th")).agg(F.collect_set("k").alias("_starts"))

    columns = [c for c in docs.columns if c.lower() not in OUTPUT]
    joined = docs.select(*[F.col(f"`{c}`") for c in columns]).withColumn("_h", F.xxhash64(text))
    joined = joined.join(marks, (F.col("_h") == F.col("_th")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    body = F.when(F.col("_starts").isNotNull(), _keep(F.col(text), F.col("_starts")))
    cut = joined.withColumn("_cut", body)
    lines = F.when(F.col(text).isNull(), 0).otherwise(F.size(F.split(F.col(text), "\n"))).cast("long")
    return cut.select(
        *[F.coalesce(F.col("_cut.text"), F.col(text)).alias(text) if c == text else F.col(f"`{c}`") for c in columns],
        lines.alias("n_lines"),
        F.coalesce(F.col("_cut.n_removed"), F.lit(0)).cast("long").alias("n_removed"),
    )
