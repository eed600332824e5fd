"""Whole-table order without a single-task window: ordinals, seeded order, first and last rows, pages."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from works_risk.session import settle

# Up to this many leading rows a page comes from a bounded top-n; deeper pages use ordinals.
SHALLOW_ROWS = 10_000
_ROW_BITS = 33


def ordinal(df: DataFrame, order: list[Column], name: str = "ordinal") -> DataFrame:
    """Add the 1-based position of each row in ``order``.

    The rows are range-partitioned and sorted once, then settled. Each partition's offset comes from the
    partition sizes, a table with one row per partition. ``order`` should end in a unique key.
    """
    laid = settle(df.orderBy(*order)).withColumn("_at", F.monotonically_increasing_id())
    part = F.shiftright("_at", _ROW_BITS)
    sizes = laid.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    within = F.col("_at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return (
        laid.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + within + 1)
        .drop("_at", "_part", "_offset")
    )


def seeded_key(seed: int, *keys: Column) -> Column:
    """A reproducible shuffle key: the same rows get the same order however they are partitioned."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys]))


def first_per_key(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The first row of each key. Rows combine before the shuffle, so a hot key costs no more than others."""
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), order).alias("_row")
    return df.groupBy(*keys).agg(best).select(*keys, "_row.*")


def last_per_key(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The last row of each key."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), order).alias("_row")
    return df.groupBy(*keys).agg(best).select(*keys, "_row.*")


def top_rows(df: DataFrame, order: list[Column], n: int | None) -> DataFrame:
    """The first ``n`` rows of the order; all rows in order when ``n`` is None."""
    ranked = df.orderBy(*order)
    return ranked if n is None else ranked.limit(n)


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """Rows ``[(number-1)*size, number*size)`` of the order."""
    if number < 1 or not 1 <= size <= 500:
        raise ValueError("page must be >= 1 and page size within 1..500")
    start = (number - 1) * size
    if start + size <= SHALLOW_ROWS:
        return df.orderBy(*order).offset(start).limit(size)
    placed = ordinal(df, order, "_pos")
    return placed.filter((F.col("_pos") > start) & (F.col("_pos") <= start + size)).drop("_pos")


def page_count(total: int, size: int) -> int:
    return math.ceil(total / size)


def seeded_split(df: DataFrame, seed: int, keys: list[Column], name: str = "split") -> DataFrame:
    """Positional 70/15/15 split in seeded order."""
    placed = ordinal(df, [seeded_key(seed, *keys), *keys], "_pos")
    n = placed.count()
    train, val = int(0.7 * n), int(0.85 * n)
    at = F.col("_pos") - 1
    label = F.when(at < train, "train").when(at < val, "val").otherwise("test")
    return placed.withColumn(name, label).drop("_pos")
