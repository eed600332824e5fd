"""Joins of rows with facts about their keys, where one key may hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key with more than one in so many of all rows is hot, so fewer than this many keys are.
HOT_SHARE = 1024


def attach(rows: DataFrame, facts: DataFrame, key: str, unique: Column, count: str = "n") -> DataFrame:
    """Left join of ``rows`` with ``facts`` on ``key``; ``facts`` has ``count``, the number of rows of its key.

    Hot keys are answered by a broadcast of fewer than ``HOT_SHARE`` facts; their rows are then dealt out by ``unique``,
    and only the others meet their facts by ``key``. ``facts`` should be a written table: it is read three times.
    """
    total = facts.agg(F.coalesce(F.sum(count), F.lit(0)).alias("t")).collect()[0]["t"]
    bound = total // HOT_SHARE
    values = [c for c in facts.columns if c not in (key, count)]
    hot = facts.filter(F.col(count) > bound).select(F.col(key).alias("_hot"), F.struct(*values).alias("_hot_facts"))
    cold = facts.filter(F.col(count) <= bound).select(F.col(key).alias("_dealt"), F.struct(*values).alias("_facts"))
    marked = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left")
    named = lambda value: F.concat(F.lit("k"), value.cast("string"))
    apart = F.concat(F.lit("u"), unique.cast("string"))  # rows of hot keys and of no key
    dealt = F.when(F.col("_hot").isNull() & F.col(key).isNotNull(), named(F.col(key))).otherwise(apart)
    cold = cold.withColumn("_dealt", named(F.col("_dealt")))
    met = marked.withColumn("_by", dealt).join(cold, F.col("_by") == F.col("_dealt"), "left")
    found = [F.coalesce(F.col(f"_hot_facts.{v}"), F.col(f"_facts.{v}")).alias(v) for v in values]
    return met.select(*[F.col(f"`{c}`") for c in rows.columns], *found)
