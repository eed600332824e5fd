"""Descriptions apart from the works that name them: a work carries the key of its text, and each text is kept once.

Texts are far longer than the rest of a work and many works share one. Steps between works move the key (``text_id``, empty
without a text); texts come back by it only where they are read, and then to works that lie side by side by text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from works_risk.session import spread_tasks

KEY, TEXT = "text_id", "work_desc"
#: Works of one text that a task lays side by side; a text with more of them goes to several tasks.
TOGETHER = 50_000


def text_key(text: Column) -> Column:
    return F.sha2(text, 256)


def distinct_texts(named: DataFrame) -> DataFrame:
    """``text_id, work_desc, n`` of a column ``work_desc``: each text once with the rows that name it.

    The text is a grouping key, so copies combine in hash tables before the shuffle and no row is sorted by its text.
    """
    known = named.select(text_key(F.col(TEXT)).alias(KEY), TEXT).filter(F.col(TEXT).isNotNull())
    return known.groupBy(KEY, TEXT).agg(F.count(F.lit(1)).alias("n"))


def beside(rows: DataFrame, facts: DataFrame, unique: Column, key: str = KEY) -> DataFrame:
    """Left join of ``rows`` with facts about their text (``key``, ``n``, others), rows of one text next to each other.

    Copies in neighbouring rows cost little in a compressed file. Facts are moved once, those of a text with more than
    ``TOGETHER`` rows once for each part of its rows. ``facts`` should be a written table.
    """
    parts = F.ceil(F.col("n") / TOGETHER).cast("int")
    # Each listed text has more than TOGETHER rows, so the list is short beside the rows.
    many = F.broadcast(facts.filter(F.col("n") > TOGETHER).select(key, parts.alias("_parts")))
    whole = F.coalesce("_parts", F.lit(1))
    placed = rows.join(many, key, "left").withColumn("_part", F.pmod(F.xxhash64(unique), whole).cast("int")).drop("_parts")
    each = F.explode(F.sequence(F.lit(0), F.when(F.col("n") > TOGETHER, parts).otherwise(1) - 1))
    held = facts.withColumn("_part", each).drop("n")
    # A join keeps the order of its left side.
    dealt = placed.repartition(spread_tasks(rows.sparkSession), key, "_part").sortWithinPartitions(key, "_part")
    values = [c for c in held.columns if c not in (key, "_part")]
    return dealt.join(held, [key, "_part"], "left").select(*[F.col(f"`{c}`") for c in rows.columns], *values)


def with_descriptions(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """``rows`` with the description in the place of its key, empty without one."""
    named = rows.join(texts.select(KEY, TEXT), KEY, "left")
    return named.select(*[F.coalesce(TEXT, F.lit("")).alias(TEXT) if c == KEY else F.col(f"`{c}`") for c in rows.columns])
