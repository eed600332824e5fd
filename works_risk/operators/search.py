"""Nearest vectors and reading the flags table."""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from works_risk.functions.cleaning import has_text
from works_risk.functions.vectors import EmbedMany, embedding, hashed_trigrams
from works_risk.operators import cells
from works_risk.operators.cells import Cells
from works_risk.operators.ordering import page, top_rows
from works_risk.operators.texts import KEY, TEXT, beside
from works_risk.session import scratch, settle, small_batches, spread



def nearest(
    anchors: DataFrame | Cells, queries: DataFrame | list[tuple[object, list[float]]], k: int
) -> DataFrame:
    """The ``k`` anchors (``id``, ``vec``) of highest cosine for each query (``query``, ``vec``).

    ``anchors`` may be written cells (``cells.build``), of which only those are read that can hold a hit. Anchors given as a
    table are scored directly while all queries fit into one block, and are written in cells first when there are more, so
    that no anchor is copied to every block of queries. Zero vectors score 0. Ties go to the lower id.
    """
    if isinstance(queries, list):
        if not queries:
            raise ValueError("no query vectors")
        key = "string" if isinstance(queries[0][0], str) else "bigint"
        queries = SparkSession.active().createDataFrame(queries, f"query {key}, vec array<double>")
    asked = queries.select("query", "vec")
    if not isinstance(anchors, Cells):
        if asked.limit(cells.QUERY_BLOCK + 1).count() <= cells.QUERY_BLOCK:
            return _direct(anchors, asked, k)
        anchors = cells.build(anchors, scratch(anchors.sparkSession, "cells"))
    return cells.search(anchors, asked, k).withColumn("score", F.round("score", 4))


def _direct(anchors: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """One block of queries meets every part of the anchors in a task."""
    # Both sides may come from one table, so one of them gets a name of its own.
    held = anchors.select("id", "vec")
    parts = max(1, math.ceil(held.count() / cells.ANCHOR_BLOCK))
    q = asked.select("query", F.col("vec").alias("asked_vec"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("ab")).groupBy("ab")
    a = held.withColumn("ab", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")).groupBy("ab")

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(left) and len(right):
            scores = cells.unit_rows(left["asked_vec"]) @ cells.unit_rows(right["vec"]).T
            ids = right["id"].to_numpy()
            for query, row in zip(left["query"], scores, strict=True):
                found += [(query, ids[i], row[i]) for i in cells.leading(row, ids, k)]
        return pd.DataFrame(found, columns=["query", "id", "score"])

    types = dict(asked.dtypes)["query"], dict(held.dtypes)["id"]
    partial = q.cogroup(a).applyInPandas(best, f"query {types[0]}, id {types[1]}, score double")
    return cells.top_of(partial, k).withColumn("score", F.round("score", 4))


def anchor_table(
    flags: DataFrame, n: int | None = None, embed_many: EmbedMany = hashed_trigrams, texts: DataFrame | None = None
) -> DataFrame:
    """``work_id, vec`` of the flagged works with text, of the ``n`` riskiest when given.

    With ``texts`` works carry the key of their text: each text is embedded once, and works of one text lie side by side.
    """
    if texts is not None:
        small_batches(flags.sparkSession)
        usable = flags.filter(F.col("is_flagged") & (F.col(KEY) != "")).select("work_id", KEY, "risk_score")
        kept = top_rows(usable, risk_order(), n).select("work_id", KEY)
        asked = spread(texts.join(kept.select(KEY).distinct(), KEY, "left_semi"), KEY)
        vectors = settle(asked.select(KEY, "n", embedding(F.col(TEXT), embed_many).alias("vec")))
        return beside(kept, vectors, F.col("work_id")).select("work_id", "vec")
    usable = flags.filter(F.col("is_flagged") & has_text(F.col("work_desc"))).select(
        "work_id", "work_desc", "risk_score"
    )
    kept = top_rows(usable, risk_order(), n)
    small_batches(flags.sparkSession)
    return kept.select("work_id", embedding(F.col("work_desc"), embed_many).alias("vec"))


def similar_works(
    desc: str, anchors: DataFrame | Cells, works: DataFrame, k: int = 5, embed_many: EmbedMany = hashed_trigrams
) -> DataFrame:
    """``work_id, work_desc, score`` of the ``k`` anchors nearest to a description.

    ``anchors`` is the table of them (``work_id``, ``vec``), or its cells with the work ids as ``id``.
    """
    if not 1 <= k <= 50:
        raise ValueError("k must be within 1..50")
    vec = [float(x) for x in np.asarray(embed_many([desc]), dtype=float)[0]]
    held = anchors if isinstance(anchors, Cells) else anchors.select(F.col("work_id").alias("id"), "vec")
    hits = nearest(held, [(0, vec)], k)
    texts = works.select(F.col("work_id").alias("id"), "work_desc")
    return hits.join(texts, "id", "left").select(
        F.col("id").alias("work_id"), F.coalesce("work_desc", F.lit("")).alias("work_desc"), "score", "place"
    )


def contains(c: Column, text: str, regex: bool = False) -> Column:
    """Case-insensitive containment; NULL is no match."""
    found = c.rlike("(?i)" + text) if regex else F.lower(c).contains(text.lower())
    return F.coalesce(found, F.lit(False))


def filtered_works(
    flags: DataFrame, mp: str = "", state: str = "", fraud_type: str = "", min_risk: float = 0.0, regex: bool = False
) -> DataFrame:
    """Flagged works under all given filters; an empty filter does not restrict."""
    if not 0 <= min_risk <= 100:
        raise ValueError("min_risk must be within 0..100")
    tests = [F.col("is_flagged"), F.col("risk_score") >= min_risk]
    if mp:
        tests.append(contains(F.col("mp_name"), mp, regex))
    if state:
        tests.append(contains(F.col("state"), state, regex))
    if fraud_type:
        tests.append(F.col("fraud_type") == fraud_type)
    return flags.filter(reduce(and_, tests))


def risk_order() -> list[Column]:
    return [F.desc("risk_score"), F.asc("work_id")]


def works_page(flags: DataFrame, number: int = 1, size: int = 50, **filters) -> tuple[int, DataFrame]:
    """Total number of matching works and one page of them, riskiest first."""
    found = filtered_works(flags, **filters)
    return found.count(), page(found, risk_order(), number, size)


def one_work(flags: DataFrame, work_id: str) -> DataFrame:
    return flags.filter(F.col("work_id") == work_id)


def json_records(df: DataFrame) -> DataFrame:
    """One JSON text per row; NULL and not-a-number values are written as null."""
    plain = [
        F.when(~F.isnan(c), F.col(c)).alias(c) if kind in ("double", "float") else F.col(c) for c, kind in df.dtypes
    ]
    return df.select(F.to_json(F.struct(*plain), {"ignoreNullFields": "false"}).alias("record"))
