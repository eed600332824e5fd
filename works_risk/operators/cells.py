"""Vectors written out in cells, and exact nearest-vector searches that leave cells out.

Every vector goes to the nearest of a bounded number of centres. A cell keeps its centre, the largest distance of a member from it
and the number of members. Distances are those of unit vectors, so the triangle inequality holds: no member of a cell is
nearer to a query than the query's distance from the centre less the radius. A search first visits the nearest cells that hold
``k`` vectors; every cell that cannot hold a nearer vector than the k-th found there is left out, and the result is that of a full
search. Centres are a sample, which decides how many cells are left out and nothing else.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from works_risk.session import small_batches

# Vectors of a cell, and queries to it, that meet in one task.
QUERY_BLOCK, ANCHOR_BLOCK = 512, 4_096
MOST_CELLS = 1024
#: Cell of the zero vectors: every score with one of them is 0.
ZEROS = -1
_ACROSS = math.sqrt(2)
# Rounding of a distance between unit vectors stays far below this.
_SLACK = 1e-6


def unit_rows(vecs: pd.Series) -> np.ndarray:
    matrix = np.stack(vecs.to_numpy()).astype(float)
    size = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, size, out=np.zeros_like(matrix), where=size > 0)


def leading(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` highest scores, lower ids first among equals at the edge."""
    if len(scores) <= k:
        return np.arange(len(scores))
    edge = np.partition(scores, len(scores) - k)[len(scores) - k]
    above = np.flatnonzero(scores > edge)
    level = np.flatnonzero(scores == edge)
    return np.concatenate([above, level[np.argsort(ids[level])][: k - len(above)]])


def top_of(partial: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc("id"))
    return partial.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


@dataclass(frozen=True)
class Layout:
    """Of each cell its number, centre, radius and size; at most ``MOST_CELLS`` and one."""

    cell: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    size: np.ndarray

    def distances(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each query and cell the distance from the centre, and the least distance that a member may have."""
        at = np.full((len(unit), len(self.cell)), _ACROSS)
        if self.centre.shape[1]:  # there are vectors that are not zero
            at = np.sqrt(np.maximum(2 - 2 * (unit @ self.centre.T), 0))
        zero = ~unit.any(axis=1)
        at[:, self.cell == ZEROS] = _ACROSS
        at[zero] = _ACROSS
        least = np.maximum(at - self.radius, 0)
        least[zero] = _ACROSS
        return at, least


@dataclass(frozen=True)
class Cells:
    """``members`` (cell, id, vec) as written, and the layout of the cells."""

    members: DataFrame
    layout: Layout


def build(anchors: DataFrame, path: str) -> Cells:
    """Write ``anchors`` (``id``, ``vec``) in cells under ``path``."""
    spark = anchors.sparkSession
    small_batches(spark)
    rows = anchors.select("id", F.transform("vec", lambda x: x.cast("double")).alias("vec"))
    some = F.exists("vec", lambda x: x != 0)
    wanted = min(MOST_CELLS, max(1, math.isqrt(rows.count())))
    drawn = rows.filter(some).orderBy(F.xxhash64("id"), "id").limit(wanted).select("vec").collect()
    centre = unit_rows(pd.Series([np.array(r["vec"]) for r in drawn])) if drawn else np.zeros((0, 0))
    centre = np.unique(np.round(centre, 12), axis=0) if len(centre) else centre

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                unit = unit_rows(batch["vec"])
                cell = np.full(len(batch), ZEROS)
                away = np.zeros(len(batch))
                there = unit.any(axis=1)
                if there.any():
                    near = unit[there] @ centre.T
                    cell[there] = near.argmax(axis=1)
                    away[there] = np.sqrt(np.maximum(2 - 2 * near.max(axis=1), 0))
                yield pd.DataFrame({"cell": cell, "id": batch["id"], "vec": list(unit), "away": away})

    id_type = dict(rows.dtypes)["id"]
    placed = rows.mapInPandas(assign, f"cell int, id {id_type}, vec array<double>, away double")
    # By cell and, within a large one, by id, so that a cell of very many vectors is many files.
    placed.repartitionByRange("cell", F.xxhash64("id")).sortWithinPartitions("cell").write.parquet(f"{path}/members")
    members = spark.read.parquet(f"{path}/members")
    facts = members.groupBy("cell").agg(F.max("away").alias("radius"), F.count(F.lit(1)).alias("n"))
    facts.write.parquet(f"{path}/facts")
    if len(centre):
        listed = [(k, c.tolist()) for k, c in enumerate(centre)]
        spark.createDataFrame(listed, "cell int, centre array<double>").write.parquet(f"{path}/centres")
    return load(spark, path, centre if len(centre) else None)


def load(spark: SparkSession, path: str, centre: np.ndarray | None = None) -> Cells:
    """Cells written by ``build``."""
    members = spark.read.parquet(f"{path}/members").select("cell", "id", "vec")
    facts = sorted(spark.read.parquet(f"{path}/facts").collect(), key=lambda r: r["cell"])
    cell = np.array([r["cell"] for r in facts], np.int64)
    if centre is None and (cell >= 0).any():
        rows = spark.read.parquet(f"{path}/centres").orderBy("cell").collect()
        centre = np.array([r["centre"] for r in rows])
    width = centre.shape[1] if centre is not None else 0
    own = np.zeros((len(cell), width))
    for k, c in enumerate(cell):
        if c >= 0:
            own[k] = centre[c]
    layout = Layout(cell, own, np.array([r["radius"] for r in facts], float), np.array([r["n"] for r in facts], np.int64))
    return Cells(members, layout)


def _visit(cells: Cells, asked: DataFrame, k: int, id_type: str) -> DataFrame:
    """The ``k`` best per query, cell and part of (query, asked_vec, cell); a cell is read in parts, its queries come in blocks."""
    blocks = asked.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("blocks"))
    parts = cells.members.sparkSession.createDataFrame(
        [(int(c), max(1, math.ceil(int(n) / ANCHOR_BLOCK))) for c, n in zip(cells.layout.cell, cells.layout.size)] or [(ZEROS, 1)], "cell int, parts int"
    )
    # One row per cell that is asked for: at most MOST_CELLS and one.
    facts = F.broadcast(blocks.join(parts, "cell"))
    spread = lambda df, key, own, other, n_own, n_other: df.join(facts, "cell").select(
        *df.columns,
        F.pmod(F.xxhash64(key), F.col(n_own).cast("long")).cast("int").alias(own),
        F.explode(F.sequence(F.lit(0), F.col(n_other) - 1)).alias(other),
    )
    q = spread(asked, "query", "qb", "ab", "blocks", "parts").groupBy("cell", "ab", "qb")
    a = spread(cells.members, "id", "ab", "qb", "parts", "blocks").groupBy("cell", "ab", "qb")

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(left) and len(right):
            scores = np.stack(left["asked_vec"].to_numpy()) @ np.stack(right["vec"].to_numpy()).T
            ids = right["id"].to_numpy()
            for query, row in zip(left["query"], scores, strict=True):
                found += [(query, ids[i], row[i]) for i in leading(row, ids, k)]
        return pd.DataFrame(found, columns=["query", "id", "score"])

    kind = dict(asked.dtypes)["query"]
    return q.cogroup(a).applyInPandas(best, f"query {kind}, id {id_type}, score double")


def _asked(layout: Layout, queries: DataFrame, choose) -> DataFrame:
    """``query, asked_vec, cell`` for the cells that ``choose`` picks from the distances of a query."""
    kind = dict(queries.dtypes)["query"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                unit = unit_rows(batch["vec"])
                at, least = layout.distances(unit)
                picked = choose(batch, at, least)
                row, column = np.nonzero(picked)
                if len(row):
                    yield pd.DataFrame({"query": batch["query"].to_numpy()[row], "asked_vec": list(unit[row]), "cell": layout.cell[column]})

    return queries.mapInPandas(run, f"query {kind}, asked_vec array<double>, cell int")


def first_cells(at: np.ndarray, size: np.ndarray, k: int) -> np.ndarray:
    """Which cells to visit first: the nearest ones that together hold ``k`` vectors."""
    order = np.argsort(at, axis=1, kind="stable")
    before = np.cumsum(size[order], axis=1) - size[order]
    picked = np.zeros(at.shape, bool)
    np.put_along_axis(picked, order, before < k, axis=1)
    return picked


def further_cells(cells: Cells, queries: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """``query, asked_vec, cell``: what is left to visit once the first cells gave ``found``."""
    worst = found.filter(F.col("place") == k).select(F.col("query").alias("_query"), F.col("score").alias("worst"))
    known = queries.join(worst, F.col("query") == F.col("_query"), "left").drop("_query")
    layout = cells.layout

    def choose(batch: pd.DataFrame, at: np.ndarray, least: np.ndarray) -> np.ndarray:
        # Without k hits so far all cells are visited: there are fewer than k vectors, or none.
        reach = np.sqrt(np.maximum(2 - 2 * batch["worst"].fillna(-1.0).to_numpy(float), 0))
        return (least <= reach[:, None] + _SLACK) & ~first_cells(at, layout.size, k)

    return _asked(layout, known, choose)


def search(cells: Cells, queries: DataFrame, k: int) -> DataFrame:
    """The ``k`` vectors of highest cosine for each distinct query (``query``, ``vec``); ties go to the lower id."""
    id_type = dict(cells.members.dtypes)["id"]
    queries = queries.select("query", F.transform("vec", lambda x: x.cast("double")).alias("vec"))
    layout = cells.layout
    if not len(layout.cell):
        kind = dict(queries.dtypes)["query"]
        return cells.members.sparkSession.createDataFrame([], f"query {kind}, id {id_type}, score double, place int")
    first = _visit(cells, _asked(layout, queries, lambda _, at, __: first_cells(at, layout.size, k)), k, id_type)
    found = top_of(first, k)
    rest = _visit(cells, further_cells(cells, queries, found, k), k, id_type)
    return top_of(found.drop("place").unionByName(rest), k)
