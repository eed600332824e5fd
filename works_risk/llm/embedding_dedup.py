"""Embedding near-dedup with randomised-rotation binary codes.

A unit vector is rotated at random and keeps the signs of its coordinates, one bit each, and a correction factor: its inner
product with the unit vector of those signs. The inner product of another vector with the sign vector, divided by the
factor, estimates the inner product of the two without bias, with a bound that follows from the factor and the dimension.
A pair whose upper bound is below the threshold is done; every other pair is computed exactly, in double precision.

Which pairs are looked at comes from further random rotations: the largest coordinate of a rotated vector, with its sign, is a
hash that near vectors share. A table joins as many of them as it takes to make buckets of unrelated vectors small, and
there are as many tables as make the chance to miss a pair at the threshold ``miss`` at most (both follow from
the number of vectors and the dimension).

Steps: (1) equal vectors fold to one node; (2) buckets with several nodes, cut into tiles, give a forest of exact links;
(3) its components are cut into tiles in turn, and every pair inside is decided once, by bound or exactly, which
counts the links of each node. Tasks write forests and counts, never the pairs of a group.

Defined results: vectors that are null, empty, zero or hold a null or non-finite component link with nothing, and
vectors of different lengths do not link. Rows are vectors: repeated rows link with each other. A null vec_id takes part and
is never the smallest while a component has another. Other columns, labels too, are not read. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from works_risk.llm.components import Forest, components
from works_risk.operators.lookup import attach
from works_risk.llm.minhash_dedup import mix
from works_risk.llm.tiles import KEYS, forest_links, meet, run_edges, runs, tiled, written


@dataclass(frozen=True)
class Params:
    threshold: float = 0.9
    #: Chance to look past a pair at the threshold.
    miss: float = 1e-6
    #: Width of the bound, in standard errors of the estimate.
    width: float = 6.0
    tile: int = 1024
    seed: int = 5


@lru_cache(maxsize=8)
def rotation(dim: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dim, 0]).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


@lru_cache(maxsize=8)
def share_rate(dim: int, threshold: float, seed: int) -> float:
    """Chance that two vectors at the threshold have the same largest rotated coordinate (by a fixed simulation)."""
    random = np.random.default_rng([seed, dim, 1])
    x, z = random.normal(size=(2, 40_000, dim))
    y = threshold * x + math.sqrt(1 - threshold**2) * z
    same = np.abs(x).argmax(axis=1) == np.abs(y).argmax(axis=1)
    at = np.abs(x).argmax(axis=1)
    rows = np.arange(len(x))
    rate = float((same & (x[rows, at] * y[rows, at] > 0)).mean())
    return min(max(rate - 3 * math.sqrt(rate * (1 - rate) / len(x)), 1e-3), 0.999)


def layout(dim: int, n: int, params: Params) -> tuple[int, int]:
    """Hashes per table and number of tables for ``n`` vectors."""
    hashes = max(1, math.ceil(math.log(8 * max(n, 2)) / math.log(max(2 * dim, 2))))
    hit = share_rate(dim, params.threshold, params.seed) ** hashes
    return hashes, max(1, math.ceil(math.log(params.miss) / math.log1p(-hit)))


def bucket_keys(unit: np.ndarray, hashes: int, tables: int, params: Params) -> np.ndarray:
    """One 64-bit key per vector and table."""
    n, dim = unit.shape
    random = np.random.default_rng([params.seed, dim, 2])
    out = np.zeros((n, tables), np.uint64)
    small = unit.astype(np.float32)
    for t in range(tables):
        turned = (small @ random.normal(size=(dim, hashes * dim)).astype(np.float32)).reshape(n, hashes, dim)
        at = np.abs(turned).argmax(axis=2)
        sign = np.take_along_axis(turned, at[:, :, None], axis=2)[:, :, 0] > 0
        h = np.full(n, (dim << 20) + t, np.uint64)
        for k in range(hashes):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + (2 * at[:, k] + sign[:, k]).astype(np.uint64))
        out[:, t] = h
    return out.view(np.int64)


class Coded:
    """Unit vectors with their sign codes and correction factors."""

    def __init__(self, unit: np.ndarray, params: Params):
        dim = unit.shape[1]
        self.unit, self.params = unit, params
        self.turned = unit @ rotation(dim, params.seed)
        self.signs = np.where(self.turned >= 0, 1.0, -1.0) / math.sqrt(dim)
        self.factor = np.maximum((self.signs * self.turned).sum(axis=1), 1e-9)
        spread = np.sqrt(np.maximum(1 - self.factor**2, 0)) / self.factor
        self.slack = params.width * spread / math.sqrt(max(dim - 1, 1)) if dim > 1 else np.full(len(unit), np.inf)

    def links(self, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
        """For each row and column, whether the two vectors reach the threshold."""
        estimate = (self.turned[rows] @ self.signs[columns].T) / self.factor[columns]
        maybe = estimate + self.slack[columns] >= self.params.threshold
        out = np.zeros(maybe.shape, bool)
        some = maybe.any(axis=1)
        if some.any():
            exact = self.unit[rows[some]] @ self.unit[columns].T
            out[some] = maybe[some] & (exact >= self.params.threshold)
        return out


def _kind(vectors: DataFrame, column: str) -> str:
    return "<f8" if "double" in vectors.schema[column].dataType.simpleString() else "<f4"


def _valid(vectors: DataFrame) -> DataFrame:
    """vec_id and the vector as bytes, for the rows that can link."""
    kind = _kind(vectors, "embedding")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = [], []
            for vec_id, vector in zip(batch.column("vec_id"), batch.column("embedding"), strict=True):
                if vector.is_valid and not vector.values.null_count:
                    x = vector.values.to_numpy(zero_copy_only=False)
                    if len(x) and np.isfinite(x).all() and x.any():
                        ids.append(vec_id.as_py())
                        rows.append(x.astype(kind).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(rows, pa.binary())], ["vec_id", "vector"])

    source = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    return source.mapInArrow(run, "vec_id long, vector binary")


def _units(column: pa.Array, kind: str) -> np.ndarray:
    """Unit vectors of one length, in double precision."""
    x = np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _hash(kind: str, n: int, params: Params):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.array([len(v) for v in batch.column("vector").to_pylist()])
            for size in np.unique(sizes):
                own = batch.take(pa.array(np.flatnonzero(sizes == size)))
                unit = _units(own.column("vector"), kind)
                hashes, tables = layout(unit.shape[1], n, params)
                keys = bucket_keys(unit, hashes, tables, params)
                edges = np.arange(len(unit) + 1, dtype=np.int32) * tables
                lists = pa.ListArray.from_arrays(edges, pa.array(keys.reshape(-1)))
                yield pa.RecordBatch.from_arrays([own.column("node"), lists], ["node", "keys"])

    return run


def _others(sides: np.ndarray, at: int, start: int, stop: int) -> np.ndarray:
    rest = np.arange(at + 1, stop)
    return rest if sides[at] == 2 else rest[sides[rest] != sides[at]]


def _forest(kind: str, params: Params):
    """Exact links inside buckets, as a forest over all tiles of the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number: dict[int, int] = {}
        forest = Forest(0)
        for table in runs(batches, KEYS):
            edges = run_edges(table, KEYS)
            local = np.array([number.setdefault(n, len(number)) for n in table.column("node").to_pylist()])
            forest.parent.extend(range(len(forest.parent), len(number)))
            sides, vector = table.column("side").to_numpy(), table.column("vector").combine_chunks()
            for start, stop in zip(edges[:-1], edges[1:], strict=True):
                if stop - start < 2:
                    continue
                coded = Coded(_units(vector.slice(start, stop - start), kind), params)
                for at in range(start, stop - 1):
                    rest = _others(sides, at, start, stop)
                    own = forest.root(int(local[at]))
                    roots = np.fromiter((forest.root(int(x)) for x in local[rest]), np.int64, len(rest))
                    rest = rest[roots != own]
                    if len(rest):
                        for other in rest[coded.links(np.array([at - start]), rest - start)[0]]:
                            forest.join(int(local[at]), int(local[other]))
        yield forest_links(number, forest)

    return run


def _count(kind: str, params: Params):
    """Rows that each node links with, inside the tiles of its component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, KEYS):
            edges = run_edges(table, KEYS)
            sides, copies = table.column("side").to_numpy(), table.column("n_copies").to_numpy()
            vector, total = table.column("vector").combine_chunks(), np.zeros(table.num_rows, np.int64)
            for start, stop in zip(edges[:-1], edges[1:], strict=True):
                coded = Coded(_units(vector.slice(start, stop - start), kind), params)
                side, own = sides[start:stop], copies[start:stop]
                whole = np.arange(stop - start)
                inner = len(side) > 0 and side[0] == 2
                left, right = (whole, whole) if inner else (whole[side == 0], whole[side == 1])
                if not len(left) or not len(right):
                    continue
                linked = coded.links(left, right)
                if inner:  # a pair is one pair: what either estimate finds
                    linked |= linked.T
                    np.fill_diagonal(linked, False)
                total[start + left] += linked @ own[right]
                if not inner:
                    total[start + right] += own[left] @ linked
            yield pa.RecordBatch.from_arrays([table.column("node").combine_chunks(), pa.array(total)], ["node", "links"])

    return run


def links(vectors: DataFrame, params: Params = Params()) -> DataFrame:
    """``vectors`` (vec_id, embedding) to one row each: vec_id, n_links, component_id and kept."""
    kind = _kind(vectors, "embedding")
    rows = _valid(vectors)
    folded = rows.groupBy("vector").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("n_copies"))
    nodes = written(folded.withColumn("node", F.monotonically_increasing_id()), "vector-nodes")
    n = nodes.count()

    hashed = nodes.select("node", "vector").mapInArrow(_hash(kind, n, params), "node long, keys array<long>")
    entries = written(hashed.select("node", F.explode("keys").alias("key")), "vector-keys")
    shared = entries.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    sizes = written(shared.withColumn("size", F.col("n")), "vector-buckets")
    met = attach(entries, sizes, "key", F.col("node")).filter(F.col("size").isNotNull())
    bucketed = tiled(met, F.col("size"), params.tile).join(nodes.select("node", "vector"), "node")
    found = written(components(written(meet(bucketed, _forest(kind, params)), "vector-links")), "vector-groups")

    group_sizes = found.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    placed = attach(found, written(group_sizes.withColumn("size", F.col("n")), "vector-group-sizes"), "component", F.col("node"))
    placed = placed.withColumnRenamed("component", "key")
    grouped = tiled(placed, F.col("size"), params.tile).join(nodes.select("node", "vector", "n_copies"), "node")
    counted = meet(grouped, _count(kind, params), "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))

    of_node = nodes.select("node", "first", "n_copies").join(found, "node", "left").join(counted, "node", "left")
    of_node = written(of_node.withColumn("component", F.coalesce("component", "node")), "vector-members")
    least = of_node.groupBy("component").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("n"))
    named = attach(of_node, written(least, "vector-components"), "component", F.col("node"))
    # A linked vector is found again by its id and a hash of its bytes; one that cannot link has no hash.
    facts = named.join(nodes.select("node", "vector"), "node").select(
        F.md5("vector").alias("_digest"), F.col("n_copies").alias("n"), "component_id",
        (F.coalesce("links", F.lit(0)) + F.col("n_copies") - 1).cast("long").alias("n_links"),
    )
    good = rows.select("vec_id", F.md5("vector").alias("_digest"))
    bad = _invalid(vectors)
    linked = attach(good, written(facts, "vector-facts"), "_digest", F.col("vec_id")).select("vec_id", "n_links", "component_id")
    every = linked.unionByName(bad.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return every.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _invalid(vectors: DataFrame) -> DataFrame:
    """The ids of the rows that ``_valid`` leaves out."""
    x = F.col("embedding")
    odd = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    bad = x.isNull() | (F.size(x) == 0) | F.exists(x, odd) | F.forall(x, lambda v: v == 0)
    return vectors.filter(F.coalesce(bad, F.lit(True))).select(F.col("vec_id").cast("long").alias("vec_id"))
