"""Groups of rows that meet in tasks: cut into tiles of bounded size, read back run by run, answered by forests."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from works_risk.llm.components import Forest
from works_risk.session import scratch

KEYS = ["key", "i", "j"]


def tiled(rows: DataFrame, count: Column, most: int) -> DataFrame:
    """Cut the keys with more than ``most`` nodes: nodes fall into chunks by hash, and every two chunks meet in a tile (i, j).

    ``side`` is 2 inside a chunk, else which of the two chunks a node is from.
    """
    parts = F.ceil(count / most).cast("int")
    chunk = F.pmod(F.xxhash64("node"), F.col("_parts").cast("long")).cast("int")
    tiles = F.transform(
        F.sequence(F.lit(0), F.col("_parts") - 1),
        lambda j: F.struct(
            F.least(F.col("_chunk"), j).alias("i"),
            F.greatest(F.col("_chunk"), j).alias("j"),
            F.when(F.col("_chunk") == j, 2).when(F.col("_chunk") < j, 0).otherwise(1).alias("side"),
        ),
    )
    made = rows.withColumn("_parts", parts).withColumn("_chunk", chunk).withColumn("_tile", F.explode(tiles))
    return made.select(*rows.columns, "_tile.i", "_tile.j", "_tile.side")


def written(df: DataFrame, name: str) -> DataFrame:
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def meet(rows: DataFrame, run, schema: str = "a long, b long") -> DataFrame:
    """Bring the rows of each tile together and run the comparison."""
    laid = rows.repartition(*KEYS).sortWithinPartitions(*KEYS, "node")
    return laid.mapInArrow(run, schema)


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal ``keys`` from sorted batches; small runs come several at a time, never cut."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = [batch.column(k)[batch.num_rows - 1] for k in keys]
        ids = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        same = np.ones(batch.num_rows, bool)
        for values, end in zip(ids, last):
            same &= values == end.as_py()
        cut = int(np.argmax(same))  # where the last run of this batch begins
        if cut or (held and any(held[-1].column(k)[-1] != batch.column(k)[0] for k in keys)):
            yield pa.Table.from_batches([*held, batch.slice(0, cut)], batch.schema)
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def run_edges(table: pa.Table, keys: list[str]) -> np.ndarray:
    values = [table.column(k).to_numpy() for k in keys]
    new = np.ones(table.num_rows, bool)
    if table.num_rows:
        new[1:] = np.any([v[1:] != v[:-1] for v in values], axis=0)
    return np.append(np.flatnonzero(new), table.num_rows)


def forest_links(number: dict[int, int], forest: Forest) -> pa.RecordBatch:
    nodes = list(number)
    roots = [nodes[forest.root(k)] for k in range(len(nodes))]
    pairs = [(a, b) for a, b in zip(nodes, roots, strict=True) if a != b]
    return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])


def byte_rows(table: np.ndarray) -> pa.Array:
    """A binary value for each row of bytes."""
    edges = np.arange(len(table) + 1, dtype=np.int32) * table.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(table), [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(table))])


def byte_matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), width)
