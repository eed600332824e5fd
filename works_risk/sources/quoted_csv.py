"""CSV files whose quoted fields hold line breaks, read by many tasks.

A split of a file starts somewhere in a line, and whether that is inside a quoted field depends on everything before it. So
lines are read in splits twice. The first pass folds every split to its effect: the state at its end, inside a quoted field or
not, for each state it may begin in. Effects are composed along each file, one row per split, which gives the state each
split begins in. The second pass cuts the lines of each split into records at line ends outside of quotes. Only records that
run over the end of a split are put together across tasks; all others stay where they were read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_SPLIT = ["file", "block"]
CORRUPT = "_corrupt_record"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with the file and the start of the split they were read from, in file order within a split."""
    rows = spark.read.option("lineSep", "\n").text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a line that begins inside a quoted field, or at the start of a field, ends inside one."""
    at = 0
    while True:
        if inside:
            at = line.find('"', at)
            if at < 0:
                return True
            if line.startswith('"', at + 1):  # a doubled quote stands for one
                at += 2
                continue
        elif line.startswith('"', at):
            at, inside = at + 1, True
            continue
        at = line.find(",", at)  # what is left of a field outside of quotes
        if at < 0:
            return False
        at, inside = at + 1, False


def _effects(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For every line the state at its end when it begins outside, and when it begins inside of quotes."""
    outside, inside = np.zeros(len(values), bool), np.ones(len(values), bool)
    quoted = np.flatnonzero(pc.match_substring(values, '"').to_numpy(zero_copy_only=False))
    for k, line in zip(quoted, values.take(pa.array(quoted)).to_pylist(), strict=True):
        outside[k], inside[k] = ends_inside(line, False), ends_inside(line, True)
    return outside, inside


def _states(outside: np.ndarray, inside: np.ndarray, start: bool) -> np.ndarray:
    """The state after each line."""
    place = np.arange(len(outside))
    fixed = outside == inside  # whatever the state was before
    last = np.maximum.accumulate(np.where(fixed, place, -1))
    turns = np.cumsum(outside & ~inside)
    base = np.where(last >= 0, outside[last], start)
    since = turns - np.where(last >= 0, turns[last], 0)
    return base ^ (since % 2 == 1)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, bool, pa.RecordBatch]]:
    """Each batch cut where the split changes: (file and block, whether the split goes on from the last piece, rows)."""
    held = None
    for batch in batches:
        start = 0
        while start < batch.num_rows:
            key = tuple(batch.column(c)[start].as_py() for c in _SPLIT)
            same = pc.and_(pc.equal(batch.column("file"), key[0]), pc.equal(batch.column("block"), key[1]))
            other = np.flatnonzero(~same.to_numpy(zero_copy_only=False)[start:])
            stop = start + int(other[0]) if len(other) else batch.num_rows
            yield key, key == held, batch.slice(start, stop - start)
            held, start = key, stop


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per split: its end state from either start state, and whether a record begins in it after the first line."""
    done: dict[tuple, list[bool]] = {}
    for key, _, rows in _pieces(batches):
        outside, inside = _effects(rows.column("value"))
        now = done.setdefault(key, [False, True])
        done[key] = [bool(_states(outside, inside, start)[-1]) for start in now]
    keys = list(done)
    columns = [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64())]
    columns += [pa.array([done[k][i] for k in keys], pa.bool_()) for i in (0, 1)]
    yield pa.RecordBatch.from_arrays(columns, [*_SPLIT, "outside", "inside"])


def _split_states(lines: DataFrame) -> DataFrame:
    """The state each split begins in: the effects of the splits before it, composed along the file."""
    folded = lines.mapInArrow(_fold, "file string, block long, outside boolean, inside boolean")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    fixed = F.col("outside") == F.col("inside")
    turn = (F.col("outside") & ~F.col("inside")).cast("long")
    turned = folded.withColumn("turns", F.sum(turn).over(Window.partitionBy("file").orderBy("block")))
    last = F.last(F.when(fixed, F.struct("outside", "turns")), ignorenulls=True).over(before)
    so_far = F.coalesce(F.last("turns").over(before), F.lit(0))
    known = turned.withColumns({"last": last, "so_far": so_far})
    odd = (F.col("so_far") - F.coalesce("last.turns", F.lit(0))) % 2 == 1
    return known.select(*_SPLIT, (F.coalesce("last.outside", F.lit(False)) != odd).alias("begins_inside"))


def _cut(batches: Iterator[pa.RecordBatch], whole: bool | None = None) -> Iterator[pa.RecordBatch]:
    """With ``whole`` the records that begin and end in a split, with False the parts of those that run over an end of it, else
    both. A part that goes on with the record of an earlier split is a ``head``."""
    state, open_lines, open_at, count, started = False, [], 0, 0, False
    held = None
    out: list[tuple] = []

    def flush(key: tuple) -> None:
        # The record that is open at the end of a split; a head has no start in it.
        if open_lines and whole in (None, not state and started):
            out.append((*key, open_at, "\n".join(open_lines), not started))

    def batch_of() -> pa.RecordBatch:
        columns = [[o[k] for o in out] for k in range(5)]
        out.clear()
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
        names = [*_SPLIT, "at", "record", "head"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    for key, goes_on, rows in _pieces(batches):
        if not goes_on:
            if held is not None:
                flush(held)
            state, open_lines, open_at, count = bool(rows.column("begins_inside")[0].as_py()), [], 0, 0
            started = not state
            held = key
        after = _states(*_effects(rows.column("value")), state)
        before = np.concatenate([[state], after[:-1]])
        starts = np.flatnonzero(~before)
        first = int(starts[0]) if len(starts) else rows.num_rows
        values = rows.column("value")
        open_lines += values.slice(0, first).to_pylist()
        if len(starts):
            if open_lines and whole in (None, started):
                out.append((*key, open_at, "\n".join(open_lines), not started))
            last = int(starts[-1])
            if whole is not False:
                texts = values.slice(0, last).to_pylist()
                edges = starts.tolist()
                out += [(*key, count + a, "\n".join(texts[a:b]) if b > a + 1 else texts[a], False) for a, b in pairwise(edges)]
            open_lines, open_at, started = values.slice(last).to_pylist(), count + last, True
        count += rows.num_rows
        state = bool(after[-1])
        yield batch_of()
    if held is not None:
        flush(held)
        yield batch_of()


def records(spark: SparkSession, path: str) -> DataFrame:
    """``file, block, at, record``: the records of CSV files, quoted line breaks and all, in file order by the first three."""
    lines = _lines(spark, path)
    states = _split_states(lines)
    met = lines.join(F.broadcast(states), _SPLIT)  # one row per split
    named = met.select(*_SPLIT, "value", "begins_inside")
    kinds = "file string, block long, at long, record string, head boolean"
    whole = named.mapInArrow(partial(_cut, whole=True), kinds).select("file", "block", "at", "record")
    # A part of a record: one that was begun in a split and is open at its end, or one that goes on.
    parts = named.mapInArrow(partial(_cut, whole=False), kinds)
    begun = Window.partitionBy("file").orderBy("block", "at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    owner = F.last(F.when(~F.col("head"), F.struct("block", "at")), ignorenulls=True).over(begun)
    joined = (
        parts.withColumn("owner", owner)
        .groupBy("file", "owner")
        .agg(F.sort_array(F.collect_list(F.struct("block", "at", "record"))).alias("parts"))
        .select("file", "owner.block", "owner.at", F.array_join("parts.record", "\n").alias("record"))
    )
    return whole.unionByName(joined)


def read_quoted(spark: SparkSession, path: str) -> DataFrame:
    """All-text columns as the header names them, the place of each record as ``file, block, at``, and the text of records
    that do not fit the header as ``_corrupt_record``."""
    header = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path).schema
    names = ", ".join(f"`{c.replace('`', '``')}` string" for c in [*header.fieldNames(), CORRUPT])
    found = records(spark, path)
    plain = F.regexp_replace("record", "\r$", "")
    # The first record of every file is its header; blank lines outside of quotes are no records.
    rows = found.filter(~((F.col("block") == 0) & (F.col("at") == 0))).withColumn("record", plain).filter(F.trim("record") != "")
    parsed = F.from_csv("record", names, {"escape": '"', "columnNameOfCorruptRecord": CORRUPT})
    return rows.select(*_SPLIT, "at", parsed.alias("_parsed")).select(*_SPLIT, "at", "_parsed.*")
