"""Words and hashed character n-grams of Arrow text batches, in numpy.

A batch is cut into slices of bounded bytes (a single longer text is its own slice), and each distinct word of a slice is
hashed once, however often it occurs.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

SLICE_BYTES = 2_500_000
BATCH_ROWS = 1_000


def long_text_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Hand Python fewer rows at a time than Spark's default, where the session keeps that default: texts are long, and a batch
    is held on both sides."""
    name, default = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"
    if spark.conf.get(name, default) == default:
        spark.conf.set(name, rows)


@cache
def _trim() -> Callable[[int], int] | None:
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):  # another C library
        return None


def give_back_memory() -> None:
    """Return freed memory to the system: workers outlive their tasks, and the next stage needs it."""
    pa.default_memory_pool().release_unused()
    trim = _trim()
    if trim is not None:
        trim(0)


def text_slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose text stays under ``limit`` bytes; one longer text is a run of its own."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    start = 0
    while start < batch.num_rows:
        before = ends[start] - sizes[start]
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop
    give_back_memory()


@dataclass
class Bag:
    """Distinct words, the word number of every position, and the first position of each document (one more at the end)."""

    words: list[str]
    at: np.ndarray
    offsets: np.ndarray

    @property
    def document(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))


def bag_of(texts: pa.Array) -> Bag:
    """Lower-cased words between white space. A null text has none."""
    lists = pc.utf8_split_whitespace(pc.utf8_lower(pc.fill_null(texts, "").cast(pa.large_string())))
    coded = lists.values.dictionary_encode()
    words, at = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    if "" in words:  # white space at the ends of a text gives empty words
        real = at != words.index("")
        before = np.concatenate([[0], np.cumsum(real)])
        at, offsets = at[real], before[offsets]
    return Bag(words, at, offsets)


@cache
def letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


_GAP = 0x20


def _codes(words: list[str]) -> np.ndarray:
    joined = " " + " ".join(words) + " "
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)


def ngrams(words: list[str], low: int, high: int, bits: int, only_letters: bool) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the character n-grams (low..high) of every word and the word each belongs to.

    A word counts its edges as one character each. With ``only_letters`` any other character ends a word, so
    punctuation and digits give no n-gram of their own.
    """
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    codes = _codes(words)
    word = np.cumsum(codes == _GAP) - 1
    if only_letters:
        codes = np.where(letters()[codes], codes, _GAP).astype(np.uint32)
    gap = codes == _GAP
    gaps = np.concatenate([[0], np.cumsum(gap)])
    rolling = codes.astype(np.uint64)
    hashed, owner = [], []
    powers = np.uint64(0x9E3779B97F4A7C15)
    h = np.zeros(len(codes), np.uint64)
    for n in range(1, high + 1):
        size = len(codes) - n + 1
        if size <= 0:
            break
        h = h[:size] * powers + rolling[n - 1 :] + np.uint64(1)
        if n < low:
            continue
        # An edge may start or end an n-gram; none may lie inside, and one of edges alone is none.
        inside = gaps[n - 1 : n - 1 + size] - gaps[1 : 1 + size] if n > 2 else 0
        empty = (gaps[n : n + size] - gaps[:size]) >= min(n, 2) if n <= 2 else False
        good = np.flatnonzero((inside == 0) & ~np.asarray(empty)) if n > 1 else np.flatnonzero(~gap)
        x = (h[good] ^ (h[good] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * n)
        hashed.append((x >> np.uint64(64 - bits)).astype(np.int64))
        # A leading edge belongs to the word after it.
        owner.append(word[good] - 0)
    if not hashed:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(hashed), np.minimum(np.concatenate(owner), len(words) - 1)


def per_document(values: np.ndarray, bag: Bag) -> np.ndarray:
    """Sum over each document of a value (or a row of values) per distinct word."""
    taken = values[bag.at]
    edges = np.concatenate([np.zeros((1, *taken.shape[1:])), np.cumsum(taken, axis=0, dtype=np.float64)])
    return edges[bag.offsets[1:]] - edges[bag.offsets[:-1]]
