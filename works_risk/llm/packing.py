"""Order-preserving packing by dynamic programming.

Documents in ascending ``doc_id`` form one stream of ids per partition. Windows of at most ``length`` ids are cut at the end of a
document, at the end of a sentence, or, inside a stretch without either, every ``gap`` ids. The cuts minimise padding
plus a penalty for each cut inside a document and a small price for each window, exactly: the best cut before ``j`` is the least of ``cost + position`` over
a sliding window, which a monotone queue holds, so each candidate costs constant time. A window of a power of two needs no
padding and is tried on its own.

A partition is read as a stream, and the size of its chunks decides nothing: costs, predecessors and the queue go on from one
chunk to the next. After each ``CHUNK`` ids those windows leave that every way to go on has in common, so what is held is the
chunk and the windows on which the ways still differ: a few, or a long text without a sentence end. Range partitions split by
size, not by key.

Defined results: a null text is empty and has the end id only; each id lies in exactly one piece; repeated rows
are packed each; texts of any length are cut into as many pieces as needed; equal ids go by the hash of the text, null first.
Other columns do not enter. An empty table gives no rows.
"""

from __future__ import annotations

import bisect
import heapq
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from works_risk.llm.tokens import SLICE_BYTES, Encoder, binary_rows, sentence_ends, with_end, worker_encoder
from works_risk.llm.words import give_back_memory, long_text_batches, text_slices

CHUNK = 1 << 19
_PART_BITS = 33


@dataclass(frozen=True)
class Params:
    length: int = 1024
    end: int = 0
    #: In ids: the price of a cut at the end of a sentence, and elsewhere inside a document.
    sentence_penalty: int = 4
    forced_penalty: int = 24
    #: Most ids without a candidate.
    gap: int = 64
    #: In ids: the price of a window, so that a stretch is not cut into many short powers of two.
    window_price: int = 8
    #: Shorter powers of two are not tried as windows of their own.
    least_power: int = 1


def candidates(doc_ends: np.ndarray, sentence_cuts: np.ndarray, params: Params) -> tuple[np.ndarray, np.ndarray]:
    """Ascending cut positions from 0 to the end of the last document, and the penalty of each."""
    natural = np.unique(np.concatenate([[0], doc_ends, sentence_cuts]))
    steps = np.maximum(-(-np.diff(natural) // params.gap) - 1, 0)
    before = np.cumsum(steps) - steps
    extra = np.repeat(natural[:-1], steps) + params.gap * (np.arange(steps.sum()) - np.repeat(before, steps) + 1)
    at = np.sort(np.concatenate([natural, extra]))
    penalty = np.full(len(at), params.forced_penalty)
    penalty[np.searchsorted(at, sentence_cuts)] = params.sentence_penalty
    penalty[np.searchsorted(at, doc_ends)] = 0
    penalty[0] = 0
    return at, penalty


class Cutter:
    """The cheapest way to cut candidates into windows, as candidates arrive."""

    def __init__(self, length: int, window_price: int = 0, least_power: int = 1):
        self.length, self.window_price, self.least_power = length, window_price, least_power
        self.place, self.cost, self.came = [0], [0], [0]
        self.waiting: deque[tuple[int, int]] = deque([(0, 0)])  # (cost + position, candidate), both ascending

    def extend(self, at: np.ndarray, penalty: np.ndarray) -> None:
        """Take on further candidates, ascending and behind those known."""
        known, length = len(self.place), self.length
        every = np.concatenate([np.array(self.place, np.int64), at])
        exact: dict[int, list[int]] = {}
        size = self.least_power
        while size < length:
            found = np.searchsorted(every, every[known:] - size)
            hits = np.flatnonzero(every[found] == every[known:] - size)
            for j, i in zip((hits + known).tolist(), found[hits].tolist(), strict=True):
                if j in exact:
                    exact[j].append(i)
                else:
                    exact[j] = [i]
            size *= 2
        place, cost, came, waiting = self.place, self.cost, self.came, self.waiting
        place += at.tolist()
        cost += (penalty + self.window_price).tolist()  # until the cheapest way before it is added
        came += [0] * len(at)
        none: tuple[int, ...] = ()
        of = exact.get
        for j in range(known, len(place)):
            here = place[j]
            first = here - length
            while place[waiting[0][1]] < first:
                waiting.popleft()
            value, best = waiting[0]
            value += length - here
            for i in of(j, none):
                if cost[i] < value:
                    value, best = cost[i], i
            value += cost[j]
            cost[j] = value
            came[j] = best
            value += here
            while waiting and waiting[-1][0] >= value:
                waiting.pop()
            waiting.append((value, j))

    def _chain(self, j: int) -> np.ndarray:
        cuts = [j]
        while cuts[-1]:
            cuts.append(self.came[cuts[-1]])
        return np.array([self.place[k] for k in reversed(cuts)], np.int64)

    def finish(self) -> np.ndarray:
        """All cuts up to the last candidate, first and last included."""
        return self._chain(len(self.place) - 1)

    def release(self) -> np.ndarray:
        """The cuts that all ways to go on share; positions count from the last of them afterwards."""
        place = self.place
        last = bisect.bisect_right(place, place[-1] - self.length)
        # Candidates that a later window may begin at; the latest is replaced by its predecessor until one is left.
        live = [-k for k in range(last, len(place))]
        heapq.heapify(live)
        while len(live) > 1:
            top = heapq.heappop(live)
            if live[0] != top:
                heapq.heappush(live, -self.came[-top])
        common = -live[0]
        cuts, base = self._chain(common), place[common]
        self.place = [x - base for x in place[common:]]
        self.cost = self.cost[common:]
        self.came = [max(0, x - common) for x in self.came[common:]]
        self.waiting = deque((key - base, k - common) for key, k in self.waiting if k >= common)
        return cuts


def best_cuts(at: np.ndarray, penalty: np.ndarray, length: int, window_price: int = 0, least_power: int = 1) -> np.ndarray:
    """The cut positions, first and last included, of the cheapest way to cut the candidates into windows.

    Windows of a power of two from ``least_power`` on are tried as unpadded ones.
    """
    cutter = Cutter(length, window_price, least_power)
    cutter.extend(at[1:], penalty[1:])
    return cutter.finish()


class _Stream:
    """The documents of one partition on their way into windows."""

    def __init__(self, ends_sentence: np.ndarray, params: Params):
        self.ends_sentence, self.params = ends_sentence, params
        self.ids: list[np.ndarray] = []
        self.docs: list[tuple[object, int, int]] = []  # (doc_id, ids already gone, ids in all)
        self.n = 0
        self.cutter = Cutter(params.length, params.window_price, params.least_power)
        self.seen, self.seen_docs = 0, 0  # ids and documents that the cutter knows
        self.sequence = 0

    def add(self, doc_ids: list, ids: np.ndarray, offsets: np.ndarray) -> None:
        self.docs += zip(doc_ids, [0] * len(doc_ids), np.diff(offsets).tolist())
        self.ids.append(ids)
        self.n += len(ids)

    @property
    def fresh(self) -> int:
        return self.n - self.seen

    def settle(self, last: bool) -> dict[str, list | np.ndarray] | None:
        """Cut what has come; windows leave that no later document can change, all of them if this is the end."""
        if not self.n:
            return None
        ids = np.concatenate(self.ids)
        self.ids = [ids]
        if self.fresh:
            ends = np.cumsum(np.array([t for _, _, t in self.docs[self.seen_docs :]], np.int64))
            sentences = np.flatnonzero(self.ends_sentence[ids[self.seen :]]) + 1
            at, penalty = candidates(ends, sentences, self.params)
            self.cutter.extend(at[1:] + self.seen, penalty[1:])
            self.seen, self.seen_docs = self.n, len(self.docs)
        cuts = self.cutter.finish() if last else self.cutter.release()
        if len(cuts) < 2:
            return None
        gone = np.array([g for _, g, _ in self.docs], np.int64)
        total = np.array([t for _, _, t in self.docs], np.int64)
        doc_ends = np.cumsum(total - gone)
        stop = int(cuts[-1])
        edges = np.unique(np.concatenate([cuts, doc_ends[doc_ends < stop]]))
        starts, sizes = edges[:-1], np.diff(edges)
        doc = np.searchsorted(doc_ends, starts, side="right")
        window = np.searchsorted(cuts, starts, side="right") - 1
        out = {
            "doc_id": [self.docs[k][0] for k in doc],
            "start": starts - (doc_ends - total)[doc],
            "length": sizes,
            "doc_tokens": total[doc],
            "sequence": self.sequence + window,
            "offset": starts - cuts[window],
            "ids": binary_rows(ids[:stop].astype("<u4"), edges),
        }
        self.sequence += len(cuts) - 1
        done = int(np.searchsorted(doc_ends, stop, side="right"))
        rest = self.docs[done:]
        if rest:  # the first may be cut: what is gone of it counts from its own start
            before = int(doc_ends[done] - (total - gone)[done])
            rest[0] = (rest[0][0], rest[0][1] + max(0, stop - before), rest[0][2])
        self.docs, self.ids, self.n = rest, [ids[stop:]], len(ids) - stop
        self.seen, self.seen_docs = self.n, len(rest)
        return out


def pack(docs: DataFrame, path: str, params: Params = Params(), keep_encoder: bool = True) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text): doc_id, start, length, doc_tokens, sequence_id, offset, and ids as binary.

    ``sequence_id`` holds the partition in its upper bits and counts windows from 0 in its lower 33. ``keep_encoder`` lets a
    worker keep its encoder and the pieces it knows for its next task; without it, later stages find that memory free, and texts
    are encoded in smaller slices.
    """
    long_text_batches(docs.sparkSession, 2_000 if keep_encoder else 1_000)
    source = docs.select("doc_id", "text")
    id_type = source.schema["doc_id"].dataType
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    laid = source.repartitionByRange(*order).sortWithinPartitions(*order)
    names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
    schema = f"doc_id {id_type.simpleString()}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, encoder = _Stream(sentence_ends(path), params), worker_encoder(path) if keep_encoder else Encoder(path)
        base = TaskContext.get().partitionId() << _PART_BITS
        kind = None

        def rows(last: bool) -> Iterator[pa.RecordBatch]:
            got = stream.settle(last)
            if got and len(got["length"]):
                numbers = [got["start"], got["length"], got["doc_tokens"], base + got["sequence"], got["offset"]]
                columns = [pa.array(got["doc_id"], kind), *[pa.array(v, pa.int64()) for v in numbers], got["ids"]]
                yield pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            kind = batch.column("doc_id").type
            for part in text_slices(batch, "text", SLICE_BYTES if keep_encoder else SLICE_BYTES // 3):
                ids, offsets = with_end(*encoder.encode(part.column("text")), params.end)
                stream.add(part.column("doc_id").to_pylist(), ids, offsets)
                if stream.fresh >= CHUNK:
                    yield from rows(False)
        yield from rows(True)
        del encoder
        stream.ids = []
        give_back_memory()

    return laid.mapInArrow(run, schema)
