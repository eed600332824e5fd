"""Filter interaction audit: what each filter of a chain removes, for every order of the chain.

One pass over the bytes of a text gives all counts. A transducer of two states (gap, word) reads a table by state and
byte: the output says whether a word starts or ends here and whether the byte is a capital, the first byte of a code point or
a symbol. The next state follows from the byte alone, so the pass runs over whole slices in numpy. Word spans go
into an open-addressing hash table per slice; a span that meets an owner of equal hash is compared with it byte by byte, so
the number of distinct words is exact.

Each document keeps one bit per filter that it fails and a digest of its text. Copies are found by digest over the whole
table: a partial minimum of ``doc_id``, brought back by ``lookup.attach``, so a text with very many copies is no task of its
own. Documents then fold to one row per part and bit pattern, at most 32 per part, and everything about the 120 orders
follows from those: what a filter removes depends only on the set of filters before it, not on their order.

Defined results: a null text is the empty text, a null part the empty string. A null ``doc_id`` has no label and is no smaller
id of any other. Rows that repeat a ``doc_id`` with its text count each, and none is a copy of another. Labels that repeat an id
count once, as 1 if any of them is 1. Bytes that are not UTF-8 count a code point for each byte that is no continuation.
Other columns are not read. An empty table has no parts and gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from works_risk.llm.minhash_dedup import mix
from works_risk.llm.tiles import written
from works_risk.llm.words import long_text_batches, text_slices
from works_risk.operators.lookup import attach

GAPS = b" \t\n\v\f\r"
SYMBOLS = b"#$%&*|"
GAP, WORD = 0, 1
START, END, CAPITAL, POINT, SYMBOL = 1, 2, 4, 8, 16
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
#: Words up to this many bytes are hashed and compared eight bytes at a time for all spans at once.
WIDE = 64


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """(next state by byte, outputs by state and byte) of the transducer."""
    code = np.arange(256)
    gap = np.isin(code, list(GAPS))
    both = np.where((code >= 65) & (code <= 90), CAPITAL, 0)
    both += np.where((code & 0xC0) != 0x80, POINT, 0) + np.where(np.isin(code, list(SYMBOLS)), SYMBOL, 0)
    out = np.stack([both + np.where(gap, 0, START), both + np.where(gap, END, 0)])
    return np.where(gap, GAP, WORD).astype(np.uint8), out.astype(np.uint8).reshape(-1)


NEXT, OUT = _tables()
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


@dataclass
class Counts:
    """Per text."""

    words: np.ndarray
    distinct: np.ndarray
    capitals: np.ndarray
    points: np.ndarray
    symbols: np.ndarray


@dataclass(frozen=True)
class Filter:
    """A named test over the counts; true means the document fails. Its place in the list is its bit."""

    name: str
    fails: Callable[[Counts], np.ndarray]


FILTERS = (
    Filter("A", lambda c: c.words < 100),
    Filter("B", lambda c: 100 * c.distinct < 80 * c.words),
    Filter("C", lambda c: 100 * c.capitals > 10 * c.points),
    Filter("D", lambda c: c.symbols > 0),
)
#: The last filter asks the whole table: identical to the text of a smaller id.
COPY = "E"
NAMES = "".join(f.name for f in FILTERS) + COPY


class SpanTable:
    """Word spans of a slice, each the span itself or the first equal span of its text."""

    def __init__(self, data: np.ndarray, text: np.ndarray, start: np.ndarray, size: np.ndarray):
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        self.data, self.text, self.start, self.size = data, text, start, size
        self.eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))  # the eight bytes from each place on

    def _load(self, spans: np.ndarray, done: int) -> np.ndarray:
        return self.eight[self.start[spans] + done] & _MASKS[np.minimum(self.size[spans] - done, 8)]

    def hashes(self) -> np.ndarray:
        import xxhash

        h = mix(self.text.astype(np.uint64) * _GOLDEN + self.size.astype(np.uint64))
        live = np.flatnonzero(self.size <= WIDE)
        for done in range(0, WIDE, 8):
            live = live[self.size[live] > done]
            if not len(live):
                break
            h[live] = mix(h[live] * _GOLDEN + self._load(live, done))
        for k in np.flatnonzero(self.size > WIDE):
            h[k] ^= np.uint64(xxhash.xxh3_64_intdigest(self.data[self.start[k] : self.start[k] + self.size[k]]))
        return h

    def equal(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether spans a and b (places, pair by pair) are of one text and hold the same bytes."""
        same = (self.text[a] == self.text[b]) & (self.size[a] == self.size[b])
        live = np.flatnonzero(same & (a != b))
        wide = live[self.size[a[live]] > WIDE]
        for k in wide:
            i, j, n = self.start[a[k]], self.start[b[k]], self.size[a[k]]
            same[k] = np.array_equal(self.data[i : i + n], self.data[j : j + n])
        live = live[self.size[a[live]] <= WIDE]
        for done in range(0, WIDE, 8):
            live = live[self.size[a[live]] > done]
            if not len(live):
                break
            good = self._load(a[live], done) == self._load(b[live], done)
            same[live[~good]] = False
            live = live[good]
        return same

    def first(self) -> np.ndarray:
        """For each span whether it entered the table, that is, is the first of its word in its text."""
        count = len(self.start)
        bits = max(1, (2 * count).bit_length())
        last = np.uint64((1 << bits) - 1)
        owner = np.full(1 << bits, -1, np.int64)
        entered = np.zeros(count, bool)
        h, waiting = self.hashes(), np.arange(count)
        while len(waiting):
            slot = (h[waiting] & last).astype(np.int64)
            free = owner[slot] < 0
            owner[slot[free][::-1]] = waiting[free][::-1]  # of several spans the first one stays
            holder = owner[slot]
            entered[waiting[holder == waiting]] = True
            left = ~((h[waiting] == h[holder]) & self.equal(waiting, holder))
            waiting = waiting[left]
            h[waiting] += np.uint64(1)  # equal words wait in the same slots, so they move on together
        return entered


def scan(texts: pa.Array) -> tuple[Counts, np.ndarray, np.ndarray]:
    """Counts of each text, and the bytes of all texts with the edges between them."""
    filled = pc.fill_null(texts, "").cast(pa.large_string())
    buffers = filled.buffers()
    edges = np.frombuffer(buffers[1], np.int64)[filled.offset : filled.offset + len(filled) + 1] if len(filled) else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8)[edges[0] : edges[-1]] if edges[-1] > edges[0] else np.zeros(0, np.uint8)
    edges = edges - edges[0]
    after = NEXT[data]
    state = np.empty(len(data), np.uint8)
    if len(data):
        state[1:] = after[:-1]
        state[edges[:-1][edges[:-1] < len(data)]] = GAP  # every text begins in a gap
    out = OUT[(state.astype(np.uint16) << 8) | data]

    def per_text(places: np.ndarray) -> np.ndarray:
        return np.diff(np.searchsorted(places, edges))

    begins = np.flatnonzero(out & START)
    stops = edges[1:][np.diff(edges) > 0]
    stops = stops[after[stops - 1] == WORD]
    ends = np.sort(np.concatenate([np.flatnonzero(out & END), stops]))
    text = np.searchsorted(edges, begins, side="right") - 1
    entered = SpanTable(data, text, begins, ends - begins).first()
    counts = Counts(
        words=per_text(begins),
        distinct=per_text(begins[entered]),
        capitals=per_text(np.flatnonzero(out & CAPITAL)),
        points=np.diff(edges) - per_text(np.flatnonzero((out & POINT) == 0)),
        symbols=per_text(np.flatnonzero(out & SYMBOL)),
    )
    return counts, data, edges


def _judge(filters: tuple[Filter, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                counts, data, edges = scan(part.column("text"))
                bits = sum((f.fails(counts).astype(np.int32) << k for k, f in enumerate(filters)), np.zeros(part.num_rows, np.int32))
                digests = [hashlib.sha256(data[a:b]).digest() for a, b in zip(edges[:-1], edges[1:])]
                columns = [part.column("doc_id"), part.column("part"), pa.array(bits, pa.int32()), pa.array(digests, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "part", "bits", "digest"])

    return run


def patterns(docs: DataFrame, labels: DataFrame, part: str = "lang", filters: tuple[Filter, ...] = FILTERS) -> DataFrame:
    """(part, bits, n, good, toxic): documents of each pattern of failed filters, copies being the last bit."""
    long_text_batches(docs.sparkSession)
    source = docs.select("doc_id", "text", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"))
    id_type = source.schema["doc_id"].dataType.simpleString()
    judged = source.select("doc_id", "part", "text").mapInArrow(_judge(filters), f"doc_id {id_type}, part string, bits int, digest binary")
    judged = written(judged, "audit-rows")
    copies = judged.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = attach(judged, written(copies, "audit-copies"), "digest", F.xxhash64("doc_id", "digest"))
    copied = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False))
    bits = F.col("bits") + F.when(copied, 1 << len(filters)).otherwise(0)
    folded = met.groupBy("doc_id", "part", bits.alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    one = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False))
    known = labels.groupBy("doc_id").agg(one("quality").alias("good"), one("toxic").alias("toxic"))
    marked = folded.join(known.withColumnRenamed("doc_id", "_labelled"), F.col("doc_id") == F.col("_labelled"), "left")
    if_so = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0))
    return marked.groupBy("part", "bits").agg(F.sum("n").alias("n"), if_so("good").alias("good"), if_so("toxic").alias("toxic"))


def _places(spark: SparkSession, names: str) -> DataFrame:
    """Every order and step with the bit of its filter and the bits of those before it; fixed by the names alone."""
    rows = []
    for order in permutations(range(len(names))):
        for step, k in enumerate(order):
            rows.append(("".join(names[x] for x in order), step + 1, 1 << k, sum(1 << x for x in order[:step])))
    return spark.createDataFrame(rows, "filter_order string, step int, bit int, before int")


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang", filters: tuple[Filter, ...] = FILTERS) -> DataFrame:
    """One row per part, order of the filters and step of the order."""
    names = "".join(f.name for f in filters) + COPY
    found = written(patterns(docs, labels, part, filters), "audit-patterns")
    size = len(names)
    # What a step does depends on its filter and the set before it: 80 cases for five filters.
    cases = [(1 << k, m) for k in range(size) for m in range(1 << size) if not m >> k & 1]
    case = F.explode(F.array(*[F.struct(F.lit(b).alias("bit"), F.lit(m).alias("before")) for b, m in cases]))
    laid = found.withColumn("case", case).select("part", "bits", "n", "good", "toxic", "case.bit", "case.before")
    fails = F.col("bits").bitwiseAND(F.col("bit")) != 0
    gone = F.col("bits").bitwiseAND(F.col("before")) != 0
    total = lambda when, what="n": F.sum(F.when(when, F.col(what)).otherwise(0)).cast("long")
    done = laid.groupBy("part", "bit", "before").agg(
        total(~fails & ~gone).alias("kept"),
        total(fails & ~gone).alias("removed"),
        total(fails & gone).alias("redundant"),
        total(F.col("bits") == F.col("bit")).alias("unique_fails"),
        total(fails & ~gone, "good").alias("good_lost"),
        total(fails & ~gone, "toxic").alias("toxic_lost"),
    )
    orders = [factorial(m) * factorial(size - 1 - m) for m in range(size)]  # orders with so many filters before
    weight = F.get(F.array(*[F.lit(x).cast("long") for x in orders]), F.bit_count("before"))
    shares = Window.partitionBy("part", "bit")
    done = done.withColumn("shapley", F.sum(F.col("removed") * weight).over(shares))
    return done.join(F.broadcast(_places(docs.sparkSession, names)), ["bit", "before"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    )
