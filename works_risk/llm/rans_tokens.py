"""Token ids on disk by a static range asymmetric numeral system.

One table of symbol frequencies, counted over all documents, serves every file. The ids of a shard form one stream in the
order of the documents, cut into independent blocks; a block is coded by ``LANES`` interleaved coders that share
one run of 32-bit words. Every ``STRIDE`` rows of ids the coder states and the place in the words are kept as a checkpoint, so a
reader starts at any of them; numpy decodes all checkpoints of a group of blocks side by side. Each block has checksums of its
words and of its ids.

A shard file: the magic bytes, the blocks, the document index (an Arrow stream with one row per document), a JSON footer
with the place of each block, and the footer's length. Tasks write shards under names of their own into the shared
folder; only shards named in the written manifest count, so a task that runs twice leaves an unread file and no harm.

Defined results: a null text is empty, and every document ends with the end id, so an empty one has just that. Documents
follow ``doc_id``, null first; equal ids follow a hash of their ids. Repeated rows are written each. A text of any length is
written whole; other columns do not enter the files. An empty table gives no shard and no rows.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from works_risk.sources.files import open_input, open_output
from works_risk.llm.tokens import SLICE_BYTES, binary_rows, flat_values, with_end, worker_encoder
from works_risk.llm.words import long_text_batches, text_slices
from works_risk.session import scratch

MAGIC = b"RANS-IDS-1\n"
LANES, STRIDE, BLOCK_ROWS = 32, 512, 2048
BLOCK = LANES * BLOCK_ROWS
#: Full blocks that are coded together.
GROUP = 32
SCALE = 20
#: Tokenising is all that its stage does, so its workers can keep more pieces.
KNOWN_PIECES = 500_000
_LOW = np.uint64(1 << 31)
_WORD = np.uint64(32)
_MASK = np.uint64((1 << SCALE) - 1)


@dataclass
class Table:
    """Frequencies that sum to 2**SCALE; a symbol that occurs has at least one."""

    freq: np.ndarray

    def __post_init__(self):
        self.start = (np.cumsum(self.freq) - self.freq).astype(np.uint64)
        self.freq = self.freq.astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))
        self.crc = zlib.crc32(self.freq.astype("<u4").tobytes())

    @classmethod
    def of_counts(cls, counts: np.ndarray) -> Table:
        """Scale counts: floors of the shares, at least 1, and the rest by the most frequent symbols."""
        counts = np.asarray(counts, np.float64)
        there = counts > 0
        whole = 1 << SCALE
        if not there.any():
            return cls(np.zeros(len(counts), np.int64))
        free = whole - int(there.sum())
        freq = np.where(there, 1 + np.floor(counts / counts.sum() * free), 0).astype(np.int64)
        freq[int(np.argmax(counts))] += whole - int(freq.sum())
        return cls(freq)


def _encode_rows(ids: np.ndarray, table: Table) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Encode blocks of equal size, given as (block, row, lane): checkpoint states, their places, and words of each."""
    blocks, rows, lanes = ids.shape
    freq, start = table.freq[ids], table.start[ids]
    state = np.full((blocks, lanes), _LOW, np.uint64)
    words, out = np.zeros((rows, blocks, lanes), np.uint32), np.zeros((rows, blocks, lanes), bool)
    marks = list(range(0, rows, STRIDE))
    kept = np.zeros((len(marks), blocks, lanes), np.uint64)
    shift, top = np.uint64(SCALE), np.uint64(63 - SCALE)
    for r in range(rows - 1, -1, -1):
        f, c = freq[:, r], start[:, r]
        full = state >= f << top
        words[r] = state.astype(np.uint32)
        out[r] = full
        state = np.where(full, state >> _WORD, state)
        share = state // f
        state = (share << shift) + (state - share * f) + c
        if r % STRIDE == 0:
            kept[r // STRIDE] = state
    made = []
    for b in range(blocks):
        own = out[:, b]
        before = np.concatenate([[0], np.cumsum(own.sum(axis=1))])
        made.append((kept[:, b], before[marks].astype(np.uint32), words[:, b][own]))
    return made


def _decode_rows(states: np.ndarray, places: np.ndarray, words: np.ndarray, rows: int, table: Table) -> np.ndarray:
    """Decode runs of ``rows`` rows from their checkpoints, side by side: (run, row, lane)."""
    state, place = states.copy(), places.astype(np.int64)
    out = np.zeros((len(states), rows, states.shape[1]), np.uint32)
    words = np.append(words, np.zeros(states.shape[1], np.uint32))
    shift = np.uint64(SCALE)
    for r in range(rows):
        slot = state & _MASK
        symbol = table.symbol[slot]
        out[:, r] = symbol
        state = table.freq[symbol] * (state >> shift) + slot - table.start[symbol]
        low = state < _LOW
        rank = np.cumsum(low, axis=1)
        word = words[place[:, None] + rank - low].astype(np.uint64)
        state = np.where(low, state << _WORD | word, state)
        place += rank[:, -1]
    return out


def encode_blocks(ids: np.ndarray, table: Table) -> list[bytes]:
    """Independent blocks of ids, as bytes. All but the last have BLOCK ids."""
    full = len(ids) // BLOCK
    groups = [ids[: full * BLOCK].reshape(full, BLOCK_ROWS, LANES)] if full else []
    tail = ids[full * BLOCK :]
    if len(tail):  # the last row is filled with the most frequent id
        filled = np.full(-(-len(tail) // LANES) * LANES, np.argmax(table.freq), np.uint32)
        filled[: len(tail)] = tail
        groups.append(filled.reshape(1, -1, LANES))
    made, at = [], 0
    for group in groups:
        for states, places, words in _encode_rows(group, table):
            own = ids[at : at + BLOCK]
            at += len(own)
            body = states.astype("<u8").tobytes() + places.astype("<u4").tobytes() + words.astype("<u4").tobytes()
            head = [len(own), len(states), len(words), zlib.crc32(own.astype("<u4").tobytes()), zlib.crc32(body), table.crc]
            made.append(np.array(head, "<u4").tobytes() + body)
    return made


def decode_blocks(blocks: list[bytes], table: Table) -> np.ndarray:
    """The ids of the blocks, in order. Raises ValueError where a checksum or a length differs."""
    runs: dict[int, list] = {}
    heads, words, base = [], [], 0
    for b, block in enumerate(blocks):
        n, marks, n_words, crc_ids, crc_body, crc_table = np.frombuffer(block, "<u4", 6).tolist()
        body = block[24:]
        if crc_table != table.crc:
            raise ValueError("the block was coded with another table")
        if len(body) != marks * (LANES * 8 + 4) + 4 * n_words or zlib.crc32(body) != crc_body:
            raise ValueError("a block is damaged")
        states = np.frombuffer(body, "<u8", marks * LANES).reshape(marks, LANES)
        places = np.frombuffer(body, "<u4", marks, marks * LANES * 8).astype(np.int64) + base
        words.append(np.frombuffer(body, "<u4", n_words, marks * (LANES * 8 + 4)))
        base += n_words
        rows = -(-n // LANES)
        heads.append((n, crc_ids))
        for k in range(marks):
            runs.setdefault(min(STRIDE, rows - k * STRIDE), []).append((b, k, states[k], places[k]))
    flat = np.concatenate(words) if words else np.zeros(0, np.uint32)
    out = [np.zeros(-(-n // LANES) * LANES, np.uint32) for n, _ in heads]
    for rows, group in runs.items():
        states = np.stack([s for _, _, s, _ in group])
        got = _decode_rows(states, np.array([p for _, _, _, p in group]), flat, rows, table)
        for (b, k, _, _), ids in zip(group, got):
            out[b][k * STRIDE * LANES : k * STRIDE * LANES + rows * LANES] = ids.reshape(-1)
    for k, (n, crc) in enumerate(heads):
        out[k] = out[k][:n]
        if zlib.crc32(out[k].astype("<u4").tobytes()) != crc:
            raise ValueError("a block decodes to other ids")
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


class ShardWriter:
    """Writes one shard: documents in, blocks out, a bounded number of ids in memory."""

    def __init__(self, path: str, table: Table):
        self.path, self.table, self.file, self.at = path, table, open_output(path), len(MAGIC)
        self.file.write(MAGIC)
        self.held: list[np.ndarray] = []
        self.n_held = self.n_ids = 0
        self.places: list[tuple[int, int]] = []
        self.docs: list[pa.RecordBatch] = []

    def add(self, docs: pa.RecordBatch, ids: np.ndarray) -> None:
        """Documents (doc_id, n_tokens) and their ids, concatenated."""
        self.docs.append(docs)
        self.held.append(ids)
        self.n_held += len(ids)
        self.n_ids += len(ids)
        if self.n_held >= GROUP * BLOCK:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        stop = len(ids) if last else len(ids) // BLOCK * BLOCK
        for start in range(0, stop, GROUP * BLOCK):
            for block in encode_blocks(ids[start : min(stop, start + GROUP * BLOCK)], self.table):
                self.file.write(block)
                self.places.append((self.at, len(block)))
                self.at += len(block)
        self.held, self.n_held = [ids[stop:]], len(ids) - stop

    def close(self) -> None:
        self._flush(True)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, self.docs[0].schema) as stream:
            for batch in self.docs:
                stream.write_batch(batch)
        index = sink.getvalue().to_pybytes()
        foot = {"blocks": self.places, "index": [self.at, len(index)], "n_ids": self.n_ids, "table": self.table.crc}
        text = json.dumps(foot).encode()
        self.file.write(index + text + len(text).to_bytes(8, "little"))
        self.file.close()


def read_shard(path: str, table: Table) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Documents of a shard in order, some at a time: the index rows, their ids, and the first position of each."""
    with open_input(path) as file:
        size = file.size()
        file.seek(0)
        if file.read(len(MAGIC)) != MAGIC:
            raise ValueError(f"{path} is no shard")
        file.seek(size - 8)
        length = int.from_bytes(file.read(8), "little")
        file.seek(size - 8 - length)
        foot = json.loads(file.read(length))
        file.seek(foot["index"][0])
        docs = pa.ipc.open_stream(file.read(foot["index"][1])).read_all().combine_chunks()
        docs = docs.to_batches()[0] if docs.num_rows else None
        if docs is None:
            return
        edges = np.concatenate([[0], np.cumsum(docs.column("n_tokens").to_numpy())])
        if edges[-1] != foot["n_ids"]:
            raise ValueError(f"{path}: the index does not add up")
        held, at, doc = np.zeros(0, np.uint32), 0, 0
        for k in range(0, len(foot["blocks"]), GROUP):
            blocks = []
            for place, length in foot["blocks"][k : k + GROUP]:
                file.seek(place)
                blocks.append(file.read(length))
            held = np.concatenate([held, decode_blocks(blocks, table)])
            stop = int(np.searchsorted(edges, at + len(held), side="right")) - 1
            if stop > doc:
                used = int(edges[stop]) - at
                yield docs.slice(doc, stop - doc), held[:used], edges[doc : stop + 1] - at
                held, at, doc = held[used:], int(edges[stop]), stop
        if doc != docs.num_rows:
            raise ValueError(f"{path} ends early")


@dataclass
class Written:
    """Written shards: ``manifest`` has shard (in order of the documents), path, n_docs and n_tokens of each."""

    manifest: DataFrame
    table: Table


def _tokenise(path: str, end: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(path, KNOWN_PIECES)
        for batch in batches:
            for part in text_slices(batch, "text", 6 * SLICE_BYTES // 5):
                ids, offsets = with_end(*encoder.encode(part.column("text")), end)
                rows = binary_rows(ids.astype(kind), offsets)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), rows], ["doc_id", "ids"])

    return run


def _count(kind: str, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(flat_values(batch.column("ids"), kind)[0], minlength=size)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int64()), pa.array(total[there])], ["id", "n"])

    return run


def _write(folder: str, table_of, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, n_docs = None, 0
        for batch in batches:
            for part in text_slices(batch, "ids", SLICE_BYTES):
                writer = writer or ShardWriter(f"{folder}/{uuid.uuid4().hex}.rans", table_of.value)
                ids, offsets = flat_values(part.column("ids"), kind)
                sizes = pa.array(np.diff(offsets).astype(np.int64))
                writer.add(pa.RecordBatch.from_arrays([part.column("doc_id"), sizes], ["doc_id", "n_tokens"]), ids.astype(np.uint32))
                n_docs += part.num_rows
        if writer:
            writer.close()
            shard = TaskContext.get().partitionId()
            row = [[shard], [writer.path], [n_docs], [writer.n_ids]]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)], ["shard", "path", "n_docs", "n_tokens"])

    return run


def write(docs: DataFrame, path: str, vocab: int, end: int = 0) -> Written:
    """Tokenise ``docs`` (doc_id, text), count all ids, and write shards in ascending ``doc_id``.

    Ids are written once to the shared folder, so that counting and coding neither tokenise again nor lose work with an
    executor. ``vocab`` bounds the table.
    """
    spark = docs.sparkSession
    long_text_batches(spark, 2_000)
    kind = "<u2" if vocab <= 1 << 16 else "<u4"
    source = docs.select("doc_id", "text")
    id_type = source.schema["doc_id"].dataType.simpleString()
    tokens = scratch(spark, "token-ids")
    source.mapInArrow(_tokenise(path, end, kind), f"doc_id {id_type}, ids binary").write.parquet(tokens)
    coded = spark.read.parquet(tokens)
    counts = np.zeros(vocab, np.int64)
    for row in coded.select("ids").mapInArrow(_count(kind, vocab), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[row["id"]] = row["n"]
    table = Table.of_counts(counts)
    folder, listed = scratch(spark, "rans"), scratch(spark, "rans-manifest")
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("ids")]
    laid = coded.repartitionByRange(*order).sortWithinPartitions(*order)
    held = spark.sparkContext.broadcast(table)
    schema = "shard long, path string, n_docs long, n_tokens long"
    laid.mapInArrow(_write(folder, held, kind), schema).write.parquet(listed)
    return Written(spark.read.parquet(listed), table)


def read(spark: SparkSession, written: Written, id_type: str = "bigint") -> DataFrame:
    """The documents of the shards: doc_id, start (ids of all documents before), n_tokens, and ids as binary."""
    held = spark.sparkContext.broadcast(written.table)
    # One row per shard goes through this window.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = written.manifest.withColumn("before", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    shards = max(1, written.manifest.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("before").to_pylist()):
                for docs, ids, offsets in read_shard(path, held.value):
                    columns = [docs.column("doc_id"), pa.array(start + offsets[:-1]), docs.column("n_tokens"), binary_rows(ids.astype("<u4"), offsets)]
                    start += int(offsets[-1])
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids"])

    schema = f"doc_id {id_type}, start long, n_tokens long, ids binary"
    return placed.select("path", "before").repartition(shards).mapInArrow(run, schema)
