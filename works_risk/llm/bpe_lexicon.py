"""Byte-level BPE through a lexicon: a minimal acyclic transducer for frequent words, exact merges for the rest.

Spark counts the words of all documents and keeps the ``lexicon_words`` most frequent. Their ids are merged once and
compiled into a minimal acyclic automaton: words share prefixes and suffixes, each arc carries the number of words that sort
before it, and the sum along a path is the word's place in the table of ids. The automaton is a flat binary file of
bounded size that Spark ships to every executor, where workers map it into memory. Words it lacks go through the merge
table, all words of a slice at once in numpy; decoding concatenates token bytes.

Defined results: a null text is empty and has no ids; a text of any length is encoded whole; repeated rows get
equal ids. The literal text of the vocabulary's special token is that token, as the tokenizer's own library has it. Columns
named like an output column are replaced by it. An empty table gives an empty lexicon and no rows.
"""

from __future__ import annotations

import heapq
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from works_risk.sources.files import write_bytes
from works_risk.llm.tokens import SLICE_BYTES, PieceEncoder, binary_rows, byte_alphabet, flat_values, ragged_take
from works_risk.llm.words import long_text_batches, text_slices
from works_risk.session import scratch, shared_dir

LEXICON_WORDS = 60_000
#: Most bytes of a piece of the lexicon.
LONGEST_PIECE = 64
_NONE = np.int32(1 << 30)
_WIDTHS = (4, 8, 16, 32, 64)


class Bpe:
    """Vocabulary and merge table of a byte-level tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            whole = json.load(file)
        model = whole["model"]
        vocab = model["vocab"]
        byte_of = {c: b for b, c in enumerate(byte_alphabet())}
        self.special = {t["content"]: t["id"] for t in whole["added_tokens"]}
        n = 1 + max([*vocab.values(), *self.special.values()])
        spelled = [b""] * n
        for token, k in vocab.items():
            spelled[k] = bytes(byte_of[c] for c in token if c in byte_of)
        for token, k in self.special.items():
            spelled[k] = token.encode()
        self.spelled_lengths = np.fromiter(map(len, spelled), np.int64, n)
        self.spelled_starts = np.cumsum(self.spelled_lengths) - self.spelled_lengths
        self.spelled = np.frombuffer(b"".join(spelled), np.uint8)
        self.byte_id = np.array([vocab[c] for c in byte_alphabet()], np.int32)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left = np.fromiter((vocab[a] for a, _ in merges), np.int64, len(merges))
        right = np.fromiter((vocab[b] for _, b in merges), np.int64, len(merges))
        self.merged = np.fromiter((vocab[a + b] for a, b in merges), np.int32, len(merges))
        self.n = n
        keys = left * n + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank_of_key = keys[order], order.astype(np.int32)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge rank of each pair, a large number where the pair does not merge."""
        key = left.astype(np.int64) * self.n + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((left >= 0) & (right >= 0) & (self.keys[at] == key), self.rank_of_key[at], _NONE)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, concatenated, and their number per word."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        low = 0
        for width in _WIDTHS:
            own = np.flatnonzero((sizes > low) & (sizes <= width))
            low = width
            if len(own):
                rows = self._merge_rows([words[k] for k in own], sizes[own], width)
                done.append((own, rows[rows >= 0], (rows >= 0).sum(axis=1)))
        for k in np.flatnonzero(sizes > _WIDTHS[-1]):
            ids = self._merge_long(words[k])
            done.append((np.array([k]), ids, np.array([len(ids)])))
        lengths = np.zeros(len(words), np.int64)
        starts = np.zeros(len(words), np.int64)
        before = 0
        for own, ids, number in done:
            lengths[own] = number
            starts[own] = before + np.cumsum(number) - number
            before += len(ids)
        flat = np.concatenate([ids for _, ids, _ in done]).astype(np.uint32) if done else np.zeros(0, np.uint32)
        return ragged_take(flat, starts, lengths), lengths

    def _merge_rows(self, words: list[bytes], sizes: np.ndarray, width: int) -> np.ndarray:
        """One row of ids per word, padded with -1: in each round every word does its first merge of lowest rank."""
        column = np.arange(width)
        out = np.full((len(words), width), -1, np.int32)
        out[column < sizes[:, None]] = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        ids, row = out.copy(), np.arange(len(words))
        ranks = np.full(ids.shape, _NONE, np.int32)
        ranks[:, :-1] = self.ranks(ids[:, :-1], ids[:, 1:])
        while True:
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(row)), at]
            live = best < _NONE
            if not live.all():
                out[row[~live]] = ids[~live]
                ids, ranks, row, at, best = ids[live], ranks[live], row[live], at[live], best[live]
            if not len(row):
                return out
            each = np.arange(len(row))
            after = column[None, :-1] > at[:, None]
            ids[:, :-1] = np.where(after, ids[:, 1:], ids[:, :-1])
            ids[:, -1] = -1
            ids[each, at] = self.merged[best]
            ranks[:, :-1] = np.where(column[None, :-1] >= at[:, None], ranks[:, 1:], ranks[:, :-1])
            ranks[:, -1] = _NONE
            ranks[each, at] = self.ranks(ids[each, at], ids[each, np.minimum(at + 1, width - 1)])
            ranks[at == width - 1, -1] = _NONE
            left = np.flatnonzero(at > 0)
            ranks[left, at[left] - 1] = self.ranks(ids[left, at[left] - 1], ids[left, at[left]])

    def _merge_long(self, word: bytes) -> np.ndarray:
        """The same for one long word: a heap of mergeable pairs over a linked list of its parts."""
        ids = self.byte_id[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        first = self.ranks(np.array(ids[:-1]), np.array(ids[1:]))
        heap = [(int(r), k, ids[k], ids[k + 1]) for k, r in enumerate(first) if r < _NONE]
        heapq.heapify(heap)
        while heap:
            rank, k, a, b = heapq.heappop(heap)
            j = after[k] if ids[k] == a else n
            if j >= n or ids[j] != b:
                continue
            ids[k], ids[j] = int(self.merged[rank]), -1
            after[k] = after[j]
            if after[k] < n:
                before[after[k]] = k
            for x, y in ((before[k], k), (k, after[k])):
                if x >= 0 and y < n:
                    new = int(self.ranks(np.array([ids[x]]), np.array([ids[y]]))[0])
                    if new < _NONE:
                        heapq.heappush(heap, (new, x, ids[x], ids[y]))
        return np.array([k for k in ids if k >= 0], np.uint32)


class Lexicon:
    """A minimal acyclic transducer from words to ids, as flat arrays."""

    NAMES = ("keys", "target", "output", "final", "starts", "ids")
    KINDS = (np.int64, np.int32, np.int32, np.uint8, np.int64, np.uint32)

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.arrays = arrays
        for name in self.NAMES:
            setattr(self, name, arrays[name])

    @classmethod
    def compile(cls, words: list[bytes], ids: np.ndarray, lengths: np.ndarray) -> Lexicon:
        """``words`` sorted and distinct, none empty, with their ids concatenated in that order."""
        register: dict[tuple, int] = {}
        #: Arcs of finished states: (label, target) pairs, and whether a word ends there.
        states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []

        def settle(node: list) -> int:
            key = (node[0], tuple(node[1]))
            if key not in register:
                register[key] = len(states)
                states.append(key)
            return register[key]

        # The path of the last word: [word ends here, finished arcs, label to the next]
        path: list[list] = [[False, [], -1]]
        last = b""
        for word in words:
            shared = 0
            while shared < min(len(last), len(word)) and last[shared] == word[shared]:
                shared += 1
            while len(path) > shared + 1:
                node = path.pop()
                path[-1][1].append((path[-1][2], settle(node)))
            for label in word[shared:]:
                path[-1][2] = label
                path.append([False, [], -1])
            path[-1][0] = True
            last = word
        while len(path) > 1:
            node = path.pop()
            path[-1][1].append((path[-1][2], settle(node)))
        root = settle(path[0])
        # States were settled after the states they lead to, so counts follow in that order. The root becomes state 0.
        number = {k: (0 if k == root else k + 1) for k in range(len(states))}
        below = np.zeros(len(states), np.int64)
        rows = []
        for k, (ends, arcs) in enumerate(states):
            total = int(ends)
            for label, target in arcs:
                rows.append((number[k] << 8 | label, number[target], total))
                total += int(below[target])
            below[k] = total
        table = np.array(sorted(rows), np.int64).reshape(-1, 3)
        final = np.zeros(len(states) + 1, np.uint8)
        for k, (ends, _) in enumerate(states):
            final[number[k]] = ends
        starts = np.concatenate([[0], np.cumsum(lengths)])
        made = (table[:, 0], table[:, 1], table[:, 2], final, starts, ids)
        return cls({n: np.ascontiguousarray(a, dtype=t) for n, a, t in zip(cls.NAMES, made, cls.KINDS)})

    def tobytes(self) -> bytes:
        head = np.array([len(self.arrays[n]) for n in self.NAMES], np.int64).tobytes()
        parts = [self.arrays[n].tobytes() for n in self.NAMES]
        return head + b"".join(p + b"\0" * (-len(p) % 8) for p in parts)

    @classmethod
    def mapped(cls, path: str) -> Lexicon:
        """The file mapped into memory: workers of one machine share its pages."""
        raw = np.memmap(path, np.uint8, "r")
        sizes = raw[: 8 * len(cls.NAMES)].view(np.int64)
        at, arrays = 8 * len(cls.NAMES), {}
        for name, kind, n in zip(cls.NAMES, cls.KINDS, sizes.tolist()):
            width = n * np.dtype(kind).itemsize
            arrays[name] = raw[at : at + width].view(kind)
            at += width + (-width % 8)
        return cls(arrays)

    def find(self, words: list[bytes]) -> np.ndarray:
        """Place of each word in the table of ids, -1 for a word that is not in the lexicon."""
        place = np.full(len(words), -1, np.int64)
        if not len(self.keys) or not words:
            return place
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.cumsum(sizes) - sizes
        flat = np.frombuffer(b"".join(words), np.uint8)
        row, state, total = np.arange(len(words)), np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        depth = 0
        while len(row):
            ends = sizes[row] == depth
            if ends.any():
                hit = ends & (self.final[state] > 0)
                place[row[hit]] = total[hit]
                row, state, total = row[~ends], state[~ends], total[~ends]
            key = state << 8 | flat[starts[row] + depth]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            on = self.keys[at] == key
            row, at = row[on], at[on]
            state, total = self.target[at].astype(np.int64), total[on] + self.output[at]
            depth += 1
        return place


class LexiconEncoder(PieceEncoder):
    """Encodes through a lexicon, and through the merge table where a word is not in it."""

    def __init__(self, bpe: Bpe, lexicon: Lexicon, pattern: str):
        super().__init__(most_known=0)  # the words of every slice go through the automaton
        import regex

        self.bpe, self.lexicon = bpe, lexicon
        self.find_words = regex.compile(pattern).findall
        self.specials = regex.compile("(" + "|".join(regex.escape(t) for t in bpe.special) + ")") if bpe.special else None
        self.marks = tuple(bpe.special)

    def pretokens(self, text: str) -> list[str]:
        if not any(mark in text for mark in self.marks):
            return self.find_words(text)
        out: list[str] = []
        for part in self.specials.split(text):
            out += [part] if part in self.bpe.special else self.find_words(part)
        return out

    def spaced_ids(self, pieces: list[str], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self._ids([[" " + p] if p.isalpha() else self.pretokens(" " + p) for p in pieces])

    def other_ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self._ids([self.pretokens(p) for p in pieces])

    def _ids(self, cut: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        number: dict[str, int] = {}
        at = np.fromiter((number.setdefault(w, len(number)) for words in cut for w in words), np.int64)
        spelled = [w.encode() for w in number]
        place = self.lexicon.find(spelled)
        special = np.array([self.bpe.special.get(w, -1) for w in number], np.int64) if self._any_special(number) else None
        missing = place < 0
        if special is not None:
            missing &= special < 0
        new = np.flatnonzero(missing)
        merged, merged_lengths = self.bpe.merge([spelled[k] for k in new])
        starts, lengths = np.zeros((2, len(spelled)), np.int64)
        in_table = place >= 0
        starts[in_table] = self.lexicon.starts[place[in_table]]
        lengths[in_table] = self.lexicon.starts[place[in_table] + 1] - starts[in_table]
        flat = np.concatenate([self.lexicon.ids, merged])
        starts[new] = len(self.lexicon.ids) + np.cumsum(merged_lengths) - merged_lengths
        lengths[new] = merged_lengths
        if special is not None:
            own = np.flatnonzero(special >= 0)
            starts[own], lengths[own] = len(flat) + np.arange(len(own)), 1
            flat = np.concatenate([flat, special[own].astype(np.uint32)])
        per_piece = np.fromiter(map(len, cut), np.int64, len(cut))
        edges = np.concatenate([[0], np.cumsum(lengths[at])])
        last = np.cumsum(per_piece)
        return ragged_take(flat, starts[at], lengths[at]), edges[last] - edges[last - per_piece]

    def _any_special(self, words: dict[str, int]) -> bool:
        return any(mark in words for mark in self.marks)


def frequent_pieces(docs: DataFrame, most: int, text: str = "text") -> list[str]:
    """The most frequent strings between spaces over all documents, at most ``most``, each found twice or more.

    A histogram of the counts gives the least count that fits, so only the words themselves reach the driver; words that
    tie beyond it are left out together.
    """
    spark = docs.sparkSession
    words = docs.select(F.explode(F.split(F.col(text), " ")).alias("w"))
    # Longer ones, as whole texts without spaces, would fill the driver; they go through the exact merges.
    words = words.filter((F.col("w") != "") & (F.octet_length("w") <= LONGEST_PIECE))
    stored = scratch(spark, "word-counts")
    words.groupBy("w").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1).write.parquet(stored)
    counted = spark.read.parquet(stored)
    # A step is about one percent of a count, so the histogram has a few thousand rows at most.
    step = F.floor(F.log2(F.col("n").cast("double")) * 64).cast("long")
    histogram = counted.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words")).collect()
    least, held = 1 << 20, 0
    for at, number in sorted(((row["step"], row["words"]) for row in histogram), reverse=True):
        held += number
        if held > most:
            break
        least = at
    return [row["w"] for row in counted.filter(step >= least).select("w").collect()]


def build(docs: DataFrame, path: str, pattern: str, most: int = LEXICON_WORDS, text: str = "text") -> Lexicon:
    """Count, merge and compile. The lexicon holds at most ``most`` pieces' words, with and without the space before."""
    bpe = Bpe(path)
    spell = LexiconEncoder(bpe, Lexicon.compile([], np.zeros(0, np.uint32), np.zeros(0, np.int64)), pattern)
    found = {w.encode() for piece in frequent_pieces(docs, most, text) for s in (piece, " " + piece) for w in spell.pretokens(s)}
    words = sorted(w for w in found if w.decode() not in bpe.special)
    return Lexicon.compile(words, *bpe.merge(words))


def ship(docs: DataFrame, lexicon: Lexicon) -> str:
    """Write the lexicon below the shared folder and let Spark send it to every executor; returns the file's name."""
    spark = docs.sparkSession
    long_text_batches(spark, 2_000)
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    where = f"{shared_dir(spark)}/{name}"
    write_bytes(spark, where, lexicon.tobytes())
    spark.sparkContext.addFile(where)
    return name


def _encoded(batches: Iterator[pa.RecordBatch], name: str, path: str, pattern: str, text: str) -> Iterator[pa.RecordBatch]:
    """The batches with ``ids`` in place of the text, in slices of bounded size."""
    own = LexiconEncoder(Bpe(path), Lexicon.mapped(SparkFiles.get(name)), pattern)  # freed with the task
    for batch in batches:
        for part in text_slices(batch, text, SLICE_BYTES):
            ids, offsets = own.encode(part.column(text))
            kept = [c for c in part.schema.names if c not in (text, "ids")]
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], binary_rows(ids.astype("<u4"), offsets)], [*kept, "ids"])


def _decoded(batches: Iterator[pa.RecordBatch], path: str, to: str) -> Iterator[pa.RecordBatch]:
    """The batches with the text of their ``ids``, as UTF-8 bytes in the column ``to``."""
    bpe = Bpe(path)
    for batch in batches:
        for part in text_slices(batch, "ids", 2 * SLICE_BYTES):
            flat, at = flat_values(part.column("ids"), "<u4")
            lengths = bpe.spelled_lengths[flat]
            edges = np.concatenate([[0], np.cumsum(lengths)])[at]
            spelled = ragged_take(bpe.spelled, bpe.spelled_starts[flat], lengths)
            rows = binary_rows(spelled, edges)
            if not _valid(spelled):  # ids that cut a character: as the library, put the replacement character
                rows = pa.array([r.as_py().decode("utf-8", "replace").encode() for r in rows], pa.binary())
            kept = [c for c in part.schema.names if c != to]
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], rows], [*kept, to])


def _without(docs: DataFrame, *names: str) -> T.StructType:
    return T.StructType([f for f in docs.schema if f.name not in names])


def encode(docs: DataFrame, name: str, path: str, pattern: str, text: str = "text") -> DataFrame:
    """``docs`` without the text, with ``ids``: the token ids as little-endian unsigned 32-bit integers."""
    schema = _without(docs, text, "ids").add("ids", "binary")
    return docs.mapInArrow(lambda batches: _encoded(batches, name, path, pattern, text), schema)


def decode(coded: DataFrame, path: str, to: str = "decoded") -> DataFrame:
    """``coded``, which has ``ids``, with ``to``: the text of the ids, as UTF-8 bytes."""
    return coded.mapInArrow(lambda batches: _decoded(batches, path, to), _without(coded, to).add(to, "binary"))


def round_trip(docs: DataFrame, name: str, path: str, pattern: str, text: str = "text", to: str = "decoded") -> DataFrame:
    """``decode(encode(docs))`` in one pass through a Python worker."""
    schema = _without(docs, text, "ids", to).add("ids", "binary").add(to, "binary")
    return docs.mapInArrow(lambda batches: _decoded(_encoded(batches, name, path, pattern, text), path, to), schema)


def _valid(spelled: np.ndarray) -> bool:
    try:
        spelled.tobytes().decode("utf-8")
    except UnicodeDecodeError:
        return False
    return True
