"""Token ids of Arrow text batches by a public byte-level tokenizer, each distinct piece of a slice encoded once.

A space before a character that is no white space always starts a pre-token of a byte-level vocabulary, so a
text can be cut there and its pieces encoded apart. A text in which some space is followed by white space or by the end
is encoded as a whole.
"""

from __future__ import annotations

import json
import os
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are encoded together. More bytes repeat more pieces.
SLICE_BYTES = 5_000_000
#: Pieces a worker keeps with their ids, to encode them once, unless told otherwise.
KNOWN_PIECES = 200_000


#: Letters of Latin alphabets and one mark, which is a token by itself.
_MARKS = ".,"
_MARKED = "^[A-Za-zÀ-ÖØ-öø-ſ]+[.,]$"
#: Nothing, or white space first.
_LOOSE = "^(?:$|[\\s\\x0B\\x1C-\\x1F\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}])"


@dataclass
class Pieces:
    """Distinct pieces, the piece number at every position, and the first position of each text (one more at the end).

    ``spaced`` are written without the space they start with and come first in number, then ``others``.
    """

    spaced: pa.Array
    others: list[str]
    at: np.ndarray
    offsets: np.ndarray


def pieces_of(texts: pa.Array) -> Pieces:
    """Cut texts before every space that starts a pre-token; a null text is empty and has no piece."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    lists = pc.split_pattern(texts, " ")
    coded = lists.values.dictionary_encode()
    words, at = coded.dictionary, coded.indices.to_numpy()
    offsets = lists.offsets.to_numpy()
    n, start = len(words), offsets[:-1]
    size = pc.binary_length(words).to_numpy()
    loose = pc.match_substring_regex(words, _LOOSE).to_numpy(zero_copy_only=False)
    flagged = loose[at]
    flagged[start] = False
    number = at.copy()
    number[start] += n
    keep = np.ones(len(at), bool)
    keep[start] = size[at[start]] > 0
    whole = np.flatnonzero(np.add.reduceat(flagged, start)) if flagged.any() else np.zeros(0, np.int64)
    for k, doc in enumerate(whole):  # such a text becomes one piece, in its first place
        keep[offsets[doc] : offsets[doc + 1]] = False
        keep[offsets[doc]] = True
        number[offsets[doc]] = 2 * n + k
    before = np.concatenate([[0], np.cumsum(keep)])
    number = number[keep]
    used = np.zeros(2 * n + len(whole), bool)
    used[number] = True
    renumber = np.cumsum(used) - 1
    others = words.take(pa.array(np.flatnonzero(used[n : 2 * n]))).to_pylist() + [texts[int(k)].as_py() for k in whole]
    return Pieces(words.filter(pa.array(used[:n])), others, renumber[number], before[offsets])


def ragged_take(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenated runs of ``flat`` that begin at ``starts``."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(starts - ends + lengths, lengths) + np.arange(total)]


class PieceEncoder:
    """Encodes texts piece by piece; a subclass says how pieces are encoded."""

    def __init__(self, most_known: int = KNOWN_PIECES):
        #: Pieces met before, up to ``most_known``, with their ids.
        self.most_known = most_known
        self.known: dict[str, int] = {}
        self.known_ids = np.zeros(0, np.uint32)
        self.known_starts = self.known_lengths = np.zeros(0, np.int64)

    def spaced_ids(self, pieces: list[str], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids, and their number per piece, of pieces given without the space they start with, of ``sizes`` bytes each."""
        raise NotImplementedError

    def other_ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for any texts."""
        raise NotImplementedError

    def _spaced(self, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
        """A mark after letters is a pre-token of its own, so a word is encoded once, with and without it."""
        marked = pc.match_substring_regex(pieces.spaced, _MARKED)
        coded = pc.if_else(marked, pc.utf8_rtrim(pieces.spaced, _MARKS), pieces.spaced).dictionary_encode()
        at, has = coded.indices.to_numpy(), marked.to_numpy(zero_copy_only=False)
        flat, lengths = self._words(coded.dictionary.to_pylist(), pc.binary_length(coded.dictionary).to_numpy())
        both = ragged_take(flat, (np.cumsum(lengths) - lengths)[at], lengths[at])
        if not has.any():
            return both, lengths[at]
        is_last = pc.equal(pc.utf8_slice_codeunits(pieces.spaced.filter(marked), -1), _MARKS[1])
        marks, _ = self.other_ids(list(_MARKS))
        own = marks[is_last.to_numpy(zero_copy_only=False).astype(np.int64)]
        return np.insert(both, np.cumsum(lengths[at])[has], own), lengths[at] + has

    def _words(self, spaced: list[str], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        known = self.known
        slot = np.fromiter(map(known.get, spaced, repeat(-1)), np.int64, len(spaced))
        old, new = slot >= 0, np.flatnonzero(slot < 0)
        starts, lengths = np.zeros((2, len(slot)), np.int64)
        starts[old], lengths[old] = self.known_starts[slot[old]], self.known_lengths[slot[old]]
        flat = self.known_ids
        if len(new):
            fresh = [spaced[k] for k in new]
            ids, lengths[new] = self.spaced_ids(fresh, sizes[new])
            starts[new] = len(flat) + np.cumsum(lengths[new]) - lengths[new]
            flat = np.concatenate([flat, ids])
            if len(known) + len(new) <= self.most_known:
                known.update(zip(fresh, range(len(known), len(known) + len(new))))
                self.known_starts = np.concatenate([self.known_starts, starts[new]])
                self.known_lengths = np.concatenate([self.known_lengths, lengths[new]])
                self.known_ids = flat
        return ragged_take(flat, starts, lengths), lengths

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in order, and the first position of each text (one more at the end)."""
        cut = pieces_of(texts)
        spaced, spaced_lengths = self._spaced(cut)
        rest, rest_lengths = self.other_ids(cut.others)
        flat, lengths = np.concatenate([spaced, rest]), np.concatenate([spaced_lengths, rest_lengths])
        sizes = lengths[cut.at]
        edges = np.concatenate([[0], np.cumsum(sizes)])
        return ragged_take(flat, (np.cumsum(lengths) - lengths)[cut.at], sizes), edges[cut.offsets]


class Encoder(PieceEncoder):
    """Token ids by the ``tokenizers`` library for the vocabulary file at ``path``."""

    def __init__(self, path: str, most_known: int = KNOWN_PIECES):
        super().__init__(most_known)
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        decoder = set(byte_alphabet())
        added = self.tokenizer.get_added_tokens_decoder()
        self.bytes = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for token, k in self.tokenizer.get_vocab().items():
            self.bytes[k] = len(token.encode()) if k in added else sum(c in decoder for c in token)

    def spaced_ids(self, pieces: list[str], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # Encoded joined: the lengths of the tokens in bytes tell where each piece ends.
        ids, _ = self.other_ids([" " + " ".join(pieces)])
        edge = np.searchsorted(np.cumsum(self.bytes[ids]), np.cumsum(sizes + 1)) + 1
        return ids, np.diff(edge, prepend=0)

    def other_ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(lengths.sum())), lengths


@lru_cache(maxsize=1)
def worker_encoder(path: str, most_known: int = KNOWN_PIECES) -> Encoder:
    """An encoder that a Python worker keeps between its tasks, with the pieces it has met."""
    return Encoder(path, most_known)


def byte_alphabet() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable bytes stand for themselves."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    made, n = [], 0
    for b in range(256):
        if b in set(shown):
            made.append(chr(b))
        else:
            made.append(chr(256 + n))
            n += 1
    return made


def sentence_ends(path: str, marks: str = ".!?\n") -> np.ndarray:
    """For each id, whether the token ends a sentence."""
    known = json.load(open(path, encoding="utf-8"))["model"]["vocab"]
    decoder = {c: b for b, c in enumerate(byte_alphabet())}
    out = np.zeros(max(known.values()) + 2, bool)
    for token, k in known.items():
        out[k] = chr(decoder.get(token[-1:], 0)) in marks
    return out


def binary_rows(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """One binary row for each run of ``values``."""
    bytes_at = (np.asarray(offsets, np.int64) * values.itemsize).astype(np.int32)
    buffers = [None, pa.py_buffer(bytes_at), pa.py_buffer(np.ascontiguousarray(values))]
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, buffers)


def flat_values(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The reverse: all values of binary rows, and the first position of each row (one more at the end)."""
    column = column.fill_null(b"").cast(pa.binary())
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    width = np.dtype(kind).itemsize
    raw = column.buffers()[2]
    flat = np.frombuffer(raw, kind, (at[-1] - at[0]) // width, int(at[0])) if raw else np.zeros(0, kind)
    return flat, (at - at[0]) // width


def with_end(ids: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Append the id ``end`` to every document."""
    return np.insert(ids, offsets[1:], np.uint32(end)), offsets + np.arange(len(offsets))
