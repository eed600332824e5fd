"""Token ids, packing, range ANS and the BPE lexicon against the tokenizers library."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from works_risk.llm import bpe_lexicon, packing, rans_tokens, tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    None,
    "",
    "a",
    "  a  b ",
    "\n\n x  \n",
    " <|endoftext|>b<|endoftext|> c's it's\t q 's",
    "日本 語　x 12 3a.. ,",
    "é" * 300 + "  ",
    " lead",
    "x\u0085 y \x1c z",
    "a" * 3000,
    "日本語" * 200,
    "!!<|endoftext|>!!",
    "the cat sat on the mat. The cat!\nSat? " * 400,
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def _ids(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_encoder_matches_the_library(library):
    own = tokens.Encoder(PATH)
    for _ in range(2):  # the second time from known pieces
        ids, offsets = own.encode(pa.array(TEXTS, pa.string()))
        for k, text in enumerate(TEXTS):
            assert ids[offsets[k] : offsets[k + 1]].tolist() == _ids(library, text)
    assert len(own.encode(pa.array([], pa.string()))[0]) == 0


def test_lexicon_finds_its_words_only():
    words = sorted({b"a", b"ab", b"abc", b"b", b"bc", b"xabc", b"zz"})
    lengths = np.array([1, 2, 1, 1, 1, 3, 1])
    lexicon = bpe_lexicon.Lexicon.compile(words, np.arange(10, dtype=np.uint32), lengths)
    assert lexicon.find([*words, b"", b"abcd", b"x", b"q"]).tolist() == [0, 1, 2, 3, 4, 5, 6, -1, -1, -1, -1]
    # "c" after "ab" and after "b" lead to one final state, so the words share suffixes.
    assert len(lexicon.final) - 1 < sum(map(len, words))


def test_lexicon_file_round_trip(tmp_path):
    lexicon = bpe_lexicon.Lexicon.compile([b"ab", b"b"], np.array([7, 8, 9], np.uint32), np.array([2, 1]))
    (tmp_path / "x").write_bytes(lexicon.tobytes())
    mapped = bpe_lexicon.Lexicon.mapped(str(tmp_path / "x"))
    assert mapped.find([b"b", b"c"]).tolist() == [1, -1] and mapped.ids.tolist() == [7, 8, 9]


@pytest.mark.parametrize("most", [0, 40])
def test_bpe_round_trip_through_spark(spark, library, most):
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(TEXTS)] + [(2, "a", "x")], "doc_id long, text string, ids string")
    lexicon = bpe_lexicon.build(docs, PATH, public_tokenizers.PATTERN, most)
    name = bpe_lexicon.ship(docs, lexicon)
    made = bpe_lexicon.round_trip(docs, name, PATH, public_tokenizers.PATTERN).collect()
    assert len(made) == len(TEXTS) + 1
    for row in made:
        expected = _ids(library, TEXTS[row.doc_id])
        assert np.frombuffer(bytes(row.ids), "<u4").tolist() == expected
        assert bytes(row.decoded).decode() == library.decode(expected, skip_special_tokens=False)
    apart = bpe_lexicon.decode(bpe_lexicon.encode(docs, name, PATH, public_tokenizers.PATTERN), PATH)
    assert sorted(hashlib.sha256(r.decoded).hexdigest() for r in apart.collect()) == sorted(hashlib.sha256(r.decoded).hexdigest() for r in made)
    assert bpe_lexicon.round_trip(docs.limit(0), name, PATH, public_tokenizers.PATTERN).count() == 0


def test_merge_of_many_lengths_matches_the_library(library):
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("theainorsdéß"), rng.integers(1, 90))) for _ in range(300)]
    ids, lengths = bpe_lexicon.Bpe(PATH).merge([w.encode() for w in words])
    edges = np.concatenate([[0], np.cumsum(lengths)])
    for k, word in enumerate(words):
        assert ids[edges[k] : edges[k + 1]].tolist() == _ids(library, word)


@pytest.mark.parametrize("n", [0, 1, 31, 32, 33, rans_tokens.BLOCK - 1, rans_tokens.BLOCK, 3 * rans_tokens.BLOCK + 77])
def test_rans_blocks_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.3, n), 4999).astype(np.uint32)
    table = rans_tokens.Table.of_counts(np.bincount(ids, minlength=5000))
    blocks = rans_tokens.encode_blocks(ids, table)
    assert (rans_tokens.decode_blocks(blocks, table) == ids).all()
    if n > rans_tokens.BLOCK:
        assert (rans_tokens.decode_blocks(blocks[1:2], table) == ids[rans_tokens.BLOCK : 2 * rans_tokens.BLOCK]).all()
        assert sum(map(len, blocks)) < 1.5 * n


def test_rans_one_symbol_and_damage():
    ids = np.full(500, 3, np.uint32)
    table = rans_tokens.Table.of_counts(np.bincount(ids, minlength=9))
    block = rans_tokens.encode_blocks(ids, table)[0]
    assert (rans_tokens.decode_blocks([block], table) == ids).all()
    for k in (30, len(block) - 1):
        broken = bytearray(block)
        broken[k] ^= 1
        with pytest.raises(ValueError):
            rans_tokens.decode_blocks([bytes(broken)], table)
    with pytest.raises(ValueError):
        rans_tokens.decode_blocks([block], rans_tokens.Table.of_counts(np.ones(9)))


def _streams(library, rows):
    docs = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    return [(i, [*_ids(library, t), 0]) for i, t in docs]


def test_rans_files_hold_every_document_in_order(spark, library):
    rows = [(len(TEXTS) - k, t) for k, t in enumerate(TEXTS)] + [(None, "none"), (3, "twice"), (3, "twice")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    written = rans_tokens.write(docs, PATH, 50_257)
    found = sorted(rans_tokens.read(spark, written).collect(), key=lambda r: r.start)
    start = 0
    for row in found:
        assert row.start == start and row.n_tokens == len(row.ids) // 4
        start += row.n_tokens
    assert [r.doc_id for r in found] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i or 0))
    expected = sorted(str((i, ids)) for i, ids in _streams(library, rows))
    assert sorted(str((r.doc_id, np.frombuffer(bytes(r.ids), "<u4").tolist())) for r in found) == expected
    assert rans_tokens.read(spark, rans_tokens.write(docs.limit(0), PATH, 50_257)).count() == 0


def _price(cuts, at, penalty, length, window):
    own = dict(zip(at.tolist(), penalty.tolist(), strict=True))
    total = 0
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        size = int(b - a)
        assert 0 < size <= length
        total += (0 if size & (size - 1) == 0 else length - size) + own[int(b)] + window
    return total


def test_packing_cuts_are_the_cheapest():
    rng = np.random.default_rng(2)
    for _ in range(120):
        length, window = int(rng.choice([8, 16, 64])), int(rng.choice([0, 3]))
        ends = np.cumsum(rng.integers(1, 40, rng.integers(1, 12)))
        params = packing.Params(length=length, gap=length // 4)
        at, penalty = packing.candidates(ends, np.unique(rng.integers(1, ends[-1] + 1, 5)), params)
        best = [0] + [10**9] * (len(at) - 1)
        for j in range(1, len(at)):
            for i in range(j):
                size = int(at[j] - at[i])
                if size <= length:
                    best[j] = min(best[j], best[i] + (0 if size & (size - 1) == 0 else length - size) + int(penalty[j]) + window)
        assert _price(packing.best_cuts(at, penalty, length, window, 1), at, penalty, length, window) == best[-1]


def _stream_of(rng, n):
    """Documents of ids, some long, with sentence ends (id 5) of uneven density."""
    docs = []
    while sum(map(len, docs)) < n:
        size = int(rng.choice([3, 40, 300, 900, 5000, 20_000], p=[0.2, 0.3, 0.2, 0.2, 0.09, 0.01]))
        ids = rng.integers(6, 50, int(rng.integers(1, size + 1)))
        ids[rng.random(len(ids)) < rng.choice([0, 0.01, 0.08])] = 5
        docs.append(np.append(ids, 0).astype(np.uint32))
    return docs


def _packed(docs, chunk, params):
    stream = packing._Stream(np.arange(60) == 5, params)
    found, most = [], 0
    for k, ids in enumerate(docs):
        stream.add([k], ids, np.array([0, len(ids)]))
        if stream.fresh >= chunk:
            found.append(stream.settle(False))
        most = max(most, stream.n)
    found.append(stream.settle(True))
    names = ("doc_id", "start", "length", "doc_tokens", "sequence", "offset")
    return [tuple(int(x) for x in row) for f in found if f for row in zip(*[f[c] for c in names], strict=True)], most


def test_packing_does_not_depend_on_the_chunk():
    rng = np.random.default_rng(3)
    for length, n in ((64, 20_000), (1024, 1_200_000)):
        params, docs = packing.Params(length=length), _stream_of(rng, n)
        whole, _ = _packed(docs, 1 << 40, params)
        assert sum(r[2] for r in whole) == sum(map(len, docs))
        for chunk in (1, 2_000, 500_000) if n < 100_000 else (2_000, 500_000):
            cut, most = _packed(docs, chunk, params)
            assert cut == whole
            assert most < chunk + 200_000


@pytest.mark.parametrize("chunk", [700, 1 << 19])
def test_packing_holds_every_id_once(spark, library, monkeypatch, chunk):
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(None, "none at all"), (2, "a")]
    stream = packing._Stream(packing.sentence_ends(PATH), packing.Params(length=64))
    pieces, n = [], 0
    for i, ids in _streams(library, rows):
        stream.add([i], np.array(ids, np.uint32), np.array([0, len(ids)]))
        if stream.n >= chunk:
            pieces.append(stream.settle(False))
        n += len(ids)
    pieces.append(stream.settle(True))
    got = [
        (s, o, i, a, size, bytes(raw.as_py()))
        for p in pieces
        if p
        for s, o, i, a, size, raw in zip(p["sequence"], p["offset"], p["doc_id"], p["start"], p["length"], p["ids"], strict=True)
    ]
    assert got == sorted(got, key=lambda g: (g[0], g[1])) and sum(g[4] for g in got) == n
    flat = np.concatenate([np.frombuffer(g[5], "<u4") for g in got])
    assert flat.tolist() == [k for _, ids in _streams(library, rows) for k in ids]
    filled = {}
    for sequence, offset, *_, size, _raw in got:
        assert filled.get(sequence, 0) == offset
        filled[sequence] = offset + size
    assert max(filled.values()) <= 64 and sorted(filled) == list(range(len(filled)))


def test_packing_through_spark(spark, library):
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(None, None)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, start string")
    found = packing.pack(docs, PATH).collect()
    by_doc = {}
    for row in sorted(found, key=lambda r: r.start):
        ids = np.frombuffer(bytes(row.ids), "<u4")
        assert row.length == len(ids) and zlib.crc32(row.ids) is not None
        assert row.start == len(by_doc.get(row.doc_id, []))
        by_doc[row.doc_id] = by_doc.get(row.doc_id, []) + ids.tolist()
    assert by_doc == dict(_streams(library, rows))
    assert packing.pack(docs.limit(0), PATH).count() == 0


def test_long_pieces_stay_out_of_the_lexicon(spark):
    rows = [(k, "short " + "é" * 33 + " " + "x" * 64) for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(bpe_lexicon.frequent_pieces(docs, 100)) == ["short", "x" * 64]


def test_packing_tries_every_power_of_two():
    params = packing.Params()
    at, penalty = packing.candidates(np.array([1024, 1088]), np.zeros(0, np.int64), params)
    cuts = packing.best_cuts(at, penalty, params.length, params.window_price, params.least_power)
    assert cuts.tolist() == [0, 1024, 1088]
    assert params.least_power == 1
