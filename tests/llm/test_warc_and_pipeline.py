"""WARC archives, the pipeline's stages, and the registered queries of this folder."""

import base64
import collections
import hashlib
import struct

import pytest
import zstandard

import __spark_entry__ as entry
import corpus_pipeline
from works_risk.llm import warc
from works_risk.sources import files

SMALL = "/root/testdata/sf0.001"


def _digest(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def test_warc_round_trip_folds_equal_payloads(spark):
    pages = [(1, "http://a", "xx"), (2, None, "xx"), (2, "u\r\nv é", "xx"), (None, None, None), (None, "", "x" * 300_000), (5, "h", ""), (7, "a b", "ä")]
    frame = spark.createDataFrame([(*p, "r") for p in pages], "page_id long, url string, html string, record_type string").repartition(3)
    manifest = warc.write(frame)
    assert manifest.agg({"n_records": "sum"}).collect()[0][0] == len(pages)
    last = collections.defaultdict(lambda: None)
    for i, _, html in pages:
        last[html or ""] = max((x for x in (last[html or ""], i) if x is not None), default=None)
    expected = []
    for i, url, html in pages:
        payload, top = (html or "").encode(), last[html or ""]
        revisit = i != top
        expected.append((i, url, None if revisit else payload, len(payload), _digest(payload), "revisit" if revisit else "response", top if revisit else None))
    got = [(r.page_id, r.url, None if r.payload is None else bytes(r.payload), *r[3:]) for r in warc.read(spark, manifest).collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)
    empty = warc.write(frame.limit(0))
    assert empty.count() == 0 and warc.read(spark, empty).count() == 0


def test_warc_small_payloads_stay_responses(spark):
    frame = spark.createDataFrame([(1, "a", "x"), (2, "a", "x"), (3, "a", "long"), (4, "a", "long")], "page_id long, url string, html string")
    got = warc.read(spark, warc.write(frame, warc.Params(min_bytes=2)))
    assert {r.page_id: (r.record_type, r.refers_to) for r in got.collect()} == {1: ("response", None), 2: ("response", None), 3: ("revisit", 4), 4: ("response", None)}


def _archive(tmp_path, raws, dictionary=None):
    writer = warc.Writer(f"file:{tmp_path}/x.warc.zst", dictionary, 3)
    for raw in raws:
        writer.add(raw)
    writer.close()
    return f"{tmp_path}/x.warc.zst"


def test_warc_dictionary_is_read_from_the_leading_frame(tmp_path):
    raw = warc.record(4, "http://x", b"<p>hello hello</p>" * 50, None, False, "2000-01-01T00:00:00Z")
    dictionary = zstandard.train_dictionary(2048, [raw + bytes([k % 256]) * (k % 50) for k in range(400)]).as_bytes()
    path = _archive(tmp_path, [raw, raw], dictionary)
    data = open(path, "rb").read()
    assert struct.unpack("<II", data[:8]) == (warc.SKIPPABLE, len(dictionary))
    assert list(warc.records(path)) == [raw, raw]
    packed = zstandard.ZstdCompressor().compress(dictionary)  # a dictionary may be stored compressed
    with open(path, "wb") as file:
        file.write(struct.pack("<II", warc.SKIPPABLE, len(packed)) + packed + data[8 + len(dictionary) :])
    assert list(warc.records(path)) == [raw, raw]
    with open(path, "wb") as file:
        file.write(data[:-3])
    with pytest.raises(warc.Damaged):
        list(warc.records(path))


def test_warc_records_are_validated():
    raw = warc.record(4, "u", b"body", None, False, "2000-01-01T00:00:00Z")
    assert warc.parse(raw)["payload"] == b"body"
    digest = _digest(b"body").encode()
    for old, new in (
        (b"WARC/1.1", b"WARC/9"),
        (b"body", b"bodyy"),
        (b"body", b"bodi"),
        (b"WARC-Date", b"Other"),
        (b"Content-Length: 4", b"Content-Length: 5"),
        (digest, b"A" * 32),
        (b"response\r", b"request\r"),
    ):
        with pytest.raises(warc.Damaged):
            warc.parse(raw.replace(old, new))
    with pytest.raises(warc.Damaged):
        warc.parse(raw + b"x")


def test_files_keep_bytes_as_they_are(spark, tmp_path):
    files.write_bytes(spark, f"file:{tmp_path}/a.bin", bytes(range(256)))
    with files.open_output(f"{tmp_path}/b/c.zst") as out:
        out.write(b"plain")
    with files.open_input(f"file://{tmp_path}/a.bin") as a, files.open_input(f"{tmp_path}/b/c.zst") as b:
        assert a.read() == bytes(range(256)) and b.read() == b"plain"


def test_stages_keep_the_columns_and_their_decisions(spark):
    source = spark.read.parquet(f"{SMALL}/documents.parquet")
    docs = source.selectExpr("*", "doc_id AS score", "'x' AS kept", "1 AS n_removed")
    extra = [(9001, None, "en", "s", 0, 0, "x", 1), (9002, "", "en", "s", 0, 0, "x", 1), (9003, "123 456", None, None, 0, None, "x", 1)]
    docs = docs.union(spark.createDataFrame(extra, docs.schema))
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, docs, SMALL).cache()
        assert made.columns == docs.columns, name
        ids = {r.doc_id for r in made.select("doc_id").collect()}
        assert made.count() == len(ids) <= n
        if name == "toxicity":
            assert {9001, 9002, 9003} <= ids
        if name == "language_id":
            assert not {9001, 9002, 9003} & ids and made.filter("score <> doc_id").count() == 0
        if name == "line_dedup":
            assert made.filter("n_chars <> length(text)").count() == 0
        docs, n = made, made.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == ids


def test_every_stage_takes_an_empty_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SMALL).count() == 0


def test_queries_are_registered_once_for_each_operator():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in entry.queries() and set(entry.oracle_sql()) <= set(entry.queries())
