"""WARC archives in Zstandard: a dictionary in the leading skippable frame, one frame per record.

The reader takes a file from its start: the skippable frame gives the dictionary, then every frame is decoded by itself and
must hold exactly one record. It checks the version line, the header fields, that the block is as long as the header says,
the two line ends after it, the HTTP length against the payload, and the payload's digest.

The writer folds equal payloads: one record of a group is a response, the others are revisits that refer to it. Which payloads
occur again comes from digests alone; the page bodies are dealt out once, and the pages of one very common payload are
spread by ``lookup.attach``. Tasks write files under names of their own into the shared folder, and only files named in
the written manifest are read, so a task that runs twice does no harm.

Defined results: a null body is an empty payload. Of equal payloads of at least ``min_bytes`` bytes the page with the
largest page_id is the response (null is smallest); repeated rows with that same page_id are responses too. A null url is
left out of the header. Bodies of any length are written whole; other columns do not enter. An empty table gives no file and
no rows. The dictionary is trained on at most ``dictionary_pages`` pages, the first by the hash of their id; with too few
to train one, the files have none.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from works_risk.llm.language_id import one_row_each
from works_risk.sources.files import open_input, open_output
from works_risk.operators.lookup import attach
from works_risk.llm.words import long_text_batches, text_slices
from works_risk.session import scratch

SKIPPABLE = 0x184D2A5D
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ROLL_BYTES = 256 << 20
_CHUNK = 1 << 16
_END = b"\r\n\r\n"


@dataclass(frozen=True)
class Params:
    min_bytes: int = 0
    date: str = "2000-01-01T00:00:00Z"
    level: int = 3
    dictionary_bytes: int = 32 << 10
    #: Most pages to train the dictionary on.
    dictionary_pages: int = 500


class Damaged(ValueError):
    """A file that does not hold what its headers say."""


def digest_text(payload_sha1: bytes) -> str:
    return base64.b32encode(payload_sha1).decode()


def page_urn(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _page_of(urn: str) -> int | None:
    if not (urn.startswith("<urn:page:") and urn.endswith(">")):
        raise Damaged(f"{urn} names no page")
    text = urn[len("<urn:page:") : -1]
    return None if text == "none" else int(text)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One WARC record. A revisit has the HTTP header only; its length field is that of the payload it stands for."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", page_urn(page_id)),
        ("WARC-Date", date),
    ]
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe="!#$&'()*+,/:;=?@[]~-._")))
    fields += [
        ("WARC-Payload-Digest", "sha1:" + digest_text(hashlib.sha1(payload).digest())),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", page_urn(refers_to))]
    head = "".join(f"{k}: {v}\r\n" for k, v in fields)
    return VERSION + b"\r\n" + head.encode() + b"\r\n" + block + _END


def parse(raw: bytes) -> dict:
    """A record's fields, checked: page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to."""
    head, split, rest = raw.partition(_END)
    if not split:
        raise Damaged("a record has no end of header")
    lines = head.split(b"\r\n")
    if lines[0] not in (b"WARC/1.0", VERSION):
        raise Damaged(f"no WARC record: {lines[0][:40]!r}")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.decode("utf-8").partition(":")
        if not colon:
            raise Damaged(f"a header line without a colon: {line[:40]!r}")
        fields[name.strip().lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length", "warc-payload-digest"):
        if name not in fields:
            raise Damaged(f"a record without {name}")
    length = int(fields["content-length"])
    if len(rest) != length + len(_END) or rest[length:] != _END:
        raise Damaged("a block is not as long as its header says")
    http, split, payload = rest[:length].partition(_END)
    if not split:
        raise Damaged("a block has no HTTP header")
    sizes = [int(x.split(b":")[1]) for x in http.split(b"\r\n")[1:] if x.lower().startswith(b"content-length:")]
    if len(sizes) != 1:
        raise Damaged("a block has no HTTP length")
    kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
    revisit = kind == "revisit"
    if kind == "response":
        if sizes[0] != len(payload):
            raise Damaged("a payload is not as long as its HTTP header says")
        if digest_text(hashlib.sha1(payload).digest()) != digest:
            raise Damaged("a payload has another digest")
    elif not revisit or payload:
        raise Damaged(f"unexpected record: {kind}")
    return {
        "page_id": _page_of(fields["warc-record-id"]),
        "url": unquote(fields["warc-target-uri"]) if "warc-target-uri" in fields else None,
        "payload": None if revisit else payload,
        "payload_bytes": sizes[0],
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": _page_of(fields["warc-refers-to"]) if revisit else None,
    }


class Writer:
    """One archive file."""

    def __init__(self, path: str, dictionary: bytes | None, level: int):
        self.path, self.file, self.size = path, open_output(path), 0
        known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.pack = zstandard.ZstdCompressor(level=level, dict_data=known, write_checksum=True, write_content_size=True)
        if dictionary:
            self._put(struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary)

    def _put(self, data: bytes) -> None:
        self.file.write(data)
        self.size += len(data)

    def add(self, raw: bytes) -> None:
        self._put(self.pack.compress(raw))

    def close(self) -> None:
        self.file.close()


def records(path: str) -> Iterator[bytes]:
    """The decoded frames of an archive, one record each."""
    with open_input(path) as file:
        held, dictionary = file.read(8), None
        if len(held) == 8 and struct.unpack("<I", held[:4])[0] == SKIPPABLE:
            size = struct.unpack("<I", held[4:])[0]
            stored = file.read(size)
            if len(stored) != size:
                raise Damaged(f"{path}: the dictionary is cut")
            if stored[:4] == b"\x28\xb5\x2f\xfd":  # a dictionary may itself be compressed
                stored = zstandard.ZstdDecompressor().decompressobj().decompress(stored)
            dictionary, held = zstandard.ZstdCompressionDict(stored), b""
        opened = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
        while True:
            held = held or file.read(_CHUNK)
            if not held:
                return
            frame, parts = opened.decompressobj(), []
            while True:
                try:
                    parts.append(frame.decompress(held))
                except zstandard.ZstdError as error:
                    raise Damaged(f"{path}: {error}") from error
                if frame.eof:
                    held = frame.unused_data
                    break
                held = file.read(_CHUNK)
                if not held:
                    raise Damaged(f"{path}: the last frame is cut")
            yield b"".join(parts)


def train_dictionary(pages: DataFrame, params: Params) -> bytes | None:
    """A dictionary from at most ``dictionary_pages`` pages, or None where they are too few to train one."""
    ids = pages.select("page_id").filter(F.col("page_id").isNotNull()).distinct()
    few = ids.orderBy(F.xxhash64(F.lit(3), "page_id"), "page_id").limit(params.dictionary_pages)
    found = pages.join(F.broadcast(few), "page_id", "left_semi").select("page_id", "html")
    rows = one_row_each(found, ["page_id"]).collect()
    samples = [(r["html"] or "").encode() for r in sorted(rows, key=lambda r: (r["page_id"], r["html"] or ""))]
    try:
        return zstandard.train_dictionary(params.dictionary_bytes, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return None


def _write(folder: str, dictionary, params: Params):
    names = ["path", "n_records"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, done, n = None, [], 0

        def close() -> None:
            writer.close()
            done.append((writer.path, n))

        for batch in batches:
            for part in text_slices(batch, "html"):
                columns = [part.column(c).to_pylist() for c in ("page_id", "url", "html", "last", "again")]
                for page_id, url, html, last, again in zip(*columns):
                    if writer is None:
                        writer, n = Writer(f"{folder}/{uuid.uuid4().hex}.warc.zst", dictionary.value, params.level), 0
                    revisit = bool(again) and page_id != last
                    writer.add(record(page_id, url, (html or "").encode(), last if revisit else None, revisit, params.date))
                    n += 1
                    if writer.size >= ROLL_BYTES:
                        close()
                        writer = None
        if writer is not None:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done]), pa.array([k for _, k in done], pa.int64())], names)

    return run


def write(pages: DataFrame, params: Params = Params()) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives below the shared folder; returns the manifest (path, n_records)."""
    spark = pages.sparkSession
    long_text_batches(spark)
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    source = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    hashed = source.withColumn("sha1", F.sha1(body)).withColumn("size", F.octet_length(body))
    counted = hashed.filter(F.col("size") >= params.min_bytes).groupBy("sha1").agg(
        F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n")
    )
    facts, listed, folder = scratch(spark, "warc-payloads"), scratch(spark, "warc-manifest"), scratch(spark, "warc")
    counted.filter(F.col("n") > 1).withColumn("again", F.lit(True)).write.parquet(facts)
    joined = attach(hashed.drop("size"), spark.read.parquet(facts), "sha1", F.xxhash64("page_id", "url"))
    held = spark.sparkContext.broadcast(train_dictionary(source, params))
    laid = joined.select("page_id", "url", "html", "last", "again")
    laid.mapInArrow(_write(folder, held, params), "path string, n_records long").write.parquet(listed)
    return spark.read.parquet(listed)


SCHEMA = (
    "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"
)


def read(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Every record of the archives in ``manifest``: page_id, url, payload (null for a revisit) and what its headers say."""
    files = max(1, manifest.count())
    kinds = {
        "page_id": pa.int64(), "url": pa.string(), "payload": pa.binary(), "payload_bytes": pa.int64(),
        "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(),
    }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, expected in zip(batch.column("path").to_pylist(), batch.column("n_records").to_pylist()):
                held, size, n = [], 0, 0

                def rows() -> pa.RecordBatch:
                    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in held], t) for k, t in kinds.items()], list(kinds))

                for raw in records(path):
                    held.append(parse(raw))
                    size, n = size + len(raw), n + 1
                    if size >= 8 << 20:
                        yield rows()
                        held, size = [], 0
                if held:
                    yield rows()
                if n != expected:
                    raise Damaged(f"{path} has {n} records, {expected} were written")

    return manifest.select("path", "n_records").repartition(files).mapInArrow(run, SCHEMA)
