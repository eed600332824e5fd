"""MinHash near-dedup of multisets of word shingles with BagMinHash signatures.

The weight of a shingle is how often the text has it. Weights are cut at 0, 1, 2, 4, 8, ...; each interval of
levels is a Poisson process whose points have a time, a level in the interval and a slot of the signature, all from a hash of the
shingle. A text sees the points below its weights, and each slot keeps the earliest: two texts agree in a slot with
exactly the probability of their weighted Jaccard similarity. Points come in order of time and stop at a time by which the
slots are full, so a long text makes few points per shingle.

Steps: (1) one pass gives each text its signature and a 128-bit digest of its words; equal texts fold to one node. (2) Bands of the signature
name buckets; a bucket of many nodes is cut into tiles. Tasks compare signatures (one byte a slot) inside tiles and keep a
forest of links that may reach the threshold. (3) The connected nodes form loose groups; each gets its texts once per
tile (a fixed-size bitmap of wanted rows keeps all other texts from being moved), and tasks confirm links on the full multisets, best guess first, skipping pairs that are already connected. (4) The
confirmed links give the classes. No step writes the pairs of a group: tasks write forests, at most one link per node.

A link at similarity 0.8 is missed with a chance of (1 - 0.8**4)**24 = 3e-6 by the bands and of under 1e-6 by the margin of the
signatures; what is linked is exact.

Defined results: a null text or one without a word is alone in its class. One to four words are one shingle. Texts of equal
lower-cased words are one class without comparison. Texts of any length are read whole. The id of a class is the smallest
doc_id in it, null where it has none, and that document is kept; rows that repeat a doc_id are one document and share the
verdict. Columns named like an output column are replaced. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from works_risk.llm.components import Forest, components
from works_risk.operators.lookup import attach
from works_risk.llm.tiles import KEYS, byte_matrix, byte_rows, forest_links, meet, run_edges, runs, tiled, written
from works_risk.llm.words import bag_of, long_text_batches, text_slices

SLICE_BYTES = 3_000_000
OUTPUT = ("class_id", "class_size", "kept")
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Params:
    shingle: int = 5
    threshold: float = 0.8
    rows: int = 4
    bands: int = 24
    #: Signatures that agree in less than threshold - margin of their slots are not compared in full.
    margin: float = 0.2
    #: Most nodes of a tile; larger buckets and groups are cut.
    tile: int = 1024

    @property
    def slots(self) -> int:
        return self.rows * self.bands


def mix(x: np.ndarray) -> np.ndarray:
    """A finalising mix of 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_hashes(words: list[str]) -> np.ndarray:
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words))


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A hash per word position of all texts, and the first position of each text (one more at the end)."""
    bag = bag_of(texts)
    return _word_hashes(bag.words)[bag.at] if len(bag.at) else np.zeros(0, np.uint64), bag.offsets


def digests(hashes: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """128 bits over the words of each text in their order, null for a text without a word."""
    sizes = np.diff(offsets)
    place = mix((np.arange(len(hashes)) - np.repeat(offsets[:-1], sizes)).astype(np.uint64) * _GOLDEN)
    sums = []
    for seed in (0x2545F4914F6CDD1D, 0x9FB21C651E98DF25):
        parts = mix(mix(hashes ^ np.uint64(seed)) + place)
        edges = np.concatenate([np.zeros(1, np.uint64), np.cumsum(parts, dtype=np.uint64)])
        sums.append(mix(edges[offsets[1:]] - edges[offsets[:-1]] + sizes.astype(np.uint64)))
    made = np.ascontiguousarray(np.stack(sums, axis=1)).view(np.uint8).reshape(len(sizes), 16)
    return pc.if_else(pa.array(sizes > 0), byte_rows(made), pa.scalar(None, pa.binary()))


def shingles(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per distinct shingle of each text: the text's number (ascending), the shingle's hash (ascending), its count."""
    return shingles_of(*hashed_words(texts), size)


def shingles_of(hashes: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lengths = np.diff(offsets)
    # A text of fewer words than a shingle has one shingle of all its words.
    number = np.where(lengths >= size, lengths - size + 1, np.minimum(lengths, 1))
    doc = np.repeat(np.arange(len(lengths)), number)
    start = offsets[:-1][doc] + np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)
    stop = offsets[1:][doc]
    h = np.zeros(len(doc), np.uint64)
    for k in range(size):
        there = start + k < stop
        word = np.zeros(len(doc), np.uint64)
        word[there] = hashes[start[there] + k]
        h = mix(h * _GOLDEN + word + np.uint64(k))
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return doc[at], h[at], np.diff(np.append(at, len(h)))


def signatures(doc: np.ndarray, shingle: np.ndarray, count: np.ndarray, n_docs: int, slots: int) -> np.ndarray:
    """BagMinHash: one row of ``slots`` values for each text; texts without a shingle keep the largest value."""
    # The intervals of levels that each weight reaches: [0, 1), [1, 2), [2, 4), ...
    steps = np.where(count > 1, np.ceil(np.log2(np.maximum(count, 1))).astype(np.int64), 0) + 1
    item = np.repeat(np.arange(len(count)), steps)
    step = np.arange(steps.sum()) - np.repeat(np.cumsum(steps) - steps, steps)
    low = np.where(step == 0, 0, 1 << np.maximum(step - 1, 0))
    width = np.where(step == 0, 1, low)
    state = mix(shingle[item] + _GOLDEN * (step + 1).astype(np.uint64))
    owner, weight = doc[item], count[item]
    total = np.bincount(doc, count, n_docs)
    best = np.full(n_docs * slots, np.uint64(0xFFFFFFFFFFFFFFFF))
    time = np.zeros(len(item))
    limit = slots * (np.log(slots) + 5) / np.maximum(total, 1)
    pending = np.ones(len(item), bool)
    while pending.any():
        live = np.flatnonzero(pending)
        h, t, lim = state[live], time[live], limit[owner[live]]
        while len(live):
            h = h + _GOLDEN
            r = mix(h)
            # A point beyond the limit is not used now, so its state is kept from before it was drawn.
            after = t - np.log(((r >> np.uint64(24)).astype(np.float64) + 0.5) * 2.0**-40) / width[live]
            on = after <= lim
            off = live[~on]
            state[off], time[off] = h[~on] - _GOLDEN, t[~on]
            live, h, t, lim, r = live[on], h[on], after[on], lim[on], r[on]
            r2 = mix(r ^ _GOLDEN)
            seen, place = slice(None), live
            if (width[live] > 1).any():  # of an interval that the weight cuts, only points below the weight count
                level = low[live] + ((r2 >> np.uint64(32)).astype(np.float64) * 2.0**-32) * width[live]
                seen = np.flatnonzero(level < weight[live])
                place = live[seen]
            slot = (((r[seen] & np.uint64(0xFFFFFF)) * np.uint64(slots)) >> np.uint64(24)).astype(np.int64)
            packed = t[seen].astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32) | (r2[seen] & np.uint64(0xFFFFFFFF))
            np.minimum.at(best, owner[place] * slots + slot, packed)
        # Texts with an empty slot look further; the others are done.
        short = (best.reshape(n_docs, slots) == np.uint64(0xFFFFFFFFFFFFFFFF)).any(axis=1) & (total > 0)
        limit = np.where(short, limit * 2, limit)
        pending = short[owner]
    return (best.reshape(n_docs, slots) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def band_keys(sig: np.ndarray, params: Params) -> np.ndarray:
    """One 64-bit key per band."""
    rows = sig.reshape(len(sig), params.bands, params.rows).astype(np.uint64)
    h = np.broadcast_to(np.arange(params.bands, dtype=np.uint64), rows.shape[:2]).copy()
    for k in range(params.rows):
        h = mix(h * _GOLDEN + rows[:, :, k])
    return h.view(np.int64)


def agreement(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Similarity that byte signatures suggest, corrected for bytes that agree by chance."""
    share = (others == one).mean(axis=-1)
    return (share - 1 / 256) / (1 - 1 / 256)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact similarity of two multisets, given as ascending hashes and counts."""
    at = np.minimum(np.searchsorted(b[0], a[0]), max(len(b[0]) - 1, 0))
    both = b[0][at] == a[0] if len(b[0]) else np.zeros(len(a[0]), bool)
    common = np.minimum(a[1][both], b[1][at[both]]).sum()
    union = a[1].sum() + b[1].sum() - common
    return float(common / union) if union else 0.0


def _sign(params: Params):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text", SLICE_BYTES):
                words, offsets = hashed_words(part.column("text"))
                doc, h, count = shingles_of(words, offsets, params.shingle)
                sig = signatures(doc, h, count, part.num_rows, params.slots)
                keys = band_keys(sig, params)
                lists = pa.ListArray.from_arrays(np.arange(part.num_rows + 1, dtype=np.int32) * params.bands, pa.array(keys.reshape(-1)))
                columns = [part.column("doc_id"), part.column("row"), digests(words, offsets), byte_rows(sig.astype(np.uint8)), lists]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row", "digest", "sig", "keys"])

    return run


def _maybe(params: Params):
    """Links inside tiles that signatures allow, as a forest over all tiles of the task."""
    least = params.threshold - params.margin

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number: dict[int, int] = {}
        forest = Forest(0)
        for table in runs(batches, KEYS):
            edges = run_edges(table, KEYS)
            nodes = table.column("node").to_pylist()
            sides = table.column("side").to_numpy()
            sig = byte_matrix(table.column("sig").combine_chunks(), params.slots)
            local = np.array([number.setdefault(n, len(number)) for n in nodes])
            forest.parent.extend(range(len(forest.parent), len(number)))
            for start, stop in zip(edges[:-1], edges[1:]):
                for at in range(start, stop - 1):
                    rest = np.arange(at + 1, stop)
                    if sides[at] != 2:  # in a tile of two chunks, only pairs across
                        rest = rest[sides[rest] != sides[at]]
                    if len(rest) > 8:
                        own = forest.root(int(local[at]))
                        roots = np.fromiter((forest.root(int(x)) for x in local[rest]), np.int64, len(rest))
                        rest = rest[roots != own]
                    if len(rest):
                        for other in rest[agreement(sig[at], sig[rest]) >= least]:
                            forest.join(int(local[at]), int(local[other]))
        yield forest_links(number, forest)

    return run


def _confirm(params: Params):
    """Links inside tiles that the full multisets confirm, as a forest over all tiles of the task."""
    least = params.threshold - params.margin

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number: dict[int, int] = {}
        forest = Forest(0)
        for table in runs(batches, KEYS):
            edges = run_edges(table, KEYS)
            nodes = table.column("node").to_pylist()
            sides = table.column("side").to_numpy()
            sig = byte_matrix(table.column("sig").combine_chunks(), params.slots)
            local = [number.setdefault(n, len(number)) for n in nodes]
            forest.parent.extend(range(len(forest.parent), len(number)))
            bags: list[tuple[np.ndarray, np.ndarray]] = []
            for batch in table.select(["text"]).to_batches():
                for part in text_slices(batch, "text", SLICE_BYTES):
                    doc, h, count = shingles(part.column("text"), params.shingle)
                    at = np.searchsorted(doc, np.arange(part.num_rows + 1))
                    bags += [(h[a:b], count[a:b]) for a, b in zip(at[:-1], at[1:])]
            for start, stop in zip(edges[:-1], edges[1:]):
                for at in range(start, stop - 1):
                    rest = np.arange(at + 1, stop)
                    if sides[at] != 2:
                        rest = rest[sides[rest] != sides[at]]
                    guess = agreement(sig[at], sig[rest])
                    for k in np.argsort(-guess, kind="stable"):
                        if guess[k] < least:
                            break
                        other = int(rest[k])
                        if forest.root(local[at]) != forest.root(local[other]) and weighted_jaccard(bags[at], bags[other]) >= params.threshold:
                            forest.join(local[at], local[other])
        yield forest_links(number, forest)

    return run


#: Bits of the bitmap of wanted rows; the more rows are wanted, the less it keeps back, and it is always this large.
_WANTED_BITS = 1 << 25


def row_key() -> Column:
    """The same for rows of one id and text. The hash comes first, so that an id of any kind cannot be taken for part of it."""
    return F.concat_ws("|", F.xxhash64("text"), F.col("doc_id").cast("string"))


def only_wanted(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Rows whose ``key`` is in ``wanted``, with a few others, found without moving them: a broadcast bitmap of fixed size."""
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(_WANTED_BITS))
    number, position = F.bitmap_bucket_number("_bit"), F.bitmap_bit_position("_bit")
    made = wanted.select(bit(key).alias("_bit")).groupBy(number.alias("_bucket")).agg(F.bitmap_construct_agg(position).alias("_bits"))
    asked = rows.withColumn("_bit", bit(key)).withColumns({"_own": number, "_at": position})
    met = asked.join(F.broadcast(made), F.col("_own") == F.col("_bucket"))
    byte = F.conv(F.hex(F.substring("_bits", F.floor(F.col("_at") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    there = F.expr("shiftright(_byte, cast(_at % 8 as int)) & 1") == 1
    return met.withColumn("_byte", byte).filter(there).select(*[F.col(f"`{c}`") for c in rows.columns])


def links(docs: DataFrame, params: Params = Params()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (doc_id, row, digest), nodes (node, digest, doc_id of their first row, n_copies) and the (node, component) of
    linked nodes."""
    long_text_batches(docs.sparkSession)
    source = docs.select("doc_id", row_key().alias("row"), "text")
    id_type = source.schema["doc_id"].dataType.simpleString()
    signed = source.mapInArrow(_sign(params), f"doc_id {id_type}, row string, digest binary, sig binary, keys array<long>")
    signed = written(signed, "signatures")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("first")
    folded = signed.filter(F.col("digest").isNotNull()).groupBy("digest").agg(
        first, F.count(F.lit(1)).alias("n_copies"), F.first("sig").alias("sig"), F.first("keys").alias("keys")
    )
    folded = folded.select("digest", "first.doc_id", "first.row", "n_copies", "sig", "keys")
    nodes = written(folded.withColumn("node", F.monotonically_increasing_id()), "nodes")

    entries = written(nodes.select("node", F.explode("keys").alias("key")), "bands")
    shared = entries.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = written(shared.withColumn("size", F.col("n")), "band-sizes")
    met = attach(entries, shared, "key", F.col("node")).filter(F.col("size").isNotNull())
    cut_bands = tiled(met, F.col("size"), params.tile).join(nodes.select("node", "sig"), "node")
    maybe = written(meet(cut_bands.select("key", "i", "j", "side", "node", "sig"), _maybe(params)), "maybe-links")

    loose = written(components(maybe), "loose-groups")
    sizes = written(loose.groupBy("component").agg(F.count(F.lit(1)).alias("n")).withColumn("size", F.col("n")), "loose-sizes")
    placed = attach(loose, sizes, "component", F.col("node")).withColumnRenamed("component", "key")
    cut = tiled(placed, F.col("size"), params.tile)
    # The text of a node is that of its first row; rows of one id and text fold before they move.
    wanted = written(loose.join(nodes.select("node", "row", "sig"), "node").select("node", "row", "sig"), "wanted-texts")
    texts = only_wanted(source.select("row", "text"), wanted, "row").groupBy("row").agg(F.any_value("text").alias("text"))
    texts = texts.join(wanted, "row").select("node", "text", "sig")
    full = cut.join(texts, "node").select("key", "i", "j", "side", "node", "sig", "text")
    confirmed = written(meet(full, _confirm(params)), "links")
    return signed.select("doc_id", "row", "digest"), nodes, written(components(confirmed), "classes")


def classes(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """``docs`` with class_id (smallest doc_id of the class), class_size (rows) and kept (the document the class is named for)."""
    rows, nodes, found = links(docs, params)
    member = nodes.join(found.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left").select(
        F.col("digest").alias("_digest"), "doc_id", "n_copies", F.coalesce("component", "node").alias("component")
    )
    member = written(member, "members")
    merged = member.groupBy("component").agg(
        F.min("doc_id").alias("class_id"), F.sum("n_copies").alias("class_size"), F.count(F.lit(1)).alias("n")
    )
    classed = attach(member.select("_digest", "component", "n_copies"), written(merged, "merged"), "component", F.col("_digest"))
    facts = written(classed.select("_digest", "class_id", "class_size", F.col("n_copies").alias("n")), "class-facts")
    # From digests to rows: narrow, so that the documents themselves move once, or not at all where no text is asked for.
    of_row = attach(rows.withColumnRenamed("digest", "_digest"), facts, "_digest", F.monotonically_increasing_id())
    of_row = of_row.groupBy(F.col("row").alias("_row")).agg(
        F.first("class_id").alias("class_id"), F.first("class_size").alias("class_size"), F.count(F.lit(1)).alias("n")
    )

    columns = [c for c in docs.columns if c.lower() not in OUTPUT]
    own = docs.select(*[F.col(f"`{c}`") for c in columns]).withColumn("_row", row_key())
    marked = attach(own, written(of_row, "class-rows"), "_row", F.monotonically_increasing_id())
    alone = F.col("class_size").isNull()
    return marked.select(
        *[F.col(f"`{c}`") for c in columns],
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
        (alone | F.col("doc_id").eqNullSafe(F.col("class_id"))).alias("kept"),
    )
