"""Toxicity: embeddings of character n-grams, averaged over a bag of words, into a linear softmax; trained in numpy.

A word is the mean of the vectors of its known n-grams (of half its n-grams at least, so that one known n-gram does not stand
for a whole unknown word), so a misspelling or an inflected form that was never seen shares the vectors of the form that
was. The words of a document fall into bags of ``bag_words`` consecutive words; each bag is the mean over its slots, a
repeated word taking one slot and the others staying zero, and is scored by the softmax. A document is as toxic as its most
toxic bag, so one insult in a long text is not averaged away. Training learns vectors and softmax together: bags of clean
documents are clean, and of a toxic document first all bags, then its most toxic one, count as toxic.

Only n-grams whose spread over the classes is no matter of chance are learned, each only to the side its evidence is on. This
asks for more documents than one, but for no fixed number, so few labels suffice for a word that only toxic ones hold.

Training uses at most ``max_docs`` labelled documents of each class (first by the hash of their id, the only bound) on the
driver. The trained model folds to one number per n-gram bucket, is broadcast, and scores Arrow batches in numpy.

Defined results: a null or empty text gets the score of an empty bag. A text of any length is read whole.
Repeated rows get equal scores. Without labelled rows of both classes every score is 0. Columns named like an output
column are replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from works_risk.llm.language_id import bounded_sample
from works_risk.llm.words import Bag, bag_of, long_text_batches, ngrams, text_slices

OUTPUT = ("score", "predicted")
_EDGE = ".,;:!?\"'()[]{}<>|…«»„“”‚‘’"


@dataclass(frozen=True)
class Params:
    low: int = 3
    high: int = 5
    bits: int = 20
    dim: int = 2
    bag_words: int = 16
    steps: int = 60
    warm_steps: int = 20
    rate: float = 20.0
    decay: float = 0.03
    #: An n-gram counts when at least this many training documents hold it,
    min_docs: int = 2
    #: and when its spread over the classes is at least this far from chance; about the standard deviations of a normal value.
    least_evidence: float = 4.0
    threshold: float = 0.7
    #: Most labelled documents of each class to learn from.
    max_docs: int = 1_300
    seed: int = 11


@dataclass
class Model:
    #: Toxic-against-clean margin of a word that consists of one bucket alone; NaN for a bucket that was not learned
    weight: np.ndarray
    bias: float
    params: Params


def _word_grams(words: list[str], params: Params) -> tuple[np.ndarray, np.ndarray]:
    bucket, word = ngrams([w.strip(_EDGE) or "_" for w in words], params.low, params.high, params.bits, False)
    return bucket.astype(np.int32), word.astype(np.int32)


def _spread(every: np.ndarray, known: np.ndarray, n_words: int) -> np.ndarray:
    """What the sum over a word's known n-grams is divided by: their number, or half of all its n-grams if that is more."""
    return np.maximum(np.bincount(known, minlength=n_words), np.bincount(every, minlength=n_words) / 2)


def _bags(bag: Bag, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First word position of each bag of words, and the first bag of each document; an empty document has no bag."""
    lengths = np.diff(bag.offsets)
    per_doc = -(-lengths // size)
    first = np.concatenate([[0], np.cumsum(per_doc)])
    doc = np.repeat(np.arange(len(lengths)), per_doc)
    within = np.arange(first[-1]) - first[doc]
    return bag.offsets[doc] + within * size, first


def _slots(bag: Bag, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct words of each bag of words: (bag, word) pairs in ascending order."""
    lengths = np.diff(np.append(starts, len(bag.at)))
    size = max(1, len(bag.words))
    pairs = np.unique(np.repeat(np.arange(len(starts)), lengths) * size + bag.at)
    return pairs // size, pairs % size


def _sum_runs(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of the runs of rows that begin at ``starts`` (ascending, none empty)."""
    return np.add.reduceat(values, starts, axis=0) if len(starts) else np.zeros((0, *values.shape[1:]), values.dtype)


def _documents_with(bag: Bag, bucket: np.ndarray, word: np.ndarray, toxic: np.ndarray, size: int) -> np.ndarray:
    """For each bucket, the numbers of clean and of toxic documents that hold it; one document at a time, to bound the memory."""
    order = np.argsort(word, kind="stable")
    bucket, edges = bucket[order], np.searchsorted(word[order], np.arange(len(bag.words) + 1))
    total = np.zeros((2, size), np.int32)
    for start, stop, bad in zip(bag.offsets[:-1], bag.offsets[1:], toxic.astype(int)):
        own = np.unique(bag.at[start:stop])
        spans = edges[own + 1] - edges[own]
        flat = np.repeat(edges[own] - np.cumsum(spans) + spans, spans) + np.arange(spans.sum())
        total[bad, np.unique(bucket[flat])] += 1
    return total


def _evidence(docs_with: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """How far each bucket's spread over the classes is from an even one, in the measure of chance; above 0 on the toxic side.

    This is the signed root of the likelihood ratio. It has no count of documents in it, so a bucket that 5 of 30 toxic
    documents and no clean one hold tells as surely as one that 5 of 1,300 and no clean one hold.
    """
    total, shares = docs_with.sum(axis=0), np.array([(~toxic).mean(), toxic.mean()])
    ratio = np.zeros(total.shape)
    for held, share in zip(docs_with, shares):
        there = held > 0
        ratio[there] += 2 * held[there] * np.log(held[there] / (total[there] * share))
    return np.sign(docs_with[1] - total * shares[1]) * np.sqrt(np.maximum(ratio, 0))


class _Means:
    """The linear map that averages rows over groups, and its transpose."""

    def __init__(self, group: np.ndarray, item: np.ndarray, n_groups: int, n_items: int, size: np.ndarray):
        self.share = (1 / np.maximum(size, 1)).astype(np.float32)
        self.items, self.group_ids, self.group_starts = self._runs(group, item)
        self.groups, self.item_ids, self.item_starts = self._runs(item, group)
        self.shape = n_groups, n_items

    @staticmethod
    def _runs(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Values in the order of their key, the keys there are, and where each one's run begins."""
        order = np.argsort(key, kind="stable")
        value, key = value[order].astype(np.int32), key[order]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        return value, key[starts], starts

    def forward(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros((self.shape[0], rows.shape[1]), np.float32)
        out[self.group_ids] = _sum_runs(rows[self.items], self.group_starts)
        return out * self.share[:, None]

    def backward(self, grad: np.ndarray) -> np.ndarray:
        out = np.zeros((self.shape[1], grad.shape[1]), np.float32)
        out[self.item_ids] = _sum_runs((grad * self.share[:, None])[self.groups], self.item_starts)
        return out


class _Descent:
    """Momentum descent whose largest component moves by ``rate``.

    Components keep their proportions, so an n-gram of many toxic documents moves far and a chance one of a few hardly.
    """

    def __init__(self, value: np.ndarray, rate: float):
        self.value, self.rate = value, rate
        self.mean = np.zeros_like(value)
        self.largest = 0.0

    def take(self, grad: np.ndarray) -> None:
        self.mean += 0.1 * (grad - self.mean)
        self.largest = max(float(np.abs(grad).max()), 0.9 * self.largest, 1e-12)
        self.value -= (self.rate / self.largest) * self.mean


def train(texts: list[str | None], toxic: np.ndarray, params: Params = Params()) -> Model:
    """Learn from texts and 0/1 labels."""
    nothing = Model(np.zeros(1 << params.bits, np.float32), -50.0, params)
    toxic = np.asarray(toxic, bool)
    if toxic.all() or not toxic.any():
        return nothing
    bag = bag_of(pa.array(texts, pa.string()))
    bucket, word = _word_grams(bag.words, params)
    grams_of = word
    starts, first = _bags(bag, params.bag_words)
    n_bags, n_words = len(starts), len(bag.words)
    if not n_bags:
        return nothing
    docs_with = _documents_with(bag, bucket, word, toxic, 1 << params.bits)
    evidence = _evidence(docs_with, toxic)
    told = (np.abs(evidence) >= params.least_evidence) & (docs_with.sum(axis=0) >= params.min_docs)
    number = np.cumsum(told) - 1
    known = told[bucket]
    n_known = int(number[-1]) + 1
    if not n_known:
        return nothing
    bucket, word = number[bucket[known]].astype(np.int32), word[known].astype(np.int32)
    to_word = _Means(word, bucket, n_words, n_known, _spread(grams_of, word, n_words))
    slot_bag, slot_word = _slots(bag, starts)
    to_bag = _Means(slot_bag, slot_word, n_bags, n_words, np.full(n_bags, params.bag_words))
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    bad = toxic[owner]
    held = np.flatnonzero(np.diff(first))
    n_bad, n_good = max(1, toxic[held].sum()), max(1, (~toxic[held]).sum())
    each = np.where(bad, 0, 0.5 / n_good) / np.diff(first)[owner]

    side = np.sign(evidence[told])
    random = np.random.default_rng(params.seed)
    vectors = _Descent(random.normal(0, 0.1, (n_known, params.dim)).astype(np.float32), params.rate)
    softmax = _Descent(random.normal(0, 0.5, (params.dim, 2)).astype(np.float32), 0.05)
    bias = _Descent(np.zeros(2, np.float32), 0.1)
    for step in range(params.steps):
        mean = to_bag.forward(to_word.forward(vectors.value))
        logits = mean @ softmax.value + bias.value
        p = 1 / (1 + np.exp(np.clip(logits[:, 0] - logits[:, 1], -60, 60)))
        weight = each.copy()
        if step < params.warm_steps:
            weight[bad] = 0.5 / n_bad / np.diff(first)[owner][bad]
        else:
            top = np.maximum.reduceat(p, first[held])
            best = bad & (p >= np.repeat(top, np.diff(first)[held]))
            weight[best] = 0.5 / n_bad
            # A clean document is judged by its most toxic bag too, so that bag counts as much as all of them.
            worst = ~bad & (p >= np.repeat(top, np.diff(first)[held]))
            weight[worst] += 0.5 / n_good
        off = ((p - bad) * weight).astype(np.float32)
        grad = np.stack([-off, off], axis=1)
        vectors.take(to_word.backward(to_bag.backward(grad @ softmax.value.T)))
        vectors.value *= 1 - params.decay
        # What was learned against an n-gram's own evidence only makes up for others of its word, and fails on other words.
        across = softmax.value[:, 1] - softmax.value[:, 0]
        margin = vectors.value @ across
        against = margin * side < 0
        vectors.value[against] -= np.outer(margin[against] / (across @ across), across)
        softmax.take(mean.T @ grad)
        bias.take(grad.sum(axis=0))
    weight = np.full(1 << params.bits, np.nan, np.float32)
    weight[told] = vectors.value @ (softmax.value[:, 1] - softmax.value[:, 0])
    return Model(weight, float(bias.value[1] - bias.value[0]), params)


def fit(labelled: DataFrame, params: Params = Params()) -> Model:
    """Learn from the columns doc_id, text and toxic. Rows without a label or a text are left out."""
    rows = labelled.select("doc_id", "text", F.col("toxic").cast("int").alias("toxic"))
    rows = rows.filter(F.col("text").isNotNull() & F.col("toxic").isin(0, 1))
    classes = [bounded_sample(rows.filter(F.col("toxic") == k), params.max_docs, params.seed) for k in (0, 1)]
    sample = classes[0].unionByName(classes[1]).select("doc_id", "text", "toxic").toPandas()
    sample = sample.sort_values(["doc_id", "text"], kind="stable")
    return train(sample["text"].tolist(), sample["toxic"].to_numpy(), params)


def score_texts(model: Model, texts: pa.Array) -> np.ndarray:
    """Probability of the toxic class for each text."""
    params = model.params
    bag = bag_of(texts)
    best = np.full(len(texts), model.bias)
    if len(bag.at):
        bucket, word = _word_grams(bag.words, params)
        weight = model.weight[bucket]
        known = ~np.isnan(weight)
        size = _spread(word, word[known], len(bag.words))
        margin = np.bincount(word[known], weight[known], len(bag.words)) / np.maximum(size, 1)
        starts, first = _bags(bag, params.bag_words)
        slot_bag, slot_word = _slots(bag, starts)
        means = np.bincount(slot_bag, margin[slot_word], len(starts)) / params.bag_words + model.bias
        held = np.flatnonzero(np.diff(first))
        best[held] = np.maximum.reduceat(means, first[held])
    return 1 / (1 + np.exp(-np.clip(best, -60, 60)))


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` and ``predicted``."""
    long_text_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c.lower() not in OUTPUT]
    schema = T.StructType([docs.schema[c] for c in kept]).add("score", "double").add("predicted", "integer")
    threshold = model.params.threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, text):
                score = score_texts(held.value, part.column(text))
                made = [pa.array(score), pa.array((score >= threshold).astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], *made], [*kept, *OUTPUT])

    return docs.mapInArrow(run, schema)
