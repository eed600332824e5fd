"""Language identification: multinomial naive Bayes over hashed character n-grams.

The model is a matrix of log probabilities (2**bits buckets by languages), counted by Spark over at most
``max_docs`` labelled documents (an equal share of each language, by the hash of their id, the only bound) and broadcast: its size is set by
``bits`` and the number of languages, not by the data. Scoring runs in numpy on Arrow batches: each distinct word of a
slice gets one row of log likelihoods, a document is the sum over its words.

Defined results: a null text, or one without a letter, is ``und`` with score 0. A text of any length is
read whole; ties between languages go to the first in alphabetical order; repeated rows get equal answers. With no
labelled row to learn from, every document is ``und``. Columns named like an output column are replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from works_risk.llm.words import bag_of, long_text_batches, ngrams, per_document, text_slices

UNDETERMINED = "und"
OUTPUT = ("lang_pred", "score")


@dataclass(frozen=True)
class Params:
    low: int = 1
    high: int = 4
    bits: int = 16
    alpha: float = 0.5
    #: Most labelled documents to learn from, and most languages.
    max_docs: int = 20_000
    max_languages: int = 1_000


@dataclass
class Model:
    languages: list[str]
    #: log P(bucket | language), one row per bucket
    table: np.ndarray
    prior: np.ndarray
    params: Params


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; -1 for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus, F.lit(-1))


def _first_ids(labelled: DataFrame, most: int, seed: int) -> DataFrame:
    ids = labelled.select("doc_id").filter(F.col("doc_id").isNotNull()).distinct()
    return ids.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(most)


def one_row_each(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of the rows that share their keys the one with the least hash, and of equal hashes the least; combined before any shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    least = F.min(F.struct(F.xxhash64(*rest).alias("__hash"), *rest)).alias("__row")
    return rows.groupBy(*keys).agg(least).select(*[F.col("__row")[c].alias(c) if c in rest else F.col(c) for c in rows.columns])


def bounded_sample(labelled: DataFrame, most: int, seed: int = 7) -> DataFrame:
    """At most ``most`` rows, the first by the hash of ``doc_id``: the same rows however the table is laid out.

    Only ids are ordered; the rows are then fetched by a join with those ids, one row of each id.
    """
    return one_row_each(labelled.join(F.broadcast(_first_ids(labelled, most, seed)), "doc_id", "left_semi"), ["doc_id"])


def sample_by_language(labelled: DataFrame, most: int, seed: int = 7, most_languages: int = 1_000) -> DataFrame:
    """At most ``most`` rows, an equal share for each language, so that a rare language is not lost among frequent ones.

    Of more than ``most_languages`` values those with most labelled rows are kept (then by name). The share of a language is
    the first ids by hash; Spark cuts each partition to the share before anything moves. However many languages there are,
    the labels are read twice and the texts once.
    """
    counted = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    languages = counted.orderBy(F.desc("n"), "lang").limit(min(most, most_languages)).select("lang").collect()
    if not languages:
        return labelled.limit(0)
    kept = labelled.select("doc_id", "lang").filter(F.col("doc_id").isNotNull() & F.col("lang").isin([r["lang"] for r in languages]))
    hashed = kept.distinct().withColumn("_hash", F.xxhash64(F.lit(seed), "doc_id"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("_hash", "doc_id"))
    few = hashed.withColumn("_place", place).filter(F.col("_place") <= most // len(languages)).select("doc_id", "lang")
    return one_row_each(labelled.join(F.broadcast(few), ["doc_id", "lang"], "left_semi"), ["doc_id", "lang"])


def _bucket_counts(params: Params):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in text_slices(batch, "text"):
                langs = np.array(part.column("lang").to_pylist(), object)
                bag = bag_of(part.column("text"))
                bucket, word = ngrams(bag.words, params.low, params.high, params.bits, True)
                for lang in set(langs):
                    times = np.bincount(bag.at[(langs == lang)[bag.document]], minlength=len(bag.words))
                    got = np.bincount(bucket, times[word].astype(float), 1 << params.bits)
                    totals[lang] = totals.get(lang, 0) + got
        for lang, got in totals.items():
            there = np.flatnonzero(got)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(there)), pa.array(there, pa.int64()), pa.array(got[there], pa.float64())],
                ["lang", "bucket", "n"],
            )

    return count


def fit(labelled: DataFrame, params: Params = Params()) -> Model:
    """Learn from the columns doc_id, text and lang. Rows without a language or a text are left out."""
    long_text_batches(labelled.sparkSession)
    rows = labelled.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sample = sample_by_language(rows, params.max_docs, most_languages=params.max_languages).select("text", "lang")
    counted = sample.mapInArrow(_bucket_counts(params), "lang string, bucket long, n double")
    found = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(found["lang"].unique())
    table = np.full((1 << params.bits, len(languages)), params.alpha)
    for k, lang in enumerate(languages):
        own = found[found["lang"] == lang]
        table[own["bucket"].to_numpy(np.int64), k] += own["n"].to_numpy(float)
    table = np.log(table) - np.log(table.sum(axis=0)) if languages else table
    # A flat prior: how often a language was labelled says nothing about the text at hand.
    return Model(languages, table.astype(np.float32), np.zeros(len(languages)), params)


def score_texts(model: Model, texts: pa.Array) -> tuple[list[str], np.ndarray]:
    """Language and posterior of each text."""
    n = len(texts)
    bag = bag_of(texts)
    bucket, word = ngrams(bag.words, model.params.low, model.params.high, model.params.bits, True)
    size = max(1, len(bag.words))
    seen = per_document(np.bincount(word, minlength=size).astype(float), bag)
    if not model.languages:
        return [UNDETERMINED] * n, np.zeros(n)
    by_word = np.stack([np.bincount(word, column[bucket], size) for column in model.table.T], axis=1)
    logs = per_document(by_word, bag) + model.prior
    best = logs.argmax(axis=1)
    share = 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
    found = seen > 0.5
    return [model.languages[k] if f else UNDETERMINED for k, f in zip(best, found)], np.where(found, share, 0.0)


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``."""
    long_text_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c.lower() not in OUTPUT]
    schema = T.StructType([docs.schema[c] for c in kept]).add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, text):
                langs, score = score_texts(held.value, part.column(text))
                columns = [part.column(c) for c in kept]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(langs, pa.string()), pa.array(score)], [*kept, *OUTPUT])

    return docs.select(*[F.col(f"`{c}`") for c in docs.columns]).mapInArrow(run, schema)
