"""From raw documents to packed training sequences.

Five stages, each a function of (spark, docs, sf_dir) that returns a DataFrame; ``run`` writes what a stage returns as
Parquet and hands the next one what it reads back. All but the last return the columns of the documents they got.

1. toxicity      documents scored toxic go; the model learns from ``labels`` outside the held-out third
2. language_id   documents without a letter and short ones undecided between the learned languages go
3. line_dedup    repeated windows of three lines leave the texts; ``n_chars`` follows
4. minhash       of each class of near copies one document stays
5. packing       the rest becomes sequences of at most 1024 tokens, one row per piece

A null or empty text passes 1 (an empty bag is not toxic), goes in 2 (it has no letter), and a text emptied by 3 stays as an
empty document. A long text in a language that was not learned gets the likeliest learned one and stays: the score compares
learned languages only. An extra column passes through 1 to 4 whatever its name; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from works_risk.llm import language_id, line_dedup, minhash_dedup, packing, toxicity
from works_risk.session import scratch

VOCABULARY = "byte_bpe_50k.json"
#: A language counts as found from this posterior on; only short texts stay below it.
LEAST_POSTERIOR = 0.5


def _apply(docs: DataFrame, outputs: tuple[str, ...], work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``work`` on docs whose own columns named like its outputs step aside, then the columns of docs again."""
    aside = {c: f"__own_{c}" for c in docs.columns if c.lower() in outputs}
    made = work(docs.withColumnsRenamed(aside))
    return made.select(*[F.col(f"`{aside.get(c, c)}`").alias(c) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    learn = docs.select("doc_id", "text").filter(language_id.id_remainder(F.col("doc_id"), 3) != 1)
    model = toxicity.fit(learn.join(labels, "doc_id"))
    return _apply(docs, toxicity.OUTPUT, lambda d: toxicity.predict(d, model).filter(F.col("predicted") == 0))


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    learn = docs.select("doc_id", "text", "lang").filter(language_id.id_remainder(F.col("doc_id"), 4) != 2)
    model = language_id.fit(learn)
    known = (F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") >= LEAST_POSTERIOR)
    return _apply(docs, language_id.OUTPUT, lambda d: language_id.predict(d, model).filter(known))


def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = _apply(docs, line_dedup.OUTPUT, line_dedup.dedup)
    if "n_chars" not in docs.columns:
        return cut
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _apply(docs, minhash_dedup.OUTPUT, lambda d: minhash_dedup.classes(d).filter("kept"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path(VOCABULARY), keep_encoder=False)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("language_id", keep_known_languages),
    ("line_dedup", cut_repeated_lines),
    ("minhash_dedup", drop_near_copies),
    ("packing", pack),
]

#: Trained models and signatures have no SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
