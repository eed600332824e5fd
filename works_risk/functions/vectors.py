"""Vector expressions and text embedding."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import Accumulator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from works_risk.params import EMBED_BATCH, EMBED_DIM

EmbedMany = Callable[[list[str]], np.ndarray]


def norm(vec: Column) -> Column:
    return F.sqrt(F.aggregate(vec, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def with_unit(df: DataFrame, source: str, name: str = "vec") -> DataFrame:
    """Add the vector scaled to length 1, as DOUBLE; a zero vector stays zero.

    The length is a column of its own, so that it is taken once per row and not once per element.
    """
    sized = df.withColumn("_length", norm(F.col(source)))
    scaled = F.transform(source, lambda x: F.when(F.col("_length") > 0, x.cast("double") / F.col("_length")).otherwise(0.0))
    return sized.withColumn(name, scaled).drop("_length")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def clipped_cosine(unit_a: Column, unit_b: Column) -> Column:
    """Cosine of two unit vectors; a zero vector gives 0."""
    return F.least(F.greatest(dot(unit_a, unit_b), F.lit(-1.0)), F.lit(1.0))


def _hashed_grams(texts: list[str], size: int) -> np.ndarray:
    """Counts of hashed runs of ``size`` characters, scaled to length 1."""
    out = np.zeros((len(texts), EMBED_DIM))
    for row, text in enumerate(texts):
        plain = " ".join(text.lower().split())
        codes = np.frombuffer(plain.encode("utf-32-le"), dtype="<u4").astype(np.int64)
        if codes.size < size:
            continue
        runs = codes.size - size + 1
        mixed = sum(codes[k : k + runs] * 31 ** (size - 1 - k) for k in range(size))
        counts = np.bincount(mixed % 1000003 % EMBED_DIM, minlength=EMBED_DIM).astype(float)
        out[row] = counts / np.sqrt(counts @ counts)
    return out


def hashed_trigrams(texts: list[str]) -> np.ndarray:
    """Default embedder: counts of hashed character trigrams, scaled to length 1."""
    return _hashed_grams(texts, 3)


def hashed_bigrams(texts: list[str]) -> np.ndarray:
    """A coarser embedder: counts of hashed pairs of characters, scaled to length 1."""
    return _hashed_grams(texts, 2)


def counting_failures(embed_many: EmbedMany, failed: Accumulator) -> EmbedMany:
    """``embed_many`` that adds the texts of every batch that fails, or has too few vectors, to an accumulator."""

    def run(texts: list[str]) -> np.ndarray:
        try:
            got = np.atleast_2d(np.asarray(embed_many(texts), dtype=float))
            if got.shape[0] != len(texts) or got.shape[1] < EMBED_DIM:
                raise ValueError("one vector per text is needed")
        except Exception:
            failed.add(len(texts))
            raise
        return got

    return run


def one_by_one(embed_one: Callable[[str], list[float]]) -> EmbedMany:
    """Adapt a single-text embedder; a text that fails, or gives too few values, gets a zero vector."""

    def embed_many(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), EMBED_DIM))
        for row, text in enumerate(texts):
            try:
                vec = np.asarray(embed_one(text), dtype=float)
            except Exception:
                continue
            if vec.ndim == 1 and vec.size >= EMBED_DIM:
                out[row] = vec[:EMBED_DIM]
        return out

    return embed_many


def _embed_batch(embed_many: EmbedMany, texts: list[str]) -> np.ndarray:
    try:
        got = np.asarray(embed_many(texts), dtype=float)
        if got.ndim == 1:
            got = got.reshape(1, -1)
    except Exception:
        return np.zeros((len(texts), EMBED_DIM))
    if got.shape[0] != len(texts) or got.shape[1] < EMBED_DIM:
        return np.zeros((len(texts), EMBED_DIM))
    return got[:, :EMBED_DIM]


def embedding(text: Column, embed_many: EmbedMany = hashed_trigrams, batch: int = EMBED_BATCH) -> Column:
    """Embed a text column in batches; a batch that fails gets zero vectors, so its rows match nothing."""

    @F.pandas_udf("array<float>")
    def embed(chunks: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for chunk in chunks:
            texts = chunk.fillna("").tolist()
            vecs = [
                vec.astype(np.float32)
                for at in range(0, len(texts), batch)
                for vec in _embed_batch(embed_many, texts[at : at + batch])
            ]
            yield pd.Series(vecs, index=chunk.index, dtype=object)

    return embed(F.trim(text))
