"""Scores of labelled pairs and models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from works_risk.operators.ordering import ordinal, seeded_key, top_rows
from works_risk.operators.search import nearest

MATCH, NOT_MATCH = "MATCH", "NOT_MATCH"
VERDICT_CUT = 0.6
ACCURACY_CUT = 0.5


def class_means(scored: DataFrame, score: str = "cosine") -> DataFrame:
    """Mean score of matches and of non-matches, and their separation."""
    match = F.avg(F.when(F.col("expected") == MATCH, F.col(score)))
    other = F.avg(F.when(F.col("expected") == NOT_MATCH, F.col(score)))
    return scored.agg(match.alias("match_mean"), other.alias("nonmatch_mean"), (match - other).alias("separation"))


def before_after(before: DataFrame, after: DataFrame) -> DataFrame:
    """Old and new score of each pair; a pair without an old score keeps NULL."""
    old = before.select("pair_a", "pair_b", F.col("cosine").alias("before"))
    new = after.select("pair_a", "pair_b", "expected", F.col("cosine").alias("after"))
    return new.join(old, ["pair_a", "pair_b"], "left").select("pair_a", "pair_b", "expected", "before", "after")


def right_verdict(score: Column, expected: Column, cut: float = VERDICT_CUT) -> Column:
    return ((score > cut) & (expected == MATCH)) | ((score < cut) & (expected == NOT_MATCH))


def accuracy(scored: DataFrame, score: str = "cosine", cut: float = ACCURACY_CUT) -> DataFrame:
    hit = (F.col(score) >= cut).cast("int") == F.col("label")
    return scored.agg(F.round(F.avg(hit.cast("double")), 4).alias("accuracy"))


def score_range(scored: DataFrame, score: str = "cosine") -> DataFrame:
    return scored.groupBy("model").agg(
        F.avg(score).alias("mean"), F.min(score).alias("lowest"), F.max(score).alias("highest")
    )


def with_mean_rank(df: DataFrame, value: str, key: str) -> DataFrame:
    """Add the rank of ``value``; equal values share their mean rank. ``key`` is unique."""
    placed = ordinal(df, [F.asc(value), F.asc(key)], "pos")
    ties = placed.groupBy(value).agg(F.avg("pos").alias(f"{value}_rank"))
    return placed.drop("pos").join(ties, value)


def correlations(scored: DataFrame, key: str, score: str = "cosine", label: str = "label") -> DataFrame:
    """Linear and rank correlation of a score with the label."""
    ranked = with_mean_rank(with_mean_rank(scored.select(key, score, label), score, key), label, key)
    return ranked.agg(
        F.corr(score, label).alias("pearson"), F.corr(f"{score}_rank", f"{label}_rank").alias("spearman")
    )


def precision_at_k(
    test: DataFrame, vectors: DataFrame, k: int = 20, n_queries: int = 300, seed: int = 42
) -> DataFrame:
    """Share of sampled positive anchors whose target is among the ``k`` nearest of the corpus.

    ``test`` has ``anchor, other, label, pos``; ``vectors`` has ``id, vec``. The target of an anchor is its first
    positive. The corpus is every distinct ``other`` of the test set.
    """
    positives = test.filter(F.col("label") == 1)
    targets = positives.groupBy("anchor").agg(F.min_by("other", "pos").alias("target"))
    order = [seeded_key(seed, F.col("anchor"), F.col("other")), F.asc("anchor"), F.asc("other")]
    asked = top_rows(positives.select("anchor", "other"), order, n_queries).groupBy("anchor").agg(
        F.count(F.lit(1)).alias("times")
    )
    corpus = test.select(F.col("other").alias("id")).distinct().join(vectors, "id")
    with_vec = asked.join(vectors.withColumnRenamed("id", "anchor"), "anchor").select("anchor", "vec")
    hits = nearest(corpus, with_vec.withColumnRenamed("anchor", "query"), k).select(F.col("query").alias("anchor"), F.col("id").alias("target"), F.lit(1).alias("hit"))
    judged = asked.join(targets, "anchor").join(hits, ["anchor", "target"], "left")
    hit_times = F.sum(F.when(F.col("hit") == 1, F.col("times")).otherwise(0))
    return judged.agg(
        F.coalesce(F.sum("times"), F.lit(0)).alias("queries"),
        F.coalesce(F.round(hit_times / F.sum("times"), 4), F.lit(0.0)).alias("precision"),
    )


def best_row(df: DataFrame, value: str, metric: str, order: str, keys: list[str]) -> DataFrame:
    """The ``value`` with the highest metric of each group; the first in ``order`` wins a tie."""
    best = F.max_by(value, F.struct(F.col(metric), -F.col(order)))
    return df.groupBy(*keys).agg(best.alias(value), F.max(metric).alias(metric))


def latest_verdicts(verdicts: DataFrame) -> DataFrame:
    """The last reviewer verdict of each work."""
    return verdicts.groupBy("work_id").agg(F.max_by("verdict", "given_at").alias("verdict"))
