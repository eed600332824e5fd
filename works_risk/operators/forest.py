"""Isolation forest: sampled, grown and applied as Spark jobs.

Liu, Ting and Zhou, "Isolation Forest", ICDM 2008. Each tree is grown in its own group from a bounded sample. The
grown forest has at most ``trees * (2 * tree_sample - 1)`` nodes whatever the size of the data, so it travels to the
executors as one broadcast and scores rows in Arrow batches.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from works_risk.functions.scalars import inverted_min_max
from works_risk.operators.features import feature_medians, finite_features, imputed
from works_risk.operators.ordering import ordinal
from works_risk.operators.quantiles import exact_quantiles
from works_risk.params import Params
from works_risk.schema import FEATURE_COLUMNS
from works_risk.session import settle, spread_if_few

_EULER = 0.5772156649015329

_NODES = "tree int, node int, feature int, cut double, left int, right int, size int, depth int"


def drawn_positions(n: int, params: Params) -> pd.DataFrame:
    """``tree, _pos``: distinct positions in 1..n for every tree, ``min(tree_sample, n)`` each."""
    want = min(params.tree_sample, n)
    rows = []
    for tree in range(params.trees):
        rng = np.random.default_rng([params.seed, tree, 1])
        if 2 * want >= n:
            taken = rng.permutation(n)[:want]
        else:
            taken = np.zeros(0, np.int64)
            while len(taken) < want:
                fresh = np.concatenate([taken, rng.integers(0, n, want)])
                taken = fresh[np.sort(np.unique(fresh, return_index=True)[1])][:want]
        rows.append(pd.DataFrame({"tree": tree, "_pos": taken + 1}))
    return pd.concat(rows, ignore_index=True)


def tree_samples(rows: DataFrame, n: int, params: Params) -> DataFrame:
    """``min(tree_sample, n)`` rows for every tree, without replacement and the same for any partitioning.

    Positions in the order of the work ids are drawn and joined, so the rule is one for any ``n`` and only drawn rows
    are copied. The drawn table has at most ``trees * tree_sample`` rows, which the parameters bound.
    """
    drawn = rows.sparkSession.createDataFrame(drawn_positions(n, params), "tree int, _pos bigint")
    return ordinal(rows, [F.asc("work_id")], "_pos").join(F.broadcast(drawn), "_pos").drop("_pos")


def _grow(points: np.ndarray, limit: int, rng: np.random.Generator) -> list[tuple]:
    """Nodes of one tree: each split takes a random non-constant feature and a random cut in its range."""
    nodes: list[tuple] = []
    todo = [(np.arange(len(points)), 0, -1)]
    children: dict[int, list[int]] = {}
    while todo:
        members, depth, parent = todo.pop()
        at = len(nodes)
        if parent >= 0:
            children.setdefault(parent, []).append(at)
        part = points[members]
        low, high = part.min(axis=0), part.max(axis=0)
        varied = np.flatnonzero(high > low)
        if depth >= limit or len(members) <= 1 or varied.size == 0:
            nodes.append((at, -1, 0.0, len(members), depth))
            continue
        feature = int(rng.choice(varied))
        cut = float(rng.uniform(low[feature], high[feature]))
        goes_left = part[:, feature] <= cut
        nodes.append((at, feature, cut, len(members), depth))
        todo.append((members[~goes_left], depth + 1, at))
        todo.append((members[goes_left], depth + 1, at))
    return [
        (node, feature, cut, *(children.get(node, [-1, -1])), size, depth)
        for node, feature, cut, size, depth in nodes
    ]


def grow_forest(samples: DataFrame, params: Params, sample_size: int) -> DataFrame:
    """Node table of the forest."""
    limit = math.ceil(math.log2(max(sample_size, 2)))
    seed = params.seed

    def grow(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        tree = int(key[0])
        ordered = group.sort_values("work_id")[FEATURE_COLUMNS].to_numpy(dtype=float)
        nodes = _grow(ordered, limit, np.random.default_rng([seed, tree]))
        out = pd.DataFrame(nodes, columns=["node", "feature", "cut", "left", "right", "size", "depth"])
        out.insert(0, "tree", tree)
        return out

    return samples.groupBy("tree").applyInPandas(grow, _NODES)


def mean_path(n: np.ndarray) -> np.ndarray:
    """Mean depth of an unsuccessful search among ``n`` points."""
    n = np.asarray(n, dtype=float)
    out = np.zeros_like(n)
    out[n == 2] = 1.0
    many = n > 2
    out[many] = 2.0 * (np.log(n[many] - 1.0) + _EULER) - 2.0 * (n[many] - 1.0) / n[many]
    return out


def forest_scores(rows: DataFrame, nodes: DataFrame, sample_size: int) -> DataFrame:
    """``work_id, outlier_score``: 2^(-mean depth / c), near 1 for rows that isolate early."""
    table = nodes.toPandas().sort_values(["tree", "node"], ignore_index=True)
    start = table.groupby("tree")["node"].size().cumsum().shift(fill_value=0)
    shift = table["tree"].map(start)
    inner = table["feature"].to_numpy() >= 0
    feature = np.where(inner, table["feature"], 0)
    cut = table["cut"].to_numpy()
    left = np.where(inner, table["left"] + shift, np.arange(len(table)))
    right = np.where(inner, table["right"] + shift, np.arange(len(table)))
    reach = table["depth"].to_numpy() + mean_path(table["size"].to_numpy())
    roots, depth = start.to_numpy(), int(table["depth"].max())
    scale = len(roots) * float(mean_path(np.array([sample_size]))[0] or 1.0)
    shared = rows.sparkSession.sparkContext.broadcast((feature, cut, left, right, reach, roots, depth, scale))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        feature, cut, left, right, reach, roots, depth, scale = shared.value
        for batch in batches:
            x = batch[FEATURE_COLUMNS].to_numpy(dtype=float)
            each = np.arange(len(x))
            total = np.zeros(len(x))
            for root in roots:
                at = np.full(len(x), root)
                for _ in range(depth):
                    at = np.where(x[each, feature[at]] <= cut[at], left[at], right[at])
                total += reach[at]
            yield pd.DataFrame({"work_id": batch["work_id"], "outlier_score": np.exp2(-total / scale)})

    return rows.select("work_id", *FEATURE_COLUMNS).mapInPandas(score, "work_id string, outlier_score double")


def outliers(features: DataFrame, params: Params) -> DataFrame:
    """``work_id, anomaly_score, is_anomaly`` for every work; too few inputs give a NULL score and no flag."""
    finite = spread_if_few(settle(finite_features(features).select("work_id", "n_features", *FEATURE_COLUMNS)), "work_id")
    enough = F.col("n_features") >= params.min_features
    usable = finite.filter(enough)
    n = usable.count()
    skipped = finite.filter(~enough).select(
        "work_id", F.lit(None).cast("double").alias("anomaly_score"), F.lit(False).alias("is_anomaly")
    )
    if n == 0:
        return skipped
    matrix = imputed(usable, feature_medians(finite, params.min_features))
    size = min(params.tree_sample, n)
    nodes = grow_forest(tree_samples(matrix, n, params), params, size)
    # Shifted and negated so that low means odd, as the contamination quantile expects.
    scored = settle(forest_scores(matrix, nodes, size).withColumn("normality", -F.col("outlier_score")))
    bound = exact_quantiles(scored, {"normality": params.contamination})["normality"]
    ends = scored.agg(F.min("normality"), F.max("normality")).first()
    judged = scored.select(
        "work_id",
        inverted_min_max(F.col("normality"), ends[0], ends[1]).alias("anomaly_score"),
        (F.col("normality") < F.lit(bound)).alias("is_anomaly"),
    )
    return judged.unionByName(skipped)
