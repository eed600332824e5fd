import numpy as np
import pytest
from pyspark.sql import functions as F

from works_risk.operators import ordering, quantiles


def test_ordinal_matches_sorted_positions(spark):
    df = spark.range(1000).withColumn("v", F.col("id") % 7).repartition(5)
    got = {r["id"]: r["ordinal"] for r in ordering.ordinal(df, [F.desc("v"), F.asc("id")]).collect()}
    expected = sorted(range(1000), key=lambda i: (-(i % 7), i))
    assert [got[i] for i in expected] == list(range(1, 1001))


def test_first_and_last(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, None), ("b", 1, "z"), ("a", 3, "w")], "k string, o int, v string")
    assert {tuple(r) for r in ordering.first_per_key(df, ["k"], F.col("o")).collect()} == {("a", 1, None), ("b", 1, "z")}
    assert {tuple(r) for r in ordering.last_per_key(df, ["k"], F.col("o")).collect()} == {("a", 3, "w"), ("b", 1, "z")}


def test_pages(spark, monkeypatch):
    df = spark.range(25)
    order = [F.desc("id")]
    for shallow in (ordering.SHALLOW_ROWS, 0):
        monkeypatch.setattr(ordering, "SHALLOW_ROWS", shallow)
        assert sorted(r[0] for r in ordering.page(df, order, 3, 10).collect()) == [0, 1, 2, 3, 4]
        assert ordering.page(df, order, 4, 10).count() == 0
    assert ordering.page_count(25, 10) == 3
    with pytest.raises(ValueError):
        ordering.page(df, order, 0, 10)
    with pytest.raises(ValueError):
        ordering.page(df, order, 1, 501)


def test_split_sizes_and_stability(spark):
    df = spark.range(207)
    a = {r["id"]: r["split"] for r in ordering.seeded_split(df.repartition(3), 42, [F.col("id")]).collect()}
    b = {r["id"]: r["split"] for r in ordering.seeded_split(df.repartition(7), 42, [F.col("id")]).collect()}
    assert a == b
    n = len(a)
    sizes = [list(a.values()).count(s) for s in ("train", "val", "test")]
    assert sizes == [int(0.7 * n), int(0.85 * n) - int(0.7 * n), n - int(0.85 * n)]
    # Published sizes of the same rule at 70,607 rows.
    assert (int(0.7 * 70607), int(0.85 * 70607) - int(0.7 * 70607), 70607 - int(0.85 * 70607)) == (49424, 10591, 10592)


@pytest.mark.parametrize("read_out", [20_000, 5])
def test_exact_quantiles(spark, monkeypatch, read_out):
    monkeypatch.setattr(quantiles, "READ_OUT_ROWS", read_out)
    rng = np.random.default_rng(3)
    x = np.exp(rng.normal(size=30001) * 4)
    y = rng.integers(0, 3, size=30001).astype(float)
    df = spark.createDataFrame([(float(a), float(b) if i % 3 else None) for i, (a, b) in enumerate(zip(x, y))], "x double, y double")
    df = df.withColumn("none", F.lit(None).cast("double")).repartition(6).cache()
    got = quantiles.exact_quantiles(df, {"x": 0.05, "y": 0.5, "none": 0.5})
    kept = np.array([b for i, b in enumerate(y) if i % 3])
    assert got["x"] == pytest.approx(np.percentile(x, 5), rel=1e-12)
    assert got["y"] == np.median(kept)
    assert got["none"] is None


@pytest.mark.parametrize("share", [0.0, 0.3, 0.499999, 0.5, 0.500001, 0.8, 1.0])
def test_quantiles_read_out_few_rows_however_many_tie(spark, monkeypatch, share):
    monkeypatch.setattr(quantiles, "READ_OUT_ROWS", 100)
    n = 60_001
    df = spark.range(n).select(F.when(F.col("id") <= n // 2, 0.0).otherwise(F.col("id").cast("double")).alias("x")).repartition(4).cache()
    read = []
    out = quantiles._read_out
    monkeypatch.setattr(quantiles, "_read_out", lambda d, t: read.append(out(d, t)) or read[-1])
    x = np.where(np.arange(n) <= n // 2, 0.0, np.arange(n))
    assert quantiles.exact_quantiles(df, {"x": share})["x"] == pytest.approx(np.quantile(x, share))
    assert all(sum(k for _, k in values) <= 100 for values in read[0])


def test_spread_by_cores_or_by_size(spark, monkeypatch):
    from works_risk import session

    df = spark.range(1000).selectExpr("id", "cast(id % 7 as string) AS block")
    assert session.spread(df, "block").rdd.getNumPartitions() == max(spark.sparkContext.defaultParallelism, 4)
    monkeypatch.setattr(session, "SPREAD_BYTES", 0)
    rebalanced = session.spread(df, "block")
    assert rebalanced.count() == 1000 and "REBALANCE" in rebalanced._jdf.queryExecution().executedPlan().toString()
