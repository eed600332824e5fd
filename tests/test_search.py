import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from works_risk.operators import cells, evaluate, search


def test_nearest_matches_brute_force(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(200, 6))
    v[150:] = v[3]
    v[7] = 0
    q = [(10, list(map(float, v[3]))), (11, list(map(float, rng.normal(size=6)))), (12, [0.0] * 6)]
    df = spark.createDataFrame([(i, list(map(float, r))) for i, r in enumerate(v)], "id long, vec array<double>").repartition(5)
    got = {}
    for r in search.nearest(df, q, 4).collect():
        got.setdefault(r["query"], {})[r["place"]] = (r["id"], r["score"])
    unit = v / np.where(np.linalg.norm(v, axis=1) > 0, np.linalg.norm(v, axis=1), 1)[:, None]
    for key, vec in q:
        s = unit @ np.array(vec) / (np.linalg.norm(vec) or 1)
        best = sorted(range(200), key=lambda i: (-round(s[i], 9), i))[:4]
        assert [got[key][p][1] for p in (1, 2, 3, 4)] == [pytest.approx(round(s[i], 4), abs=1e-4) for i in best]
    assert {i for i, _ in got[12].values()} == {0, 1, 2, 3}
    with pytest.raises(ValueError):
        search.nearest(df, [], 3)


@pytest.mark.parametrize("block", [999, 7])
def test_nearest_takes_any_number_of_queries(spark, monkeypatch, block):
    monkeypatch.setattr(cells, "QUERY_BLOCK", block)
    monkeypatch.setattr(cells, "ANCHOR_BLOCK", 60)
    v = np.random.default_rng(4).normal(size=(150, 5))
    df = spark.createDataFrame([(i, list(map(float, r))) for i, r in enumerate(v)], "id long, vec array<double>")
    hits = search.nearest(df, df.withColumnRenamed("id", "query"), 1).collect()
    assert len(hits) == 150 and all(h["query"] == h["id"] and h["score"] == 1.0 for h in hits)


def test_similar_works(spark, work):
    df = work(
        {"work_desc": "Construction of drain"}, {"work_desc": "Supply of computers"}, {"work_desc": " "}, {"work_desc": "quiet"}
    ).withColumns({"is_flagged": F.col("work_desc") != "quiet", "risk_score": F.lit(5)})
    anchors = search.anchor_table(df, 200)
    assert anchors.count() == 2
    hits = search.similar_works("construction of  DRAIN", anchors, df.filter("work_desc <> 'Supply of computers'"), 2).orderBy("place").collect()
    assert [(h["work_desc"], h["score"] == 1.0) for h in hits] == [("Construction of drain", True), ("", False)]


def test_filters_and_json(spark, work):
    df = work(
        {"mp_name": "Asha (R) Rao", "state": "Kerala"}, {"mp_name": "ASHA rao"}, {"mp_name": None, "state": "Goa"}, {"mp_name": "x"}
    ).withColumns({"is_flagged": F.col("mp_name").isNull() | (F.col("mp_name") != "x"), "risk_score": F.lit(20), "fraud_type": F.lit("ghost_work")})
    count = lambda **f: search.filtered_works(df, **f).count()
    assert count() == 3
    assert count(mp="asha") == 2 and count(mp="(r)") == 1 and count(mp="a.*rao", regex=True) == 2
    assert count(state="ker", mp="asha") == 1 and count(fraud_type="siphoned_funds") == 0
    assert count(min_risk=20.5) == 0
    with pytest.raises(ValueError):
        count(min_risk=101)
    total, rows = search.works_page(df, 2, 2)
    assert total == 3 and rows.count() == 1
    assert search.one_work(df, "MP1/2024-2025/2").count() == 1 and search.one_work(df, "none").count() == 0
    record = json.loads(search.json_records(df.select("mp_name", F.lit(float("nan")).alias("n"), "risk_score").filter("mp_name is null")).first()[0])
    assert record == {"mp_name": None, "n": None, "risk_score": 20}


def test_published_pair_means(spark):
    # Published cosines of ten labelled pairs: five matches, five non-matches.
    before = [0.5143, 0.8985, 0.1061, 0.2728, 0.1337, 0.9799, 0.1666, 0.1353, 0.0392, 0.1096]
    rows = [(f"a{i}", f"b{i}", "MATCH" if i < 5 else "NOT_MATCH", c) for i, c in enumerate(before)]
    df = spark.createDataFrame(rows, "pair_a string, pair_b string, expected string, cosine double")
    r = evaluate.class_means(df).first()
    assert (round(r[0], 4), round(r[1], 4), round(r[2], 4)) == (0.3851, 0.2861, 0.0990)
    joined = evaluate.before_after(df.filter("pair_a <> 'a9'"), df).collect()
    assert len(joined) == 10 and [x["before"] for x in joined if x["pair_a"] == "a9"] == [None]
    right = df.select(evaluate.right_verdict(F.col("cosine"), F.col("expected"))).collect()
    assert sum(x[0] for x in right) == 1 + 4


def test_accuracy_correlation_and_best(spark):
    x = [0.1, 0.4, 0.4, 0.6, 0.9, 0.5]
    y = [0, 0, 1, 1, 1, 0]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(x, y))], "k int, cosine double, label int")
    assert evaluate.accuracy(df).first()[0] == round(4 / 6, 4)
    r = evaluate.correlations(df, "k").first()
    assert r["pearson"] == pytest.approx(np.corrcoef(x, y)[0, 1])
    ranks = lambda v: [np.mean([j + 1 for j, o in enumerate(sorted(v)) if o == u]) for u in v]
    assert r["spearman"] == pytest.approx(np.corrcoef(ranks(x), ranks(y))[0, 1])
    # Published epoch accuracies: the fourth checkpoint wins.
    epochs = spark.createDataFrame([(1, 0.9565, "e1"), (2, 0.9598, "e2"), (3, 0.963, "e3"), (4, 0.963, "e4")], "epoch int, acc double, path string")
    assert evaluate.best_row(epochs.withColumn("run", F.lit(1)), "path", "acc", "epoch", ["run"]).first()["path"] == "e3"
    span = evaluate.score_range(df.withColumn("model", F.lit("m"))).first()
    assert (span["lowest"], span["highest"]) == (0.1, 0.9)


def test_precision_at_k(spark):
    rng = np.random.default_rng(8)
    v = rng.normal(size=(60, 5))
    vectors = spark.createDataFrame([(i, list(map(float, r))) for i, r in enumerate(v)], "id long, vec array<double>")
    test = [(i, i + 1, i % 2, i) for i in range(50)] + [(1, 9, 1, 99)]
    df = spark.createDataFrame(test, "anchor long, other long, label int, pos long")
    r = evaluate.precision_at_k(df, vectors, k=5).first()
    corpus = sorted({t[1] for t in test})
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    target, hits, total = {}, 0, 0
    for a, o, label, _ in test:
        if label:
            target.setdefault(a, o)
    for a, _, label, _ in test:
        if label:
            total += 1
            hits += target[a] in sorted(corpus, key=lambda c: -(u[a] @ u[c]))[:5]
    assert (r["queries"], r["precision"]) == (total, round(hits / total, 4))
    assert evaluate.precision_at_k(df.filter("label = 5"), vectors).first()["precision"] == 0.0


def test_latest_verdicts(spark):
    df = spark.createDataFrame([("w", "refer", 2), ("w", "legitimate", 3), ("v", "refer", 1)], "work_id string, verdict string, given_at int")
    assert {tuple(r) for r in evaluate.latest_verdicts(df).collect()} == {("w", "legitimate"), ("v", "refer")}
