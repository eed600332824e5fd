import datetime as dt
import math

import numpy as np
import pytest

from works_risk.operators import features, forest
from works_risk.params import Params

PARAMS = Params(ref_date=dt.date(2025, 6, 1), trees=40, tree_sample=128)


@pytest.fixture
def works(work):
    rng = np.random.default_rng(4)
    rows = [
        {"recommended_amount": round(float(rng.normal(1000, 50)), 2), "sanction_amount": round(float(rng.normal(1000, 50)), 2),
         "amount_disbursed": round(float(rng.normal(900, 50)), 2), "exp_total": round(float(rng.normal(900, 50)), 2),
         "sanction_date": f"2024-0{1 + i % 9}-1{i % 9}", "recommended_date": "2024-01-01"}
        for i in range(400)
    ]
    rows.append({"recommended_amount": 10, "sanction_amount": 99999, "amount_disbursed": 1, "exp_total": 88888, "exp_pay_count": 40,
                 "sanction_date": "2019-01-01", "recommended_date": "2024-01-01"})
    return work(*rows)


def test_outliers(works):
    built = features.build_features(works, PARAMS.ref_date)
    rows = {r["work_id"]: r for r in forest.outliers(built, PARAMS).collect()}
    again = {r["work_id"]: r for r in forest.outliers(built.repartition(7), PARAMS).collect()}
    assert rows == again
    scores = np.array([r["anomaly_score"] for r in rows.values()])
    assert scores.max() == pytest.approx(1, abs=1e-6) and scores.min() == pytest.approx(0, abs=1e-6)
    worst = max(rows.values(), key=lambda r: r["anomaly_score"])
    assert worst["work_id"].endswith("/400") and worst["is_anomaly"]
    bound = np.percentile(-scores, 5)
    assert sum(r["is_anomaly"] for r in rows.values()) == int((-scores < bound - 1e-12).sum())
    assert len(set(scores)) < len(scores) or sum(r["is_anomaly"] for r in rows.values()) == math.ceil(0.05 * (len(scores) - 1))
    assert math.ceil(0.05 * (17879 - 1)) == 894


def test_samples_and_nodes(works):
    built = features.finite_features(features.build_features(works, PARAMS.ref_date))
    matrix = features.imputed(built, features.feature_medians(built))
    drawn = forest.tree_samples(matrix, 401, PARAMS)
    sizes = {r["tree"]: r["count"] for r in drawn.groupBy("tree").count().collect()}
    assert sizes == dict.fromkeys(range(40), 128)
    assert drawn.select("tree", "work_id").distinct().count() == 40 * 128
    nodes = forest.grow_forest(drawn, PARAMS, 128).toPandas()
    assert nodes["depth"].max() <= 7
    leaves = nodes[nodes["feature"] < 0]
    assert (leaves.groupby("tree")["size"].sum() == 128).all()


@pytest.mark.parametrize("n", [1, 7, 39, 41, 262_143, 262_145, 10**11])
def test_positions_follow_one_rule_at_every_size(n):
    params = Params(trees=6, tree_sample=20)
    drawn = forest.drawn_positions(n, params)
    want = min(20, n)
    assert drawn.groupby("tree")["_pos"].nunique().to_dict() == dict.fromkeys(range(6), want)
    assert drawn["_pos"].between(1, n).all()
    assert drawn.equals(forest.drawn_positions(n, params))
    if n > 40:
        assert drawn["_pos"].max() > n / 2 > drawn["_pos"].min()


def test_too_few_inputs(works):
    built = features.build_features(works.limit(5), PARAMS.ref_date)
    rows = forest.outliers(built, Params(min_features=12)).collect()
    assert len(rows) == 5 and all(r["anomaly_score"] is None and r["is_anomaly"] is False for r in rows)


def test_mean_path():
    got = forest.mean_path(np.array([1, 2, 256]))
    assert got[0] == 0 and got[1] == 1 and got[2] == pytest.approx(10.244770920116851)
