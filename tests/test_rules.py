import datetime as dt

import pytest
from pyspark.sql import functions as F

from works_risk.operators import aggregate, classify, features, rules
from works_risk.params import RISK_WEIGHTS, Params
from works_risk.plans.detect import judged, with_signals

PARAMS = Params(ref_date=dt.date(2025, 6, 1))


def by_id(df):
    return {r["work_id"].rsplit("/", 1)[1]: r for r in df.collect()}


def test_flags_at_their_boundaries(work):
    s = {"is_sanctioned": True, "amount_disbursed": 1}
    df = work(
        s | {"sanction_date": "2025-01-01"},
        s | {"sanction_date": "2024-12-31"},
        s | {"sanction_date": "2024-12-31", "is_completed": True},
        s | {"sanction_date": None},
        {"recommended_amount": 100, "sanction_amount": 120},
        {"recommended_amount": 100, "sanction_amount": "120.01"},
        {"recommended_amount": 0, "sanction_amount": 50},
        {"is_sanctioned": True, "amount_disbursed": None, "sanction_amount": 5, "exp_total": 5},
        {"is_sanctioned": True, "amount_disbursed": 1, "sanction_amount": 5, "exp_total": "5.01"},
        {"work_id": " na-1/9", "is_sanctioned": None},
    )
    r = by_id(rules.rule_flags(df, PARAMS))
    assert [r[str(i)]["flag_stalled"] for i in range(4)] == [False, True, False, False]
    assert [r[str(i)]["flag_incomplete"] for i in range(4)] == [True, True, False, False]
    assert [r[str(i)]["flag_sanction_overrun"] for i in (4, 5, 6)] == [False, True, False]
    assert r["7"]["flag_zero_disbursal"] and not r["7"]["flag_cost_overrun"]
    assert r["8"]["flag_cost_overrun"]
    assert any(x["flag_unparseable"] for x in r.values()) and not r["4"]["flag_unparseable"]


def test_risk_reasons_and_pattern(work, spark):
    stalled = {"is_sanctioned": True, "sanction_date": "2024-01-01", "sanction_amount": 3100000}
    df = work(
        stalled | {"has_duplicate_lead": True},
        stalled | {"is_anomaly": True},
        stalled | {"amount_disbursed": 5},
        {"is_sanctioned": True, "is_completed": True},
        {},
        {"recommended_amount": 10, "sanction_amount": 13, "is_anomaly": True},
        {"work_id": "NA-1/6"} | stalled | {"has_duplicate_lead": True, "is_anomaly": True, "recommended_amount": 1, "exp_total": 9999999},
    )
    signal_cols = [c for c in df.columns if not c.startswith("flag_")]
    r = by_id(judged(df.select(*signal_cols), PARAMS))
    assert (r["0"]["risk_score"], r["0"]["fraud_type"], r["0"]["fraud_priority"]) == (80, "duplicate_claim", 1)
    assert r["0"]["reasons"] == (
        "stalled: sanctioned before 2025-01-01, never completed; sanctioned but never completed; sanctioned but zero "
        "amount disbursed; duplicate-resubmission candidate (cross-FY, same MP+amount, description sim >= 0.8)"
    )
    assert (r["1"]["risk_score"], r["1"]["fraud_type"], r["1"]["fraud_signals"]) == (75, "siphoned_funds", "stalled_no_funds,zero_disbursal,anomaly")
    assert r["1"]["fraud_narrative"] == "Work was sanctioned (3100000.0) but has not been completed and has zero amount disbursed."
    assert r["1"]["legal_route"] == "enforcement - agency investigation"
    assert (r["2"]["risk_score"], r["2"]["fraud_type"]) == (35, "ghost_work")
    assert (r["3"]["fraud_type"], r["3"]["fraud_signals"], r["3"]["legal_route"]) == ("statistical_anomaly", "zero_disbursal", "internal - review only")
    assert (r["4"]["fraud_type"], r["4"]["fraud_priority"], r["4"]["fraud_signals"], r["4"]["fraud_narrative"]) == ("", 0, "[]", "No detection signal.")
    assert r["4"]["legal_route"] == "internal - review only" and not r["4"]["is_flagged"]
    assert r["5"]["fraud_type"] == "over_invoicing"
    assert r["6"]["risk_score"] == 100 and sum(RISK_WEIGHTS.values()) == 125
    flags = judged(df.select(*signal_cols), PARAMS)
    assert classify.missing_routes(flags).count() == 0
    more = flags.filter(F.col("work_id") == "MP1/2024-2025/5").select(classify.corroboration(classify.signals(), classify.pattern()))
    assert more.first()[0] == ["anomaly"]
    total = aggregate.summary(flags).first()
    assert (total["total_works"], total["flagged"], total["duplicate_leads"], total["highest_risk"]) == (7, 6, 2, 100.0)
    assert total["with_any_rule"] == 4 and total["with_any_flag"] == 6


def test_features(work):
    df = work(
        {"recommended_amount": 100, "sanction_amount": 150, "amount_disbursed": 75, "recommended_date": "2024-01-01",
         "sanction_date": "2024-01-31", "completion_date": "2024-01-01"},
        {"recommended_amount": 0, "sanction_amount": 0, "exp_vendors": None},
    )
    r = by_id(features.finite_features(features.build_features(df, PARAMS.ref_date)))
    assert (r["0"]["f1_sanction_delta_ratio"], r["0"]["f2_disbursed_ratio"]) == (0.5, 0.5)
    assert (r["0"]["f4_days_rec_to_san"], r["0"]["f4_days_san_to_done"], r["0"]["f4_days_san_to_ref"]) == (30.0, -30.0, 487.0)
    assert r["1"]["f1_sanction_delta_ratio"] is None and r["1"]["f3_vendor_count"] == 0.0
    assert (r["0"]["n_features"], r["1"]["n_features"]) == (11, 6)
    with pytest.raises(ValueError):
        features.build_features(df, None)


def test_per_mp_published_example(work, spark):
    stalled = {"is_sanctioned": True, "flag_stalled": True, "flag_zero_disbursal": True}
    unpaid = {"is_sanctioned": True, "flag_zero_disbursal": True}
    df = work(*[stalled] * 379, *[unpaid] * 72, *[{}] * 6).withColumn(
        "risk_score", F.when(F.col("flag_stalled"), 55).when(F.col("flag_zero_disbursal"), 20).otherwise(0)
    )
    r = aggregate.per_mp(df).first()
    assert (r["works"], r["stalled"], r["zero_disbursal"], r["cumulative_risk_points"]) == (457, 379, 451, 2039)
    assert round(r["avg_risk_per_work"], 2) == 48.76
    assert r["spend_pct_alloc"] is None


def test_per_mp_keys_and_rank(work):
    df = work(
        {"mp_no": None}, {"mp_no": "2", "mp_name": None, "flag_stalled": True}, {"mp_no": "1", "flag_stalled": True},
        {"mp_no": "3", "alloc_limit": 50, "exp_total": 25, "has_duplicate_lead": True}, {"mp_no": "3", "alloc_limit": 40, "exp_total": 25},
    ).withColumn("risk_score", F.lit(10))
    ranked = aggregate.ranked(aggregate.per_mp(df)).orderBy("risk_rank").collect()
    assert [(r["mp_no"], r["cumulative_risk_points"], r["risk_rank"]) for r in ranked] == [("3", 4, 1), ("1", 3, 2), ("2", 3, 3)]
    assert ranked[0]["spend_pct_alloc"] == 100.0
    assert sum(r["works"] for r in ranked) == 4
    points = aggregate.with_points(df, aggregate.per_mp(df)).filter("mp_no = '2'").first()
    assert points["cumulative_risk_points"] == 3


def test_missing_signals_are_zero(work):
    df = work({}).drop("has_duplicate_lead", "is_anomaly")
    assert with_signals(df, None).first()["has_duplicate_lead"] is False
