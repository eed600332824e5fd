"""Deterministic rule flags, reasons and the risk score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from works_risk.functions.cleaning import is_unparseable
from works_risk.functions.scalars import clipped_score, joined_texts, truth
from works_risk.params import RISK_WEIGHTS, Params


def rule_flags(master: DataFrame, params: Params) -> DataFrame:
    sanctioned = truth(F.col("is_sanctioned"))
    open_work = sanctioned & ~truth(F.col("is_completed"))

    def amount(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0)).cast("decimal(18,2)")

    limit = amount("recommended_amount") * F.lit(params.overrun_ratio).cast("decimal(6,2)")
    return master.withColumns(
        {
            "flag_unparseable": is_unparseable(F.col("work_id")),
            "flag_stalled": open_work & truth(F.col("sanction_date") < F.lit(params.stall_before)),
            "flag_incomplete": open_work & F.col("sanction_date").isNotNull(),
            "flag_sanction_overrun": (amount("recommended_amount") > 0) & (amount("sanction_amount") > limit),
            "flag_zero_disbursal": sanctioned & (amount("amount_disbursed") == 0),
            "flag_cost_overrun": sanctioned & (amount("exp_total") > amount("sanction_amount")),
        }
    )


def reason_texts(params: Params) -> dict[str, str]:
    # The wording of each reason, in output order.
    return {
        "flag_unparseable": "unparseable/NA- work id (kept, flagged)",
        "flag_stalled": f"stalled: sanctioned before {params.stall_before.isoformat()}, never completed",
        "flag_incomplete": "sanctioned but never completed",
        "flag_sanction_overrun": f"sanctioned > {round(float(params.overrun_ratio) * 100)}% of recommended amount",
        "flag_zero_disbursal": "sanctioned but zero amount disbursed",
        "flag_cost_overrun": "paid out more than sanctioned amount",
        "has_duplicate_lead": "duplicate-resubmission candidate (cross-FY, same MP+amount, description sim >= "
        f"{params.duplicate_cosine})",
        "is_anomaly": "anomalous on F1-F4 features (Isolation Forest)",
    }


def add_reasons(flags: DataFrame, params: Params) -> DataFrame:
    """Join the reason of every raised flag: rules first, then the duplicate lead, then the outlier."""
    texts = [F.when(truth(F.col(c)), F.lit(text)) for c, text in reason_texts(params).items()]
    return flags.withColumn("reasons", joined_texts("; ", *texts))


def add_risk(flags: DataFrame) -> DataFrame:
    points = sum((F.when(truth(F.col(c)), w).otherwise(0) for c, w in RISK_WEIGHTS.items()), F.lit(0))
    return flags.withColumn("risk_score", clipped_score(points)).withColumn("is_flagged", F.length("reasons") > 0)
