"""Numeric features of a work and their imputed matrix."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from works_risk.functions.scalars import guarded_ratio
from works_risk.operators.quantiles import exact_quantiles
from works_risk.params import MIN_FEATURES
from works_risk.schema import FEATURE_COLUMNS


def build_features(master: DataFrame, ref_date: dt.date | None) -> DataFrame:
    """Add the ratio, count and day-gap features; ``ref_date`` is the day that open works are measured to."""
    if ref_date is None:
        raise ValueError("ref_date is required: day counts must not depend on the clock")
    rec = F.coalesce(F.col("recommended_amount"), F.lit(0))
    san = F.coalesce(F.col("sanction_amount"), F.lit(0))

    def filled(name: str):
        return F.coalesce(F.col(name).cast("double"), F.lit(0.0))

    def days(later, earlier):
        return F.datediff(later, earlier).cast("double")

    return master.withColumns(
        {
            "f1_sanction_delta_ratio": guarded_ratio(san - rec, rec, (rec > 0) & (san > 0)),
            "f2_disbursed_ratio": guarded_ratio(F.col("amount_disbursed"), san),
            "f3_vendor_count": filled("exp_vendors"),
            "f3_payment_count": filled("exp_pay_count"),
            "f4_days_rec_to_san": days(F.col("sanction_date"), F.col("recommended_date")),
            "f4_days_san_to_done": days(F.col("completion_date"), F.col("sanction_date")),
            "f4_days_san_to_ref": days(F.lit(ref_date), F.col("sanction_date")),
            "aux_sanction_amount": filled("sanction_amount"),
            "aux_amount_disbursed": filled("amount_disbursed"),
            "aux_exp_total": filled("exp_total"),
            "aux_exp_paid": filled("exp_paid"),
            "aux_alloc_limit": filled("alloc_limit"),
            "aux_exp_vendors": filled("exp_vendors"),
            "aux_exp_pay_count": filled("exp_pay_count"),
        }
    )


def finite_features(features: DataFrame) -> DataFrame:
    """Model inputs with infinities as NULL, and how many inputs each work has."""
    finite = {c: F.when(F.abs(c) != float("inf"), F.nanvl(c, F.lit(None).cast("double"))) for c in FEATURE_COLUMNS}
    present = F.size(F.array_compact(F.array(*[F.col(c) for c in FEATURE_COLUMNS])))
    return features.withColumns(finite).withColumn("n_features", present)


def feature_medians(features: DataFrame, min_features: int = MIN_FEATURES) -> dict[str, float]:
    """Exact median of every model input over the works that have enough inputs."""
    usable = features.filter(F.col("n_features") >= min_features)
    medians = exact_quantiles(usable, dict.fromkeys(FEATURE_COLUMNS, 0.5))
    return {c: 0.0 if v is None else v for c, v in medians.items()}


def imputed(features: DataFrame, medians: dict[str, float]) -> DataFrame:
    return features.withColumns({c: F.coalesce(F.col(c), F.lit(medians[c])) for c in FEATURE_COLUMNS})
