"""Column layouts of the tables."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)

# Layout of the one-row-per-work table.
MASTER = T.StructType(
    [
        T.StructField("work_id", T.StringType()),
        T.StructField("mp_no", T.StringType()),
        T.StructField("fy", T.StringType()),
        T.StructField("work_no", T.StringType()),
        T.StructField("mp_name", T.StringType()),
        T.StructField("mp_state", T.StringType()),
        T.StructField("state", T.StringType()),
        T.StructField("constituency", T.StringType()),
        T.StructField("work_category", T.StringType()),
        T.StructField("work_desc", T.StringType()),
        T.StructField("work_status", T.StringType()),
        T.StructField("recommended_date", T.DateType()),
        T.StructField("recommended_amount", MONEY),
        T.StructField("sanction_date", T.DateType()),
        T.StructField("sanction_amount", MONEY),
        T.StructField("completion_date", T.DateType()),
        T.StructField("amount_disbursed", MONEY),
        T.StructField("exp_pay_count", T.LongType()),
        T.StructField("exp_total", MONEY),
        T.StructField("exp_inprogress", MONEY),
        T.StructField("exp_paid", MONEY),
        T.StructField("exp_vendors", T.LongType()),
        T.StructField("alloc_limit", MONEY),
        T.StructField("calamity_consent", MONEY),
        T.StructField("is_recommended", T.BooleanType()),
        T.StructField("is_sanctioned", T.BooleanType()),
        T.StructField("is_completed", T.BooleanType()),
        T.StructField("has_expenditure", T.BooleanType()),
    ]
)

DUP_SIGNALS = T.StructType(
    [
        T.StructField("work_id", T.StringType()),
        T.StructField("dup_partner_count", T.LongType()),
        T.StructField("dup_partner_sim_max", T.DoubleType()),
        T.StructField("dup_partner_cross_fy", T.LongType()),
        T.StructField("has_duplicate_lead", T.BooleanType()),
    ]
)

PAIRS = T.StructType(
    [
        T.StructField("work_a", T.StringType()),
        T.StructField("work_b", T.StringType()),
        T.StructField("similarity", T.DoubleType()),
    ]
)

SWEEP = T.StructType(
    [
        T.StructField("model", T.StringType()),
        T.StructField("similarity", T.DoubleType()),
        T.StructField("work_a", T.StringType()),
        T.StructField("work_b", T.StringType()),
        T.StructField("work_status_a", T.StringType()),
        T.StructField("work_status_b", T.StringType()),
        T.StructField("mp_name", T.StringType()),
    ]
)

# The model inputs, in order.
FEATURE_COLUMNS = [
    "f1_sanction_delta_ratio",
    "f2_disbursed_ratio",
    "f3_vendor_count",
    "f4_days_rec_to_san",
    "f4_days_san_to_done",
    "f4_days_san_to_ref",
    "aux_sanction_amount",
    "aux_amount_disbursed",
    "aux_exp_total",
    "aux_alloc_limit",
    "aux_exp_pay_count",
]

FLAG_COLUMNS = [
    "flag_unparseable",
    "flag_stalled",
    "flag_incomplete",
    "flag_sanction_overrun",
    "flag_zero_disbursal",
    "flag_cost_overrun",
]
