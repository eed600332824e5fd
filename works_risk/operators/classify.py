"""Suspected pattern of a flagged work, and the review route that belongs to it.

The output is a lead for a human reviewer. Route texts come from the fixed table only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from works_risk.functions.scalars import float_text, labels_of, truth

# Pattern names with their priority.
PRIORITY = {
    "duplicate_claim": 1,
    "siphoned_funds": 2,
    "ghost_work": 3,
    "over_invoicing": 4,
    "statistical_anomaly": 5,
}

# Which signals each pattern already explains.
EXPLAINED = {
    "duplicate_claim": ["duplicate_resubmission"],
    "siphoned_funds": ["stalled_no_funds", "stalled"],
    "ghost_work": ["stalled_no_funds", "stalled"],
    "over_invoicing": ["cost_overrun", "sanction_overrun"],
    "statistical_anomaly": ["anomaly"],
}

# Narrative wording.
NARRATIVE_DUPLICATE = (
    "Duplicate-claim candidate: a near-identical work description for the same MP and amount appears in a "
    "different financial year (cross-FY partner)."
)
NARRATIVE_STALLED = "Work was sanctioned (%s) but has not been completed and has %s."
STALLED_NO_FUNDS = "zero amount disbursed"
STALLED_ONLY = "no recorded completion"
NARRATIVE_OVERRUN = (
    "Amount paid or sanctioned exceeds the recommended/sanctioned baseline (cost or sanction overrun)."
)
NARRATIVE_OUTLIER = (
    "Statistical outlier on the engineered features (F1-F4) - unusual compared with other works."
)
NARRATIVE_NONE = "No detection signal."

# Review routes per pattern.
ROUTES = [
    (
        "duplicate_claim",
        [
            "Bharatiya Nyaya Sanhita (BNS) - cheating / dishonest misappropriation",
            "Indian Penal Code-era analogues to misappropriation provisions",
        ],
        "Controlling authority (scheme re-personnel) for verification before any referral",
        "Outright duplicate claims of public funds for the same work are unlawful; verification of both claims is "
        "required before citing any provision.",
        "internal - administrative recovery",
    ),
    (
        "ghost_work",
        [
            "BNS - criminal breach of trust",
            "Prevention of Corruption Act, 1988 - disproportionate assets / misappropriation not captured in accounts",
        ],
        "Enforcement agency only if records show funds drawn against non-existent work",
        "Work sanctioned and funded but never executed - if funds are routed out without execution, it engages "
        "breach-of-trust analysis under the relevant criminal code.",
        "enforcement - agency investigation",
    ),
    (
        "siphoned_funds",
        [
            "Prevention of Money Laundering Act (PMLA), 2002 - if proceeds routed through layered transactions",
            "Prevention of Corruption Act, 1988 - misappropriation / abuse of public office",
        ],
        "ED/FIU additionally if bank trails show layering",
        "Funds sanctioned, not disbursed to physical work, and possibly rerouted: PMLA analysis attaches only when "
        "financial trails indicate layering.",
        "enforcement - agency investigation",
    ),
    (
        "over_invoicing",
        [
            "BNS - cheating / forgery of records",
            "Prevention of Corruption Act, 1988 - criminal misconduct if a public servant is involved",
        ],
        "Audit trail (expenditure vs sanction) provided; confirm invoices against market rates before referral",
        "Inflated billing or sanction overrun is a predicate for cheating / forgery-of-records analysis, not proof "
        "by itself.",
        "internal - audit then enforcement",
    ),
    (
        "statistical_anomaly",
        [],
        "Operational review only - no legal route on its own",
        "A statistical outlier is a screening flag, not a legal finding. No statute applies until corroborating "
        "evidence links it to a concrete fraud type.",
        "internal - review only",
    ),
]
DEFAULT_ROUTE = "statistical_anomaly"

_ROUTE_SCHEMA = T.StructType(
    [
        T.StructField("fraud_type", T.StringType(), False),
        T.StructField("statutes", T.ArrayType(T.StringType(), False), False),
        T.StructField("refer_to", T.StringType(), False),
        T.StructField("note", T.StringType(), False),
        T.StructField("route", T.StringType(), False),
    ]
)


def signals() -> Column:
    stalled, unpaid = truth(F.col("flag_stalled")), truth(F.col("flag_zero_disbursal"))
    return labels_of(
        {
            "duplicate_resubmission": truth(F.col("has_duplicate_lead")),
            "stalled_no_funds": stalled & unpaid,
            "stalled": stalled & ~unpaid,
            "zero_disbursal": unpaid,
            "cost_overrun": truth(F.col("flag_cost_overrun")),
            "sanction_overrun": truth(F.col("flag_sanction_overrun")),
            "anomaly": truth(F.col("is_anomaly")),
        }
    )


def pattern() -> Column:
    """The highest-priority pattern that the flags support."""
    stalled = truth(F.col("flag_stalled"))
    overrun = truth(F.col("flag_cost_overrun")) | truth(F.col("flag_sanction_overrun"))
    return (
        F.when(truth(F.col("has_duplicate_lead")), "duplicate_claim")
        .when(stalled & truth(F.col("flag_zero_disbursal")), "siphoned_funds")
        .when(stalled, "ghost_work")
        .when(overrun, "over_invoicing")
        .otherwise("statistical_anomaly")
    )


def narrative(fraud_type: Column) -> Column:
    def stalled(why: str) -> Column:
        return F.format_string(NARRATIVE_STALLED, float_text(F.col("sanction_amount")), F.lit(why))

    return (
        F.when(fraud_type == "duplicate_claim", NARRATIVE_DUPLICATE)
        .when(fraud_type == "siphoned_funds", stalled(STALLED_NO_FUNDS))
        .when(fraud_type == "ghost_work", stalled(STALLED_ONLY))
        .when(fraud_type == "over_invoicing", NARRATIVE_OVERRUN)
        .otherwise(NARRATIVE_OUTLIER)
    )


def corroboration(signal_list: Column, fraud_type: Column) -> Column:
    """Signals that the pattern itself does not explain."""
    explained = F.lit(None).cast("array<string>")
    for name, covered in EXPLAINED.items():
        explained = F.when(fraud_type == name, F.array(*[F.lit(s) for s in covered])).otherwise(explained)
    return F.filter(signal_list, lambda s: ~F.array_contains(explained, s))


def add_pattern(flags: DataFrame) -> DataFrame:
    """Pattern, priority, signals and narrative of flagged works; the fixed blanks for the others."""
    priority = F.create_map(*[F.lit(x) for item in PRIORITY.items() for x in item])
    flagged = F.col("is_flagged")
    return flags.withColumn("_pattern", pattern()).select(
        *flags.columns,
        F.when(flagged, F.col("_pattern")).otherwise("").alias("fraud_type"),
        F.when(flagged, priority[F.col("_pattern")]).otherwise(0).alias("fraud_priority"),
        F.when(flagged, F.concat_ws(",", signals())).otherwise("[]").alias("fraud_signals"),
        F.when(flagged, narrative(F.col("_pattern"))).otherwise(NARRATIVE_NONE).alias("fraud_narrative"),
    )


def route_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ROUTES, _ROUTE_SCHEMA)


def missing_routes(flags: DataFrame) -> DataFrame:
    """Patterns in use that the route table lacks; must be empty."""
    used = flags.filter(F.col("fraud_type") != "").select("fraud_type").distinct()
    return used.join(route_table(flags.sparkSession), "fraud_type", "left_anti")


def with_route_details(flags: DataFrame) -> DataFrame:
    """Attach the whole route row; a blank or unknown pattern gets the default row."""
    table = route_table(flags.sparkSession).withColumnRenamed("fraud_type", "_route_key")
    known = F.col("fraud_type").isin(*PRIORITY)
    key = F.when(known, F.col("fraud_type")).otherwise(DEFAULT_ROUTE)
    # Five fixed rows, so broadcasting is safe at any scale.
    return flags.join(F.broadcast(table), key == F.col("_route_key"), "left").drop("_route_key")


def add_route(flags: DataFrame) -> DataFrame:
    detailed = with_route_details(flags).withColumnRenamed("route", "legal_route")
    return detailed.drop("statutes", "refer_to", "note")
