"""Roll-ups per representative, ranking and job summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from works_risk.functions.scalars import guarded_ratio, truth
from works_risk.operators.ordering import ordinal, top_rows
from works_risk.params import RANK_POINTS

MP_KEYS = ["mp_no", "mp_name", "mp_state"]
_AMOUNTS = ["recommended_amount", "sanction_amount", "amount_disbursed", "exp_total", "alloc_limit"]


def _counted(name: str) -> Column:
    return F.count_if(truth(F.col(name)))


def with_amounts(flags: DataFrame) -> DataFrame:
    """Every amount column present, numeric and without NULLs."""

    def amount(name: str) -> Column:
        found = F.col(name).try_cast("decimal(18,2)") if name in flags.columns else F.lit(None).cast("decimal(18,2)")
        return F.coalesce(found, F.lit(0).cast("decimal(18,2)"))

    return flags.withColumns({name: amount(name) for name in _AMOUNTS})


def per_mp(flags: DataFrame) -> DataFrame:
    """One row per representative with counts, totals, spend share and risk points."""
    grouped = (
        with_amounts(flags)
        .dropna(subset=["mp_no"])
        .groupBy(*MP_KEYS)
        .agg(
            F.count("work_id").alias("works"),
            _counted("is_sanctioned").alias("sanctioned"),
            _counted("is_completed").alias("completed"),
            F.sum("recommended_amount").alias("recommended_total"),
            F.sum("sanction_amount").alias("sanctioned_total"),
            F.sum("amount_disbursed").alias("disbursed_total"),
            F.sum("exp_total").alias("spent_total"),
            F.max("alloc_limit").alias("alloc_limit"),
            _counted("flag_stalled").alias("stalled"),
            _counted("flag_zero_disbursal").alias("zero_disbursal"),
            _counted("has_duplicate_lead").alias("dup_leads"),
            _counted("is_anomaly").alias("anomalies"),
            F.avg("risk_score").alias("avg_risk_per_work"),
        )
    )
    points = sum((F.col(c) * w for c, w in RANK_POINTS.items()), F.lit(0).cast("bigint"))
    return grouped.withColumns(
        {
            "spend_pct_alloc": guarded_ratio(F.col("spent_total"), F.col("alloc_limit")) * 100,
            "cumulative_risk_points": points,
        }
    )


def rank_order() -> list[Column]:
    """Most points first; ties by member number, name and state."""
    return [F.desc("cumulative_risk_points"), *[F.asc_nulls_last(c) for c in MP_KEYS]]


def ranked(mps: DataFrame) -> DataFrame:
    return ordinal(mps, rank_order(), "risk_rank")


def offenders(mps: DataFrame, top: int = 20) -> DataFrame:
    return top_rows(mps, rank_order(), top)


def with_points(flags: DataFrame, mps: DataFrame) -> DataFrame:
    """Each work together with its representative's risk points."""
    f, m = flags.alias("f"), mps.select(*MP_KEYS, "cumulative_risk_points").alias("m")
    same = [F.col(f"f.{k}").eqNullSafe(F.col(f"m.{k}")) for k in MP_KEYS]
    return f.join(m, same, "left").select("f.*", "m.cumulative_risk_points")


def delays_per_mp(flags: DataFrame) -> DataFrame:
    """Mean days from recommendation to sanction and to completion, and overrun counts."""
    return flags.dropna(subset=["mp_no"]).groupBy(*MP_KEYS).agg(
        F.avg(F.datediff("sanction_date", "recommended_date")).alias("avg_days_to_sanction"),
        F.avg(F.datediff("completion_date", "sanction_date")).alias("avg_days_to_complete"),
        _counted("flag_cost_overrun").alias("cost_overruns"),
        _counted("flag_sanction_overrun").alias("sanction_overruns"),
    )


# Fixed value: the words that mark a rule in the reason text.
RULE_WORDS = "(?i)stalled|overrun|unparseable|zero disbursal"


def summary(flags: DataFrame) -> DataFrame:
    """One row of job totals. ``with_any_rule`` tests the reason text, ``with_any_flag`` the flag columns."""
    flagged = F.col("is_flagged")
    any_flag = (
        truth(F.col("flag_stalled"))
        | truth(F.col("flag_sanction_overrun"))
        | truth(F.col("flag_unparseable"))
        | truth(F.col("flag_zero_disbursal"))
        | truth(F.col("flag_cost_overrun"))
    )
    return flags.agg(
        F.count(F.lit(1)).alias("total_works"),
        F.count_if(flagged).alias("flagged"),
        F.count_if(flagged & F.col("reasons").rlike(RULE_WORDS)).alias("with_any_rule"),
        F.count_if(flagged & any_flag).alias("with_any_flag"),
        F.count_if(flagged & truth(F.col("has_duplicate_lead"))).alias("duplicate_leads"),
        _counted("is_anomaly").alias("anomalies"),
        _counted("flag_stalled").alias("stalled"),
        _counted("flag_zero_disbursal").alias("zero_disbursal"),
        _counted("flag_sanction_overrun").alias("sanction_overrun"),
        F.max("risk_score").cast("double").alias("highest_risk"),
    )


def pattern_counts(flags: DataFrame) -> DataFrame:
    return flags.groupBy("fraud_type").agg(F.count(F.lit(1)).alias("works"))


def load_summary(flags: DataFrame, source: str) -> DataFrame:
    return flags.agg(
        F.count(F.lit(1)).alias("works"),
        F.count_if(F.col("is_flagged")).alias("flagged"),
    ).withColumn("source", F.lit(source))


def roster_complete(roster: DataFrame, flags: DataFrame) -> DataFrame:
    """Every member of the roster with the number of works, zero for members without any."""
    works = flags.groupBy("mp_name").agg(
        F.count(F.lit(1)).alias("works"), F.count_if(F.col("is_flagged")).alias("flagged")
    )
    return roster.join(works, "mp_name", "left").fillna(0, subset=["works", "flagged"])
