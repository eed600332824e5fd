"""One row per work out of the stage tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from works_risk.functions.cleaning import fiscal_year, mp_number, work_number
from works_risk.params import Params
from works_risk.operators.texts import KEY, TEXT, text_key
from works_risk.schema import MASTER
from works_risk.sources import extracts as X


def work_ids(stages: list[DataFrame], key: str = "work_id") -> DataFrame:
    """Distinct ids over all stages."""
    ids = [s.select(key) for s in stages]
    return reduce(DataFrame.unionByName, ids).filter(F.col(key).isNotNull()).distinct()


_PAID = ("exp_pay_count", "exp_total", "exp_inprogress", "exp_paid")
_TEXTS = ("state", "mp_name", "constituency", "work_desc")


def payments_by_vendor(expenditure: DataFrame, key: str, params: Params, names: tuple[str, ...] = ()) -> DataFrame:
    """Payments of each work and vendor. Two-step counting spreads a work with very many payments over its vendors.

    With ``names``, the first row's text fields come along as the struct ``expenditure``.
    """
    status = F.lower(F.coalesce("payment_status", F.lit("")))
    pending = status.contains("in-progress") & F.lit(params.split_payments)
    zero = F.lit(0).cast("decimal(18,2)")
    aggs = [
        F.count("paid_on").alias("exp_pay_count"),
        F.sum("amount").cast("decimal(18,2)").alias("exp_total"),
        F.sum(F.when(pending, F.col("amount")).otherwise(zero)).cast("decimal(18,2)").alias("exp_inprogress"),
        F.sum(F.when(pending, zero).otherwise(F.col("amount"))).cast("decimal(18,2)").alias("exp_paid"),
    ]
    if names:
        aggs.append(F.min_by(F.struct(*names, X.ORDINAL), X.ORDINAL).alias("expenditure"))
    return expenditure.groupBy(key, "vendor").agg(*aggs)


def _payment_totals() -> list[Column]:
    sums = [F.sum(c).alias(c) for c in _PAID]
    return [*sums, F.count("vendor").alias("exp_vendors")]


def payments(expenditure: DataFrame, key: str, params: Params) -> DataFrame:
    """Payments of each work: dated rows, totals and distinct vendors."""
    totals = payments_by_vendor(expenditure, key, params).groupBy(key).agg(*_payment_totals())
    return totals.withColumns({c: F.col(c).cast("decimal(18,2)") for c in _PAID[1:]})


def assemble(
    stages: dict[str, DataFrame], params: Params, key: str = "work_id", carried: tuple[str, ...] = ()
) -> DataFrame:
    """One row per key over all stages, by stacking the stages and grouping once.

    Stacking reads every stage once and shuffles once, after combining on the map side; a chain of joins would
    shuffle each stage and the key list. The first row of a key counts within a stage.

    Text fields come from the first stage that has them: recommended, sanctioned, completed, and with
    ``names_from_expenditure`` the payments. A disbursed amount of 0 counts as not known and falls back to the
    payment total. ``carried`` names further text fields to pass through.
    """
    stacked, aggs = [], []
    fields: dict[str, list[Column]] = {}

    def offer(role: str, cols: list[str]) -> None:
        for c in cols:
            fields.setdefault(c, []).append(F.col(f"{role}.{c}"))

    for role in ("recommended", "sanctioned", "completed"):
        if role in stages:
            rows = stages[role]
            cols = [c for c in rows.columns if c != key]
            stacked.append(rows.select(key, F.struct(*cols).alias(role)))
            ordered = X.ORDINAL in cols
            aggs.append((F.min_by(role, F.col(f"{role}.{X.ORDINAL}")) if ordered else F.any_value(role, True)).alias(role))
            offer(role, [c for c in cols if c != X.ORDINAL])
    if "expenditure" in stages:
        names = tuple(c for c in _TEXTS if c in stages["expenditure"].columns) if params.names_from_expenditure else ()
        rows = payments_by_vendor(stages["expenditure"], key, params, names)
        stacked.append(rows.withColumn("there", F.lit(True)))
        aggs += [*_payment_totals(), F.max("there").alias("there")]
        if names:
            aggs.append(F.min_by("expenditure", F.col(f"expenditure.{X.ORDINAL}")).alias("expenditure"))
            offer("expenditure", list(names))
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), stacked)
    grouped = whole.filter(F.col(key).isNotNull()).groupBy(key).agg(*aggs)

    def pick(name: str, kind: str) -> Column:
        return F.coalesce(*fields.get(name, []), F.lit(None).cast(kind))

    def text(name: str) -> Column:
        return F.coalesce(pick(name, "string"), F.lit("")).alias(name)

    def amount(c: Column, name: str) -> Column:
        return F.coalesce(c, F.lit(0)).cast("decimal(18,2)").alias(name)

    def there(role: str) -> Column:
        return F.col(role).isNotNull() if role in stages else F.lit(False)

    def paid(name: str) -> Column:
        return F.col(name) if "expenditure" in stages else F.lit(None)

    known = F.nullif(pick("amount", "decimal(18,2)"), F.lit(0).cast("decimal(18,2)"))
    return grouped.select(
        key,
        *[text(c) for c in (*_TEXTS, "work_title", "work_category", "work_status", *carried)],
        *[pick(c, "date").alias(c) for c in ("recommended_date", "sanction_date", "completion_date")],
        *[amount(pick(c, "decimal(18,2)"), c) for c in ("recommended_amount", "sanction_amount")],
        amount(F.coalesce(known, paid("exp_total")), "amount_disbursed"),
        *[amount(paid(c), c) for c in _PAID[1:]],
        *[F.coalesce(paid(c), F.lit(0)).cast("bigint").alias(c) for c in ("exp_pay_count", "exp_vendors")],
        *[there(role).alias(f"is_{role}") for role in ("recommended", "sanctioned", "completed")],
        (F.coalesce("there", F.lit(False)) if "expenditure" in stages else F.lit(False)).alias("has_expenditure"),
    )


def with_limits(works: DataFrame, roster: DataFrame | None, consent: DataFrame | None) -> DataFrame:
    """Limit and calamity consent by member name, 0 when the name is not listed.

    Spark broadcasts the lists when they are small, and otherwise joins by name with skew handling.
    """
    zero = F.lit(0).cast("decimal(18,2)")
    for table, col in ((roster, "alloc_limit"), (consent, "calamity_consent")):
        if table is None:
            works = works.withColumn(col, zero)
        else:
            works = works.join(table.select("mp_name", col), "mp_name", "left").withColumn(col, F.coalesce(col, zero))
    return works


def identified(works: DataFrame) -> DataFrame:
    """Member number, fiscal year and work number out of the id, in master layout."""
    wid = F.col("work_id")
    parsed = works.withColumns(
        {
            "mp_no": mp_number(wid),
            "fy": fiscal_year(wid),
            "work_no": work_number(wid),
            "mp_state": F.col("state"),
        }
    )
    extra = [c for c in ("work_title", "chamber") if c in parsed.columns]
    return parsed.select(*MASTER.fieldNames(), *extra)


def descriptions(raw: X.Extracts) -> DataFrame:
    """The descriptions of all raw rows, as ``work_desc``."""
    tables = [raw.get(role) for role in X.WORK_ROLES if raw.get(role) is not None]
    return reduce(DataFrame.unionByName, [rows.select(X.description(rows).alias(TEXT)) for rows in tables])


def master_from_extracts(raw: X.Extracts, params: Params, keyed: bool = False) -> DataFrame:
    """The master of one chamber from its raw extracts; ``keyed`` has ``text_id`` in the place of the description."""
    stages = {role: X.STAGES[role](raw.get(role), params) for role in X.WORK_ROLES if raw.get(role) is not None}
    if keyed:
        stages = {role: rows.withColumn(TEXT, text_key(F.col(TEXT))) for role, rows in stages.items()}
    works = assemble(stages, params)
    limits = raw.get("roster"), raw.get("consent")
    roster = None if limits[0] is None else X.roster(limits[0], params)
    consent = None if limits[1] is None else X.consent(limits[1], params)
    built = identified(with_limits(works, roster, consent).withColumn("chamber", F.lit(params.chamber)))
    return built.withColumnRenamed(TEXT, KEY) if keyed else built

