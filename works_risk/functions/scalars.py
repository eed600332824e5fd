"""Small numeric and label expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def guarded_ratio(num: Column, den: Column, guard: Column | None = None) -> Column:
    """``num / den`` as DOUBLE, NULL unless the guard holds (default: the denominator is positive)."""
    ok = den > 0 if guard is None else guard
    return F.when(ok, num.cast("double") / den.cast("double"))


def clipped_score(c: Column, low: int = 0, high: int = 100) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high)).cast("int")


def amount_bucket(c: Column, grain: int) -> Column:
    """Amount rounded half-even to ``grain``; grain 0 keeps the exact amount. NULL counts as 0."""
    filled = F.coalesce(c.cast("decimal(18,2)"), F.lit(0).cast("decimal(18,2)"))
    return F.bround(filled / F.lit(grain), 0).cast("bigint") if grain else filled


def labels_of(cases: Mapping[str, Column]) -> Column:
    """Array of the labels whose condition holds, in the given order."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(label)) for label, cond in cases.items()]))


def joined_texts(sep: str, *parts: Column) -> Column:
    """Join the non-empty parts."""
    return F.concat_ws(sep, *[F.nullif(p, F.lit("")) for p in parts])


def float_text(c: Column) -> Column:
    """A two-place decimal written the way a float prints: 3100000.0, 12.5, 12.34."""
    return F.regexp_replace(c.cast("decimal(18,2)").cast("string"), "0$", "")


def truth(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def inverted_min_max(c: Column, low: float, high: float) -> Column:
    """0 for the highest value, 1 for the lowest."""
    return F.lit(1.0) - (c - F.lit(low)) / F.lit(high - low + 1e-9)
