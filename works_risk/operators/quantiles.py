"""Exact quantiles of whole columns without gathering the column."""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Once an interval holds at most this many rows, its values are read out.
READ_OUT_ROWS = 20_000
_ACCURACY = 10_000
_MARGIN = 3.0 / _ACCURACY


@dataclass
class _Target:
    """One order statistic: the ``rank``-th value (from 0) of a column lies strictly between ``low`` and ``high``.

    ``below`` rows are at or under ``low`` and ``inside`` rows lie between, until ``value`` is found.
    """

    column: str
    rank: int
    inside: int
    below: int = 0
    low: float = -math.inf
    high: float = math.inf
    value: float | None = None

    @property
    def open(self) -> bool:
        return self.value is None and self.inside > READ_OUT_ROWS

    def within(self) -> Column:
        v = F.col(self.column).cast("double")
        return F.when((v > self.low) & (v < self.high), v)


def exact_quantiles(df: DataFrame, wanted: Mapping[str, float]) -> dict[str, float | None]:
    """Linear-interpolated quantile of each column in ``wanted``; NULLs are left out. Values are finite.

    Every round puts two guesses around each wanted rank with a mergeable sketch and counts exactly the rows below and at
    them. A rank among the rows at a guess is found, however many rows tie there; else the open interval between the
    guesses goes on, which always holds fewer rows. A round reads the table twice and returns a few numbers, and at
    most ``READ_OUT_ROWS`` rows of a target are read out. ``df`` is read once per round, so settle costly inputs.
    """
    sizes = df.agg(*[F.count(c).alias(c) for c in wanted]).first()
    targets: dict[tuple[str, int], _Target] = {}
    parts = {}
    for c, share in wanted.items():
        if sizes[c]:
            at = (sizes[c] - 1) * share
            parts[c] = (math.floor(at), math.ceil(at), at - math.floor(at))
            for rank in parts[c][:2]:
                targets[c, rank] = _Target(c, rank, sizes[c])
    while still := [t for t in targets.values() if t.open]:
        _narrow(df, still)
    left = [t for t in targets.values() if t.value is None]
    for t, counted in zip(left, _read_out(df, left), strict=True):
        t.value = _kth(counted, t.rank - t.below)
    result: dict[str, float | None] = dict.fromkeys(wanted)
    for c, (low, high, part) in parts.items():
        a, b = targets[c, low].value, targets[c, high].value
        result[c] = a + (b - a) * part
    return result


def _narrow(df: DataFrame, targets: list[_Target]) -> None:
    """One round: find each target's value, or tighten its open interval."""
    sketches = []
    for k, t in enumerate(targets):
        at = (t.rank - t.below) / t.inside
        ends = [max(0.0, at - _MARGIN), min(1.0, at + 1 / t.inside + _MARGIN)]
        sketches.append(F.percentile_approx(t.within(), ends, _ACCURACY).alias(f"g{k}"))
    guess = df.agg(*sketches).first()
    counts = []
    for k, t in enumerate(targets):
        for end, g in zip("ab", guess[k], strict=True):
            v = F.col(t.column).cast("double")
            counts += [F.count_if(v < g).alias(f"under_{end}{k}"), F.count_if(v == g).alias(f"at_{end}{k}")]
    seen = df.agg(*counts).first()
    for k, t in enumerate(targets):
        for end, g in zip("ab", guess[k], strict=True):
            under, at = seen[f"under_{end}{k}"], seen[f"at_{end}{k}"]
            if under <= t.rank < under + at:
                t.value = g
            elif t.rank >= under + at and g > t.low:
                t.inside -= under + at - t.below
                t.low, t.below = g, under + at
            elif t.rank < under and g < t.high:
                t.inside = under - t.below
                t.high = g


def _read_out(df: DataFrame, targets: list[_Target]) -> list[list[tuple[float, int]]]:
    """Values and counts strictly inside each target's interval, ascending."""
    values: list[list[tuple[float, int]]] = [[] for _ in targets]
    if not targets:
        return values
    each = [F.struct(F.lit(k).alias("k"), t.within().alias("v")) for k, t in enumerate(targets)]
    long = df.select(F.explode(F.array(*each)).alias("e")).select("e.k", "e.v")
    counted = long.filter(F.col("v").isNotNull()).groupBy("k", "v").agg(F.count(F.lit(1)).alias("n"))
    for row in counted.toLocalIterator():
        values[row["k"]].append((row["v"], row["n"]))
    for pairs in values:
        pairs.sort()
    return values


def _kth(counted: list[tuple[float, int]], k: int) -> float:
    for value, n in counted:
        if k < n:
            return value
        k -= n
    raise ArithmeticError("rank outside the bracket")
