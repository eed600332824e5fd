"""From the master to the flags table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from works_risk.functions.vectors import EmbedMany, counting_failures
from works_risk.operators.classify import add_pattern, add_route
from works_risk.operators.duplicates import duplicate_signals, no_signals, updated_signals
from works_risk.operators.features import build_features
from works_risk.operators.forest import outliers
from works_risk.operators.rules import add_reasons, add_risk, rule_flags
from works_risk.params import Params


def with_signals(master: DataFrame, dup_signals: DataFrame | None) -> DataFrame:
    """Attach duplicate signals by work id; without any, every work has none."""
    signals = no_signals(master) if dup_signals is None else dup_signals
    return master.join(signals, "work_id", "left").fillna(
        {"dup_partner_count": 0, "dup_partner_sim_max": 0.0, "dup_partner_cross_fy": 0, "has_duplicate_lead": False}
    )


def with_outliers(master: DataFrame, scores: DataFrame | None) -> DataFrame:
    if scores is None:
        return master.withColumns({"anomaly_score": F.lit(None).cast("double"), "is_anomaly": F.lit(False)})
    return master.join(scores, "work_id", "left").fillna(False, subset=["is_anomaly"])


def judged(signalled: DataFrame, params: Params) -> DataFrame:
    """Rules, reasons, risk, pattern and route of works that carry duplicate and outlier signals."""
    return add_route(add_pattern(add_risk(add_reasons(rule_flags(signalled, params), params))))


def detect(
    master: DataFrame, params: Params, dup_signals: DataFrame | None = None, with_forest: bool = True
) -> DataFrame:
    """The flags table. Sorting is left to the sink."""
    scores = outliers(build_features(master, params.ref_date), params) if with_forest else None
    return judged(with_outliers(with_signals(master, dup_signals), scores), params)


@dataclass(frozen=True)
class Earlier:
    """What an earlier run leaves to go on from: its master and its signals."""

    master: DataFrame
    signals: DataFrame


def live_signals(
    master: DataFrame,
    params: Params,
    embed_many: EmbedMany | None,
    earlier: Earlier | None = None,
    texts: DataFrame | None = None,
) -> tuple[DataFrame | None, str, DataFrame | None]:
    """Duplicate signals computed here, where they come from, and with ``earlier`` the works that were compared again.

    The source is ``none`` without an embedder, ``live``, or ``partial`` where the embedder failed on some texts, which then
    match nothing. Embedding runs here, so the count of failures is known. A master that carries ``text_id`` needs ``texts``.
    """
    if embed_many is None:
        return None, "none", None
    failed = master.sparkSession.sparkContext.accumulator(0)
    counted = counting_failures(embed_many, failed)
    again = None
    if earlier is None:
        signals = duplicate_signals(master, params, counted, texts)
    else:
        signals, again = updated_signals(master, earlier.master, earlier.signals, params, counted, texts)
    return signals, "partial" if failed.value else "live", again


def detect_live(
    master: DataFrame, params: Params, embed_many: EmbedMany | None, texts: DataFrame | None = None
) -> DataFrame:
    """As ``detect`` with duplicate signals computed here; ``dup_source`` records where they come from."""
    signals, source, _ = live_signals(master, params, embed_many, texts=texts)
    return detect(master, params, signals).withColumn("dup_source", F.lit(source))
