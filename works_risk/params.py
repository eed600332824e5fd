"""Parameters of the detection job."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

# Thresholds, weights and points that decide the results.
STALL_BEFORE = dt.date(2025, 1, 1)
MIN_TEXT_CHARS = 10
OVERRUN_RATIO = "1.20"
DUPLICATE_COSINE = 0.80
CONTAMINATION = 0.05
FOREST_TREES = 200
FOREST_SAMPLE = 512
MIN_FEATURES = 5
EMBED_DIM = 384
EMBED_BATCH = 64

RISK_WEIGHTS = {
    "flag_stalled": 35,
    "flag_unparseable": 10,
    "flag_sanction_overrun": 15,
    "flag_zero_disbursal": 20,
    "has_duplicate_lead": 25,
    "is_anomaly": 20,
}

RANK_POINTS = {"stalled": 3, "dup_leads": 4, "anomalies": 2, "zero_disbursal": 2}

POSITIVE_RATIO = 0.80
HARD_RATIO = 0.45


@dataclass(frozen=True)
class Params:
    """One run's settings. ``ref_date`` is required by the features that count days to a reference day."""

    ref_date: dt.date | None = None
    stall_before: dt.date = STALL_BEFORE
    overrun_ratio: str = OVERRUN_RATIO
    duplicate_cosine: float = DUPLICATE_COSINE
    cross_year_only: bool = True
    amount_grain: int = 1000
    block_on_category: bool = False
    max_texts: int | None = None
    contamination: float = CONTAMINATION
    trees: int = FOREST_TREES
    tree_sample: int = FOREST_SAMPLE
    seed: int = 42
    min_features: int = MIN_FEATURES
    drop_unparseable: bool = False
    names_from_expenditure: bool = False
    split_payments: bool = True
    money_mode: str = "decimal"
    consent_mode: str = "last"
    chamber: str = "ls"
