"""The floors that figures and predicates are held to, and what may override them."""

from __future__ import annotations

import math

# The defaults.
THRESHOLDS = {
    "minInstances": 5, "ownSupport": 0.6, "borrowedOperators": 3, "guardSupport": 0.4, "impliesSupport": 0.9, "maxGuardRules": 3, "unknownRateGate": 0.2, "reproposalDelta": 0.1,
    "maxCounterexamples": 20, "antecedentMaxLength": 3, "recommendAgreement": 0.8, "recommendGain": 0.05, "recommendNovelty": 0.5, "antecedentFloorExponent": 1,
    "minCalibration": 60, "minCalibrationPerLabel": 15, "minPredicatePrecision": 0.9, "minLabelSeparation": 0.2,
}


def with_thresholds(given: dict | None = None) -> dict:
    """The defaults with what is given in their place; unknown names and what is no finite number are refused."""
    for name, value in (given or {}).items():
        if name not in THRESHOLDS:
            raise ValueError(f"unknown threshold {name!r}")
        if isinstance(value, bool) or not isinstance(value, (int, float)) or not math.isfinite(value):
            raise ValueError(f"threshold {name!r} must be a finite number")
    return THRESHOLDS | (given or {})
