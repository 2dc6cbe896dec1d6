"""Weights, thresholds and literal tables of the reconciliation rules."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class MatchConfig:
    """Two-step matching: overlap, distance and attributes."""

    radius_m: float = 15.0
    w_iou: float = 0.5
    w_centroid: float = 0.3
    w_attribute: float = 0.2
    min_score: float = 0.5
    strict_iou: float = 0.30

    def __post_init__(self):
        if abs(self.w_iou + self.w_centroid + self.w_attribute - 1) > 1e-9:
            raise ValueError("weights must sum to 1")


@dataclass(frozen=True)
class SignalConfig:
    """Eight-signal matching and its classes."""

    radius_m: float = 15.0
    w_iou: float = 0.30
    w_centroid: float = 0.25
    w_area: float = 0.12
    w_shape: float = 0.10
    w_perimeter: float = 0.08
    w_bbox: float = 0.05
    w_identifier: float = 0.05
    w_source: float = 0.05
    strong_score: float = 0.82
    strong_iou: float = 0.70
    strong_drift: float = 2.0
    possible_score: float = 0.60
    possible_drift: float = 5.0
    weak_score: float = 0.40
    weak_iou: float = 0.05

    def __post_init__(self):
        total = self.w_iou + self.w_centroid + self.w_area + self.w_shape + self.w_perimeter + self.w_bbox + self.w_identifier + self.w_source
        if abs(total - 1) > 1e-9:
            raise ValueError("weights must sum to 1")


@dataclass(frozen=True)
class PolicyConfig:
    """Confidence formula and decision thresholds."""

    w_match: float = 0.50
    w_iou: float = 0.35
    w_extraction: float = 0.15
    match_proxy: float = 0.3
    iou_proxy: float = 0.0
    extraction_proxy: float = 0.5
    duplicate_cap: float = 0.69
    auto_min: float = 0.85
    review_min: float = 0.70
    max_drift: float = 2.0


MATCH, SIGNALS, POLICY = MatchConfig(), SignalConfig(), PolicyConfig()

# The lifecycle of a conflict, state -> states that may follow.
TRANSITIONS = {
    "DETECTED": ("UNDER_REVIEW",),
    "UNDER_REVIEW": ("SURVEY_REQUIRED", "RESOLVED", "REJECTED"),
    "SURVEY_REQUIRED": ("SURVEY_RECEIVED", "UNDER_REVIEW"),
    "SURVEY_RECEIVED": ("RECONCILIATION_PENDING", "UNDER_REVIEW"),
    "RECONCILIATION_PENDING": ("RESOLVED", "UNDER_REVIEW"),
    "RESOLVED": ("APPROVED", "UNDER_REVIEW"),
    "APPROVED": ("REOPENED",),
    "REJECTED": ("REOPENED",),
    "REOPENED": ("UNDER_REVIEW",),
}
