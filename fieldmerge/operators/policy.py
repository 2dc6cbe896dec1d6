"""Confidence and decisions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldmerge.config import POLICY, PolicyConfig
from fieldmerge.functions.geometry import rounded


def confidence(match: Column, iou: Column, extraction: Column, duplicate: Column | None = None, cfg: PolicyConfig = POLICY) -> Column:
    """Weighted sum within 0 and 1, rounded to 4; proxies stand for what was not measured; a duplicate source caps it."""
    total = (
        F.lit(cfg.w_match) * F.coalesce(match, F.lit(cfg.match_proxy)) + F.lit(cfg.w_iou) * F.coalesce(iou, F.lit(cfg.iou_proxy)) + F.lit(cfg.w_extraction) * F.coalesce(extraction, F.lit(cfg.extraction_proxy))
    )
    total = F.least(F.lit(1.0), F.greatest(F.lit(0.0), total))
    if duplicate is not None:
        total = F.when(duplicate, F.least(total, F.lit(cfg.duplicate_cap))).otherwise(total)
    return rounded(total, 4)


def decision(confidence: Column, drift: Column, duplicate: Column | None = None, cfg: PolicyConfig = POLICY) -> Column:
    conf, move = rounded(confidence, 4), rounded(drift, 4)
    same = F.lit(False) if duplicate is None else F.coalesce(duplicate, F.lit(False))
    return F.when(same | (move >= cfg.max_drift), "conflict").when(conf >= cfg.auto_min, "auto_reconciled").when(conf >= cfg.review_min, "review_required").otherwise("conflict")


def reason(confidence: Column, drift: Column, duplicate: Column | None = None, cfg: PolicyConfig = POLICY) -> Column:
    """A sentence that says which rule decided."""
    conf, move = rounded(confidence, 4), rounded(drift, 4)
    same = F.lit(False) if duplicate is None else F.coalesce(duplicate, F.lit(False))
    return (
        F.when(same, "duplicate source in cluster")
        .when(move >= cfg.max_drift, "centroid drift beyond tolerance")
        .when(conf >= cfg.auto_min, "high agreement")
        .when(conf >= cfg.review_min, "moderate agreement, verify")
        .otherwise("low confidence")
    )


def explain(confidence: Column, drift: Column, iou: Column, sources: Column, cfg: PolicyConfig = POLICY) -> dict[str, Column]:
    """Columns of the explanation: boundary, shift, sources, action, and the formula's terms."""
    return {
        "boundary_agreement": F.when(iou >= 0.85, "very high").when(iou >= 0.70, "moderate").otherwise("low"),
        "centroid_shift": F.when(drift < 1.0, "negligible").when(drift < cfg.max_drift, "acceptable").otherwise("exceeds tolerance"),
        "source_agreement": F.when(sources > 1, "sources agree").otherwise("single source"),
        "action": F.when((drift < cfg.max_drift) & (confidence >= cfg.auto_min), "register").when((drift < cfg.max_drift) & (confidence >= cfg.review_min), "desk review").otherwise("field validation"),
    }
