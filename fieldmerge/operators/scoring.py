"""Scores of candidate pairs as column expressions over suffixed columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldmerge.config import MATCH, SIGNALS, MatchConfig, SignalConfig
from fieldmerge.functions import geometry as g
from fieldmerge.functions.sequences import sequence_ratios
from fieldmerge.operators.spatial_join import after_join


def with_overlap(pairs: DataFrame) -> DataFrame:
    """Adds inter_area, iou and centroid_dist."""
    a, b = g.box(suffix="_a"), g.box(suffix="_b")
    pairs = pairs.withColumns({"inter_area": after_join(g.intersection_area(a, b)), "centroid_dist": after_join(g.centroid_distance(a, b))})
    return pairs.withColumn("iou", after_join(g.iou(a, b, F.col("inter_area"))))


def attribute_similarity(area_a: Column, area_b: Column, type_a: Column, type_b: Column) -> Column:
    area = g.ratio(area_a, area_b, 0.5)
    known = type_a.isNotNull() & type_b.isNotNull() & (type_a != "unknown") & (type_b != "unknown")
    return F.when(known, F.lit(0.75) * area + F.lit(0.25) * F.when(type_a == type_b, 1.0).otherwise(0.0)).otherwise(area)


def combined_score(pairs: DataFrame, cfg: MatchConfig = MATCH) -> DataFrame:
    """Adds attr_sim and score to pairs with overlap."""
    attr = attribute_similarity(F.col("area_m2_a"), F.col("area_m2_b"), F.col("building_type_a"), F.col("building_type_b"))
    near = F.lit(1.0) - F.least(F.col("centroid_dist") / F.lit(cfg.radius_m), F.lit(1.0))
    pairs = pairs.withColumn("attr_sim", after_join(attr))
    score = F.lit(cfg.w_iou) * F.col("iou") + F.lit(cfg.w_centroid) * near + F.lit(cfg.w_attribute) * F.col("attr_sim")
    return pairs.withColumn("score", after_join(score))


def match_edges(pairs: DataFrame, cfg: MatchConfig = MATCH) -> DataFrame:
    return pairs.where(F.col("score") >= cfg.min_score)


def normalize_identifier(raw: Column) -> Column:
    plain = F.regexp_replace(F.lower(raw), "[^a-z0-9]", "")
    return F.regexp_replace(plain, "^(syno|surveyno|survey|plotno|plot|sy)", "")


@F.pandas_udf(T.DoubleType())
def _sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """The ratio of each pair of texts; null where either is null."""
    known = (a.notna() & b.notna()).to_numpy()
    out = np.full(len(a), np.nan)
    out[known] = sequence_ratios(a[known].tolist(), b[known].tolist())
    return pd.Series(out).where(known, None)


def with_plain_identifier(obs: DataFrame, column: str) -> DataFrame:
    """Adds <column>_plain, the identifier without what its writers add: computed once an observation, not in each of its pairs."""
    return obs.withColumn(f"{column}_plain", after_join(normalize_identifier(F.col(column))))


def identifier_similarity(pairs: DataFrame, a: str, b: str, plain: tuple[str, str] | None = None) -> DataFrame:
    """Adds id_score and id_method. Only pairs that no rule settles reach the string comparison, a batch of rows at a time where they are.

    plain names the columns of with_plain_identifier(); without them the identifiers are normalised here.
    """
    if plain is None:
        plain = ("__na", "__nb")
        pairs = pairs.withColumns({n: after_join(normalize_identifier(F.col(c))) for n, c in zip(plain, (a, b), strict=True)})
        return identifier_similarity(pairs, a, b, plain).drop(*plain)
    pairs = pairs.withColumns({n: after_join(F.lower(F.trim(F.col(c)))) for n, c in (("__la", a), ("__lb", b))})
    ra, rb, na, nb = F.col("__la"), F.col("__lb"), *map(F.col, plain)
    missing = F.coalesce(F.col(a), F.lit("")).eqNullSafe("") | F.coalesce(F.col(b), F.lit("")).eqNullSafe("")
    method = (
        F.when(missing, "NEUTRAL_MISSING")
        .when(ra == rb, "EXACT_MATCH")
        .when((na != "") & (na == nb), "NORMALIZED_EQUIVALENT")
        .when((na != "") & (nb != "") & (F.contains(na, nb) | F.contains(nb, na)), "SUBSTRING_CONTAINMENT")
        .otherwise("FUZZY_STRING_SIMILARITY")
    )
    marked = pairs.withColumn("id_method", after_join(method))
    fuzzy = F.col("id_method") == "FUZZY_STRING_SIMILARITY"
    marked = marked.withColumns({"__ra": F.when(fuzzy, ra), "__rb": F.when(fuzzy, rb)})
    scored = marked.withColumn("__fuzzy", g.rounded(_sequence_ratio("__ra", "__rb") * 0.8, 4))
    fixed = F.when(F.col("id_method") == "NEUTRAL_MISSING", 0.5).when(F.col("id_method") == "EXACT_MATCH", 1.0).when(F.col("id_method") == "NORMALIZED_EQUIVALENT", 0.95).when(F.col("id_method") == "SUBSTRING_CONTAINMENT", 0.85)
    return scored.withColumn("id_score", F.coalesce(fixed, F.col("__fuzzy"))).drop("__la", "__lb", "__ra", "__rb", "__fuzzy")


def source_agreement(a: Column, b: Column) -> Column:
    known = (F.coalesce(a, F.lit("")) != "") & (F.coalesce(b, F.lit("")) != "")
    return F.when(known & (a != b), 1.0).when(~known, 0.7).otherwise(0.5)


def multi_signal(pairs: DataFrame, cfg: SignalConfig = SIGNALS) -> DataFrame:
    """Adds the eight signals, candidate_score and match_class to pairs with overlap."""
    a, b = g.box(suffix="_a"), g.box(suffix="_b")
    area_a, area_b, per_a, per_b = g.box_area(a), g.box_area(b), g.box_perimeter(a), g.box_perimeter(b)
    plain = ("survey_no_plain_a", "survey_no_plain_b")
    pairs = identifier_similarity(pairs, "survey_no_a", "survey_no_b", plain if set(plain) <= set(pairs.columns) else None)
    qa, qb = g.compactness(area_a, per_a), g.compactness(area_b, per_b)
    pairs = pairs.withColumns({
        "s_iou": F.col("iou"),
        "s_centroid": F.greatest(F.lit(0.0), F.lit(1.0) - F.least(F.col("centroid_dist") / F.lit(cfg.radius_m), F.lit(1.0))),
        "s_area": g.ratio(area_a, area_b, 0.0),
        "s_shape": g.ratio(qa, qb, 0.0),
        "s_perimeter": g.ratio(per_a, per_b, 0.0),
        "s_bbox": F.col("iou"),
        "s_source": source_agreement(F.col("source_a"), F.col("source_b")),
    })
    total = (
        F.lit(cfg.w_iou) * F.col("s_iou") + F.lit(cfg.w_centroid) * F.col("s_centroid") + F.lit(cfg.w_area) * F.col("s_area") + F.lit(cfg.w_shape) * F.col("s_shape")
        + F.lit(cfg.w_perimeter) * F.col("s_perimeter") + F.lit(cfg.w_bbox) * F.col("s_bbox") + F.lit(cfg.w_source) * F.col("s_source") + F.lit(cfg.w_identifier) * F.col("id_score")
    )
    pairs = pairs.withColumn("candidate_score", F.least(F.lit(1.0), F.greatest(F.lit(0.0), total)))
    return pairs.withColumn("match_class", match_class(F.col("candidate_score"), F.col("iou"), F.col("centroid_dist"), cfg))


def match_class(score: Column, iou: Column, drift: Column, cfg: SignalConfig = SIGNALS) -> Column:
    return (
        F.when((score >= cfg.strong_score) & (iou >= cfg.strong_iou) & (drift < cfg.strong_drift), "STRONG_MATCH")
        .when((score >= cfg.possible_score) & (drift < cfg.possible_drift), "POSSIBLE_MATCH")
        .when((score >= cfg.weak_score) & (iou > cfg.weak_iou), "WEAK_MATCH")
        .otherwise("NO_MATCH")
    )


def pair_features(pairs: DataFrame, extraction_quality: float = 0.85, keep: list[str] = ()) -> DataFrame:
    """id_a, id_b and twelve features of pairs with overlap, then the columns of pairs in keep; a missing box gives the sentinel row.

    extraction_quality stands where neither side has a measured one.
    """
    a, b = g.box(suffix="_a"), g.box(suffix="_b")
    # in steps, and apart from the join by an expression that Spark generates no code for: one method with all of it and the join is too
    # long for the JVM to compile, and would be interpreted
    gone = F.exists(F.array(a[0], b[0]), lambda side: side.isNull())
    pairs = pairs.withColumns({f"__{n}": after_join(c) for n, c in (("area_a", g.box_area(a)), ("area_b", g.box_area(b)), ("per_a", g.box_perimeter(a)), ("per_b", g.box_perimeter(b)), ("gone", gone))})
    area_a, area_b, per_a, per_b, gone = (F.col(f"__{n}") for n in ("area_a", "area_b", "per_a", "per_b", "gone"))
    differ = lambda p, q: F.when(F.greatest(p, q) > 0, F.abs(p - q) / F.greatest(p, q) * 100).otherwise(0.0)
    share = lambda whole: F.when(whole > 0, F.col("inter_area") / whole).otherwise(0.0)
    or_else = lambda x, y: F.when(gone, F.lit(y)).otherwise(x)
    steps = [
        {
            "f_iou": or_else(g.rounded(F.col("iou"), 4), 0.0),
            "f_drift": or_else(g.rounded(F.least(F.col("centroid_dist"), F.lit(1e9)), 3), 999.0),
        },
        {
            "f_area_diff_pct": or_else(g.rounded(differ(area_a, area_b), 2), 100.0),
            "f_perimeter_diff_pct": or_else(g.rounded(differ(per_a, per_b), 2), 100.0),
        },
        {
            "f_compactness_a": or_else(g.rounded(g.compactness(area_a, per_a), 4), 0.0),
            "f_compactness_b": or_else(g.rounded(g.compactness(area_b, per_b), 4), 0.0),
            "f_vertices_a": or_else(F.lit(g.BOX_POINTS), 0.0),
            "f_vertices_b": or_else(F.lit(g.BOX_POINTS), 0.0),
        },
        {
            "f_overlap_a": or_else(g.rounded(share(area_a), 4), 0.0),
            "f_overlap_b": or_else(g.rounded(share(area_b), 4), 0.0),
            "f_sources": F.when(F.col("source_a") != F.col("source_b"), 2.0).otherwise(1.0),
            "f_extraction": F.coalesce(F.greatest("extraction_confidence_a", "extraction_confidence_b"), F.lit(float(extraction_quality))),
        },
    ]
    for step in steps:
        pairs = pairs.withColumns({n: after_join(c) for n, c in step.items()})
    return pairs.select("id_a", "id_b", *(n for step in steps for n in step), *keep)
