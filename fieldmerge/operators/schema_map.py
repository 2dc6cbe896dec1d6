"""Column names of layers matched with canonical fields."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldmerge.functions.geometry import rounded

# Abbreviations that are spelled out.
ABBREVIATIONS = {
    "no": "number",
    "num": "number",
    "nbr": "number",
    "cd": "code",
    "id": "identifier",
    "ident": "identifier",
    "dt": "date",
    "prop": "property",
    "prpty": "property",
    "surv": "survey",
    "sy": "survey",
    "parc": "parcel",
    "pcl": "parcel",
    "lat": "latitude",
    "lon": "longitude",
    "lng": "longitude",
    "long": "longitude",
    "geom": "geometry",
    "shp": "geometry",
    "sqm": "area",
    "sqft": "area",
    "sq_m": "area",
    "own": "owner",
    "ownr": "owner",
    "bld": "building",
    "bldg": "building",
    "src": "source",
    "cts": "cadastral",
    "ref": "reference",
}

# Canonical fields in order, with their synonyms.
FIELDS = {
    "parcel_id": (
        "parcel_id", "parcelid", "parcel_no", "parcel_number", "parcel_num", "pid", "cadastral_id", "cad_id", "khasra", "khasra_no", "khasra_number",
        "dag_no", "dag_number", "cts_no", "cts_number", "gis_id", "footprint_id", "canonical_uid", "bld_id", "building_id", "plot_id", "entity_uid",
    ),
    "survey_number": (
        "survey_no", "survey_number", "surveyno", "surveynumber", "sy_no", "sy_number", "survey_num", "revenue_survey_no", "rev_survey_no", "plot_no",
        "plot_number", "plotno", "survey", "sy_num", "revenue_no", "sub_division_no", "hissa_no",
    ),
    "property_id": (
        "property_id", "property_no", "property_number", "property_num", "prop_id", "prpty_id", "assessment_no", "assessment_number", "upin", "property_code",
        "holding_no", "holding_number", "khata_no", "khata_number", "door_no", "municipal_id", "tax_id", "folio_no", "gis_pid",
    ),
    "area": (
        "area", "area_sqm", "area_m2", "area_sq_m", "area_sq_meter", "parcel_area", "gis_area", "shape_area", "extent", "extent_sqm", "builtup_area",
        "land_area", "plot_area", "sqm", "carpet_area", "st_area",
    ),
    "geometry": (
        "geometry", "geom", "the_geom", "shape", "wkt", "coordinates", "polygon", "spatial_geom", "geo_shape", "footprint_geom",
    ),
    "latitude": (
        "latitude", "lat", "centroid_y", "y", "y_coord", "point_y", "lat_deg", "northing", "gps_lat", "center_lat",
    ),
    "longitude": (
        "longitude", "lon", "lng", "long", "centroid_x", "x", "x_coord", "point_x", "lon_deg", "easting", "gps_lon", "center_lng",
    ),
    "source": (
        "source", "dataset_source", "data_origin", "source_name", "provider", "layer_name", "agency", "department", "data_source", "origin", "captured_by",
    ),
    "date": (
        "date", "captured_date", "survey_date", "creation_date", "timestamp", "update_date", "upload_date", "valid_from", "effective_date", "as_of_date",
    ),
    "owner_reference": (
        "owner_name", "owner_reference", "proprietor", "holder_name", "applicant_name", "owner", "ownership_ref", "khatedar", "pattadar", "title_holder",
        "occupant_name",
    ),
    "survey_identifier": (
        "survey_no", "survey_number", "surveyno", "surveynumber", "sy_no", "survey_id", "surv_id", "survey_ident", "khasra", "khasra_no", "dag_no", "fmb_no",
    ),
    "property_identifier": (
        "property_id", "property_no", "property_number", "prop_id", "upin", "holding_no", "khata_no", "assessment_no", "gis_pid", "municipal_id",
    ),
    "owner_name": (
        "owner", "owner_name", "property_owner", "land_holder", "pattadar", "holder_name", "proprietor", "khatedar", "title_holder",
    ),
    "land_use": (
        "land_use", "landuse", "zoning", "use_type", "zone_classification", "use_category",
    ),
    "locality": (
        "locality", "neighborhood", "area_name", "village", "sector", "colony", "mohalla",
    ),
    "ward": (
        "ward", "ward_no", "ward_number", "ward_id", "ward_name", "municipal_ward",
    ),
    "zone": (
        "zone", "zone_name", "district", "revenue_district", "sub_district", "taluk",
    ),
    "source_record_id": (
        "source_record_id", "source_id", "original_id", "record_id", "raw_id", "external_id",
    ),
    "valid_from": (
        "valid_from", "effective_from", "start_date", "tenure_start", "registered_date",
    ),
    "valid_to": (
        "valid_to", "effective_to", "expiry_date", "superseded_date", "tenure_end",
    ),
    "version_id": (
        "version_id", "version", "revision_id", "rev_id", "dataset_version",
    ),
}
IDENTIFIERS = ("parcel_id", "survey_identifier", "survey_number", "property_identifier", "property_id")
SUGGESTED, CANDIDATE = 0.75, 0.40


def normalized(raw: Column) -> Column:
    """Words of a name, camel case and punctuation split, abbreviations spelled out, joined by underscores."""
    spaced = F.lower(F.regexp_replace(F.trim(raw), "([a-z0-9])([A-Z])", "$1 $2"))
    words = F.filter(F.split(F.regexp_replace(spaced, r"[^\w\s]", "_"), r"[_\s]+"), lambda w: w != "")
    table = F.create_map(*(F.lit(x) for pair in ABBREVIATIONS.items() for x in pair))
    return F.array_join(F.transform(words, lambda w: F.coalesce(F.element_at(table, w), w)), "_")


def dictionary(spark: SparkSession) -> DataFrame:
    """(field, dict_pos, synonyms): 21 rows."""
    return spark.createDataFrame([(f, i, list(s)) for i, (f, s) in enumerate(FIELDS.items())], "field string, dict_pos int, synonyms array<string>")


def _jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


@F.pandas_udf(T.DoubleType())
def _best_ratio(name: pd.Series, field: pd.Series, synonyms: pd.Series) -> pd.Series:
    best = lambda n, f, s: max(difflib.SequenceMatcher(None, n, x).ratio() for x in [f, *s])
    return pd.Series([best(n, f, list(s)) for n, f, s in zip(name, field, synonyms, strict=True)], dtype=float)


def field_similarity(columns: DataFrame, raw: str = "raw", fuzzy: bool = True) -> DataFrame:
    """Each distinct name against each field: raw, name, field, dict_pos, score, step.

    The dictionary has 21 rows and is broadcast. String comparison (fuzzy) runs only where no earlier step settles the pair.
    """
    spark = columns.sparkSession
    names = columns.select(F.col(raw).alias("raw")).distinct().withColumn("name", normalized(F.col("raw")))
    rows = names.join(F.broadcast(dictionary(spark)))
    low, plain = F.lower(F.trim("raw")), lambda c: F.regexp_replace(c, r"[^\w]", "")
    tokens = F.split("name", "_")
    overlap = F.array_max(F.transform(F.concat(F.array("field"), F.col("synonyms")), lambda s: _jaccard(tokens, F.split(s, "_"))))
    rows = rows.withColumns({"low": low, "jaccard": overlap})
    exact = (F.col("low") == F.col("field")) | (F.col("name") == F.col("field"))
    listed = F.array_contains("synonyms", F.col("low")) | F.array_contains("synonyms", F.col("name"))
    step = (
        F.when(exact, "exact").when(listed, "synonym").when(plain(F.col("low")) == plain(F.col("field")), "plain_exact")
        .when(F.exists("synonyms", lambda s: plain(F.col("low")) == plain(s)), "plain_synonym").when(F.col("jaccard") >= 0.70, "tokens").otherwise("later")
    )
    rows = rows.withColumn("step", step)
    settled = rows.where("step <> 'later'").withColumn("ratio", F.lit(0.0))
    later = rows.where("step = 'later'").withColumn("ratio", _best_ratio("name", "field", "synonyms") if fuzzy else F.lit(0.0))
    rows = settled.unionByName(later)
    score = (
        F.when(F.col("step") == "exact", 1.0).when(F.col("step") == "synonym", 0.95).when(F.col("step") == "plain_exact", 0.92).when(F.col("step") == "plain_synonym", 0.90)
        .when(F.col("step") == "tokens", rounded(0.75 + 0.15 * F.col("jaccard"), 3)).when(F.col("ratio") >= 0.75, rounded(0.85 * F.col("ratio"), 3))
        .when(F.col("jaccard") >= 0.40, rounded(0.40 + 0.20 * F.col("jaccard"), 3)).when(F.col("ratio") >= 0.55, rounded(0.70 * F.col("ratio"), 3)).otherwise(0.0)
    )
    return rows.select("raw", "name", "field", "dict_pos", score.alias("score"), "step")


def map_columns(columns: DataFrame, fuzzy: bool = True) -> DataFrame:
    """(dataset_id, pos, raw) with field, score and status; of several columns that claim a field the best keeps it."""
    similar = field_similarity(columns, fuzzy=fuzzy)
    best = Window.partitionBy("raw").orderBy(F.col("score").desc(), "dict_pos")
    top = similar.withColumn("r", F.row_number().over(best)).where("r = 1").select("raw", "field", "score")
    rows = columns.join(top, "raw")
    status = F.when(F.col("score") >= SUGGESTED, "suggested").when(F.col("score") >= CANDIDATE, "low_confidence").otherwise("unmapped")
    rows = rows.withColumns({"status": status, "field": F.when(F.col("score") >= CANDIDATE, F.col("field"))})
    claim = Window.partitionBy("dataset_id", "field").orderBy(F.col("score").desc(), "pos")
    rank = F.when(F.col("field").isNotNull(), F.row_number().over(claim))
    return rows.withColumn("status", F.when(rank > 1, "conflicting").otherwise(F.col("status"))).select("dataset_id", "pos", "raw", "field", "score", "status")


def confirmed(mapping: DataFrame, confirmations: DataFrame) -> DataFrame:
    """Saved decisions (dataset_id, raw, target or null) over suggestions: a target is confirmed with 1.0, a null rejects."""
    saved = confirmations.select("dataset_id", "raw", "target", F.lit(True).alias("saved"))
    rows = mapping.join(saved, ["dataset_id", "raw"], "left")
    told = F.col("saved").isNotNull()
    return rows.select(
        "dataset_id", "pos", "raw", F.when(told, F.col("target")).otherwise(F.col("field")).alias("field"), F.when(told, F.when(F.col("target").isNotNull(), 1.0).otherwise(0.0)).otherwise(F.col("score")).alias("score"),
        F.when(told, F.when(F.col("target").isNotNull(), "confirmed").otherwise("rejected")).otherwise(F.col("status")).alias("status"),
    )


def validate_mapping(mapping: DataFrame) -> DataFrame:
    """Per data set: whether an identifier and an area are mapped, counts, status."""
    used = mapping.where("status in ('suggested', 'confirmed', 'low_confidence')")
    found = mapping.select("dataset_id").distinct().join(used, "dataset_id", "left").groupBy("dataset_id").agg(
        F.coalesce(F.bool_or(F.col("field").isin(*IDENTIFIERS)), F.lit(False)).alias("has_identifier"), F.coalesce(F.bool_or(F.col("field") == "area"), F.lit(False)).alias("has_area"), F.countDistinct("field").alias("mapped_count")
    )
    return found.withColumn("status", F.when(F.col("has_identifier"), "VALIDATED").otherwise("NEEDS_REVIEW"))


def apply_mapping(properties: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Map column `properties` split into `mapped`, with keys renamed, and `_unmapped_attributes`."""
    table = F.create_map(*(F.lit(x) for pair in mapping.items() for x in pair))
    keys = list(mapping)
    entries = F.map_entries(F.map_filter("properties", lambda k, v: k.isin(*keys)))
    # of several keys with one target the last wins
    named = F.transform(entries, lambda e: F.struct(F.element_at(table, e["key"]).alias("key"), e["value"].alias("value")))
    unique = F.filter(named, lambda e, i: ~F.exists(F.slice(named, i + 2, F.greatest(F.size(named), F.lit(1))), lambda later: later["key"] == e["key"]))
    return properties.withColumns({"mapped": F.map_from_entries(unique), "_unmapped_attributes": F.map_filter("properties", lambda k, v: ~k.isin(*keys))})


def profile_columns(properties: DataFrame) -> DataFrame:
    """(key, filled, samples) of a map column `properties`: how many values are not blank, and the three least of them."""
    rows = properties.select(F.explode(F.map_entries("properties")).alias("e")).select("e.key", F.when(F.trim("e.value") != "", F.col("e.value")).alias("value"))
    counts = rows.groupBy("key", "value").agg(F.count(F.lit(1)).alias("n"))
    ranked = counts.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy(F.col("value").asc_nulls_last())))
    return ranked.groupBy("key").agg(F.sum(F.when(F.col("value").isNotNull(), F.col("n")).otherwise(0)).alias("filled"), F.sort_array(F.collect_list(F.when(F.col("r") <= 3, F.col("value")))).alias("samples"))
