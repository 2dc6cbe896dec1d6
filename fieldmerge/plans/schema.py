"""Queries over layers' column names, coordinate systems and packages of files."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from fieldmerge.functions import geometry as g
from fieldmerge.operators import crs, packages, schema_map
from fieldmerge.plans.matching import R
from fieldmerge.plans.register import query
from fieldmerge.sources.derived import COLUMNS, FILES, LAYERS, POINTS, derived, sql_text

COLUMNS_SQL, FILES_SQL, LAYERS_SQL, POINTS_SQL = map(sql_text, (COLUMNS, FILES, LAYERS, POINTS))


def columns(spark, sf_dir):
    return derived(spark, sf_dir, COLUMNS)


_MAP = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in schema_map.ABBREVIATIONS.items()) + "}"
_NORMAL = rf"array_to_string([coalesce({_MAP}[w], w) FOR w IN string_split_regex(regexp_replace(lower(regexp_replace(trim(raw), '([a-z0-9])([A-Z])', '\1 \2', 'g')), '[^\w\s]', '_', 'g'), '[_\s]+') IF w <> ''], '_')"
_FIELDS = "(VALUES " + ", ".join(f"('{f}', {i}, [{', '.join(repr(s) for s in syn)}])" for i, (f, syn) in enumerate(schema_map.FIELDS.items())) + ") d(field, dict_pos, synonyms)"
_SIMILAR = rf"""WITH c AS ({COLUMNS_SQL}), n AS (SELECT DISTINCT raw, lower(trim(raw)) AS low, {_NORMAL} AS name FROM c), x AS (SELECT * FROM n CROSS JOIN {_FIELDS}),
j AS (SELECT *, list_max([len(list_intersect(list_distinct(string_split(name, '_')), list_distinct(string_split(s, '_')))) / CAST(len(list_distinct(list_concat(string_split(name, '_'), string_split(s, '_')))) AS DOUBLE) FOR s IN list_concat([field], synonyms)]) AS jaccard,
 regexp_replace(low, '[^\w]', '', 'g') AS plain FROM x),
s AS (SELECT *, CASE WHEN low = field OR name = field THEN 1.0::DOUBLE WHEN list_contains(synonyms, low) OR list_contains(synonyms, name) THEN 0.95::DOUBLE WHEN plain = regexp_replace(field, '[^\w]', '', 'g') THEN 0.92::DOUBLE
 WHEN list_contains([regexp_replace(t, '[^\w]', '', 'g') FOR t IN synonyms], plain) THEN 0.9::DOUBLE WHEN jaccard >= 0.7::DOUBLE THEN {R('0.75::DOUBLE + 0.15::DOUBLE * jaccard', 3)} WHEN jaccard >= 0.4::DOUBLE THEN {R('0.4::DOUBLE + 0.2::DOUBLE * jaccard', 3)} ELSE 0.0::DOUBLE END AS score FROM j)"""
_MAPPED = _SIMILAR + """, t AS (SELECT raw, field, score FROM (SELECT *, row_number() OVER (PARTITION BY raw ORDER BY score DESC, dict_pos) AS r FROM s) WHERE r = 1),
m AS (SELECT c.dataset_id, c.pos, c.raw, CASE WHEN score >= 0.4::DOUBLE THEN field END AS field, score, CASE WHEN score >= 0.75::DOUBLE THEN 'suggested' WHEN score >= 0.4::DOUBLE THEN 'low_confidence' ELSE 'unmapped' END AS status FROM c JOIN t ON t.raw = c.raw),
f AS (SELECT dataset_id, pos, raw, field, score, CASE WHEN field IS NOT NULL AND row_number() OVER (PARTITION BY dataset_id, field ORDER BY score DESC, pos) > 1 THEN 'conflicting' ELSE status END AS status FROM m)"""


@query(f"WITH c AS ({COLUMNS_SQL}) SELECT raw, {_NORMAL} AS name, count(*) AS n FROM c GROUP BY 1, 2")
def normalize_field_name(spark, sf_dir):
    return columns(spark, sf_dir).groupBy("raw").agg(F.count(F.lit(1)).alias("n")).select("raw", schema_map.normalized(F.col("raw")).alias("name"), "n")


@query(_SIMILAR + " SELECT raw, field, score FROM s WHERE score > 0")
def field_similarity(spark, sf_dir):
    """Every step but string comparison, which map_columns_fuzzy has."""
    return schema_map.field_similarity(columns(spark, sf_dir), fuzzy=False).where("score > 0").select("raw", "field", "score")


@query(_MAPPED + " SELECT dataset_id, pos, raw, field, score, status FROM f")
def map_columns(spark, sf_dir):
    return schema_map.map_columns(columns(spark, sf_dir), fuzzy=False)


@query()
def map_columns_fuzzy(spark, sf_dir):
    return schema_map.map_columns(columns(spark, sf_dir))


@query(_MAPPED + " SELECT dataset_id, raw, field FROM f WHERE status = 'conflicting'")
def mapping_conflicts(spark, sf_dir):
    return schema_map.map_columns(columns(spark, sf_dir), fuzzy=False).where("status = 'conflicting'").select("dataset_id", "raw", "field")


@query(_MAPPED + " SELECT dataset_id, raw, CASE WHEN dataset_id % 5 = 0 AND pos = 0 THEN 'zone' WHEN dataset_id % 5 = 1 AND pos = 1 THEN NULL ELSE field END AS field, CASE WHEN dataset_id % 5 = 0 AND pos = 0 THEN 'confirmed' WHEN dataset_id % 5 = 1 AND pos = 1 THEN 'rejected' ELSE status END AS status FROM f")
def mapping_confirm_overlay(spark, sf_dir):
    cols = columns(spark, sf_dir)
    saved = cols.where("(dataset_id % 5 = 0 and pos = 0) or (dataset_id % 5 = 1 and pos = 1)").select("dataset_id", "raw", F.when(F.col("dataset_id") % 5 == 0, "zone").alias("target"))
    return schema_map.confirmed(schema_map.map_columns(cols, fuzzy=False), saved).select("dataset_id", "raw", "field", "status")


@query(
    _MAPPED
    + " , u AS (SELECT dataset_id, coalesce(bool_or(field IN ('parcel_id', 'survey_identifier', 'survey_number', 'property_identifier', 'property_id')) FILTER (status IN ('suggested', 'low_confidence')), false) AS has_identifier, coalesce(bool_or(field = 'area') FILTER (status IN ('suggested', 'low_confidence')), false) AS has_area, count(DISTINCT field) FILTER (status IN ('suggested', 'low_confidence')) AS mapped_count FROM f GROUP BY dataset_id) SELECT *, CASE WHEN has_identifier THEN 'VALIDATED' ELSE 'NEEDS_REVIEW' END AS status FROM u"
)
def validate_mapping(spark, sf_dir):
    return schema_map.validate_mapping(schema_map.map_columns(columns(spark, sf_dir), fuzzy=False))


@query(f"WITH c AS ({COLUMNS_SQL}), p AS (SELECT raw AS key, CAST(dataset_id AS VARCHAR) AS v FROM c) SELECT key, count(*) AS filled, array_to_string(list_slice(list_sort(list(DISTINCT v)), 1, 3), ',') AS samples FROM p GROUP BY key")
def profile_columns(spark, sf_dir):
    """Keys of open properties, how often each is filled, and three of its values at most."""
    rows = columns(spark, sf_dir).select(F.create_map(F.col("raw"), F.col("dataset_id").cast("string")).alias("properties"))
    return schema_map.profile_columns(rows).select("key", "filled", F.array_join("samples", ",").alias("samples"))


@query(f"WITH c AS ({COLUMNS_SQL}) SELECT dataset_id, pos, CASE raw WHEN 'SURVEY_NO' THEN 'survey_number' WHEN 'plotNo' THEN 'survey_number' WHEN 'pid' THEN 'parcel_id' END AS target, CASE WHEN raw IN ('SURVEY_NO', 'plotNo', 'pid') THEN 0 ELSE 1 END AS unmapped FROM c")
def apply_mapping(spark, sf_dir):
    rows = columns(spark, sf_dir).select("dataset_id", "pos", F.create_map(F.col("raw"), F.lit("x")).alias("properties"))
    found = schema_map.apply_mapping(rows, {"SURVEY_NO": "survey_number", "plotNo": "survey_number", "pid": "parcel_id"})
    return found.select("dataset_id", "pos", F.try_element_at(F.map_keys("mapped"), F.lit(1)).alias("target"), F.size("_unmapped_attributes").alias("unmapped"))


_ZONE = "least(60, greatest(1, CAST(floor((lon + 180) / 6) AS INTEGER) + 1))"


@query(f"SELECT k, CAST({_ZONE} AS INTEGER) AS zone, 'EPSG:' || CAST(CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END + {_ZONE} AS VARCHAR) AS epsg FROM ({POINTS_SQL})")
def utm_zone(spark, sf_dir):
    return derived(spark, sf_dir, POINTS).select("k", crs.utm_zone(F.col("lon")).alias("zone"), crs.utm_epsg(F.col("lon"), F.col("lat")).alias("epsg"))


def _krueger(lon: str, lat: str) -> tuple[str, str]:
    """Easting and northing as SQL, the series of crs.project()."""
    n, a_hat, alpha = crs.N, crs.A_HAT, crs.ALPHA
    d = lambda x: f"{x!r}::DOUBLE"
    e = 2 * math.sqrt(n) / (1 + n)
    phi, lam = f"radians({lat})", f"radians({lon} - ({_ZONE} * 6 - 183))"
    t = f"sinh(atanh(sin({phi})) - {d(e)} * atanh({d(e)} * sin({phi})))"
    xi, eta = f"atan2({t}, cos({lam}))", f"atanh(sin({lam}) / sqrt(1 + {t} * {t}))"
    east = f"500000.0::DOUBLE + 0.9996::DOUBLE * {d(a_hat)} * (eta + " + " + ".join(f"{d(alpha[j - 1])} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j in (1, 2, 3)) + ")"
    north = f"0.9996::DOUBLE * {d(a_hat)} * (xi + " + " + ".join(f"{d(alpha[j - 1])} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j in (1, 2, 3)) + ")"
    return f"SELECT *, {xi} AS xi, {eta} AS eta FROM ({POINTS_SQL})", f"{R(east, 3)} AS easting, {R(north, 3)} AS northing"


_XI, _EN = _krueger("lon", "lat")


@query(f"SELECT k, {_EN} FROM ({_XI})")
def project_utm(spark, sf_dir):
    rows = derived(spark, sf_dir, POINTS)
    p = crs.project(F.col("lon"), F.col("lat"))
    return rows.select("k", g.rounded(p["x"], 3).alias("easting"), g.rounded(p["y"], 3).alias("northing"))


@query(f"SELECT dataset_id, declared, CASE WHEN declared LIKE '%CRS84%' OR declared LIKE '%4326%' THEN 'EPSG:4326' WHEN regexp_matches(declared, '(?i)EPSG:?:?[0-9]+') THEN 'EPSG:' || regexp_extract(declared, '(?i)EPSG:?:?([0-9]+)', 1) ELSE declared END AS code, count(*) AS n FROM ({LAYERS_SQL}) GROUP BY 1, 2, 3")
def crs_from_metadata(spark, sf_dir):
    rows = derived(spark, sf_dir, LAYERS)
    return rows.groupBy("dataset_id", "declared").agg(F.count(F.lit(1)).alias("n")).withColumn("code", crs.declared_code(F.col("declared")))


_RANGE = f"WITH l AS ({LAYERS_SQL}), r AS (SELECT dataset_id, min(declared) AS declared, min(aoi) AS aoi, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, count(*) AS vertices FROM l GROUP BY dataset_id), g AS (SELECT *, min_x >= -180 AND max_x <= 180 AND min_y >= -90 AND max_y <= 90 AS is_geo FROM r)"


@query(_RANGE + " SELECT dataset_id, min_x, max_x, min_y, max_y, vertices, CASE WHEN is_geo THEN 'degrees' ELSE 'meters' END AS units FROM g")
def coord_range(spark, sf_dir):
    return crs.coord_range(derived(spark, sf_dir, LAYERS), "dataset_id").select("dataset_id", "min_x", "max_x", "min_y", "max_y", "vertices", "units")


_AOI = "CASE " + " ".join(f"WHEN lower(aoi) LIKE '%{k}%' THEN '{v}'" for k, v in crs.AOI.items()) + " END"
_DIAG = (
    _RANGE
    + f""", n AS (SELECT *, CASE WHEN declared LIKE '%CRS84%' OR declared LIKE '%4326%' THEN 'EPSG:4326' WHEN regexp_matches(declared, '(?i)EPSG:?:?[0-9]+') THEN 'EPSG:' || regexp_extract(declared, '(?i)EPSG:?:?([0-9]+)', 1) ELSE declared END AS code, {_AOI} AS aoi_crs FROM g),
k AS (SELECT *, code IN ({', '.join(repr(c) for c in crs.KNOWN)}) AS valid, code = 'EPSG:4326' AS decl_geo FROM n),
z AS (SELECT *, CASE WHEN valid AND decl_geo AND is_geo THEN 1 WHEN valid AND NOT decl_geo AND NOT is_geo THEN 2 WHEN valid AND NOT decl_geo AND is_geo THEN 3 WHEN declared IS NULL AND is_geo THEN 4 WHEN NOT is_geo THEN CASE WHEN aoi_crs IS NOT NULL THEN 5 ELSE 6 END
 WHEN declared IS NOT NULL AND NOT coalesce(valid, false) THEN 7 ELSE 8 END AS scenario FROM k)
SELECT dataset_id, CASE scenario WHEN 1 THEN code WHEN 2 THEN code WHEN 5 THEN aoi_crs WHEN 6 THEN 'EPSG:32643' WHEN 8 THEN 'LOCAL_GRID' ELSE 'EPSG:4326' END AS detected,
 CASE scenario WHEN 1 THEN 1.0::DOUBLE WHEN 2 THEN 1.0::DOUBLE WHEN 3 THEN 0.85::DOUBLE WHEN 4 THEN CASE WHEN min_x BETWEEN 68 AND 98 AND min_y BETWEEN 6 AND 38 THEN 0.95::DOUBLE ELSE 0.85::DOUBLE END WHEN 5 THEN 0.9::DOUBLE WHEN 6 THEN 0.65::DOUBLE WHEN 7 THEN 0.8::DOUBLE ELSE 0.2::DOUBLE END AS crs_confidence,
 scenario IN (3, 6, 7, 8) AS requires_confirmation FROM z"""
)


@query(_DIAG)
def crs_diagnose(spark, sf_dir):
    return crs.diagnose(derived(spark, sf_dir, LAYERS)).select("dataset_id", "detected", "crs_confidence", "requires_confirmation")


@query(f"WITH d AS ({_DIAG}) SELECT dataset_id, CASE WHEN dataset_id % 4 = 0 THEN 'EPSG:32644' ELSE detected END AS detected, CASE WHEN dataset_id % 4 = 0 THEN false ELSE requires_confirmation END AS requires_confirmation FROM d")
def crs_confirm(spark, sf_dir):
    """A reviewer's code where it is a known one: every fourth data set is confirmed, every fourth asks for an unknown code."""
    found = crs.diagnose(derived(spark, sf_dir, LAYERS)).select("dataset_id", "detected", "requires_confirmation")
    asked = found.where("dataset_id % 2 = 0").select("dataset_id", F.when(F.col("dataset_id") % 4 == 0, "EPSG:32644").otherwise("EPSG:1").alias("confirmed"))
    return crs.confirm(found, asked)


@query(f"WITH d AS ({_DIAG}) SELECT dataset_id, CASE WHEN dataset_id % 11 = 0 THEN 'Verified' WHEN detected LIKE 'EPSG:326%' OR detected IN ('EPSG:7760', 'EPSG:4326') THEN 'Validated' ELSE 'Needs Review' END AS status FROM d")
def georef_status(spark, sf_dir):
    found = crs.diagnose(derived(spark, sf_dir, LAYERS))
    return found.select("dataset_id", F.when(F.col("dataset_id") % 11 == 0, "Verified").when(F.col("detected").startswith("EPSG:326") | F.col("detected").isin("EPSG:7760", "EPSG:4326"), "Validated").otherwise("Needs Review").alias("status"))


def _classify_sql() -> str:
    arms = [f"WHEN contains(p, '{code.lower()}') OR {' OR '.join(f'''contains(p, '{k}')''' for k in keys)} THEN '{code}'" for code, keys in packages.CATEGORIES.items()]
    return "CASE " + " ".join(arms) + " WHEN p LIKE '%.tif' OR p LIKE '%.tiff' OR p LIKE '%.ecw' THEN '08_IMAGERY' WHEN p LIKE '%.las' OR p LIKE '%.dem' THEN '07_ELEVATION' WHEN p LIKE '%.csv' AND (contains(p, 'attr') OR contains(p, 'reg')) THEN '15_METADATA' ELSE '02_PARCELS' END"


@query(f"WITH f AS (SELECT *, lower(path) AS p FROM ({FILES_SQL})) SELECT package_id, {_classify_sql()} AS category, count(*) AS files, CAST(sum(features) AS BIGINT) AS features FROM f GROUP BY 1, 2")
def src_package_scan(spark, sf_dir):
    return packages.scan(derived(spark, sf_dir, FILES))


@query(f"SELECT package_id, count(DISTINCT crs) > 1 AS mixed_crs, {R('min(lon) - 0.001::DOUBLE', 6)} AS min_lon, {R('max(lon) + 0.001::DOUBLE', 6)} AS max_lon, {R('min(lat) - 0.001::DOUBLE', 6)} AS min_lat, {R('max(lat) + 0.001::DOUBLE', 6)} AS max_lat, {R('(min(lat) + max(lat)) / 2', 6)} AS center_lat, {R('(min(lon) + max(lon)) / 2', 6)} AS center_lon FROM ({FILES_SQL}) GROUP BY package_id")
def dataset_bbox_center(spark, sf_dir):
    """Extent of the centroids with a margin of 0.001 degrees, and its centre."""
    r6 = lambda c, n: g.rounded(c, 6).alias(n)
    w, e, s, n = F.min("lon"), F.max("lon"), F.min("lat"), F.max("lat")
    return derived(spark, sf_dir, FILES).groupBy("package_id").agg(
        (F.countDistinct("crs") > 1).alias("mixed_crs"), r6(w - 0.001, "min_lon"), r6(e + 0.001, "max_lon"), r6(s - 0.001, "min_lat"), r6(n + 0.001, "max_lat"), r6((s + n) / 2, "center_lat"), r6((w + e) / 2, "center_lon")
    )


_CITY = "CASE " + " ".join(f"WHEN lon BETWEEN {b[0]} AND {b[2]} AND lat BETWEEN {b[1]} AND {b[3]} THEN '{c}'" for c, b in packages.CITIES.items()) + " ELSE printf('Region (%.2fN, %.2fE)', floor(lat * 100 + 0.5) / 100, floor(lon * 100 + 0.5) / 100) END"


@query(f"SELECT k, {_CITY} AS city FROM ({POINTS_SQL})")
def city_detect(spark, sf_dir):
    return derived(spark, sf_dir, POINTS).select("k", packages.city(F.col("lon"), F.col("lat")).alias("city"))


_TURNED = f"SELECT k, CASE WHEN k % 17 = 0 THEN 512.0::DOUBLE WHEN k % 2 = 0 THEN lon ELSE lat END AS rx, CASE WHEN k % 19 = 0 THEN CAST('inf' AS DOUBLE) WHEN k % 2 = 0 THEN lat ELSE lon END AS ry FROM ({POINTS_SQL})"


@query(f"WITH t AS ({_TURNED}), n AS (SELECT k, rx BETWEEN 8 AND 38 AND ry BETWEEN 68 AND 98 AS swap, rx, ry FROM t), s AS (SELECT k, CASE WHEN swap THEN ry ELSE rx END AS x, CASE WHEN swap THEN rx ELSE ry END AS y FROM n), r AS (SELECT *, isinf(x) OR isinf(y) OR abs(x) > 180 OR abs(y) > 90 AS rejected FROM s) SELECT k, CASE WHEN NOT rejected THEN x END AS x, CASE WHEN NOT rejected THEN y END AS y, rejected FROM r")
def coords_normalize(spark, sf_dir):
    """Every second point has its axes swapped, which the known range swaps back; what is not finite or out of range is rejected."""
    k = F.col("k")
    x, y = F.when(k % 17 == 0, 512.0).when(k % 2 == 0, F.col("lon")).otherwise(F.col("lat")), F.when(k % 19 == 0, float("inf")).when(k % 2 == 0, F.col("lat")).otherwise(F.col("lon"))
    rows = derived(spark, sf_dir, POINTS).select("k", crs.swap_axes(F.array(F.struct(x.alias("x"), y.alias("y")))).alias("ring"))
    rows = rows.withColumn("rejected", crs.out_of_range(F.col("ring")))
    only = lambda c: F.when(~F.col("rejected"), F.element_at("ring", 1)[c]).alias(c)
    return rows.select("k", only("x"), only("y"), "rejected")
