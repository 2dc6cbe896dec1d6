"""Queries on the quality of layers, on ground truth, measures of shapes, and relations with infrastructure lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldmerge.functions import geometry as g
from fieldmerge.functions.session import stored
from fieldmerge.operators import crs, packages, quantiles, spatial_join
from fieldmerge.plans.matching import _ENTITIES, _MEMBERS, OBS_SQL, R, clusters_of, entities, observations
from fieldmerge.plans.register import query
from fieldmerge.sources.derived import DIRTY, FILES, POINTS, UPLOADS, derived, sql_text

DIRTY_SQL, FILES_SQL, POINTS_SQL, UPLOADS_SQL = map(sql_text, (DIRTY, FILES, POINTS, UPLOADS))


def dirty(spark, sf_dir) -> DataFrame:
    return derived(spark, sf_dir, DIRTY)


# What an upload may be.
EXTENSIONS, MAX_BYTES = (".geojson", ".json", ".zip", ".csv", ".tif", ".tiff"), 50 * 1024 * 1024
STANDARD_TYPES = ("Polygon", "MultiPolygon", "Point")

_REPORT = f"""WITH u AS (SELECT *, nullif(trim(parcel_id), '') AS pid, shape IN (0) AS good, try_cast(area AS DOUBLE) AS a, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy, coalesce(declared, 'EPSG:4326') AS code FROM ({UPLOADS_SQL})),
d AS (SELECT dataset_id, min(extension) AS extension, min(bytes) AS bytes, min(declared) AS declared, min(code) AS code, count(*) AS records, count(*) FILTER (good) AS valid_records, count(*) FILTER (NOT good) AS invalid_records,
 string_agg(DISTINCT CASE WHEN shape <> 3 AND shape <> 2 THEN geometry_type END, ',' ORDER BY CASE WHEN shape <> 3 AND shape <> 2 THEN geometry_type END) AS geometry_types, count(*) FILTER (shape IN (0, 1, 4) AND geometry_type = 'LineString') AS odd_types,
 count(*) FILTER (shape IN (1, 4)) AS invalid_geometries, count(*) FILTER (shape IN (2, 3)) AS empty_geometries, count(*) FILTER (good) - count(DISTINCT (x0, y0, x1, y1)) FILTER (good) AS duplicate_geometries, count(*) FILTER (shape = 3) AS missing_coordinates,
 count(*) FILTER (pid IS NULL) AS missing_ids, count(*) FILTER (good AND area IS NOT NULL AND (a IS NULL OR a <= 0)) AS invalid_numbers, count(*) FILTER (good AND code = 'EPSG:4326' AND (abs(cx) > 180 OR abs(cy) > 90)) AS out_of_bounds,
 count(pid) - count(DISTINCT pid) AS duplicate_ids, count(*) FILTER (shape = 1) AS self_crossing, count(*) FILTER (shape IN (0, 1, 4) AND geometry_type LIKE 'Multi%') AS multipart, avg(cx) FILTER (good) AS mx, avg(cy) FILTER (good) AS my FROM u GROUP BY dataset_id),
r AS (SELECT *, extension IN ('.geojson', '.json', '.zip', '.csv', '.tif', '.tiff') AS file_type_ok, bytes > 0 AND bytes <= 52428800 AS file_size_ok, declared IS NOT NULL AS crs_given, code <> 'EPSG:99999' AS crs_valid, CASE WHEN code = 'EPSG:4326' THEN 'degree' ELSE 'metre' END AS unit, code = 'EPSG:4326' AND coalesce(abs(mx) > 180 OR abs(my) > 90, false) AS crs_mismatch FROM d)"""


@query(
    _REPORT
    + """ SELECT dataset_id, file_type_ok, file_size_ok, crs_given, crs_valid, coalesce(geometry_types, '') AS geometry_types, invalid_geometries, empty_geometries, duplicate_geometries, missing_coordinates, missing_ids, invalid_numbers, out_of_bounds, unit, records, duplicate_ids,
 self_crossing, multipart, invalid_geometries AS invalid_topology, crs_mismatch, out_of_bounds AS coordinate_range, valid_records, invalid_records,
 CASE WHEN NOT (file_type_ok AND file_size_ok AND crs_valid) OR invalid_records * 2 > records THEN 'REJECTED' WHEN invalid_records > 0 OR crs_mismatch OR NOT crs_given OR odd_types > 0 OR duplicate_ids > 0 OR self_crossing > 0 THEN 'PASSED_WITH_WARNINGS' ELSE 'VALIDATED' END AS status FROM r"""
)
def validation_report(spark, sf_dir):
    """The twenty checks of an upload, one row per layer in one pass: file (1, 2), declared system (3, 4, 13, 19), geometries (5 to 9, 16 to 18), identifiers (10, 15), numbers (11), ranges (12, 20), schema (14: records).

    Rings are built from the boxes, and what is wrong with them is found by measuring them.
    """
    rows, b = derived(spark, sf_dir, UPLOADS), g.box()
    p = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    crossing = F.array(p(b[0], b[1]), p(b[2], b[3]), p(b[2], b[1]), p(b[0], b[3]), p(b[0], b[1]))
    flat = F.array(p(b[0], b[1]), p(b[2], b[1]), p(b[2], b[1]), p(b[0], b[1]))
    shape, none = F.col("shape"), F.array().cast("array<struct<x:double,y:double>>")
    ring = F.when(shape == 0, g.box_ring(b)).when(shape == 1, crossing).when(shape == 2, none).when(shape == 4, flat)
    rows = rows.select("*", ring.alias("ring"), F.when(F.trim("parcel_id") != "", F.trim("parcel_id")).alias("pid"), F.expr("try_cast(area AS double)").alias("a"), F.coalesce("declared", F.lit("EPSG:4326")).alias("code"))
    # stored, else every access to a point of a ring would make the ring anew
    rows = stored(rows, "upload_rings")
    missing = F.col("ring").isNull()
    empty = missing | (F.size("ring") == 0)
    rows = rows.withColumns({"missing": missing, "empty": empty, "crosses": ~empty & g.ring_crosses(F.col("ring")), "flat": ~empty & (g.ring_area(F.col("ring")) <= 0)})
    rows = rows.withColumn("good", ~(F.col("empty") | F.col("crosses") | F.col("flat")))
    middle = F.when(F.col("good"), g.ring_centroid(F.col("ring")))
    rows = rows.withColumns({"cx": middle["x"], "cy": middle["y"]})
    n = lambda c: F.count(F.when(c, 1))
    good, degrees, kind = F.col("good"), F.col("code") == "EPSG:4326", F.col("geometry_type")
    beyond = good & degrees & ((F.abs("cx") > 180) | (F.abs("cy") > 90))
    found = rows.groupBy("dataset_id").agg(
        F.min("extension").isin(*EXTENSIONS).alias("file_type_ok"), F.min("bytes").between(1, MAX_BYTES).alias("file_size_ok"), F.min("declared").isNotNull().alias("crs_given"), F.min("code").isin(*crs.KNOWN).alias("crs_valid"),
        F.array_join(F.array_sort(F.collect_set(F.when(~F.col("empty"), kind))), ",").alias("geometry_types"), n(~F.col("empty") & ~kind.isin(*STANDARD_TYPES)).alias("odd_types"),
        n(~F.col("empty") & ~good).alias("invalid_geometries"), n(F.col("empty")).alias("empty_geometries"), (n(good) - F.count_distinct(F.when(good, F.struct("x0", "y0", "x1", "y1")))).alias("duplicate_geometries"),
        n(F.col("missing")).alias("missing_coordinates"), n(F.col("pid").isNull()).alias("missing_ids"), n(good & F.col("area").isNotNull() & (F.col("a").isNull() | F.isnan("a") | (F.col("a") <= 0) | (F.col("a") == float("inf")))).alias("invalid_numbers"),
        n(beyond).alias("out_of_bounds"), F.when(F.min("code") == "EPSG:4326", "degree").otherwise("metre").alias("unit"), F.count(F.lit(1)).alias("records"), (F.count("pid") - F.count_distinct("pid")).alias("duplicate_ids"),
        n(F.col("crosses")).alias("self_crossing"), n(~F.col("empty") & kind.startswith("Multi")).alias("multipart"), ((F.min("code") == "EPSG:4326") & F.coalesce((F.abs(F.avg("cx")) > 180) | (F.abs(F.avg("cy")) > 90), F.lit(False))).alias("crs_mismatch"),
        n(good).alias("valid_records"), n(~good).alias("invalid_records"),
    )
    refused = ~(F.col("file_type_ok") & F.col("file_size_ok") & F.col("crs_valid")) | (F.col("invalid_records") * 2 > F.col("records"))
    warned = (F.col("invalid_records") > 0) | F.col("crs_mismatch") | ~F.col("crs_given") | (F.col("odd_types") > 0) | (F.col("duplicate_ids") > 0) | (F.col("self_crossing") > 0)
    found = found.withColumns({"invalid_topology": F.col("invalid_geometries"), "coordinate_range": F.col("out_of_bounds"), "status": F.when(refused, "REJECTED").when(warned, "PASSED_WITH_WARNINGS").otherwise("VALIDATED")})
    return found.drop("odd_types")


@query(f"SELECT dataset_id, id, count(*) AS n FROM ({DIRTY_SQL}) WHERE id IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_ids(spark, sf_dir):
    return dirty(spark, sf_dir).where("id is not null").groupBy("dataset_id", "id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query(f"SELECT dataset_id, count(*) - count(DISTINCT (x0, y0, x1, y1)) AS duplicates FROM ({DIRTY_SQL}) GROUP BY 1")
def duplicate_geometries(spark, sf_dir):
    same = dirty(spark, sf_dir).groupBy("dataset_id", "x0", "y0", "x1", "y1").agg(F.count(F.lit(1)).alias("n"))
    return same.groupBy("dataset_id").agg((F.sum("n") - F.count(F.lit(1))).alias("duplicates"))


@query(f"SELECT dataset_id, k, source FROM ({DIRTY_SQL}) WHERE area_m2 <= 0")
def invalid_numeric(spark, sf_dir):
    area = F.col("area_m2")
    return dirty(spark, sf_dir).where(area.isNull() | F.isnan(area) | (area <= 0) | (area == float("inf"))).select("dataset_id", "k", "source")


@query(f"SELECT dataset_id, count(*) AS n FROM ({DIRTY_SQL}) WHERE id IS NULL GROUP BY 1")
def missing_ids(spark, sf_dir):
    return dirty(spark, sf_dir).where("id is null").groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT DISTINCT source, x0, y0, x1, y1 FROM ({DIRTY_SQL})")
def dedupe_exact_geometry(spark, sf_dir):
    return dirty(spark, sf_dir).select("source", "x0", "y0", "x1", "y1").dropDuplicates()


def _raw_rings(spark, sf_dir) -> DataFrame:
    """Dirty boxes as rings as they come in: every third is not closed, every fifth repeats a point, every seventh has a spike that grows it by a tenth."""
    rows, b = dirty(spark, sf_dir), g.box()
    p = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    k = F.col("k")
    far = b[2] + (b[2] - b[0]) / 5
    points = F.concat(
        F.array(p(b[0], b[1]), p(b[2], b[1])), F.when(k % 5 == 0, F.array(p(b[2], b[1]))).otherwise(F.array().cast("array<struct<x:double,y:double>>")),
        F.when(k % 7 == 0, F.array(p(far, (b[1] + b[3]) / 2))).otherwise(F.array().cast("array<struct<x:double,y:double>>")), F.array(p(b[2], b[3]), p(b[0], b[3])),
        F.when(k % 3 != 0, F.array(p(b[0], b[1]))).otherwise(F.array().cast("array<struct<x:double,y:double>>")),
    )
    # rings are made once and stored, else every access to a point of one would make it anew
    rows = stored(rows.withColumn("raw", points), "raw_rings")
    return stored(rows.withColumn("ring", g.repaired_ring(F.col("raw"))), "rings")


@query(f"SELECT id, source, {R('(x1 - x0) * (y1 - y0) * (CASE WHEN k % 7 = 0 THEN 1.1::DOUBLE ELSE 1.0::DOUBLE END)', 6)} AS area_m2, k % 3 = 0 OR k % 5 = 0 AS repaired, {R('CASE WHEN k % 7 = 0 THEN ((x0 + x1) / 2 + 0.1::DOUBLE * (x1 + (x1 - x0) / 15)) / 1.1::DOUBLE ELSE (x0 + x1) / 2 END', 6)} AS cx, {R('(y0 + y1) / 2', 6)} AS cy, CAST(NULL AS DOUBLE) AS extraction_confidence FROM ({DIRTY_SQL}) WHERE x1 > x0 AND y1 > y0")
def normalize_layer(spark, sf_dir):
    """Required columns checked, rings repaired, empty shapes dropped, area and centre computed anew from the repaired ring, a confidence to be filled."""
    rows = _raw_rings(spark, sf_dir)
    missing = {"id", "source", "x0", "y0", "x1", "y1", "area_m2"} - set(rows.columns)
    if missing:
        raise ValueError(f"missing columns: {sorted(missing)}")
    rows = rows.withColumns({"area": g.ring_area(F.col("ring")), "c": g.ring_centroid(F.col("ring"))}).where("size(ring) >= 4 and area > 0")
    changed = F.to_json("raw") != F.to_json("ring")
    return rows.select("id", "source", g.rounded(F.col("area"), 6).alias("area_m2"), changed.alias("repaired"), g.rounded(F.col("c.x"), 6).alias("cx"), g.rounded(F.col("c.y"), 6).alias("cy"), F.lit(None).cast("double").alias("extraction_confidence"))


@query(f"SELECT k, source, CASE WHEN x0 IS NULL THEN 'null geometry' WHEN x1 <= x0 OR y1 <= y0 THEN 'zero area' ELSE 'valid' END AS reason FROM ({DIRTY_SQL})")
def validity_audit(spark, sf_dir):
    """Rings built from the boxes and audited: missing, too few points, no area, edges that cross."""
    rows = stored(dirty(spark, sf_dir).select("k", "source", "x0", g.box_ring(g.box()).alias("ring")), "rings")
    rows = rows.withColumns({"area": g.ring_area(F.col("ring")), "crosses": g.ring_crosses(F.col("ring"))})
    reason = F.when(F.col("x0").isNull(), "null geometry").when(F.size("ring") < 4, "empty geometry").when(F.col("area") <= 0, "zero area").when(F.col("crosses"), "self intersection").otherwise("valid")
    return rows.select("k", "source", reason.alias("reason"))


@query(
    f"""WITH r AS (SELECT k, source, concat_ws('+', CASE WHEN k % 3 = 0 AND x1 > x0 THEN 'closed' END, CASE WHEN k % 5 = 0 OR x1 <= x0 THEN 'deduplicated' END) AS method, area_m2 AS area_before, (x1 - x0) * (y1 - y0) * (CASE WHEN k % 7 = 0 THEN 1.1::DOUBLE ELSE 1.0::DOUBLE END) AS area_after FROM ({DIRTY_SQL}))
SELECT k, source, CASE WHEN method = '' THEN 'none' ELSE method END AS method, area_before, {R('area_after', 6)} AS area_after, CASE WHEN area_after <= 0 THEN 'rejected' WHEN abs(area_before - area_after) / area_after * 100 <= 5 THEN 'accepted' ELSE 'quarantined' END AS outcome FROM r"""
)
def repair_guard(spark, sf_dir):
    """Rings closed and rid of repeated points: which it was, the areas declared and repaired, and whether they are within 5 %."""
    rows = _raw_rings(spark, sf_dir).withColumn("after", g.ring_area(F.col("ring")))
    first, last = F.get("raw", F.lit(0)), F.element_at("raw", -1)
    was_open = (first["x"] != last["x"]) | (first["y"] != last["y"])
    repeated = F.size("raw") + was_open.cast("int") > F.size("ring")
    method = F.concat_ws("+", F.when(was_open, "closed"), F.when(repeated, "deduplicated"))
    change = F.abs(F.col("area_m2") - F.col("after")) / F.col("after") * 100
    outcome = F.when(F.col("after") <= 0, "rejected").when(change <= 5, "accepted").otherwise("quarantined")
    return rows.select("k", "source", F.when(method == "", "none").otherwise(method).alias("method"), F.col("area_m2").alias("area_before"), g.rounded(F.col("after"), 6).alias("area_after"), outcome.alias("outcome"))


@query(f"SELECT id, {R('(x1 - x0) * (y1 - y0)', 6)} AS area, {R('2 * ((x1 - x0) + (y1 - y0))', 6)} AS perimeter, {R('(x0 + x1) / 2', 6)} AS cx, {R('(y0 + y1) / 2', 6)} AS cy, 5 AS vertices FROM ({OBS_SQL})")
def geom_measures(spark, sf_dir):
    """Area, perimeter, centroid and vertices from rings, by higher-order functions."""
    rows = observations(spark, sf_dir).select("id", g.box_ring(g.box()).alias("ring"))
    rows = rows.withColumn("c", g.ring_centroid(F.col("ring")))
    r6 = lambda c: g.rounded(c, 6)
    return rows.select("id", r6(g.ring_area(F.col("ring"))).alias("area"), r6(g.ring_length(F.col("ring"))).alias("perimeter"), r6(F.col("c.x")).alias("cx"), r6(F.col("c.y")).alias("cy"), F.size("ring").alias("vertices"))


@query(f"SELECT id, {R('least(1.0::DOUBLE, 12.566370614359172::DOUBLE * ((x1 - x0) * (y1 - y0)) / ((2.0::DOUBLE * ((x1 - x0) + (y1 - y0))) * (2.0::DOUBLE * ((x1 - x0) + (y1 - y0)))))', 6)} AS q FROM ({OBS_SQL})")
def compactness(spark, sf_dir):
    b = g.box()
    return observations(spark, sf_dir).select("id", g.rounded(g.compactness(g.box_area(b), g.box_perimeter(b)), 6).alias("q"))


@query()
def polygon_overlap(spark, sf_dir):
    """Overlap of general polygons: each registry box against its survey box turned by 45 degrees, in Arrow batches."""
    obs = observations(spark, sf_dir)
    a = obs.where("source = 'registry'").select("k", g.box_ring(g.box()).alias("ring_a"))
    mid = lambda p, q: (F.col(p) + F.col(q)) / 2
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    cx, cy = mid("x0", "x1"), mid("y0", "y1")
    diamond = F.array(point(F.col("x0"), cy), point(cx, F.col("y0")), point(F.col("x1"), cy), point(cx, F.col("y1")), point(F.col("x0"), cy))
    b = obs.where("source = 'survey'").select("id", "k", diamond.alias("ring_b"))
    return a.join(b, "k").select("id", "k", g.rounded(g.ring_overlap("ring_a", "ring_b"), 6).alias("overlap"))


@query(f"SELECT id, {R('0.25 * ((x0 + x1) / 2) + 1000', 6)} AS x, {R('2000 - 0.25 * ((y0 + y1) / 2)', 6)} AS y FROM ({OBS_SQL}) WHERE source = 'imagery'")
def pixel_to_geo(spark, sf_dir):
    """Six-parameter affine map of pixel centres."""
    rows = observations(spark, sf_dir).where("source = 'imagery'")
    px, py = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    return rows.select("id", g.rounded(F.lit(0.25) * px + F.lit(0.0) * py + 1000, 6).alias("x"), g.rounded(F.lit(2000) - F.lit(0.25) * py, 6).alias("y"))


@query()
def metric_distance(spark, sf_dir):
    """Metres between each point and the one of the next key, projected in the zone of the first."""
    rows = derived(spark, sf_dir, POINTS)
    other = rows.select((F.col("k") - 1).alias("k"), F.col("lon").alias("lon2"), F.col("lat").alias("lat2"))
    zone = crs.utm_zone(F.col("lon"))
    pairs = rows.join(other, "k").select("k", crs.project(F.col("lon"), F.col("lat"), zone).alias("p"), crs.project(F.col("lon2"), F.col("lat2"), zone).alias("q"))
    dx, dy = F.col("p.x") - F.col("q.x"), F.col("p.y") - F.col("q.y")
    return pairs.select("k", F.sqrt(dx * dx + dy * dy).alias("metres"))


@query(f"SELECT k, lon BETWEEN 77.40 AND 77.80 AND lat BETWEEN 12.80 AND 13.20 AS inside FROM ({POINTS_SQL})")
def city_bounds_warn(spark, sf_dir):
    w, s, e, n = packages.CITIES["Bengaluru"]
    return derived(spark, sf_dir, POINTS).select("k", (F.col("lon").between(w, e) & F.col("lat").between(s, n)).alias("inside"))


_CHECKPOINTS = f"WITH o AS ({OBS_SQL}), e AS (SELECT * FROM o WHERE source = 'survey'), p AS (SELECT k, (x0 + x1) / 2 + CAST(k % 7 AS DOUBLE) / 10 AS px, (y0 + y1) / 2 AS py FROM o WHERE source = 'registry'), j AS (SELECT e.id, e.k, px, py, x0, y0, x1, y1, sqrt(((x0 + x1) / 2 - px) * ((x0 + x1) / 2 - px) + ((y0 + y1) / 2 - py) * ((y0 + y1) / 2 - py)) AS dc, CASE WHEN px BETWEEN x0 AND x1 AND py BETWEEN y0 AND y1 THEN least(px - x0, x1 - px, py - y0, y1 - py) ELSE sqrt(greatest(x0 - px, 0, px - x1) * greatest(x0 - px, 0, px - x1) + greatest(y0 - py, 0, py - y1) * greatest(y0 - py, 0, py - y1)) END AS db FROM p JOIN e ON e.k = p.k)"


@query(_CHECKPOINTS + f" SELECT id, k, {R('least(dc, db)', 6)} AS distance, least(dc, db) <= 2 AS within_2m FROM j")
def checkpoint_join(spark, sf_dir):
    """Survey checkpoints against their entity: the lesser of the distances to its outline and its centre."""
    obs = observations(spark, sf_dir)
    points = obs.where("source = 'registry'").select("k", ((F.col("x0") + F.col("x1")) / 2 + (F.col("k") % 7).cast("double") / 10).alias("px"), ((F.col("y0") + F.col("y1")) / 2).alias("py"))
    rows = obs.where("source = 'survey'").join(points, "k")
    x, y, b = F.col("px"), F.col("py"), g.box()
    cx, cy = (b[0] + b[2]) / 2 - x, (b[1] + b[3]) / 2 - y
    d = F.least(F.sqrt(cx * cx + cy * cy), g.point_to_box_boundary(x, y, b))
    return rows.select("id", "k", g.rounded(d, 6).alias("distance"), (d <= 2).alias("within_2m"))


_REFERENCE = f"WITH o AS ({OBS_SQL}), j AS (SELECT e.id, e.k, greatest(0.0::DOUBLE, least(e.x1, r.x1) - greatest(e.x0, r.x0)) * greatest(0.0::DOUBLE, least(e.y1, r.y1) - greatest(e.y0, r.y0)) AS i, (e.x1 - e.x0) * (e.y1 - e.y0) AS a, (r.x1 - r.x0) * (r.y1 - r.y0) AS b, sqrt(((e.x0 + e.x1) / 2 - (r.x0 + r.x1) / 2) * ((e.x0 + e.x1) / 2 - (r.x0 + r.x1) / 2) + ((e.y0 + e.y1) / 2 - (r.y0 + r.y1) / 2) * ((e.y0 + e.y1) / 2 - (r.y0 + r.y1) / 2)) AS d FROM o e JOIN o r ON e.k = r.k AND e.source = 'survey' AND r.source = 'registry'), q AS (SELECT id, k, i / (a + b - i) AS iou, d FROM j)"


def against_reference(spark, sf_dir) -> DataFrame:
    obs = observations(spark, sf_dir)
    side = lambda df, s: df.select(F.col("id").alias(f"id_{s}"), "k", *(F.col(c).alias(f"{c}_{s}") for c in ("x0", "y0", "x1", "y1")))
    rows = side(obs.where("source = 'survey'"), "a").join(side(obs.where("source = 'registry'"), "b"), "k")
    a, b = g.box(suffix="_a"), g.box(suffix="_b")
    return rows.select(F.col("id_a").alias("id"), "k", g.iou(a, b).alias("iou"), g.centroid_distance(a, b).alias("d"))


@query(_REFERENCE + f" SELECT id, k, {R('iou', 6)} AS iou, {R('d', 6)} AS drift FROM q")
def gt_reference_join(spark, sf_dir):
    return against_reference(spark, sf_dir).select("id", "k", g.rounded(F.col("iou"), 6).alias("iou"), g.rounded(F.col("d"), 6).alias("drift"))


@query(_REFERENCE + f" SELECT {R('avg(iou)', 6)} AS mean_iou, {R('median(iou)', 6)} AS median_iou, {R('avg(d)', 6)} AS mean_drift, {R('median(d)', 6)} AS median_drift, {R('100.0::DOUBLE * count(*) FILTER (d <= 2) / count(*)', 4)} AS within_2m_pct, {R('100.0::DOUBLE * count(*) FILTER (iou >= 0.85 AND d < 2) / count(*)', 4)} AS good_pct FROM q")
def ground_truth_report(spark, sf_dir):
    """Means, exact medians and shares of all matched entities; no task holds them all."""
    n = lambda c: g.rounded(F.lit(100.0) * F.count(F.when(c, 1)) / F.count(F.lit(1)), 4)
    iou, d = F.col("iou"), F.col("d")
    rows = stored(against_reference(spark, sf_dir).select("iou", "d"), "against-reference")
    found = rows.agg(g.rounded(F.avg(iou), 6).alias("mean_iou"), g.rounded(F.avg(d), 6).alias("mean_drift"), n(d <= 2).alias("within_2m_pct"), n((iou >= 0.85) & (d < 2)).alias("good_pct"))
    middle = quantiles.at_ranks(rows, [], quantiles.medians("iou", "i1", "i2") | quantiles.medians("d", "d1", "d2"))
    told = middle.select(g.rounded(quantiles.median("i1", "i2"), 6).alias("median_iou"), g.rounded(quantiles.median("d1", "d2"), 6).alias("median_drift"))
    return found.join(F.broadcast(told))  # one row each


#: A line along each row of 400 keys, typed by row: y = 30 row + 12. Drainage and water are bands 6 m high. Ten rows are a city;
#: power lines are so far apart, and run so far beside their row, that many parcels have none within reach, and some cities none at all.
_LINES = f"""SELECT line_id, line_id * 30.0::DOUBLE + CASE WHEN type = 'electricity' THEN 162 ELSE 12 END AS y, type, CASE WHEN type IN ('drainage', 'water') THEN 6.0::DOUBLE ELSE 0.0::DOUBLE END AS h, CAST(FLOOR(CAST(line_id AS DOUBLE) / 10) AS BIGINT) AS city,
 'agency-' || CAST(line_id % 3 AS VARCHAR) AS agency FROM (
 SELECT line_id, CASE WHEN line_id % 16 = 3 THEN 'electricity' ELSE CASE line_id % 4 WHEN 0 THEN 'road' WHEN 1 THEN 'drainage' WHEN 2 THEN 'railway' ELSE 'water' END END AS type
 FROM (SELECT DISTINCT CAST(FLOOR(CAST(k AS DOUBLE) / 400) AS BIGINT) AS line_id FROM ({OBS_SQL})))"""
_INFRA = f"""WITH l AS ({_LINES}), p AS (SELECT id, k, x0, y0, x1, y1, CAST(FLOOR(CAST(k AS DOUBLE) / 4000) AS BIGINT) AS city FROM ({OBS_SQL}) WHERE source = 'registry'),
i AS (SELECT p.id, p.city, x0, y0, x1, y1, l.line_id, l.type, l.h, l.y <= y1 AND l.y + l.h >= y0 AS meets, greatest(0.0::DOUBLE, y0 - (l.y + l.h), l.y - y1) AS d, x1 - greatest(x0, 0) AS w, least(y1, l.y + l.h) - greatest(y0, l.y) AS v
 FROM p JOIN l ON l.city = p.city AND l.line_id BETWEEN CAST(FLOOR(p.y0 / 30) AS BIGINT) - 10 AND CAST(FLOOR(p.y0 / 30) AS BIGINT) + 10 WHERE p.y0 - 111 <= l.y + l.h AND p.y1 + 111 >= l.y),
j AS (SELECT *, CASE WHEN meets AND h > 0 THEN w * v ELSE 0.0::DOUBLE END AS area, CASE WHEN NOT meets THEN 0.0::DOUBLE WHEN h > 0 THEN 2 * (w + v) ELSE w END AS len FROM i)"""


def lines(spark, sf_dir) -> DataFrame:
    row = F.floor(F.col("k") / 400)
    rows = observations(spark, sf_dir).select(row.cast("long").alias("line_id")).distinct()
    kind = F.when(F.col("line_id") % 16 == 3, "electricity").otherwise(F.element_at(F.array(*map(F.lit, ("road", "drainage", "railway", "water"))), (F.col("line_id") % 4 + 1).cast("int")))
    rows = rows.withColumn("type", kind)
    return rows.select(
        "line_id", (F.col("line_id") * 30.0 + F.when(F.col("type") == "electricity", 162).otherwise(12)).alias("y"), "type", F.when(F.col("type").isin("drainage", "water"), 6.0).otherwise(0.0).alias("h"), F.floor(F.col("line_id") / 10).alias("city"),
        F.concat(F.lit("agency-"), (F.col("line_id") % 3).cast("string")).alias("agency"),
    )


def parcels(spark, sf_dir) -> DataFrame:
    return observations(spark, sf_dir).where("source = 'registry'").select("id", "k", "x0", "y0", "x1", "y1", F.floor(F.col("k") / 4000).alias("city"))


def infra_pairs(spark, sf_dir) -> DataFrame:
    """Registry parcels and the lines of their city within 111 m, with distance and the length and area within the parcel.

    The lines run along x and are long, so both sides meet on strips of y within the city.
    """
    strip, r = 120.0, 111.0
    low, high = F.col("y"), F.col("y") + F.col("h")
    left = parcels(spark, sf_dir).withColumn("s", F.explode(F.sequence(F.floor((F.col("y0") - r) / strip), F.floor((F.col("y1") + r) / strip))))
    right = lines(spark, sf_dir).withColumn("s", F.explode(F.sequence(F.floor(low / strip), F.floor(high / strip))))
    pairs = left.join(right, ["city", "s"]).where((F.col("y0") - r <= high) & (F.col("y1") + r >= low))
    # a band that lies in two strips meets a parcel in the lower one that both have
    pairs = pairs.where(F.col("s") == F.greatest(F.floor((F.col("y0") - r) / strip), F.floor(low / strip)))
    meets = (low <= F.col("y1")) & (high >= F.col("y0"))
    w, v, band = F.col("x1") - F.greatest(F.col("x0"), F.lit(0.0)), F.least(F.col("y1"), high) - F.greatest(F.col("y0"), low), F.col("h") > 0
    d = F.greatest(F.lit(0.0), F.col("y0") - high, low - F.col("y1"))
    return pairs.select(
        "id", "line_id", "type", "city", d.alias("d"), meets.alias("meets"), F.when(meets & band, w * v).otherwise(0.0).alias("area"), F.when(~meets, 0.0).when(band, 2 * (w + v)).otherwise(w).alias("len"), "h",
        ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).alias("parcel_area"), (2 * ((F.col("x1") - F.col("x0")) + (F.col("y1") - F.col("y0")))).alias("parcel_perimeter"),
    )


@query(_INFRA + " SELECT id, line_id, type, city FROM j")
def infra_candidate_join(spark, sf_dir):
    """By type and city."""
    return infra_pairs(spark, sf_dir).select("id", "line_id", "type", "city")


@query(
    _INFRA
    + f""" SELECT id, line_id, CASE WHEN meets AND type IN ('water', 'electricity', 'public_utility') THEN 'Utility Intersection' WHEN meets AND area > 0 THEN 'Infrastructure Overlap' WHEN meets THEN 'Spatial Intersection Detected' WHEN d < 25 THEN 'Proximity Detected' ELSE 'No Intersection Detected' END AS relation,
 {R('len', 2)} AS length_m, {R('area', 2)} AS area_m2, {R('CASE WHEN h > 0 THEN area / ((x1 - x0) * (y1 - y0)) * 100 ELSE len / (2 * ((x1 - x0) + (y1 - y0))) * 100 END', 2)} AS pct, {R('d', 2)} AS distance_m FROM j"""
)
def infra_intersection(spark, sf_dir):
    """Length and share of the outline for lines, area and share of the parcel for bands, distance where they do not meet."""
    rows = infra_pairs(spark, sf_dir)
    meets, area = F.col("meets"), F.col("area")
    relation = (
        F.when(meets & F.col("type").isin("water", "electricity", "public_utility"), "Utility Intersection").when(meets & (area > 0), "Infrastructure Overlap")
        .when(meets, "Spatial Intersection Detected").when(F.col("d") < 25, "Proximity Detected").otherwise("No Intersection Detected")
    )
    pct = F.when(F.col("h") > 0, area / F.col("parcel_area") * 100).otherwise(F.col("len") / F.col("parcel_perimeter") * 100)
    return rows.select("id", "line_id", relation.alias("relation"), g.rounded(F.col("len"), 2).alias("length_m"), g.rounded(area, 2).alias("area_m2"), g.rounded(pct, 2).alias("pct"), g.rounded(F.col("d"), 2).alias("distance_m"))


@query(_INFRA + f" SELECT id, type, line_id, {R('d', 6)} AS distance_m FROM (SELECT *, row_number() OVER (PARTITION BY id, type ORDER BY d, line_id) AS r FROM j) WHERE r = 1")
def infra_nearest(spark, sf_dir):
    """The nearest line of each type within reach."""
    rows = infra_pairs(spark, sf_dir)
    best = rows.groupBy("id", "type").agg(F.min(F.struct("d", "line_id")).alias("b"))
    return best.select("id", "type", F.col("b.line_id").alias("line_id"), g.rounded(F.col("b.d"), 6).alias("distance_m"))


@query(
    _INFRA
    + """, t AS (SELECT DISTINCT type FROM l), a AS (SELECT DISTINCT city, type FROM l), n AS (SELECT id, type, bool_or(meets) AS met, bool_or(d < 25) AS near FROM j GROUP BY id, type)
 SELECT t.type, count(*) FILTER (n.met) AS detected, count(*) FILTER (n.near) AS near, count(*) FILTER (a.type IS NOT NULL AND NOT coalesce(n.met, false)) AS not_detected, count(*) FILTER (a.type IS NULL) AS unavailable
 FROM p CROSS JOIN t LEFT JOIN a ON a.city = p.city AND a.type = t.type LEFT JOIN n ON n.id = p.id AND n.type = t.type GROUP BY t.type"""
)
def infra_summary(spark, sf_dir):
    """Parcels for which a type was detected, near, looked for in vain, or has no data in their city."""
    met = infra_pairs(spark, sf_dir).groupBy("type", "id").agg(F.bool_or("meets").alias("met"), F.bool_or(F.col("d") < 25).alias("near")).groupBy("type").agg(F.count(F.when(F.col("met"), 1)).alias("detected"), F.count(F.when(F.col("near"), 1)).alias("near"))
    cities = parcels(spark, sf_dir).groupBy("city").agg(F.count(F.lit(1)).alias("n"))
    total = cities.agg(F.sum("n").alias("total"))
    served = lines(spark, sf_dir).select("city", "type").distinct().join(cities, "city").groupBy("type").agg(F.sum("n").alias("served"))
    rows = served.join(met, "type", "left").join(F.broadcast(total))
    detected = F.coalesce("detected", F.lit(0))
    return rows.select("type", detected.alias("detected"), F.coalesce("near", F.lit(0)).alias("near"), (F.col("served") - detected).alias("not_detected"), (F.col("total") - F.col("served")).alias("unavailable"))


@query(f"WITH l AS ({_LINES}) SELECT line_id, {R('sqrt(25000000.0::DOUBLE + (line_id % 7) * (line_id % 7)) + sqrt(49000000.0::DOUBLE + (line_id % 7) * (line_id % 7))', 6)} AS length_m FROM l")
def infra_length(spark, sf_dir):
    """Lines of three points, the middle one off by up to six metres."""
    point = lambda x, off: F.struct(F.lit(float(x)).alias("x"), (F.col("y") + off).alias("y"))
    none = F.lit(0).cast("long")
    return lines(spark, sf_dir).select("line_id", g.rounded(g.ring_length(F.array(point(0, none), point(5000, F.col("line_id") % 7), point(12000, none))), 6).alias("length_m"))


@query(f"WITH l AS ({_LINES}), t(type) AS (VALUES ('road'), ('drainage'), ('railway'), ('electricity'), ('water'), ('public_utility')) SELECT t.type, count(l.line_id) AS features, count(l.line_id) > 0 AS available, count(DISTINCT l.agency) AS sources, count(DISTINCT l.city) AS cities FROM t LEFT JOIN l USING (type) GROUP BY t.type")
def layer_catalog(spark, sf_dir):
    """All six types, also those without a feature."""
    types = spark.createDataFrame([(t,) for t in packages.INFRA_TYPES], "type string")
    found = lines(spark, sf_dir).groupBy("type").agg(F.count(F.lit(1)).alias("features"), F.count_distinct("agency").alias("sources"), F.count_distinct("city").alias("cities"))
    rows = types.join(found, "type", "left").na.fill(0)
    return rows.select("type", "features", (F.col("features") > 0).alias("available"), "sources", "cities")


@query(f"WITH l AS ({_LINES}) SELECT line_id, type FROM l WHERE lower('LINE-' || CAST(line_id AS VARCHAR)) IN ('line-0', 'line-2')")
def infra_lookup(spark, sf_dir):
    name = F.lower(F.concat(F.lit("LINE-"), F.col("line_id").cast("string")))
    return lines(spark, sf_dir).where(name.isin("line-0", "line-2")).select("line_id", "type")


@query()
def parcel_line_distance(spark, sf_dir):
    """Distance of rings and lines by segments, in Arrow batches, for the nearest line of each parcel."""
    near = infra_pairs(spark, sf_dir).groupBy("id").agg(F.min(F.struct("d", "line_id")).alias("b")).select("id", F.col("b.line_id").alias("line_id"))
    rows = near.join(observations(spark, sf_dir).select("id", g.box_ring(g.box()).alias("ring")), "id").join(lines(spark, sf_dir), "line_id")
    point = lambda x: F.struct(F.lit(float(x)).alias("x"), F.col("y").alias("y"))
    return rows.select("id", "line_id", g.ring_line_distance("ring", F.array(point(0), point(12000))).alias("distance_m"))


@query(f"WITH f AS (SELECT *, lower(string_split(path, '/')[-1]) AS n FROM ({FILES_SQL})) SELECT file_no, CASE file_no % 4 WHEN 0 THEN 'VERIFIED' WHEN 1 THEN 'REFERENCE_ONLY' ELSE 'UNVERIFIED' END AS verification_status, CASE WHEN file_no % 5 = 0 THEN 'chennai' WHEN file_no % 5 = 1 THEN 'bengaluru' END AS city_hint, CASE WHEN contains(n, 'road') THEN 'road' WHEN contains(n, 'drain') OR contains(n, 'canal') THEN 'drainage' WHEN contains(n, 'metro') OR contains(n, 'rail') THEN 'railway' WHEN contains(n, 'water') THEN 'water' WHEN contains(n, 'easement') THEN 'public_utility' END AS type FROM f")
def src_infra_layers(spark, sf_dir):
    """Type by file name, the status a file declares where it is a known one, and the city that its folder names."""
    rows = derived(spark, sf_dir, FILES)
    n = F.col("file_no")
    declared = F.when(n % 4 == 0, "verified").when(n % 4 == 1, "Reference_Only").when(n % 4 == 2, "checked by eye")
    folder = F.when(n % 5 == 0, "CHENNAI_DATA/").when(n % 5 == 1, "data/BLR_Domlur/").otherwise("upload/")
    rows = rows.select("file_no", F.concat(folder, "path").alias("path"), F.upper(declared).alias("declared"))
    known = F.when(F.col("declared").isin("VERIFIED", "UNVERIFIED", "REFERENCE_ONLY"), F.col("declared")).otherwise("UNVERIFIED")
    return rows.select("file_no", packages.infra_type(F.lit(None).cast("string"), F.col("path")).alias("type"), known.alias("verification_status"), packages.city_hint(F.col("path")).alias("city_hint"))


_LINEAGE = "row_number() OVER (PARTITION BY cluster_id ORDER BY id) AS n"


@query(_MEMBERS + f", h AS (SELECT *, {_LINEAGE} FROM m) SELECT cluster_id, string_agg(source, ',' ORDER BY id) AS history, string_agg(CASE WHEN n = 1 THEN 'CREATED' ELSE 'MATCHED' END || ':' || survey_no, ',' ORDER BY id) AS lineage, count(*) AS events FROM h GROUP BY cluster_id")
def source_history(spark, sf_dir):
    """Sources of a parcel in order of arrival, and its lineage: the record that made it and those that were matched to it."""
    rows = observations(spark, sf_dir).join(clusters_of(spark, sf_dir)[0], "id")
    listed = F.sort_array(F.collect_list(F.struct("id", "source", "survey_no")))
    entry = lambda e, i: F.concat(F.when(i == 0, "CREATED:").otherwise("MATCHED:"), e["survey_no"])
    return rows.groupBy("cluster_id").agg(F.array_join(F.transform(listed, lambda e: e["source"]), ",").alias("history"), F.array_join(F.transform(listed, entry), ",").alias("lineage"), F.count(F.lit(1)).alias("events"))


_THREE = """SELECT CASE source WHEN 'registry' THEN 'CAD-' WHEN 'survey' THEN 'MUN-' ELSE 'AI-' END || CAST(id AS VARCHAR) AS canonical_uid, CASE source WHEN 'registry' THEN survey_no WHEN 'survey' THEN coalesce(survey_no, 'N/A') ELSE 'AI-EXTRACTED' END AS survey_number,
 CASE source WHEN 'registry' THEN 'cadastral' WHEN 'survey' THEN 'municipal' ELSE 'ai' END AS source_type, 'Polygon' AS geometry_type, area_m2, CASE source WHEN 'registry' THEN 0.96::DOUBLE WHEN 'survey' THEN 0.91::DOUBLE ELSE coalesce(extraction_confidence, 0.88::DOUBLE) END AS confidence_score, 'EPSG:32643' AS crs,"""


@query(
    _THREE
    + f""" {R('(x0 + x1 + x1 + x0 + x0) / 5', 6)} AS centroid_x, {R('(y0 + y0 + y1 + y1 + y0) / 5', 6)} AS centroid_y, building_type AS land_use,
 substr(sha256(CASE source WHEN 'registry' THEN 'CAD:' || CAST(id AS VARCHAR) || ':' || survey_no WHEN 'survey' THEN 'MUN:' || CAST(id AS VARCHAR) ELSE 'AI:' || CAST(id AS VARCHAR) END || ':' || CAST(CAST(area_m2 * 100 AS BIGINT) AS VARCHAR)), 1, 16) AS provenance_hash FROM ({OBS_SQL})"""
)
def normalize_three_sources(spark, sf_dir):
    """Cadastral, municipal and extracted features as ten common fields; the centroid is the mean of the ring's points."""
    obs, parts = observations(spark, sf_dir), []
    ring = g.box_ring(g.box())
    mean = lambda c: g.rounded(F.aggregate(ring, F.lit(0.0), lambda acc, p: acc + p[c]) / F.size(ring), 6)
    number, own = F.col("id").cast("string"), F.col("extraction_confidence")
    forms = (
        ("registry", "CAD", "cadastral", F.col("survey_no"), F.lit(0.96), F.concat(F.lit("CAD:"), number, F.lit(":"), F.col("survey_no"))),
        ("survey", "MUN", "municipal", F.coalesce("survey_no", F.lit("N/A")), F.lit(0.91), F.concat(F.lit("MUN:"), number)),
        ("imagery", "AI", "ai", F.lit("AI-EXTRACTED"), F.coalesce(own, F.lit(0.88)), F.concat(F.lit("AI:"), number)),
    )
    for source, prefix, kind, survey, conf, name in forms:
        digest = F.substring(F.sha2(F.concat(name, F.lit(":"), (F.col("area_m2") * 100).cast("long").cast("string")), 256), 1, 16)
        parts.append(obs.where(F.col("source") == source).select(
            F.concat(F.lit(f"{prefix}-"), number).alias("canonical_uid"), survey.alias("survey_number"), F.lit(kind).alias("source_type"), F.lit("Polygon").alias("geometry_type"), "area_m2", conf.alias("confidence_score"),
            F.lit("EPSG:32643").alias("crs"), mean("x").alias("centroid_x"), mean("y").alias("centroid_y"), F.col("building_type").alias("land_use"), digest.alias("provenance_hash"),
        ))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT CAST(o_custkey AS BIGINT) AS dataset_id, count(*) AS versions, max(o_orderdate) AS latest FROM orders GROUP BY 1")
def dataset_catalog(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.groupBy(F.col("o_custkey").cast("long").alias("dataset_id")).agg(F.count(F.lit(1)).alias("versions"), F.max("o_orderdate").alias("latest"))


@query(f"WITH f AS ({FILES_SQL}), r AS (SELECT package_id, path, row_number() OVER (PARTITION BY package_id ORDER BY file_no) AS n FROM f) SELECT package_id, CASE WHEN contains(path, 'gnss') THEN 'checkpoints' WHEN contains(path, 'cadastral') THEN 'cadastral' WHEN contains(path, 'footprints') THEN 'municipal' ELSE 'other' END AS role FROM r WHERE n = 1")
def classify_layer(spark, sf_dir):
    """The role of a layer from its first record."""
    rows = derived(spark, sf_dir, FILES)
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy("package_id").orderBy("file_no"))).where("n = 1")
    p = F.col("path")
    return first.select("package_id", F.when(p.contains("gnss"), "checkpoints").when(p.contains("cadastral"), "cadastral").when(p.contains("footprints"), "municipal").otherwise("other").alias("role"))


_VERSIONS_OF = "SELECT CAST(l_orderkey AS BIGINT) AS k, count(*) AS versions, max(CAST(l_linenumber AS BIGINT)) AS latest_version FROM lineitem GROUP BY 1"
_EVENTS_OF = "SELECT CAST(user_id AS BIGINT) AS k, count(*) AS conflict_events FROM events GROUP BY 1"


@query(
    _ENTITIES
    + f""", infra AS ({_INFRA} SELECT id, count(*) FILTER (meets) AS crossed, min(d) AS nearest FROM j GROUP BY id), vs AS ({_VERSIONS_OF}), ev AS ({_EVENTS_OF})
 SELECT m.id, m.k, array_to_string(ent.sources, ',') AS sources, ent.confidence, ent.decision, coalesce(vs.versions, 0) AS versions, vs.latest_version, coalesce(ev.conflict_events, 0) AS conflict_events, coalesce(infra.crossed, 0) AS crossed
 FROM m JOIN ent ON ent.cluster_id = m.cluster_id LEFT JOIN vs ON vs.k = m.k LEFT JOIN ev ON ev.k = m.k LEFT JOIN infra ON infra.id = m.id WHERE m.source = 'registry'"""
)
def evidence_join(spark, sf_dir):
    """Per registry parcel: the sources, confidence and decision of its entity, its versions, conflict events and the lines that cross it, each aggregated before the join."""
    obs = observations(spark, sf_dir).where("source = 'registry'").select("id", "k").join(clusters_of(spark, sf_dir)[0], "id")
    ent = entities(spark, sf_dir).select("cluster_id", F.array_join("sources", ",").alias("sources"), "confidence", "decision")
    versions = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col("l_orderkey").cast("long").alias("k")).agg(F.count(F.lit(1)).alias("versions"), F.max(F.col("l_linenumber").cast("long")).alias("latest_version"))
    events = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(F.col("user_id").cast("long").alias("k")).agg(F.count(F.lit(1)).alias("conflict_events"))
    crossed = infra_pairs(spark, sf_dir).groupBy("id").agg(F.count(F.when(F.col("meets"), 1)).alias("crossed"))
    rows = obs.join(ent, "cluster_id").join(versions, "k", "left").join(events, "k", "left").join(crossed, "id", "left")
    none = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.select("id", "k", "sources", "confidence", "decision", none("versions"), "latest_version", none("conflict_events"), none("crossed"))
