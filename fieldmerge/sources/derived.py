"""Observations, ledgers and requests derived from the star-schema tables, as SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

OBS = """
WITH b AS (
  SELECT CAST(o_orderkey AS BIGINT) AS k,
         (CAST(o_orderkey AS BIGINT) % 400) * 30 AS gx,
         CAST(FLOOR(CAST(o_orderkey AS DOUBLE) / 400) AS BIGINT) * 30 AS gy,
         12 + (CAST(o_orderkey AS BIGINT) * 7) % 9 AS w,
         10 + (CAST(o_orderkey AS BIGINT) * 11) % 8 AS h
  FROM {orders}),
s AS (
  SELECT k * 4 + 1 AS id, k, 'registry' AS source, CAST(gx AS DOUBLE) AS x0, CAST(gy AS DOUBLE) AS y0,
         CAST(w AS DOUBLE) AS bw, CAST(h AS DOUBLE) AS bh, CAST(NULL AS DOUBLE) AS ext
  FROM b
  UNION ALL
  SELECT k * 4 + 2, k, 'survey', CAST(gx AS DOUBLE) + CAST((k * 37) % 41 - 20 AS DOUBLE) / 10,
         CAST(gy AS DOUBLE) + CAST((k * 53) % 31 - 15 AS DOUBLE) / 10,
         CAST(w AS DOUBLE) + CAST((k * 13) % 5 - 2 AS DOUBLE) / 2, CAST(h AS DOUBLE), NULL
  FROM b WHERE k % 10 <> 3
  UNION ALL
  SELECT k * 4 + 3, k, 'imagery', CAST(gx AS DOUBLE) + CAST((k * 29) % 61 - 30 AS DOUBLE) / 10,
         CAST(gy AS DOUBLE) + CAST((k * 31) % 21 - 10 AS DOUBLE) / 10, CAST(w AS DOUBLE), CAST(h AS DOUBLE),
         CAST(60 + (k * 17) % 40 AS DOUBLE) / 100
  FROM b WHERE k % 4 <> 1
  UNION ALL
  SELECT k * 4, k, 'survey', CAST(gx AS DOUBLE) + CAST((k * 37) % 41 - 13 AS DOUBLE) / 10,
         CAST(gy AS DOUBLE) + CAST((k * 53) % 31 - 11 AS DOUBLE) / 10, CAST(w AS DOUBLE), CAST(h AS DOUBLE), NULL
  FROM b WHERE k % 50 = 0)
SELECT id, k, source, x0, y0, x0 + bw AS x1, y0 + bh AS y1, bw * bh AS area_m2, ext AS extraction_confidence,
       CASE WHEN k % 3 = 0 THEN 'residential' WHEN k % 3 = 1 THEN 'commercial' ELSE 'unknown' END AS building_type,
       CONCAT('Sy No ', CAST(k AS VARCHAR(20)), CASE WHEN source = 'survey' THEN '/A' ELSE '-A' END) AS survey_no
FROM s
"""

VERSION_ROWS = """
SELECT CAST(l_orderkey AS BIGINT) AS parcel, CAST(l_linenumber AS BIGINT) AS version,
       CAST((CAST(l_suppkey AS BIGINT) % 21) - 10 AS DOUBLE) / 10 AS x0,
       CAST((CAST(l_partkey AS BIGINT) % 15) - 7 AS DOUBLE) / 10 AS y0,
       CAST(20 + CAST(l_partkey AS BIGINT) % 4 AS DOUBLE) AS w,
       CAST(15 + CAST(l_suppkey AS BIGINT) % 3 AS DOUBLE) AS h,
       l_shipdate AS recorded_at, CAST(50 + CAST(l_quantity AS BIGINT) AS DOUBLE) / 100 AS confidence,
       CASE CAST(l_suppkey AS BIGINT) % 6 WHEN 0 THEN 'Cadastral register' WHEN 1 THEN 'municipal layer' WHEN 2 THEN 'drone flight' WHEN 3 THEN 'RTK survey' WHEN 4 THEN NULL ELSE 'archive' END AS source
FROM {lineitem}
"""

REQUESTS = """
SELECT CAST(user_id AS BIGINT) AS conflict_id, event_id, ts,
       CASE CAST(FLOOR(value * 10) AS BIGINT) % 9
         WHEN 0 THEN 'DETECTED' WHEN 1 THEN 'UNDER_REVIEW' WHEN 2 THEN 'SURVEY_REQUIRED'
         WHEN 3 THEN 'SURVEY_RECEIVED' WHEN 4 THEN 'RECONCILIATION_PENDING' WHEN 5 THEN 'RESOLVED'
         WHEN 6 THEN 'APPROVED' WHEN 7 THEN 'REJECTED' ELSE 'REOPENED' END AS requested_state,
       event_type AS actor
FROM {events}
"""

#: One record per conflict of the requests: what it is about, how grave, where, and from which source it came.
CONFLICTS = """
SELECT DISTINCT CAST(user_id AS BIGINT) AS conflict_id,
       CASE CAST(user_id AS BIGINT) % 5 WHEN 0 THEN 'BOUNDARY_MISMATCH' WHEN 1 THEN 'AREA_MISMATCH' WHEN 2 THEN 'DUPLICATE_SOURCE' WHEN 3 THEN 'CENTROID_DRIFT' ELSE 'ATTRIBUTE_MISMATCH' END AS conflict_type,
       CASE CAST(user_id AS BIGINT) % 4 WHEN 0 THEN 'LOW' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'HIGH' ELSE 'CRITICAL' END AS severity,
       CONCAT('P-', CAST(CAST(user_id AS BIGINT) * 4 + 1 AS VARCHAR(20))) AS parcel_id, CONCAT('S-', CAST(CAST(user_id AS BIGINT) % 100 AS VARCHAR(20))) AS source_id
FROM {events}
"""

DIRTY = """
SELECT CASE WHEN k % 101 = 0 THEN NULL ELSE id END AS id, CAST(FLOOR(CAST(k AS DOUBLE) / 500) AS BIGINT) AS dataset_id, k, source,
       CASE WHEN k % 107 = 0 THEN CAST(0 AS DOUBLE) ELSE x0 END AS x0, CASE WHEN k % 107 = 0 THEN CAST(0 AS DOUBLE) ELSE y0 END AS y0,
       CASE WHEN k % 107 = 0 THEN CAST(0 AS DOUBLE) ELSE x1 END AS x1, CASE WHEN k % 107 = 0 THEN CAST(0 AS DOUBLE) ELSE y1 END AS y1,
       CASE WHEN k % 103 = 0 THEN CAST(-1 AS DOUBLE) ELSE area_m2 END AS area_m2
FROM ({obs}) o
UNION ALL
SELECT id, CAST(FLOOR(CAST(k AS DOUBLE) / 500) AS BIGINT), k, source, x0, y0, x1, y1, area_m2 FROM ({obs}) o WHERE k % 109 = 0
"""

#: Uploaded layers of 100 keys: a file each (extension, bytes, declared code), features with every fault that the checks look for.
#: shape: 0 a box, 1 a ring that crosses itself, 2 a ring without points, 3 no coordinates, 4 a box without area.
UPLOADS = """
WITH o AS (SELECT *, CAST(FLOOR(CAST(k AS DOUBLE) / 100) AS BIGINT) AS dataset_id FROM ({obs}) b),
f AS (
  SELECT *, CASE WHEN dataset_id % 23 = 7 THEN '.shp' WHEN dataset_id % 2 = 0 THEN '.geojson' ELSE '.zip' END AS extension,
         CASE WHEN dataset_id % 19 = 5 THEN 0 WHEN dataset_id % 29 = 9 THEN 60000000 ELSE 1000 + dataset_id END AS bytes,
         CASE WHEN dataset_id % 7 = 3 THEN NULL WHEN dataset_id % 17 = 4 THEN 'EPSG:99999' WHEN dataset_id % 3 = 0 THEN 'EPSG:4326' ELSE 'EPSG:32643' END AS declared
  FROM o),
g AS (
  SELECT *, CASE WHEN dataset_id % 13 = 8 THEN 3 WHEN k % 31 = 0 THEN 3 WHEN k % 37 = 0 THEN 2 WHEN k % 41 = 0 THEN 1 WHEN k % 43 = 0 THEN 4 ELSE 0 END AS shape,
         CASE WHEN k % 23 = 0 THEN 'MultiPolygon' WHEN k % 29 = 0 THEN 'LineString' ELSE 'Polygon' END AS geometry_type,
         CASE WHEN k % 101 = 0 THEN NULL WHEN k % 97 = 0 THEN '  ' WHEN k % 59 = 0 THEN 'P-repeated' ELSE CONCAT('P-', CAST(id AS VARCHAR(20))) END AS parcel_id,
         CASE WHEN k % 103 = 0 THEN '-1' WHEN k % 107 = 0 THEN 'n/a' WHEN k % 47 = 0 THEN NULL ELSE CAST(CAST(area_m2 AS BIGINT) AS VARCHAR(20)) END AS area,
         coalesce(declared, 'EPSG:4326') = 'EPSG:4326' AND dataset_id % 11 <> 6 AS in_degrees
  FROM f)
SELECT dataset_id, id, k, source, extension, bytes, declared, shape, geometry_type, parcel_id, area,
       CASE WHEN in_degrees AND k % 67 = 0 THEN CAST(200 AS DOUBLE) WHEN in_degrees THEN 77 + (CASE WHEN k % 53 = 0 THEN CAST(0 AS DOUBLE) ELSE x0 END) / 100000 ELSE x0 END AS x0,
       CASE WHEN in_degrees THEN 12 + (CASE WHEN k % 53 = 0 THEN CAST(0 AS DOUBLE) ELSE y0 END) / 100000 ELSE y0 END AS y0,
       CASE WHEN in_degrees AND k % 67 = 0 THEN CAST(201 AS DOUBLE) WHEN in_degrees THEN 77 + (CASE WHEN k % 53 = 0 THEN CAST(9 AS DOUBLE) ELSE x1 END) / 100000 ELSE x1 END AS x1,
       CASE WHEN in_degrees THEN 12 + (CASE WHEN k % 53 = 0 THEN CAST(9 AS DOUBLE) ELSE y1 END) / 100000 ELSE y1 END AS y1
FROM g
"""

FILES = """
SELECT CAST(o_custkey AS BIGINT) AS package_id, CAST(o_orderkey AS BIGINT) AS file_no, CAST(1 + o_orderkey % 40 AS BIGINT) AS features,
       CASE o_orderkey % 19 WHEN 0 THEN '02_PARCELS/cadastral_parcels.geojson' WHEN 1 THEN 'tiles/x.tif' WHEN 2 THEN 'misc/roads.geojson'
         WHEN 3 THEN '03_BUILDINGS/footprints.geojson' WHEN 4 THEN 'scan/relief.las' WHEN 5 THEN 'tables/attr_export.csv' WHEN 6 THEN 'misc/unknown.geojson'
         WHEN 7 THEN 'ward_boundary.geojson' WHEN 8 THEN 'stormwater_drains.geojson' WHEN 9 THEN 'metro_line.geojson' WHEN 10 THEN 'photos/ortho.ecw'
         WHEN 11 THEN 'gnss_points.geojson' WHEN 12 THEN 'zoning.geojson' WHEN 13 THEN 'easement.geojson' WHEN 14 THEN 'door_number.csv'
         WHEN 15 THEN 'city_park.geojson' WHEN 16 THEN 'README.md' WHEN 17 THEN 'legacy_layer.geojson' ELSE 'dtm/tile.txt' END AS path,
       CASE o_orderkey % 3 WHEN 0 THEN 'EPSG:4326' WHEN 1 THEN 'EPSG:32643' ELSE NULL END AS crs,
       CAST(77 AS DOUBLE) + CAST(o_orderkey % 4000 AS DOUBLE) / 1000 AS lon, CAST(12 AS DOUBLE) + CAST(o_orderkey % 900 AS DOUBLE) / 1000 AS lat
FROM {orders}
"""

POINTS = """
SELECT CAST(o_orderkey AS BIGINT) AS k, CAST(FLOOR(CAST(o_orderkey AS DOUBLE) / 100) AS BIGINT) AS dataset_id,
       CAST(70 AS DOUBLE) + CAST((o_orderkey * 7) % 26000 AS DOUBLE) / 1000 AS lon, CAST(8 AS DOUBLE) + CAST((o_orderkey * 3) % 28000 AS DOUBLE) / 1000 AS lat
FROM {orders}
"""

#: Layers with a declared code, coordinates in degrees or metres, and a place name.
LAYERS = """
SELECT dataset_id, CASE dataset_id % 7 WHEN 0 THEN 'EPSG:4326' WHEN 1 THEN 'urn:ogc:def:crs:OGC:1.3:CRS84' WHEN 2 THEN 'epsg:32643' WHEN 3 THEN NULL
         WHEN 4 THEN 'EPSG::32644' WHEN 5 THEN 'EPSG:99999' ELSE 'local sheet' END AS declared,
       CASE dataset_id % 5 WHEN 0 THEN 'Bengaluru Domlur' WHEN 1 THEN 'Chennai' WHEN 2 THEN 'Kolkata' WHEN 3 THEN '' ELSE 'Nowhere' END AS aoi,
       CASE WHEN dataset_id % 3 = 0 THEN lon ELSE CAST(500000 AS DOUBLE) + CAST(k % 100 AS DOUBLE) END AS x,
       CASE WHEN dataset_id % 3 = 0 THEN lat ELSE CAST(1400000 AS DOUBLE) + CAST(k % 77 AS DOUBLE) END AS y
FROM ({points}) p
"""

#: Raw column names of layers: six for each customer's layer.
COLUMNS = """
SELECT CAST(c_custkey AS BIGINT) AS dataset_id, CAST(j AS BIGINT) AS pos,
       CASE (c_custkey * 7 + j * 5) % 30 WHEN 0 THEN 'SURVEY_NO' WHEN 1 THEN 'plotNo' WHEN 2 THEN 'pid' WHEN 3 THEN 'cad_id' WHEN 4 THEN 'area (sqm)'
         WHEN 5 THEN 'foo_bar_xyz' WHEN 6 THEN 'ownerName' WHEN 7 THEN 'Geom' WHEN 8 THEN 'lat' WHEN 9 THEN 'LNG' WHEN 10 THEN 'land use'
         WHEN 11 THEN 'ward no' WHEN 12 THEN 'zone' WHEN 13 THEN 'captured-date' WHEN 14 THEN 'src' WHEN 15 THEN 'propertyId' WHEN 16 THEN 'khata_no'
         WHEN 17 THEN 'parcelNumber' WHEN 18 THEN 'valid_from' WHEN 19 THEN 'expiry_date' WHEN 20 THEN 'rev_id' WHEN 21 THEN 'gis area'
         WHEN 22 THEN 'taluk' WHEN 23 THEN 'village' WHEN 24 THEN 'record_id' WHEN 25 THEN 'titleHolder' WHEN 26 THEN 'shapeArea' WHEN 27 THEN 'x coord'
         WHEN 28 THEN 'qqq' ELSE 'area_sqm' END AS raw
FROM {customer} CROSS JOIN (SELECT 0 AS j UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5) js
"""

_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def sql_text(template: str, spark_dir: str | None = None) -> str:
    """The template over DuckDB's views, or over the Parquet files of spark_dir."""
    text = template
    for name, inner in (("obs", OBS), ("points", POINTS)):
        text = text.replace(f"({{{name}}})", f"({inner})")
    for name in _TABLES:
        text = text.replace(f"{{{name}}}", name if spark_dir is None else f"parquet.`{spark_dir}/{name}.parquet`")
    return text


def derived(spark: SparkSession, sf_dir: str, template: str) -> DataFrame:
    return spark.sql(sql_text(template, sf_dir))
