"""Coordinate systems as columns: UTM zones and projection, declared codes, and a diagnosis of layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# WGS 84 and the UTM series (third order in the third flattening).
SEMI_MAJOR, FLATTENING = 6378137.0, 1 / 298.257223563
N = FLATTENING / (2 - FLATTENING)
A_HAT = SEMI_MAJOR / (1 + N) * (1 + N**2 / 4 + N**4 / 64)
ALPHA = (N / 2 - 2 * N**2 / 3 + 5 * N**3 / 16, 13 * N**2 / 48 - 3 * N**3 / 5, 61 * N**3 / 240)
BETA = (N / 2 - 2 * N**2 / 3 + 37 * N**3 / 96, N**2 / 48 + N**3 / 15, 17 * N**3 / 480)
DELTA = (2 * N - 2 * N**2 / 3 - 2 * N**3, 7 * N**2 / 3 - 8 * N**3 / 5, 56 * N**3 / 15)

# Known codes, and codes of places.
KNOWN = ("EPSG:4326", "EPSG:32642", "EPSG:32643", "EPSG:32644", "EPSG:32645", "EPSG:32646", "EPSG:7760", "EPSG:24379", "EPSG:24380", "EPSG:3857")
AOI = {
    "bengaluru": "EPSG:32643",
    "blr": "EPSG:32643",
    "domlur": "EPSG:32643",
    "mumbai": "EPSG:32643",
    "bom": "EPSG:32643",
    "andheri": "EPSG:32643",
    "chennai": "EPSG:32644",
    "maa": "EPSG:32644",
    "tnagar": "EPSG:32644",
    "hyderabad": "EPSG:32644",
    "hyd": "EPSG:32644",
    "delhi": "EPSG:32644",
    "del": "EPSG:32644",
    "kolkata": "EPSG:32645",
    "ccu": "EPSG:32645",
}


def utm_zone(lon: Column) -> Column:
    return F.least(F.lit(60), F.greatest(F.lit(1), F.floor((lon + 180) / 6).cast("int") + 1))


def utm_epsg(lon: Column, lat: Column) -> Column:
    return F.concat(F.lit("EPSG:"), (F.when(lat >= 0, 32600).otherwise(32700) + utm_zone(lon)).cast("string"))


def project(lon: Column, lat: Column, zone: Column | None = None) -> Column:
    """struct(x, y): easting and northing in metres of the point's zone (or the one given); 10,000 km are added in the south."""
    zone = utm_zone(lon) if zone is None else zone
    e = 2 * N**0.5 / (1 + N)
    phi, lam = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    t = F.sinh(F.atanh(F.sin(phi)) - F.lit(e) * F.atanh(F.lit(e) * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(ALPHA, 1):
        x = x + F.lit(a) * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + F.lit(a) * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    scale = F.lit(0.9996 * A_HAT)
    return F.struct((F.lit(500000.0) + scale * x).alias("x"), (scale * y + F.when(lat < 0, 10_000_000.0).otherwise(0.0)).alias("y"))


def unproject(x: Column, y: Column, zone: Column, south: Column | None = None) -> Column:
    """struct(lon, lat) of an easting and northing."""
    south = F.lit(False) if south is None else south
    xi = (y - F.when(south, 10_000_000.0).otherwise(0.0)) / F.lit(0.9996 * A_HAT)
    eta = (x - 500000.0) / F.lit(0.9996 * A_HAT)
    p, q = xi, eta
    for j, b in enumerate(BETA, 1):
        p = p - F.lit(b) * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        q = q - F.lit(b) * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(p) / F.cosh(q))
    phi = chi
    for j, d in enumerate(DELTA, 1):
        phi = phi + F.lit(d) * F.sin(2 * j * chi)
    return F.struct((F.degrees(F.atan2(F.sinh(q), F.cos(p))) + (zone * 6 - 183)).alias("lon"), F.degrees(phi).alias("lat"))


def declared_code(declared: Column) -> Column:
    named = F.regexp_extract(declared, r"(?i)EPSG:?:?(\d+)", 1)
    return F.when(F.contains(declared, F.lit("CRS84")) | F.contains(declared, F.lit("4326")), "EPSG:4326").when(named != "", F.concat(F.lit("EPSG:"), named)).otherwise(declared)


def swap_axes(points: Column) -> Column:
    """Points that are (lat, lon) within the known range turned to (lon, lat)."""
    return F.transform(points, lambda p: F.when(p["x"].between(8, 38) & p["y"].between(68, 98), F.struct(p["y"].alias("x"), p["x"].alias("y"))).otherwise(F.struct(p["x"].alias("x"), p["y"].alias("y"))))


def out_of_range(points: Column) -> Column:
    return F.exists(points, lambda p: p["x"].isNull() | p["y"].isNull() | F.isnan(p["x"]) | F.isnan(p["y"]) | (F.abs(p["x"]) > 180) | (F.abs(p["y"]) > 90))


def coord_range(points: DataFrame, by: str) -> DataFrame:
    found = points.groupBy(by).agg(F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.min("y").alias("min_y"), F.max("y").alias("max_y"), F.count("x").alias("vertices"))
    inside = (F.col("min_x") >= -180) & (F.col("max_x") <= 180) & (F.col("min_y") >= -90) & (F.col("max_y") <= 90)
    return found.withColumn("units", F.when(F.col("vertices") == 0, "unknown").when(inside, "degrees").otherwise("meters"))


def diagnose(points: DataFrame, by: str = "dataset_id") -> DataFrame:
    """Per layer of points (x, y, declared, aoi): detected code, method, confidence, warnings, whether to confirm, code to process in."""
    named = points.groupBy(by).agg(F.min("declared").alias("declared"), F.min("aoi").alias("aoi"))
    rows = coord_range(points, by).join(named, by)
    aoi = None
    for place, code in AOI.items():
        hit = F.contains(F.lower("aoi"), F.lit(place))
        aoi = F.when(hit, code) if aoi is None else aoi.when(hit, code)
    rows = rows.withColumns({"code": declared_code(F.col("declared")), "aoi_crs": aoi, "geo": F.col("units") == "degrees", "metric": F.col("units") == "meters"})
    rows = rows.withColumn("valid", F.coalesce(F.col("code").isin(*KNOWN), F.lit(False)))
    decl_geo, decl_proj = F.col("valid") & (F.col("code") == "EPSG:4326"), F.col("valid") & (F.col("code") != "EPSG:4326")
    none = F.coalesce("declared", F.lit("")) == ""
    scenario = (
        F.when(decl_geo & F.col("geo"), 1).when(decl_proj & F.col("metric"), 2).when(decl_proj & F.col("geo"), 3).when(none & F.col("geo"), 4)
        .when(F.col("metric") & F.col("aoi_crs").isNotNull(), 5).when(F.col("metric"), 6).when(~none & ~F.col("valid") & F.col("geo"), 7)
        .when(~none & ~F.col("valid") & F.col("aoi_crs").isNotNull(), 9).when(~none & ~F.col("valid"), 10).otherwise(8)
    )
    rows = rows.withColumns({"scenario": scenario, "decl_geo": decl_geo, "decl_proj": decl_proj})
    s = F.col("scenario")
    india = F.col("min_x").between(68, 98) & F.col("min_y").between(6, 38)
    center = utm_epsg((F.col("min_x") + F.col("max_x")) / 2, (F.col("min_y") + F.col("max_y")) / 2)
    note = lambda when, text: F.when(when, F.lit(text))
    return rows.select(
        by, "declared",
        F.when(s.isin(1, 2), F.col("code")).when(s.isin(5, 9), F.col("aoi_crs")).when(s == 6, "EPSG:32643").when(s == 8, "LOCAL_GRID").otherwise("EPSG:4326").alias("detected"),
        F.when(s.isin(1, 2), "declared").when(s.isin(3, 7), "inconsistency_resolved").when(s.isin(4, 6), "coordinate_extent").when(s.isin(5, 9), "aoi").otherwise("unresolved").alias("method"),
        F.when(s.isin(1, 2), 1.0).when(s == 3, 0.85).when(s == 4, F.when(india, 0.95).otherwise(0.85)).when(s == 5, 0.90).when(s == 6, 0.65).when(s.isin(7, 9), 0.80).when(s == 10, 0.30).otherwise(0.20).alias("crs_confidence"),
        s.isin(3, 6, 7, 8, 9, 10).alias("requires_confirmation"),
        F.when(F.col("geo"), center).when(F.col("aoi_crs").isNotNull(), F.col("aoi_crs")).when(F.col("decl_proj"), F.col("code")).otherwise("EPSG:32643").alias("processing_crs"),
        F.array_compact(F.array(
            note(F.col("decl_proj") & F.col("geo"), "declared projected, coordinates in degrees"), note(F.col("decl_geo") & F.col("metric"), "declared geographic, coordinates in metres"),
            note(none, "no declared system"), note(~none & ~F.col("valid"), "declared system is not known"), note(s == 6, "several zones are possible"), note(s == 8, "local grid"),
        )).alias("warnings"),
    )


def confirm(found: DataFrame, asked: DataFrame) -> DataFrame:
    """Reviewers' codes (dataset_id, confirmed) over detected ones, where they are known codes."""
    good = asked.where(F.col("confirmed").isin(*KNOWN))
    rows = found.join(good, "dataset_id", "left")
    return rows.select("dataset_id", F.coalesce("confirmed", "detected").alias("detected"), F.when(F.col("confirmed").isNotNull(), False).otherwise(F.col("requires_confirmation")).alias("requires_confirmation"))
