"""Files of a package sorted into categories, and places found by coordinates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmerge.functions.geometry import rounded

# Categories in order with the words that mark their files.
CATEGORIES = {
    "01_BOUNDARY": ("boundary", "city_boundary", "ward_boundary", "zone_boundary", "village_boundary", "taluk", "revenue_boundary"),
    "02_PARCELS": ("parcel", "cadastral", "khasra", "survey", "cts", "fmb", "tax_parcel", "municipal_property"),
    "03_BUILDINGS": ("building", "footprint", "structure", "rooftop"),
    "04_ROADS": ("road", "street", "arterial", "highway", "lane", "pathway"),
    "05_UTILITIES": ("utility", "drainage", "stormwater", "rajakaluve", "canal", "water", "pipeline", "power", "sewer"),
    "06_TRANSPORT": ("transport", "railway", "metro", "bus", "station", "transit"),
    "07_ELEVATION": ("elevation", "dem", "dtm", "slope", "aspect", "contour", "altitude"),
    "08_IMAGERY": ("imagery", "orthomosaic", "ori", "satellite", "drone", "aerial", "ortho"),
    "09_GROUND_TRUTH": ("ground_truth", "rtk", "cors", "gnss", "survey_point", "benchmark"),
    "10_HISTORICAL": ("historical", "history", "revision", "2024", "2023", "previous", "legacy"),
    "11_LAND_USE": ("land_use", "landuse", "zoning", "masterplan", "development_plan"),
    "12_INFRASTRUCTURE": ("infrastructure", "asset", "facility", "corridor", "easement"),
    "13_ADDRESS": ("address", "door_number", "postal", "house_number"),
    "14_CONTEXT": ("context", "waterbody", "lake", "tank", "park", "garden", "amenity"),
    "15_METADATA": ("metadata", "catalog", "register", "crs_register", "readme", "manifest"),
}

# City rectangles (west, south, east, north) in order.
CITIES = {
    "Bengaluru": (77.40, 12.80, 77.80, 13.20),
    "Mumbai": (72.70, 18.80, 73.20, 19.40),
    "Chennai": (80.00, 12.80, 80.40, 13.30),
    "Delhi NCR": (76.80, 28.30, 77.50, 28.90),
    "Hyderabad": (78.20, 17.20, 78.70, 17.60),
    "Pune": (73.70, 18.40, 74.00, 18.70),
    "Kolkata": (88.20, 22.40, 88.50, 22.70),
    "Ahmedabad": (72.40, 22.90, 72.80, 23.20),
}

# Words in file names that mark the type of an infrastructure layer, in order.
INFRA_TYPES = {
    "road": ("road", "centreline", "carriageway"),
    "drainage": ("drain", "swd", "canal", "rajakaluve"),
    "railway": ("rail", "transit", "metro"),
    "electricity": ("elect", "power", "transmission", "grid"),
    "water": ("water", "pipe", "pipeline"),
    "public_utility": ("easement", "corridor", "utility"),
}


def _has(text: Column, words: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | F.contains(text, F.lit(w))
    return found


def category(path: Column) -> Column:
    """The first category whose code or word the path holds, else by file type."""
    p = F.lower(path)
    chosen = F.when(_has(p, ("01_boundary", *CATEGORIES["01_BOUNDARY"])), "01_BOUNDARY")
    for code, words in list(CATEGORIES.items())[1:]:
        chosen = chosen.when(_has(p, (code.lower(), *words)), code)
    chosen = chosen.when(p.rlike(r"\.(tif|tiff|ecw)$"), "08_IMAGERY").when(p.rlike(r"\.(las|dem)$"), "07_ELEVATION")
    return chosen.when(p.endswith(".csv") & _has(p, ("attr", "reg")), "15_METADATA").otherwise("02_PARCELS")


def scan(files: DataFrame) -> DataFrame:
    """(package_id, category, files, features) of a listing (package_id, path, features)."""
    return files.groupBy("package_id", category(F.col("path")).alias("category")).agg(F.count(F.lit(1)).alias("files"), F.sum("features").alias("features"))


def missing_categories(files: DataFrame) -> DataFrame:
    """(package_id, category) for every category of which a package has no file."""
    every = F.explode(F.array(*map(F.lit, CATEGORIES))).alias("category")
    return files.select("package_id").distinct().select("package_id", every).join(scan(files), ["package_id", "category"], "left_anti")


def city(lon: Column, lat: Column) -> Column:
    chosen = None
    for name, (w, s, e, n) in CITIES.items():
        inside = lon.between(w, e) & lat.between(s, n)
        chosen = F.when(inside, name) if chosen is None else chosen.when(inside, name)
    return chosen.otherwise(F.format_string("Region (%.2fN, %.2fE)", rounded(lat, 2), rounded(lon, 2)))


def city_hint(path: Column) -> Column:
    """The city that a path names, by the place names of coordinate systems; null if none."""
    p, chosen = F.lower(path), None
    for name, words in (("chennai", ("chennai", "maa", "tnagar")), ("bengaluru", ("bengaluru", "blr", "domlur")), ("mumbai", ("mumbai", "andheri")), ("hyderabad", ("hyderabad",)), ("delhi", ("delhi",)), ("kolkata", ("kolkata",))):
        hit = _has(p, words)
        chosen = F.when(hit, name) if chosen is None else chosen.when(hit, name)
    return chosen


def infra_type(declared: Column, path: Column) -> Column:
    """The declared type if it is a known one, else by the file name, else null."""
    name, chosen = F.lower(F.element_at(F.split(path, "/"), -1)), F.when(F.lower(declared).isin(*INFRA_TYPES), F.lower(declared))
    for kind, words in INFRA_TYPES.items():
        chosen = chosen.when(_has(name, words), kind)
    return chosen
