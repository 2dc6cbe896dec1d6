"""Sources and sinks in open formats."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmerge.functions.session import shared_dir

_FEATURE = "struct<type:string,properties:map<string,string>,geometry:struct<type:string,coordinates:string>>"
GEOJSON = f"type string, crs struct<properties:struct<name:string>>, features array<{_FEATURE}>, properties map<string,string>, geometry struct<type:string,coordinates:string>, coordinates string"


def read_geojson(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """(crs, geometry_type, coordinates as JSON text, properties) per feature of collections, single features and bare geometries.

    Files are read whole, one task each (or, without multi_line, a collection a line, which can be split); features that are not objects are null and dropped. Coordinates of any depth stay text.
    """
    raw = spark.read.schema(GEOJSON).option("multiLine", multi_line).json(path)
    single = F.struct(F.lit("Feature").alias("type"), F.col("properties").alias("properties"), F.coalesce("geometry", F.struct(F.col("type").alias("type"), F.col("coordinates").alias("coordinates"))).alias("geometry"))
    every = F.when(F.col("features").isNotNull(), F.col("features")).otherwise(F.array(single))
    rows = raw.select(F.col("crs.properties.name").alias("crs"), F.explode(every).alias("f")).where("f.geometry is not null and f.geometry.coordinates is not null")
    return rows.select("crs", F.col("f.geometry.type").alias("geometry_type"), F.col("f.geometry.coordinates").alias("coordinates"), F.col("f.properties").alias("properties"))


def outer_ring(geometry_type, coordinates):
    """The first ring of a polygon, or of the first polygon, as array of struct(x, y); null for other types."""
    rings = F.when(geometry_type == "Polygon", F.from_json(coordinates, "array<array<array<double>>>").getItem(0))
    rings = rings.when(geometry_type == "MultiPolygon", F.from_json(coordinates, "array<array<array<array<double>>>>").getItem(0).getItem(0))
    return F.transform(rings, lambda p: F.struct(p.getItem(0).alias("x"), p.getItem(1).alias("y")))


def read_attributes(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def import_layer(features: DataFrame, layer_type: str) -> tuple[DataFrame, DataFrame]:
    """Features of a user's layer with status UNVERIFIED, and those set aside because their geometry is missing or unknown."""
    good = F.coalesce(F.col("geometry_type").isin("Point", "LineString", "MultiLineString", "Polygon", "MultiPolygon"), F.lit(False))
    kept = features.where(good).withColumns({"type": F.lit(layer_type), "verification_status": F.lit("UNVERIFIED")})
    return kept, features.where(~good)


def write_lines(df: DataFrame, path: str) -> None:
    """A one-column table as text lines (newline-delimited features)."""
    df.write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def append_new(df: DataFrame, path: str, keys: list[str]) -> None:
    """Appends the rows whose keys the Parquet table at path does not have yet; repeated keys within df count once."""
    spark, rows = df.sparkSession, df.dropDuplicates(keys)
    known = spark.read.parquet(path).select(*keys)
    rows.join(known, keys, "left_anti").write.mode("append").parquet(path)


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/fieldmerge/{name}-{uuid.uuid4().hex}"


def listing(spark: SparkSession, path: str) -> tuple:
    """(name, bytes, time of writing) of a file, or of the files of a folder."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at)
    return tuple(sorted((x.getPath().getName(), x.getLen(), x.getModificationTime()) for x in found))


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the versions that a catalogue lists, ascending; none where there is no catalogue yet."""
    if not _exists(spark, f"{path}/catalog"):
        return []
    return sorted(r[0] for r in spark.read.schema("version long").parquet(f"{path}/catalog").distinct().collect())


def current(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the version that is active: the last that the catalogue lists, or what the manifest of a bucketed table names."""
    if _exists(spark, f"{path}/manifest"):
        return read_buckets(spark, path, manifest(spark, path)).drop("bucket")
    return spark.read.parquet(f"{path}/versions/{_versions(spark, path)[-1]}")


def replace(df: DataFrame, path: str) -> bool:
    """Makes df the active version of the table at path; earlier ones stay as archived. An empty df is refused and nothing changes.

    The rows are written first and the catalogue entry after them, so a run that fails on the way leaves the active version as it was.
    """
    spark = df.sparkSession
    number = max(_versions(spark, path), default=0) + 1
    df.write.mode("overwrite").parquet(f"{path}/versions/{number}")
    if spark.read.parquet(f"{path}/versions/{number}").isEmpty():
        return False
    spark.range(1).select(F.lit(number).cast("long").alias("version")).write.mode("append").parquet(f"{path}/catalog")
    return True


def manifest(spark: SparkSession, path: str, upto: int | None = None) -> dict[int, int]:
    """The version in which each bucket of the table at path was last written, as of version upto at most; at most one entry a bucket."""
    if not _exists(spark, f"{path}/manifest"):
        return {}
    told = spark.read.schema("bucket int, written int, version int").parquet(f"{path}/manifest")
    told = told if upto is None else told.where(F.col("version") <= upto)
    last = told.agg(F.max("version")).first()[0]
    return {r["bucket"]: r["written"] for r in told.where(F.col("version") == last).collect()} if last is not None else {}


def read_buckets(spark: SparkSession, path: str, written: dict[int, int]) -> DataFrame:
    """The rows of the buckets in written (see manifest), with their bucket; no other file is opened."""
    paths = [f"{path}/data/version={v}/bucket={b}" for b, v in sorted(written.items())]
    return spark.read.option("basePath", f"{path}/data").parquet(*paths).drop("version")


def write_buckets(df: DataFrame, path: str, version: int, before: dict[int, int]) -> dict[int, int]:
    """Writes the buckets of df (column bucket) as a version, then a manifest that names them and, for all others, those of before.

    Versions that exist already are written anew. A run that fails before the manifest is there changes nothing for readers.
    """
    spark = df.sparkSession
    df.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/version={version}")
    fresh = spark.read.parquet(f"{path}/data/version={version}")
    new = {r[0] for r in fresh.select("bucket").distinct().collect()} if "bucket" in fresh.columns else set()
    told = before | dict.fromkeys(new, version)
    rows = [(b, v) for b, v in sorted(told.items())]
    spark.createDataFrame(rows, "bucket int, written int").write.mode("overwrite").parquet(f"{path}/manifest/version={version}")
    return told


def upsert(df: DataFrame, path: str, key: str, update: list[str], buckets: int = 64) -> None:
    """Rows of df into the table at path: of keys that it has only the columns in update change, others are added.

    The table lies in buckets by a hash of the key. Only buckets that hold a key of df are read and written again, as files of a new
    version, and the manifest that names them is written last. buckets must stay the same for a table.
    """
    spark = df.sparkSession
    before = manifest(spark, path)
    version = max(before.values(), default=0) + 1
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    asked = [r[0] for r in df.select(bucket.alias("b")).distinct().collect()]
    held = {b: before[b] for b in asked if b in before}
    rows = df
    if held:
        old = read_buckets(spark, path, held).drop("bucket")
        both = old.alias("o").join(df.alias("n"), F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
        rows = both.select(*((F.coalesce(f"n.{c}", f"o.{c}") if c in update else F.coalesce(f"o.{c}", f"n.{c}")).alias(c) for c in old.columns))
    if asked:
        write_buckets(rows.withColumn("bucket", bucket), path, version, before)
