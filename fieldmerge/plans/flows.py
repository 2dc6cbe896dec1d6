"""Queries through files and streams: formats written and read back, keyed state, versions by micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldmerge.functions import clipping
from fieldmerge.functions import geometry as g
from fieldmerge.functions.session import stored
from fieldmerge.operators import crs, nearest, packages, scoring, spatial_join
from fieldmerge.plans.history import _CHANGES, _FOLD, changes
from fieldmerge.plans.matching import OBS_SQL, PAIRS_SQL, R, _PA, _PB, _QA, _QB, clusters_of, observations
from fieldmerge.plans.quality import _INFRA, infra_pairs, lines, parcels
from fieldmerge.plans.register import query
from fieldmerge.sources import files
from fieldmerge.sources.derived import POINTS, REQUESTS, derived, sql_text
from fieldmerge.streaming import lifecycle


@query(f"SELECT id AS parcel_id, survey_no, area_m2 FROM ({OBS_SQL}) WHERE source = 'registry'")
def src_csv_attributes(spark, sf_dir):
    """Attribute tables written as CSV and read with a schema."""
    path = files.folder(spark, "attributes")
    files.write_csv(observations(spark, sf_dir).where("source = 'registry'").select(F.col("id").alias("parcel_id"), "survey_no", "area_m2"), path)
    return files.read_attributes(spark, path, "parcel_id long, survey_no string, area_m2 double")


def geojson_layers(spark, sf_dir) -> DataFrame:
    """Registry boxes as one feature collection per 400 keys, written as text and read as GeoJSON, one collection a line."""
    rows = observations(spark, sf_dir).where("source = 'registry'")
    ring = F.array(*(F.array(F.col(x), F.col(y)) for x, y in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"), ("x0", "y0"))))
    feature = F.struct(F.lit("Feature").alias("type"), F.create_map(F.lit("parcel_id"), F.col("id").cast("string")).alias("properties"), F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"))
    sets = rows.groupBy(F.floor(F.col("k") / 400).alias("layer")).agg(F.collect_list(feature).alias("features"))
    path = files.folder(spark, "geojson")
    files.write_lines(sets.select(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), "features")).alias("value")), path)
    return files.read_geojson(spark, path, multi_line=False)


@query(f"SELECT CAST(id AS VARCHAR) AS parcel_id, {R('(x1 - x0) * (y1 - y0)', 6)} AS area FROM ({OBS_SQL}) WHERE source = 'registry'")
def src_geojson(spark, sf_dir):
    rows = geojson_layers(spark, sf_dir)
    area = g.ring_area(files.outer_ring(F.col("geometry_type"), F.col("coordinates")))
    return rows.select(F.element_at("properties", "parcel_id").alias("parcel_id"), g.rounded(area, 6).alias("area"))


@query(f"SELECT 'water' AS type, 'UNVERIFIED' AS verification_status, count(*) FILTER (id % 50 <> 5) AS n, count(*) FILTER (id % 50 = 5) AS skipped FROM ({OBS_SQL}) WHERE source = 'registry'")
def src_infra_import(spark, sf_dir):
    """A user's layer, appended as unverified; features of unknown geometry (here every fiftieth id's) go to a quarantine and are counted."""
    layer = geojson_layers(spark, sf_dir)
    bad = F.element_at("properties", "parcel_id").cast("long") % 50 == 5
    kept, skipped = files.import_layer(layer.withColumn("geometry_type", F.when(bad, "CircularString").otherwise(F.col("geometry_type"))), "water")
    path, aside = files.folder(spark, "layer"), files.folder(spark, "quarantine")
    kept.select("type", "verification_status", "coordinates").write.mode("append").parquet(path)
    skipped.select("geometry_type", "coordinates").write.mode("append").parquet(aside)
    counted = spark.read.parquet(aside).agg(F.count(F.lit(1)).alias("skipped"))
    return spark.read.parquet(path).groupBy("type", "verification_status").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(counted))


@query(PAIRS_SQL + f"SELECT id_a, id_b, {R('least(area_a, area_b) / greatest(area_a, area_b)', 6)} AS area_similarity, {R(f'least({_QA}, {_QB}) / greatest({_QA}, {_QB})', 6)} AS shape_similarity, {R(f'least({_PA}, {_PB}) / greatest({_PA}, {_PB})', 6)} AS perimeter_similarity, 1.0::DOUBLE AS source_agreement, {R('least(centroid_dist / 15.0::DOUBLE, 1.0::DOUBLE)', 6)} AS norm_distance FROM pairs")
def pair_similarities(spark, sf_dir):
    """The single scores of candidate pairs: area, shape, perimeter, sources, normalised distance."""
    pairs = scoring.with_overlap(spatial_join.candidate_pairs(observations(spark, sf_dir)))
    a, b = g.box(suffix="_a"), g.box(suffix="_b")
    pa, pb = g.box_perimeter(a), g.box_perimeter(b)
    r6 = lambda c: g.rounded(c, 6)
    return pairs.select(
        "id_a", "id_b", r6(g.ratio(F.col("area_m2_a"), F.col("area_m2_b"), 0.5)).alias("area_similarity"), r6(g.ratio(g.compactness(g.box_area(a), pa), g.compactness(g.box_area(b), pb), 0.0)).alias("shape_similarity"),
        r6(g.ratio(pa, pb, 0.0)).alias("perimeter_similarity"), scoring.source_agreement(F.col("source_a"), F.col("source_b")).alias("source_agreement"), r6(F.least(F.col("centroid_dist") / 15.0, F.lit(1.0))).alias("norm_distance"),
    )


def _appended(stream: DataFrame, out: str, check: str):
    return stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", check)


def _in_batches(parts: list[DataFrame], spark, started, read: bool = True) -> DataFrame | None:
    """A stream to which the parts are added one after the other, each a micro-batch of its own; what it wrote."""
    path = files.folder(spark, "stream")
    stream = None
    for part in parts:
        part.write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(parts[0].schema).parquet(f"{path}/in")
        started(stream, f"{path}/out", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/out") if read else None


def _as_stream(df: DataFrame, spark, name: str) -> DataFrame:
    path = files.folder(spark, name)
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


@query(_FOLD + " SELECT conflict_id, event_id, previous_state, requested_state, accepted FROM f WHERE n > 0")
def conflict_fsm_stream(spark, sf_dir):
    """The requests as they might arrive, up to 30 days late and so out of order, in four micro-batches through keyed state that puts them in order of event time: the same log as the batch fold."""
    requests = derived(spark, sf_dir, REQUESTS).select("conflict_id", F.col("event_id").cast("long").alias("event_id"), F.col("ts").cast("timestamp").alias("ts"), "requested_state")
    arrives = F.unix_timestamp("ts") + F.pmod(F.xxhash64("event_id"), F.lit(30 * 86_400))
    told = stored(requests.withColumn("arrives", arrives), "arrivals")
    first, last, end = told.agg(F.min("arrives"), F.max("arrives"), F.max("ts")).first()
    slice_ = F.floor((F.col("arrives") - first) * 4 / (last - first + 1)) if first is not None else F.lit(0)
    parts = [told.where(slice_ == k).drop("arrives") for k in range(4)]
    beat = F.lit(end) + F.expr("interval 32 days")  # after the last request time goes on, so that all are released
    parts.append(spark.range(1).select(F.lit(None).cast("long").alias("conflict_id"), F.lit(None).cast("long").alias("event_id"), beat.alias("ts"), F.lit(None).cast("string").alias("requested_state")))
    return _in_batches(parts, spark, lambda stream, out, check: _appended(lifecycle.stream_lifecycle_in_order(stream), out, check)).drop("late")


@query()
def identity_stream(spark, sf_dir):
    """All boxes as requests in order of id, a stream of four batches, each decided against what earlier ones registered; held against a plain loop in tests/test_brute_force.py."""
    requests, path = observations(spark, sf_dir).select(F.col("id").alias("request_id"), "x0", "y0", "x1", "y1"), files.folder(spark, "identities")
    requests = stored(requests, "identity-requests")
    last = requests.agg(F.max("request_id")).first()[0] or 0
    parts = [requests.where(F.floor(F.col("request_id") * 4 / (last + 1)) == k) for k in range(4)]
    decide = lambda stream, _, check: stream.writeStream.foreachBatch(lifecycle.identity_batches(path)).option("checkpointLocation", check)
    _in_batches(parts, spark, decide, read=False)
    return lifecycle.decisions(spark, path)


@query(_CHANGES + " SELECT count(*) AS records, count(*) FILTER (change_type <> 'No Significant Change') AS to_review FROM t")
def incremental_sync(spark, sf_dir):
    """Changes against the last version as a stream of micro-batches, each written as a version whose catalogue row comes last."""
    path = files.folder(spark, "sync")
    stream = _as_stream(changes(spark, sf_dir).select("k", "change_type"), spark, "changes")
    q = stream.writeStream.foreachBatch(lifecycle.incremental_sync(path)).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = lifecycle.active(spark, path)
    return rows.agg(F.count(F.lit(1)).alias("records"), F.count(F.when(F.col("change_type") != "No Significant Change", 1)).alias("to_review"))


@query(
    """WITH b AS (SELECT CAST(o_custkey AS BIGINT) % 20 AS dataset_id, CAST(month(o_orderdate) AS BIGINT) % 3 AS step, count(*) FILTER (o_orderstatus <> 'O' OR month(o_orderdate) % 3 <> 2) AS records FROM orders GROUP BY 1, 2),
 r AS (SELECT step, sum(records) AS records FROM b GROUP BY step), k AS (SELECT *, records > 0 AS taken FROM r)
 SELECT step, CAST(records AS BIGINT) AS records, CASE WHEN NOT taken THEN 'REFUSED' WHEN step = max(step) FILTER (taken) OVER () THEN 'ACTIVE' ELSE 'ARCHIVED' END AS status FROM k
 UNION ALL SELECT 3, 0, 'REFUSED'"""
)
def dataset_replace(spark, sf_dir):
    """Four imports of one data set, carried out on files: three months' worth each, then one without rows. The last that has rows is active, earlier ones are archived, the empty one is refused and changes nothing."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderstatus", (F.month("o_orderdate") % 3).cast("long").alias("step"))
    orders = orders.where("o_orderstatus <> 'O' or step <> 2")
    path, told = files.folder(spark, "dataset"), []
    for step in range(4):
        taken = files.replace(orders.where(F.col("step") == step), path)
        told.append((step, files.current(spark, path).where(F.col("step") == step).count() if taken else 0, taken))
    last = max(step for step, _, taken in told if taken)
    rows = [(step, n, "REFUSED" if not taken else "ACTIVE" if step == last else "ARCHIVED") for step, n, taken in told]
    return spark.createDataFrame(rows, "step long, records long, status string")


@query(_CHANGES + " SELECT k, CASE change_type WHEN 'New' THEN 'CREATED' WHEN 'Missing' THEN 'RETIRED' ELSE 'REVISED' END AS event FROM t WHERE change_type <> 'No Significant Change'")
def lineage_events(spark, sf_dir):
    kind = F.col("change_type")
    rows = changes(spark, sf_dir).where(kind != "No Significant Change")
    return rows.select("k", F.when(kind == "New", "CREATED").when(kind == "Missing", "RETIRED").otherwise("REVISED").alias("event"))


@query(
    _INFRA
    + f""", n AS (SELECT DISTINCT id FROM j WHERE type = 'electricity'), q AS (SELECT p.id, l.line_id, greatest(0.0::DOUBLE, y0 - (l.y + l.h), l.y - y1) AS d FROM p JOIN l ON l.city = p.city AND l.type = 'electricity' WHERE p.id NOT IN (SELECT id FROM n)),
 b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, line_id) AS r FROM q) SELECT id, line_id, {R('d', 6)} AS distance_m FROM b WHERE r = 1"""
)
def infra_nearest_fallback(spark, sf_dir):
    """Parcels that have no power line within reach: the nearest one of their city, if it has any. Lines are searched by their pieces."""
    kind = lines(spark, sf_dir).where("type = 'electricity'").withColumn("piece", F.explode(F.sequence(F.lit(0), F.lit(99)))).withColumn("x0", F.col("piece") * _PIECE)
    kind = kind.select("line_id", "city", "x0", F.col("y").alias("y0"), (F.col("x0") + _PIECE).alias("x1"), (F.col("y") + F.col("h")).alias("y1"))
    near = infra_pairs(spark, sf_dir).where("type = 'electricity'").select("id").distinct()
    left = parcels(spark, sf_dir).select("id", "city", "x0", "y0", "x1", "y1").join(near, "id", "left_anti")
    found = nearest.nearest(left, kind, keys=["city"], feature_id="line_id")
    return found.select("id", "line_id", g.rounded(F.col("distance"), 6).alias("distance_m"))


@query()
def infra_nearest_lines(spark, sf_dir):
    """The slanted line without width (road, railway, power) nearest to each turned parcel, wherever it is, by the distance of the shapes; held against all pairs in tests/test_nearest.py."""
    thin = line_pieces(spark, sf_dir).join(lines(spark, sf_dir).where("h = 0").select("line_id"), "line_id", "left_semi")
    ends = lambda f: F.array(*(F.struct(f(f"{c}x").alias("x"), f(f"{c}y").alias("y")) for c in "ab"))
    found = nearest.nearest(turned_parcels(spark, sf_dir), thin, feature_id="line_id", distance=lambda q, f: g.ring_line_distance(q("ring"), ends(f)))
    return found.select("id", "line_id", F.col("distance").alias("distance_m"))


#: A slanted line is cut into pieces of this length in x, so that a piece lies in few cells of the range join.
_PIECE = 120.0


def turned_parcels(spark, sf_dir) -> DataFrame:
    """(id, ring, x0, y0, x1, y1): registry parcels turned about their centre by up to 80 degrees, every third with a notch in its upper side."""
    k, half = F.col("k"), lambda a, b: (F.col(b) - F.col(a)) / 2
    w, h, turn = half("x0", "x1"), half("y0", "y1"), F.radians((F.col("k") % 9) * 10.0)
    corners = [(-1.0, -1.0), (1.0, -1.0), (1.0, 1.0), (0.0, 0.25), (-1.0, 1.0)]
    place = lambda a, b: F.struct((F.col("cx") + a * w * F.cos(turn) - b * h * F.sin(turn)).alias("x"), (F.col("cy") + a * w * F.sin(turn) + b * h * F.cos(turn)).alias("y"))
    points = [F.when((k % 3 == 0) | F.lit(c != (0.0, 0.25)), place(*c)) for c in corners]
    rows = parcels(spark, sf_dir).withColumns({"cx": (F.col("x0") + F.col("x1")) / 2, "cy": (F.col("y0") + F.col("y1")) / 2})
    # the ring is made once, not again for each side of its box
    rows = rows.select("id", spatial_join.after_join(F.filter(F.array(*points), lambda p: p.isNotNull())).alias("ring"))
    ends = [f(F.transform("ring", lambda p: p[c])).alias(n) for n, c, f in (("x0", "x", F.array_min), ("y0", "y", F.array_min), ("x1", "x", F.array_max), ("y1", "y", F.array_max))]
    return rows.select("id", "ring", *ends)


def line_pieces(spark, sf_dir) -> DataFrame:
    """(line_id, piece, ax, ay, bx, by and their box): each line from x = 0 to 12,000, rising or falling by up to 90 m, in pieces."""
    slope = (F.col("line_id") % 7 - 3) / 400.0
    rows = lines(spark, sf_dir).select("line_id", "y", slope.alias("slope"), F.explode(F.sequence(F.lit(0), F.lit(99))).alias("piece"))
    ax, bx = F.col("piece") * _PIECE, (F.col("piece") + 1) * _PIECE
    rows = rows.select("line_id", "piece", ax.alias("ax"), (F.col("y") + F.col("slope") * ax).alias("ay"), bx.alias("bx"), (F.col("y") + F.col("slope") * bx).alias("by"))
    return rows.withColumns({"x0": F.col("ax"), "x1": F.col("bx"), "y0": F.least("ay", "by"), "y1": F.greatest("ay", "by")})


@query()
def infra_line_clip(spark, sf_dir):
    """Length of slanted lines within turned and notched parcels, and its share of the outline; held against a plain clip in tests/test_brute_force.py.

    Pieces of lines meet the boxes of parcels in a range join; only such pairs are clipped, a batch at a time, and the pieces of a line are added up.
    """
    pairs = spatial_join.range_pairs(turned_parcels(spark, sf_dir), line_pieces(spark, sf_dir), 0.0, cell=60.0)
    told = pairs.withColumn("inside", clipping.length_inside(tuple(F.col(f"{c}_b") for c in ("ax", "ay", "bx", "by")), F.col("ring_a")))
    outline = g.ring_length(F.concat(F.col("ring_a"), F.slice("ring_a", 1, 1)))
    sums = told.where("inside > 0").groupBy(F.col("id_a").alias("id"), F.col("line_id_b").alias("line_id")).agg(F.sum("inside").alias("length_m"), F.first(outline).alias("outline"))
    return sums.select("id", "line_id", "length_m", (F.col("length_m") / F.col("outline") * 100).alias("pct"))


def turned_members(spark, sf_dir) -> DataFrame:
    """(cluster_id, id, ring): the observations of each cluster, each turned about its centre as its survey might have it."""
    turn = F.radians((F.col("id") % 12) * 7.5)
    w, h = (F.col("x1") - F.col("x0")) / 2, (F.col("y1") - F.col("y0")) / 2
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    place = lambda a, b: F.struct((cx + a * w * F.cos(turn) - b * h * F.sin(turn)).alias("x"), (cy + a * w * F.sin(turn) + b * h * F.cos(turn)).alias("y"))
    members = clusters_of(spark, sf_dir)[0].join(observations(spark, sf_dir), "id")
    return members.select("cluster_id", "id", F.array(place(-1.0, -1.0), place(1.0, -1.0), place(1.0, 1.0), place(-1.0, 1.0)).alias("ring"))


@query()
def merge_polygon_union(spark, sf_dir):
    """Area of the union of the turned outlines of each cluster; held against inclusion and exclusion in tests/test_brute_force.py.

    A cluster has one outline of a source, so its list is short.
    """
    rings = turned_members(spark, sf_dir).groupBy("cluster_id").agg(F.collect_list("ring").alias("rings"))
    return rings.select("cluster_id", F.size("rings").cast("long").alias("members"), clipping.union_area(F.col("rings")).alias("union_area"))


_POINTS_SQL = sql_text(POINTS)


@query(f"SELECT k, CASE WHEN k % 3 = 0 THEN 'chennai' WHEN contains(lower('Survey of ' || CASE k % 5 WHEN 0 THEN 'Mumbai' WHEN 1 THEN 'Delhi NCR' ELSE 'elsewhere' END), 'mumbai') THEN 'mumbai' WHEN contains(lower('Survey of ' || CASE k % 5 WHEN 0 THEN 'Mumbai' WHEN 1 THEN 'Delhi NCR' ELSE 'elsewhere' END), 'delhi') THEN 'delhi' END AS city FROM ({_POINTS_SQL})")
def infra_city_match(spark, sf_dir):
    """The city of a feature by its tag, else by a name within its authority's text."""
    rows = derived(spark, sf_dir, POINTS)
    tag = F.when(F.col("k") % 3 == 0, "chennai")
    text = F.lower(F.concat(F.lit("Survey of "), F.when(F.col("k") % 5 == 0, "Mumbai").when(F.col("k") % 5 == 1, "Delhi NCR").otherwise("elsewhere")))
    return rows.select("k", F.coalesce(tag, F.when(text.contains("mumbai"), "mumbai").when(text.contains("delhi"), "delhi")).alias("city"))


@query()
def metric_area(spark, sf_dir):
    """Square metres of a cell of 0.001 degrees at each point, projected in its zone."""
    rows = derived(spark, sf_dir, POINTS)
    zone = crs.utm_zone(F.col("lon"))
    at = lambda dx, dy: crs.project(F.col("lon") + dx, F.col("lat") + dy, zone)
    ring = F.array(at(0.0, 0.0), at(0.001, 0.0), at(0.001, 0.001), at(0.0, 0.001), at(0.0, 0.0))
    return rows.select("k", ring.alias("ring")).select("k", g.ring_area(F.col("ring")).alias("area_m2"))


@query(f"WITH c(category) AS (VALUES {', '.join(f'({c!r})' for c in packages.CATEGORIES)}) SELECT CAST(o_custkey AS BIGINT) AS package_id, count(DISTINCT category) AS categories FROM orders CROSS JOIN c GROUP BY 1")
def package_categories(spark, sf_dir):
    """Categories present and missing add up to all fifteen for every package."""
    from fieldmerge.sources.derived import FILES

    rows = derived(spark, sf_dir, FILES)
    both = packages.scan(rows).select("package_id", "category").unionByName(packages.missing_categories(rows).select("package_id", "category"))
    return both.groupBy("package_id").agg(F.count(F.lit(1)).alias("categories"))


def _pair_measure(name: str, column, sql: str) -> None:
    """Registers one measure of candidate pairs under its own name."""

    def run(spark, sf_dir):
        pairs = scoring.combined_score(scoring.with_overlap(spatial_join.candidate_pairs(observations(spark, sf_dir))))
        return pairs.select("id_a", "id_b", g.rounded(column(), 6).alias("value"))

    query(PAIRS_SQL + f"SELECT id_a, id_b, {R(sql, 6)} AS value FROM pairs", name=name)(run)


def _area(side: str):
    return g.box_area(g.box(suffix=side))


_pair_measure("iou", lambda: F.col("iou"), "iou")


@query(PAIRS_SQL + f"SELECT id_a, id_b, {R('iou', 6)} AS value FROM pairs")
def bbox_iou(spark, sf_dir):
    """Of the extents of rings: the second of each pair is a box turned by 45 degrees, whose extent is the box again."""
    pairs = spatial_join.candidate_pairs(observations(spark, sf_dir))
    p = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    x0, y0, x1, y1 = g.box(suffix="_b")
    mx, my = (x0 + x1) / 2, (y0 + y1) / 2
    rows = pairs.select("id_a", "id_b", g.box_ring(g.box(suffix="_a")).alias("ring_a"), F.array(p(x0, my), p(mx, y0), p(x1, my), p(mx, y1), p(x0, my)).alias("ring_b"))
    xs, ys = (lambda ring: F.transform(ring, lambda q: q["x"])), (lambda ring: F.transform(ring, lambda q: q["y"]))
    extent = lambda ring: (F.array_min(xs(ring)), F.array_min(ys(ring)), F.array_max(xs(ring)), F.array_max(ys(ring)))
    return rows.select("id_a", "id_b", g.rounded(g.iou(extent("ring_a"), extent("ring_b")), 6).alias("value"))


_pair_measure("centroid_distance", lambda: F.col("centroid_dist"), "centroid_dist")
_pair_measure("norm_centroid_distance", lambda: F.least(F.col("centroid_dist") / 15.0, F.lit(1.0)), "least(centroid_dist / 15.0::DOUBLE, 1.0::DOUBLE)")
_pair_measure("symmetric_difference_area", lambda: _area("_a") + _area("_b") - 2 * F.col("inter_area"), "ga + gb - 2 * inter_area")
_pair_measure("overlap_area", lambda: F.col("inter_area"), "inter_area")
_pair_measure("attribute_similarity", lambda: F.col("attr_sim"), "attr_sim")
_pair_measure("area_similarity", lambda: g.ratio(F.col("area_m2_a"), F.col("area_m2_b"), 0.5), "least(area_a, area_b) / greatest(area_a, area_b)")


@query(f"SELECT id, min(x) AS minx, max(x) AS maxx, min(y) AS miny, max(y) AS maxy FROM (SELECT id, unnest([x0, x1]) AS x, unnest([y0, y1]) AS y FROM ({OBS_SQL})) GROUP BY id")
def geom_bbox(spark, sf_dir):
    """Extents of rings."""
    rows = observations(spark, sf_dir).select("id", g.box_ring(g.box()).alias("ring"))
    of = lambda f, c: f(F.transform("ring", lambda p: p[c]))
    return rows.select("id", of(F.array_min, "x").alias("minx"), of(F.array_max, "x").alias("maxx"), of(F.array_min, "y").alias("miny"), of(F.array_max, "y").alias("maxy"))


@query(f"SELECT id, {R('least(x1 - (x0 + x1) / 2, y1 - (y0 + y1) / 2)', 6)} AS distance FROM ({OBS_SQL})")
def point_to_boundary_distance(spark, sf_dir):
    """From each box's centre to its outline."""
    b = g.box()
    return observations(spark, sf_dir).select("id", g.rounded(g.point_to_box_boundary((b[0] + b[2]) / 2, (b[1] + b[3]) / 2, b), 6).alias("distance"))
