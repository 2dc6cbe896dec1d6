"""Queries that serve and summarise reconciled entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldmerge.functions import geometry as g
from fieldmerge.functions.session import stored
from fieldmerge.operators import quantiles, scoring, spatial_join
from fieldmerge.plans.matching import _ENTITIES, OBS_SQL, PAIRS_SQL, R, clusters_of, decided_pairs, edges_of, entities, observations
from fieldmerge.plans.register import query
from fieldmerge.sources import files

_PLACED = _ENTITIES + ", pos AS (SELECT cluster_id, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, (min(x0) + max(x1)) / 2 AS cx, (min(y0) + max(y1)) / 2 AS cy FROM m GROUP BY cluster_id), pe AS (SELECT ent.*, x0, y0, x1, y1, cx, cy FROM ent JOIN pos USING (cluster_id))"
_REVIEW = "decision <> 'auto_reconciled'"
#: Fixed value: labels that training asks for.
MIN_LABELS = 500
#: Trees of the forest, and its draws that are held at once: a fit keeps a number for each of its rows and trees, on disk where memory ends.
TREES, DRAWS = 100, 10**10


def placed(spark, sf_dir) -> DataFrame:
    """Entities with the extent of their members and its centre."""
    obs = observations(spark, sf_dir).join(clusters_of(spark, sf_dir)[0], "id")
    extent = obs.groupBy("cluster_id").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    extent = extent.withColumns({"cx": (F.col("x0") + F.col("x1")) / 2, "cy": (F.col("y0") + F.col("y1")) / 2})
    return entities(spark, sf_dir).join(extent, "cluster_id").withColumn("needs_review", F.col("decision") != "auto_reconciled")


def _share(df: DataFrame) -> DataFrame:
    return df.withColumn("pct", g.rounded(F.lit(100.0) * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 4))


_PCT = R("100.0::DOUBLE * count(*) / sum(count(*)) OVER ()", 4)


@query(f"SELECT id, x0, y0 FROM ({OBS_SQL}) WHERE x1 >= 100 AND x0 <= 400 AND y1 >= 0 AND y0 <= 90 ORDER BY id LIMIT 5000")
def bbox_filter(spark, sf_dir):
    """Features whose box meets the query box; 5000 at most, the page size of the caller."""
    return observations(spark, sf_dir).where("x1 >= 100 and x0 <= 400 and y1 >= 0 and y0 <= 90").orderBy("id").limit(5000).select("id", "x0", "y0")


@query(_PLACED + " SELECT cluster_id FROM pe WHERE (cx BETWEEN 500 AND 2500 AND cy BETWEEN 0 AND 600) OR cluster_id % 97 = 0")
def centroid_in_bbox(spark, sf_dir):
    """Entities whose centre lies within bounds; those without a centre (here every 97th) are kept."""
    rows = placed(spark, sf_dir).withColumn("cx", F.when(F.col("cluster_id") % 97 != 0, F.col("cx")))
    return rows.where(F.col("cx").isNull() | (F.col("cx").between(500, 2500) & F.col("cy").between(0, 600))).select("cluster_id")


@query(_ENTITIES + " SELECT cluster_id, confidence, decision FROM ent WHERE cluster_id = 29")
def entity_lookup(spark, sf_dir):
    return entities(spark, sf_dir).where("cluster_id = 29").select("cluster_id", "confidence", "decision")


@query(_ENTITIES + f" SELECT cluster_id, confidence FROM ent WHERE {_REVIEW} ORDER BY confidence, cluster_id LIMIT 500")
def review_queue(spark, sf_dir):
    rows = entities(spark, sf_dir).where("decision <> 'auto_reconciled'")
    return rows.orderBy("confidence", "cluster_id").limit(500).select("cluster_id", "confidence")


@query(_ENTITIES + " SELECT cluster_id, round_drift AS difference FROM (SELECT cluster_id, " + R("drift", 4) + f" AS round_drift FROM ent WHERE {_REVIEW}) ORDER BY 2 DESC, 1 LIMIT 100")
def review_items(spark, sf_dir):
    rows = entities(spark, sf_dir).where("decision <> 'auto_reconciled'").select("cluster_id", g.rounded(F.col("centroid_drift_m"), 4).alias("difference"))
    return rows.orderBy(F.col("difference").desc(), "cluster_id").limit(100)


@query(_ENTITIES + f" SELECT cluster_id, CASE WHEN cluster_id % 5 = 0 THEN false ELSE {_REVIEW} END AS needs_review, CASE WHEN cluster_id % 5 = 0 THEN CASE cluster_id % 3 WHEN 0 THEN 'approved' WHEN 1 THEN 'rejected' ELSE 'edited' END END AS review_status FROM ent")
def resolve_entity(spark, sf_dir):
    """Officers' decisions over entities; the latest decision of each counts."""
    rows = entities(spark, sf_dir).select("cluster_id", (F.col("decision") != "auto_reconciled").alias("flag"))
    status = F.when(F.col("cluster_id") % 3 == 0, "approved").when(F.col("cluster_id") % 3 == 1, "rejected").otherwise("edited")
    decided = rows.where("cluster_id % 5 = 0").select("cluster_id", F.explode(F.array(F.struct(F.lit(1).alias("at"), F.lit("edited").alias("s")), F.struct(F.lit(2).alias("at"), status.alias("s")))).alias("d"))
    last = decided.groupBy("cluster_id").agg(F.max_by("d.s", "d.at").alias("review_status"))
    return rows.join(last, "cluster_id", "left").select("cluster_id", F.when(F.col("review_status").isNotNull(), False).otherwise(F.col("flag")).alias("needs_review"), "review_status")


@query(f"SELECT k % 10 AS dataset_id, count(*) AS n FROM ({OBS_SQL}) WHERE k % 10 = 4 GROUP BY 1")
def dataset_isolation(spark, sf_dir):
    rows = observations(spark, sf_dir).withColumn("dataset_id", F.col("k") % 10)
    return rows.where("dataset_id = 4").groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n"))


@query(_PLACED + f" SELECT floor(cx / 100 + 0.5) * 100 AS gx, floor(cy / 100 + 0.5) * 100 AS gy, count(*) AS n, CAST(sum(CAST(floor(confidence * 10000 + 0.5::DOUBLE) AS BIGINT)) AS DOUBLE) / CAST(count(*) AS DOUBLE) / 10000 AS avg_confidence FROM pe GROUP BY 1, 2")
def grid_cluster_summary(spark, sf_dir):
    snap = lambda c: (F.floor(F.col(c) / 100 + F.lit(0.5)) * 100).cast("double")
    return placed(spark, sf_dir).groupBy(snap("cx").alias("gx"), snap("cy").alias("gy")).agg(F.count(F.lit(1)).alias("n"), (F.sum(F.floor(F.col("confidence") * 10000 + F.lit(0.5)).cast("long")).cast("double") / F.count(F.lit(1)).cast("double") / 10000).alias("avg_confidence"))


_BADGE = """, g AS (SELECT CAST(FLOOR(CAST(cluster_id AS DOUBLE) / 20) AS BIGINT) AS dataset_id, count(*) FILTER (decision = 'conflict') AS conflicts, count(*) FILTER (decision = 'review_required') AS reviews, count(*) FILTER (decision = 'auto_reconciled' AND source_count > 1) AS verified, count(*) AS total FROM ent GROUP BY 1)"""


@query(
    _ENTITIES
    + _BADGE
    + """ SELECT dataset_id, CASE WHEN conflicts > 0 OR reviews > 0 THEN 'REVIEW REQUIRED' WHEN dataset_id % 5 = 1 THEN 'PROCESSING' WHEN dataset_id % 7 = 2 THEN 'FAILED' WHEN verified = total AND total > 0 THEN 'READY' ELSE 'ACTIVE' END AS badge FROM g"""
)
def dataset_badge(spark, sf_dir):
    """The badge of a data set: its conflicts and reviews first, then the state of its import (here from its number), then whether all is verified by two sources."""
    n = lambda c: F.count(F.when(c, 1))
    number = F.floor(F.col("cluster_id") / 20).alias("dataset_id")
    rows = entities(spark, sf_dir).groupBy(number).agg(n(F.col("decision") == "conflict").alias("conflicts"), n(F.col("decision") == "review_required").alias("reviews"), n((F.col("decision") == "auto_reconciled") & (F.col("source_count") > 1)).alias("verified"), F.count(F.lit(1)).alias("total"))
    state = F.when(F.col("dataset_id") % 5 == 1, "PROCESSING").when(F.col("dataset_id") % 7 == 2, "FAILED").otherwise("DONE")
    badge = (
        F.when((F.col("conflicts") > 0) | (F.col("reviews") > 0), "REVIEW REQUIRED").when(state == "PROCESSING", "PROCESSING").when(state == "FAILED", "FAILED")
        .when((F.col("verified") == F.col("total")) & (F.col("total") > 0), "READY").otherwise("ACTIVE")
    )
    return rows.select("dataset_id", badge.alias("badge"))


@query(_ENTITIES + f" SELECT {R('100.0::DOUBLE * count(*) FILTER (NOT (decision <> ' + chr(39) + 'auto_reconciled' + chr(39) + ')) / count(*)', 4)} AS verified_pct, count(*) FILTER ({_REVIEW}) AS to_check, {R('100.0::DOUBLE * count(*) FILTER (drift < 1) / count(*)', 4)} AS under_1m_pct, {R('max(drift)', 4)} AS largest FROM ent")
def key_finding(spark, sf_dir):
    n = lambda c: F.count(F.when(c, 1))
    auto = F.col("decision") == "auto_reconciled"
    return entities(spark, sf_dir).agg(
        g.rounded(F.lit(100.0) * n(auto) / F.count(F.lit(1)), 4).alias("verified_pct"), n(~auto).alias("to_check"), g.rounded(F.lit(100.0) * n(F.col("centroid_drift_m") < 1) / F.count(F.lit(1)), 4).alias("under_1m_pct"), g.rounded(F.max("centroid_drift_m"), 4).alias("largest")
    )


@query(_ENTITIES + f" SELECT cluster_id, {R('drift', 4)} AS difference, CASE WHEN avg_iou IS NULL THEN NULL ELSE {R('avg_iou', 6)} END AS agreement, confidence, decision FROM ent")
def difference_vs_agreement(spark, sf_dir):
    return entities(spark, sf_dir).select("cluster_id", g.rounded(F.col("centroid_drift_m"), 4).alias("difference"), g.rounded(F.col("avg_iou_agreement"), 6).alias("agreement"), "confidence", "decision")


@query(_ENTITIES + f", sc AS (SELECT DISTINCT cluster_id, source FROM m) SELECT source, count(*) AS n, {R('100.0::DOUBLE * count(*) / (SELECT count(*) FROM ent)', 4)} AS coverage_pct FROM sc GROUP BY source")
def source_contribution(spark, sf_dir):
    rows = entities(spark, sf_dir).select("cluster_id", F.explode("sources").alias("source"))
    total = entities(spark, sf_dir).agg(F.count(F.lit(1)).alias("total"))
    counts = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(F.broadcast(total)).select("source", "n", g.rounded(F.lit(100.0) * F.col("n") / F.col("total"), 4).alias("coverage_pct"))


@query(_ENTITIES + f" SELECT CASE WHEN drift < 0.5 THEN '<0.5' WHEN drift <= 1 THEN '0.5-1' WHEN drift <= 2 THEN '1-2' ELSE '>2' END AS bucket, count(*) AS n, {_PCT} AS pct FROM ent GROUP BY 1")
def difference_histogram(spark, sf_dir):
    d = F.col("centroid_drift_m")
    bucket = F.when(d < 0.5, "<0.5").when(d <= 1, "0.5-1").when(d <= 2, "1-2").otherwise(">2")
    return _share(entities(spark, sf_dir).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n")))


@query(PAIRS_SQL + f"SELECT least(source_a, source_b) AS s1, greatest(source_a, source_b) AS s2, {R('avg(iou)', 6)} AS mean_iou, {R('avg(centroid_dist)', 6)} AS mean_drift, {R('max(centroid_dist)', 6)} AS max_drift, count(*) AS pairs, count(*) FILTER (decision <> 'auto_reconciled') AS to_review FROM judged GROUP BY 1, 2")
def source_pair_agreement(spark, sf_dir):
    rows = decided_pairs(spark, sf_dir)
    return rows.groupBy(F.least("source_a", "source_b").alias("s1"), F.greatest("source_a", "source_b").alias("s2")).agg(
        g.rounded(F.avg("iou"), 6).alias("mean_iou"), g.rounded(F.avg("centroid_dist"), 6).alias("mean_drift"), g.rounded(F.max("centroid_dist"), 6).alias("max_drift"), F.count(F.lit(1)).alias("pairs"), F.count(F.when(F.col("decision") != "auto_reconciled", 1)).alias("to_review")
    )


@query(PAIRS_SQL + f", q AS (SELECT k_a % 20 AS g, iou, centroid_dist AS d, abs(area_a - area_b) / greatest(area_a, area_b) * 100 AS v FROM edges), w AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY d) AS r, count(*) OVER (PARTITION BY g) AS c FROM q) SELECT g AS dataset_id, {R('avg(iou)', 6)} AS mean_iou, {R('median(iou)', 6)} AS median_iou, {R('avg(d)', 6)} AS mean_drift, {R('max(d) FILTER (r = CAST(floor(0.95::DOUBLE * c) AS BIGINT) + 1)', 6)} AS p95_drift, {R('avg(v)', 6)} AS mean_area_variance, {R('100.0::DOUBLE * count(*) FILTER (d < 2) / count(*)', 4)} AS under_2m_pct FROM w GROUP BY g")
def geometric_quality(spark, sf_dir):
    """Per data set; the 95th percentile is the value of rank floor(0.95 n) + 1. No data set is brought together to be sorted."""
    a, b = F.col("area_m2_a"), F.col("area_m2_b")
    rows = edges_of(spark, sf_dir).select((F.col("k_a") % 20).alias("dataset_id"), "iou", F.col("centroid_dist").alias("d"), (F.abs(a - b) / F.greatest(a, b) * 100).alias("v"))
    rows = stored(rows, "edge_quality")
    ranked = quantiles.at_ranks(rows, ["dataset_id"], quantiles.medians("iou", "i1", "i2") | {"p95": ("d", lambda n: F.floor(F.lit(0.95) * n) + 1)})
    ranked = ranked.select("dataset_id", g.rounded(quantiles.median("i1", "i2"), 6).alias("median_iou"), g.rounded(F.col("p95"), 6).alias("p95_drift"))
    found = rows.groupBy("dataset_id").agg(
        g.rounded(F.avg("iou"), 6).alias("mean_iou"), g.rounded(F.avg("d"), 6).alias("mean_drift"), g.rounded(F.avg("v"), 6).alias("mean_area_variance"),
        g.rounded(F.lit(100.0) * F.count(F.when(F.col("d") < 2, 1)) / F.count(F.lit(1)), 4).alias("under_2m_pct"),
    )
    return found.join(ranked, "dataset_id")


@query(_ENTITIES + f", q AS (SELECT avg(avg_iou) AS i, avg(drift) AS d, avg(confidence) AS c FROM ent) SELECT 'iou' AS metric, {R('i', 6)} AS value, CASE WHEN i >= 0.85 THEN 'PASSED' ELSE 'WARNING' END AS status FROM q UNION ALL SELECT 'drift', {R('d', 6)}, CASE WHEN d <= 0.8 THEN 'PASSED' ELSE 'WARNING' END FROM q UNION ALL SELECT 'confidence', {R('c', 6)}, CASE WHEN c >= 0.8 THEN 'PASSED' ELSE 'WARNING' END FROM q UNION ALL SELECT 'agreement', {R('100 * i - 1.5 * d', 6)}, CASE WHEN 100 * i - 1.5 * d >= 85 THEN 'PASSED' ELSE 'WARNING' END FROM q")
def quality_benchmarks(spark, sf_dir):
    """Unclamped values against their thresholds."""
    q = entities(spark, sf_dir).agg(F.avg("avg_iou_agreement").alias("i"), F.avg("centroid_drift_m").alias("d"), F.avg("confidence").alias("c"))
    line = lambda name, value, good: F.struct(F.lit(name).alias("metric"), g.rounded(value, 6).alias("value"), F.when(good, "PASSED").otherwise("WARNING").alias("status"))
    i, d, c = F.col("i"), F.col("d"), F.col("c")
    rows = F.array(line("iou", i, i >= 0.85), line("drift", d, d <= 0.8), line("confidence", c, c >= 0.8), line("agreement", 100 * i - 1.5 * d, 100 * i - 1.5 * d >= 85))
    return q.select(F.explode(rows).alias("r")).select("r.*")


_TRUTH = PAIRS_SQL + ", truth AS (SELECT id_a, id_b FROM pairs WHERE k_a = k_b AND iou >= 0.3::DOUBLE)"


@query(_TRUTH + f", c AS (SELECT (SELECT count(*) FROM (SELECT id_a, id_b FROM edges INTERSECT SELECT id_a, id_b FROM truth)) AS tp, (SELECT count(*) FROM edges) AS p, (SELECT count(*) FROM truth) AS t) SELECT tp, p - tp AS fp, t - tp AS fn, {R('CAST(tp AS DOUBLE) / p', 3)} AS \"precision\", {R('CAST(tp AS DOUBLE) / t', 3)} AS recall, {R('2.0::DOUBLE * tp / (p + t)', 3)} AS f1 FROM c")
def precision_recall_f1(spark, sf_dir):
    """Accepted edges against pairs of one key that overlap by 0.30 or more."""
    pairs = scoring.combined_score(scoring.with_overlap(spatial_join.candidate_pairs(observations(spark, sf_dir))))
    hit, true = F.col("score") >= 0.5, (F.col("k_a") == F.col("k_b")) & (F.col("iou") >= 0.3)
    n = lambda c: F.count(F.when(c, 1))
    c = pairs.agg(n(hit & true).alias("tp"), n(hit & ~true).alias("fp"), n(~hit & true).alias("fn"))
    share = lambda a, b: g.rounded(F.when(b > 0, a / b).otherwise(0.0), 3)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.select("tp", "fp", "fn", share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"), share(2.0 * tp, 2 * tp + fp + fn).alias("f1"))


@query(_TRUTH + " SELECT 'both' AS part, count(*) AS n FROM (SELECT id_a, id_b FROM edges INTERSECT SELECT id_a, id_b FROM truth) UNION ALL SELECT 'predicted only', count(*) FROM (SELECT id_a, id_b FROM edges EXCEPT SELECT id_a, id_b FROM truth) UNION ALL SELECT 'truth only', count(*) FROM (SELECT id_a, id_b FROM truth EXCEPT SELECT id_a, id_b FROM edges)")
def pair_set_ops(spark, sf_dir):
    pairs = scoring.combined_score(scoring.with_overlap(spatial_join.candidate_pairs(observations(spark, sf_dir))))
    predicted, truth = pairs.where("score >= 0.5").select("id_a", "id_b"), pairs.where("k_a = k_b and iou >= 0.3D").select("id_a", "id_b")
    parts = (("both", predicted.intersect(truth)), ("predicted only", predicted.subtract(truth)), ("truth only", truth.subtract(predicted)))
    found = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n") for name, df in parts]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query(_ENTITIES + " SELECT cluster_id, d AS difference FROM (SELECT cluster_id, " + R("drift", 4) + " AS d FROM ent) ORDER BY d DESC, cluster_id LIMIT 6")
def topk_differences(spark, sf_dir):
    rows = entities(spark, sf_dir).select("cluster_id", g.rounded(F.col("centroid_drift_m"), 4).alias("difference"))
    return rows.orderBy(F.col("difference").desc(), "cluster_id").limit(6)


@query("SELECT CAST(o_custkey AS BIGINT) AS dataset_id, coalesce(arg_max(o_orderkey, (o_orderdate, o_orderkey)) FILTER (o_orderstatus = 'F'), arg_max(o_orderkey, (o_orderdate, o_orderkey))) AS version_id FROM orders GROUP BY 1")
def active_version(spark, sf_dir):
    """The latest version of a chain that is active (status F), else the last."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    at = F.struct("o_orderdate", "o_orderkey")
    active = F.col("o_orderstatus") == "F"
    return orders.groupBy(F.col("o_custkey").cast("long").alias("dataset_id")).agg(F.coalesce(F.max_by(F.when(active, F.col("o_orderkey")), F.when(active, at)), F.max_by("o_orderkey", at)).alias("version_id"))


@query(_PLACED + ", old AS (SELECT cluster_id, 0.5::DOUBLE AS confidence, true AS needs_review, x0 FROM pe WHERE cluster_id % 2 = 0) SELECT n.cluster_id, n.confidence, n.decision <> 'auto_reconciled' AS needs_review, coalesce(old.x0 - 1, n.x0) AS x0 FROM pe n LEFT JOIN old USING (cluster_id)")
def snk_canonical_upsert(spark, sf_dir):
    """New entities over a stored table (the even ones, a metre off), written and read back: of those that exist only confidence and review change."""
    new = placed(spark, sf_dir).select("cluster_id", "confidence", "needs_review", "x0")
    path = files.folder(spark, "canonical")
    files.upsert(new.where("cluster_id % 2 = 0").select("cluster_id", F.lit(0.5).alias("confidence"), F.lit(True).alias("needs_review"), (F.col("x0") - 1).alias("x0")), path, "cluster_id", ["confidence", "needs_review"])
    files.upsert(new, path, "cluster_id", ["confidence", "needs_review"])
    return files.current(spark, path)


@query(_PLACED + f" SELECT cluster_id AS parcel_id, array_to_string(sources, ';') AS sources, source_count, {R('drift', 3)} AS drift_m, confidence, decision, {_REVIEW} AS needs_review, {R('cx', 3)} AS cx, {R('cy', 3)} AS cy, {R('(x1 - x0) * (y1 - y0)', 2)} AS area_m2 FROM pe")
def snk_csv_ledger(spark, sf_dir):
    """The ten columns of the parcel ledger, written as CSV and read back."""
    rows = placed(spark, sf_dir)
    told = rows.select(
        F.col("cluster_id").alias("parcel_id"), F.array_join("sources", ";").alias("sources"), "source_count", g.rounded(F.col("centroid_drift_m"), 3).alias("drift_m"), "confidence", "decision", "needs_review",
        g.rounded(F.col("cx"), 3).alias("cx"), g.rounded(F.col("cy"), 3).alias("cy"), g.rounded((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")), 2).alias("area_m2"),
    )
    path = files.folder(spark, "ledger")
    files.write_csv(told, path)
    return files.read_attributes(spark, path, "parcel_id long, sources string, source_count long, drift_m double, confidence double, decision string, needs_review boolean, cx double, cy double, area_m2 double")


@query(_PLACED + f" SELECT cluster_id AS dataset, 'e-' || CAST(cluster_id AS VARCHAR) AS uid, confidence, {_REVIEW} AS needs_review, {R('(x1 - x0) * (y1 - y0)', 2)} AS area_m2 FROM pe".replace("cluster_id AS dataset", "CAST(FLOOR(CAST(cluster_id AS DOUBLE) / 1000) AS BIGINT) AS dataset"))
def snk_geojson_export(spark, sf_dir):
    """A feature collection for each 1,000 ids, written as text and read back as features."""
    rows = placed(spark, sf_dir)
    ring = F.array(*(F.array(F.col(x), F.col(y)) for x, y in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"), ("x0", "y0"))))
    area = g.rounded((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")), 2)
    dataset = F.floor(F.col("cluster_id") / 1000)
    told = F.struct(dataset.alias("dataset"), F.concat(F.lit("e-"), F.col("cluster_id").cast("string")).alias("uid"), "confidence", "needs_review", area.alias("area_m2"))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"), told.alias("properties"))
    sets = rows.groupBy(dataset.alias("dataset")).agg(F.collect_list(feature).alias("features"))
    path = files.folder(spark, "export")
    files.write_lines(sets.select(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), "features")).alias("value")), path)
    back = files.read_geojson(spark, path, multi_line=False)
    of = lambda name, kind: F.element_at("properties", name).cast(kind).alias(name)
    return back.select(of("dataset", "long"), of("uid", "string"), of("confidence", "double"), of("needs_review", "boolean"), of("area_m2", "double"))


@query(
    _ENTITIES
    + f""" SELECT cluster_id % 50 AS dataset_id, count(*) FILTER (decision = 'auto_reconciled') AS auto, count(*) FILTER (decision = 'review_required') AS review, count(*) FILTER (decision = 'conflict') AS conflict, {R('max(drift)', 3)} AS largest,
 string_agg(CASE WHEN decision <> 'auto_reconciled' THEN CAST(cluster_id AS VARCHAR) || ':' || decision END, ',' ORDER BY cluster_id) AS audit FROM ent GROUP BY 1"""
)
def snk_json_package(spark, sf_dir):
    """One package per data set: its summary as a JSON line, and its audit log, an event for each entity that was not merged by itself, as lines of a second file; written, read back and put together."""
    rows = entities(spark, sf_dir).withColumn("dataset_id", F.col("cluster_id") % 50)
    n = lambda d: F.count(F.when(F.col("decision") == d, 1))
    found = rows.groupBy("dataset_id").agg(F.struct(n("auto_reconciled").alias("auto"), n("review_required").alias("review"), n("conflict").alias("conflict"), g.rounded(F.max("centroid_drift_m"), 3).alias("largest")).alias("summary"))
    events = rows.where("decision <> 'auto_reconciled'").select("dataset_id", F.lit("DECIDED").alias("event"), F.struct("cluster_id", "decision", "confidence").alias("subject"))
    path = files.folder(spark, "package")
    for name, part in (("summary", found.select(F.struct("dataset_id", "summary").alias("o"))), ("audit", events.select(F.struct("dataset_id", "event", "subject").alias("o")))):
        files.write_lines(part.select(F.to_json("o").alias("value")), f"{path}/{name}")
    summary = spark.read.schema("dataset_id long, summary struct<auto: long, review: long, conflict: long, largest: double>").json(f"{path}/summary")
    log = spark.read.schema("dataset_id long, event string, subject struct<cluster_id: long, decision: string, confidence: double>").json(f"{path}/audit")
    # for the comparison the log of a data set is told in one line
    told = log.groupBy("dataset_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("subject.cluster_id", "subject.decision"))), lambda x: F.concat_ws(":", x["cluster_id"], x["decision"])), ",").alias("audit"))
    return summary.join(told, "dataset_id", "left").select("dataset_id", "summary.*", "audit")


@query(_ENTITIES + " SELECT unnest(['started', 'complete']) AS status, unnest([CAST(NULL AS BIGINT), (SELECT count(*) FROM obs)]) AS observations, unnest([CAST(NULL AS BIGINT), (SELECT count(*) FROM edges)]) AS edges, unnest([CAST(NULL AS BIGINT), (SELECT count(*) FROM ent)]) AS entities")
def snk_run_log(spark, sf_dir):
    """A log to which a run appends a row as it starts and one with its counts when it is done; status tells which a row is."""
    path = files.folder(spark, "runs")
    schema = "run long, started_at timestamp, completed_at timestamp, observations long, edges long, entities long"
    start = spark.range(1).select(F.lit(1).cast("long").alias("run"), F.current_timestamp().alias("started_at"), F.lit(None).cast("timestamp").alias("completed_at"), *(F.lit(None).cast("long").alias(c) for c in ("observations", "edges", "entities")))
    start.write.mode("append").parquet(path)
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    counts = count(observations(spark, sf_dir), "observations").join(F.broadcast(count(clusters_of(spark, sf_dir)[1], "edges"))).join(F.broadcast(count(entities(spark, sf_dir), "entities")))
    begun = spark.read.schema(schema).parquet(path).select("run", "started_at")
    counts.join(begun).select("run", "started_at", F.current_timestamp().alias("completed_at"), "observations", "edges", "entities").write.mode("append").parquet(path)
    log = spark.read.schema(schema).parquet(path)
    return log.select(F.when(F.col("completed_at").isNotNull(), "complete").otherwise("started").alias("status"), "observations", "edges", "entities")


@query(_ENTITIES + ", l AS (SELECT cluster_id FROM m GROUP BY cluster_id HAVING max(extraction_confidence) >= 0.9::DOUBLE) SELECT (SELECT count(*) FROM l) AS labelled, (SELECT count(*) FROM l) >= 500 AS ready")
def ml_readiness(spark, sf_dir):
    """Labelled rows (here entities with a confident extraction), of which training needs 500."""
    return entities(spark, sf_dir).agg(F.count(F.when(F.col("extraction_confidence") >= 0.9, 1)).alias("labelled")).withColumn("ready", F.col("labelled") >= MIN_LABELS)


def labelled_pairs(spark, sf_dir) -> DataFrame:
    """Pair features of all candidate pairs with a reviewer's label (here whether one key made both) and the fold of the key."""
    pairs = scoring.with_overlap(spatial_join.candidate_pairs(observations(spark, sf_dir)))
    pairs = pairs.withColumns({"label": (F.col("k_a") == F.col("k_b")).cast("double"), "fold": F.col("k_a") % 5})
    return scoring.pair_features(pairs, keep=["k_a", "label", "fold"])


@query()
def train_match_classifier(spark, sf_dir):
    """A random forest on the twelve pair features where there are 500 labels; held-out rows and accuracy by label, or none below that.

    Where rows are so many that their draws for all trees are more than DRAWS, the forest is fitted in parts, each on all rows: a part with
    fewer trees (its seed 42 and a million more for each part before it) holds less at once, and the votes of all trees are added up as one forest does.
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rows = labelled_pairs(spark, sf_dir)
    names = [c for c in rows.columns if c.startswith("f_")]
    data = stored(rows.select("label", "fold", *names), "labelled")
    labels = data.where("fold <> 0").count()
    if labels < MIN_LABELS:
        return data.limit(0).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.avg("label").alias("accuracy"))
    data = VectorAssembler(inputCols=names, outputCol="features").transform(data).select("features", "label", "fold")
    at_once = max(1, min(TREES, DRAWS // labels))
    found, votes = data.where("fold = 0"), None
    for part, first in enumerate(range(0, TREES, at_once)):
        forest = RandomForestClassifier(numTrees=min(at_once, TREES - first), maxDepth=8, seed=42 + part * 1_000_000, rawPredictionCol="raw", probabilityCol="", predictionCol="")
        found = forest.fit(data.where("fold <> 0")).transform(found).withColumn("own", vector_to_array("raw")).drop("raw")
        total = F.col("own") if votes is None else F.zip_with("votes", "own", lambda a, b: a + b)
        found, votes = found.withColumn("votes", total).drop("own"), "votes"
    said = F.array_position("votes", F.array_max("votes")) - 1  # of equal votes the first class
    return found.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.avg((said == F.col("label")).cast("double")).alias("accuracy"))
