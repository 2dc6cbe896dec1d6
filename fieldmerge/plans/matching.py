"""Queries from observations to decisions: sources, candidate joins, scores, clusters, confidence, policy and their summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldmerge.config import MATCH
from fieldmerge.functions import geometry as g
from fieldmerge.functions.session import stored
from fieldmerge.operators import clustering, policy, scoring, spatial_join
from fieldmerge.operators.graph import connected_components
from fieldmerge.plans.register import query
from fieldmerge.sources import files
from fieldmerge.sources.derived import OBS, derived, sql_text

R6 = lambda x: f"FLOOR(({x}) * 1000000.0::DOUBLE + 0.5) / 1000000.0::DOUBLE"
R = lambda x, n: f"CAST(FLOOR(({x}) * {10**n}::DOUBLE + 0.5::DOUBLE) AS DOUBLE) / {10**n}::DOUBLE"
OBS_SQL = sql_text(OBS)

#: DuckDB: observations, candidate pairs by neighbouring 60 m cells, overlap and score.
PAIRS_SQL = f"""
WITH obs AS ({OBS_SQL}),
near AS (SELECT o.*, CAST(FLOOR(x0 / 60) AS BIGINT) + dx AS gx, CAST(FLOOR(y0 / 60) AS BIGINT) + dy AS gy
         FROM obs o, (SELECT unnest([-1, 0, 1]) AS dx), (SELECT unnest([-1, 0, 1]) AS dy)),
cand AS (
  SELECT a.id AS id_a, b.id AS id_b, a.k AS k_a, b.k AS k_b, a.source AS source_a, b.source AS source_b, a.x0 AS ax0, a.y0 AS ay0, a.x1 AS ax1, a.y1 AS ay1,
         b.x0 AS bx0, b.y0 AS by0, b.x1 AS bx1, b.y1 AS by1, a.area_m2 AS area_a, b.area_m2 AS area_b, a.building_type AS type_a, b.building_type AS type_b,
         a.survey_no AS no_a, b.survey_no AS no_b, a.extraction_confidence AS ext_a, b.extraction_confidence AS ext_b
  FROM obs a JOIN near b ON CAST(FLOOR(a.x0 / 60) AS BIGINT) = b.gx AND CAST(FLOOR(a.y0 / 60) AS BIGINT) = b.gy
  WHERE a.id < b.id AND a.source <> b.source AND a.x0 - 15 <= b.x1 AND a.x1 + 15 >= b.x0 AND a.y0 - 15 <= b.y1 AND a.y1 + 15 >= b.y0),
over AS (
  SELECT *, greatest(0.0::DOUBLE, least(ax1, bx1) - greatest(ax0, bx0)) * greatest(0.0::DOUBLE, least(ay1, by1) - greatest(ay0, by0)) AS inter_area,
         (ax1 - ax0) * (ay1 - ay0) AS ga, (bx1 - bx0) * (by1 - by0) AS gb,
         sqrt(((ax0 + ax1) / 2 - (bx0 + bx1) / 2) * ((ax0 + ax1) / 2 - (bx0 + bx1) / 2) + ((ay0 + ay1) / 2 - (by0 + by1) / 2) * ((ay0 + ay1) / 2 - (by0 + by1) / 2)) AS centroid_dist
  FROM cand),
sim AS (
  SELECT *, CASE WHEN ga + gb - inter_area > 0 THEN inter_area / (ga + gb - inter_area) ELSE 0.0::DOUBLE END AS iou,
         CASE WHEN type_a <> 'unknown' AND type_b <> 'unknown' THEN 0.75::DOUBLE * (least(area_a, area_b) / greatest(area_a, area_b)) + 0.25::DOUBLE * (CASE WHEN type_a = type_b THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)
              ELSE least(area_a, area_b) / greatest(area_a, area_b) END AS attr_sim
  FROM over),
pairs AS (SELECT *, 0.5::DOUBLE * iou + 0.3::DOUBLE * (1.0::DOUBLE - least(centroid_dist / 15.0::DOUBLE, 1.0::DOUBLE)) + 0.2::DOUBLE * attr_sim AS score FROM sim),
edges AS (SELECT * FROM pairs WHERE score >= 0.5::DOUBLE),
decided AS (
  SELECT *, {R("least(1.0::DOUBLE, greatest(0.0::DOUBLE, 0.5::DOUBLE * score + 0.35::DOUBLE * iou + 0.15::DOUBLE * 0.85::DOUBLE))", 4)} AS confidence FROM edges),
judged AS (
  SELECT *, CASE WHEN {R("centroid_dist", 4)} >= 2 THEN 'conflict' WHEN confidence >= 0.85::DOUBLE THEN 'auto_reconciled' WHEN confidence >= 0.70::DOUBLE THEN 'review_required' ELSE 'conflict' END AS decision FROM decided)
"""


def observations(spark, sf_dir) -> DataFrame:
    return derived(spark, sf_dir, OBS)


def scored_pairs(spark, sf_dir) -> DataFrame:
    return scoring.combined_score(scoring.with_overlap(spatial_join.candidate_pairs(observations(spark, sf_dir))))


def edges_of(spark, sf_dir) -> DataFrame:
    return scoring.match_edges(scored_pairs(spark, sf_dir))


def decided_pairs(spark, sf_dir) -> DataFrame:
    """Accepted pairs with confidence and decision; extraction 0.85, match score the two-step score."""
    pairs = edges_of(spark, sf_dir).withColumn("confidence", policy.confidence(F.col("score"), F.col("iou"), F.lit(0.85)))
    return pairs.withColumn("decision", policy.decision(F.col("confidence"), F.col("centroid_dist")))


@query(f"SELECT id, k, source, x0, y0, x1, y1, area_m2 FROM ({OBS_SQL}) WHERE x0 >= 3000 AND x0 < 6000")
def src_raw_features(spark, sf_dir):
    """A scan of one tile column: features whose left edge lies in it."""
    return observations(spark, sf_dir).where("x0 >= 3000 and x0 < 6000").select("id", "k", "source", "x0", "y0", "x1", "y1", "area_m2")


@query(f"SELECT id, x0, y0, x1, y1 FROM ({OBS_SQL}) WHERE source = 'imagery'")
def src_by_source(spark, sf_dir):
    return observations(spark, sf_dir).where(F.col("source") == "imagery").select("id", "x0", "y0", "x1", "y1")


_STANDARD = """SELECT CASE source WHEN 'registry' THEN 'reg-' WHEN 'survey' THEN 'sur-' ELSE 'img-' END || CAST(id AS VARCHAR) AS entity_uid, source, 'building' AS feature_type,
 CASE WHEN building_type = '' THEN 'unknown' ELSE coalesce(building_type, 'unknown') END AS building_type, area_m2,
 CASE WHEN source = 'imagery' THEN extraction_confidence END AS extraction_confidence FROM ({obs})"""


@query(_STANDARD.format(obs=OBS_SQL))
def src_standardise(spark, sf_dir):
    """Per-source projections to the common columns, stacked by name."""
    obs, parts = observations(spark, sf_dir), []
    for source, prefix in (("registry", "reg-"), ("survey", "sur-"), ("imagery", "img-")):
        own = F.col("extraction_confidence") if source == "imagery" else F.lit(None).cast("double")
        kind = F.when(F.coalesce("building_type", F.lit("")) == "", "unknown").otherwise(F.col("building_type"))
        parts.append(obs.where(F.col("source") == source).select(F.concat(F.lit(prefix), F.col("id").cast("string")).alias("entity_uid"), F.lit(source).alias("source"), F.lit("building").alias("feature_type"), kind.alias("building_type"), "area_m2", own.alias("extraction_confidence")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"SELECT source, count(*) AS n FROM ({OBS_SQL}) GROUP BY source")
def source_union(spark, sf_dir):
    obs = observations(spark, sf_dir)
    parts = [obs.where(F.col("source") == s) for s in ("registry", "survey", "imagery")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT id, source FROM ({OBS_SQL})")
def snk_raw_features(spark, sf_dir):
    """An append that ignores known ids: all observations, some twice, onto a stored table that has the even keys; the table as it is then."""
    obs, path = observations(spark, sf_dir).select("id", "source", "k"), files.folder(spark, "raw")
    obs.where("k % 2 = 0").write.parquet(path)
    files.append_new(obs.unionByName(obs.where("k % 3 = 0")), path, ["id"])
    return spark.read.parquet(path).select("id", "source")


@query(PAIRS_SQL + f"SELECT id_a, id_b, {R('score', 6)} AS score FROM edges")
def snk_match_edges(spark, sf_dir):
    """Edges onto a stored table, which has those of every third key; the table as it is then."""
    edges = edges_of(spark, sf_dir).select("id_a", "id_b", "k_a", g.rounded(F.col("score"), 6).alias("score"))
    path = files.folder(spark, "match_edges")
    edges.where("k_a % 3 = 0").write.parquet(path)
    files.append_new(edges, path, ["id_a", "id_b"])
    return spark.read.parquet(path).select("id_a", "id_b", "score")


@query(PAIRS_SQL + "SELECT id_a, id_b, source_a, source_b FROM cand")
def candidate_pairs(spark, sf_dir):
    return spatial_join.candidate_pairs(observations(spark, sf_dir)).select("id_a", "id_b", "source_a", "source_b")


_AB = f"""WITH a AS (SELECT * FROM ({OBS_SQL}) WHERE source = 'registry'), b AS (SELECT * FROM ({OBS_SQL}) WHERE source = 'survey'),
near AS (SELECT o.*, CAST(FLOOR(x0 / 60) AS BIGINT) + dx AS gx, CAST(FLOOR(y0 / 60) AS BIGINT) + dy AS gy FROM b o, (SELECT unnest([-1, 0, 1]) AS dx), (SELECT unnest([-1, 0, 1]) AS dy)),
c AS (SELECT a.id AS id_a, b.id AS id_b FROM a JOIN near b ON CAST(FLOOR(a.x0 / 60) AS BIGINT) = b.gx AND CAST(FLOOR(a.y0 / 60) AS BIGINT) = b.gy
      WHERE a.x0 - 15 <= b.x1 AND a.x1 + 15 >= b.x0 AND a.y0 - 15 <= b.y1 AND a.y1 + 15 >= b.y0)"""


@query(_AB + f" SELECT (SELECT count(*) FROM a) AS n_a, (SELECT count(*) FROM b) AS n_b, count(*) AS candidates, {R('100 * (1 - CAST(count(*) AS DOUBLE) / (CAST((SELECT count(*) FROM a) AS DOUBLE) * CAST((SELECT count(*) FROM b) AS DOUBLE)))', 6)} AS reduction_pct FROM c")
def candidate_pairs_ab(spark, sf_dir):
    """Two data sets: candidates and how much of all pairs they spare."""
    obs = observations(spark, sf_dir)
    a, b = obs.where("source = 'registry'"), obs.where("source = 'survey'")
    pairs = spatial_join.range_pairs(a, b, 15.0).agg(F.count(F.lit(1)).alias("candidates"))
    sizes = obs.agg(F.count(F.when(F.col("source") == "registry", 1)).alias("n_a"), F.count(F.when(F.col("source") == "survey", 1)).alias("n_b"))
    both = sizes.join(F.broadcast(pairs))
    return both.withColumn("reduction_pct", g.rounded(F.lit(100) * (F.lit(1) - F.col("candidates").cast("double") / (F.col("n_a").cast("double") * F.col("n_b").cast("double"))), 6))


@query(PAIRS_SQL + "SELECT id_a, id_b FROM pairs WHERE iou >= 0.30::DOUBLE")
def strict_overlap_pairs(spark, sf_dir):
    pairs = scoring.with_overlap(spatial_join.candidate_pairs(observations(spark, sf_dir), radius=0.0))
    return pairs.where(F.col("iou") >= MATCH.strict_iou).select("id_a", "id_b")


@query(PAIRS_SQL + f"SELECT id_a, id_b, {R('iou', 6)} AS iou FROM pairs WHERE iou > 0.05::DOUBLE")
def intersecting_pairs(spark, sf_dir):
    pairs = scoring.with_overlap(spatial_join.candidate_pairs(observations(spark, sf_dir), radius=0.0))
    return pairs.where(F.col("iou") > 0.05).select("id_a", "id_b", g.rounded(F.col("iou"), 6).alias("iou"))


_BEST = """SELECT id_b, id_a, {iou} AS iou FROM (SELECT *, row_number() OVER (PARTITION BY id_b ORDER BY iou DESC, id_a) AS r FROM pairs WHERE source_a = 'registry' OR source_b = 'registry') WHERE r = 1"""


@query(PAIRS_SQL + _BEST.format(iou=R("iou", 6)))
def best_candidate_join(spark, sf_dir):
    """For each second observation the registry candidate that overlaps most; the smaller id wins ties."""
    pairs = scoring.with_overlap(spatial_join.candidate_pairs(observations(spark, sf_dir))).where("source_a = 'registry' or source_b = 'registry'")
    return clustering.best_per_group(pairs, ["id_b"], [F.col("iou").desc(), F.col("id_a")]).select("id_b", "id_a", g.rounded(F.col("iou"), 6).alias("iou"))


@query(PAIRS_SQL + "SELECT CASE WHEN source_a = 'registry' THEN id_a ELSE id_b END AS registry_id, CASE WHEN source_a = 'registry' THEN id_b ELSE id_a END AS survey_id FROM edges WHERE (source_a = 'registry' AND source_b = 'survey') OR (source_a = 'survey' AND source_b = 'registry')")
def edge_to_source_join(spark, sf_dir):
    """Stored edges joined with their features twice and turned to (registry, survey)."""
    obs = observations(spark, sf_dir)
    edges = edges_of(spark, sf_dir).select("id_a", "id_b")
    one = obs.select(F.col("id").alias("id_a"), F.col("source").alias("sa"))
    two = obs.select(F.col("id").alias("id_b"), F.col("source").alias("sb"))
    both = edges.join(one, "id_a").join(two, "id_b").where("(sa = 'registry' and sb = 'survey') or (sa = 'survey' and sb = 'registry')")
    swap = F.col("sa") == "registry"
    return both.select(F.when(swap, F.col("id_a")).otherwise(F.col("id_b")).alias("registry_id"), F.when(swap, F.col("id_b")).otherwise(F.col("id_a")).alias("survey_id"))


@query(PAIRS_SQL + "SELECT id, source FROM obs o WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.id_a = o.id OR e.id_b = o.id)".replace("NOT EXISTS (SELECT 1 FROM edges e WHERE e.id_a = o.id OR e.id_b = o.id)", "id NOT IN (SELECT id_a FROM edges UNION ALL SELECT id_b FROM edges)"))
def unmatched_features(spark, sf_dir):
    edges = edges_of(spark, sf_dir)
    seen = edges.select(F.explode(F.array("id_a", "id_b")).alias("id"))
    return observations(spark, sf_dir).select("id", "source").join(seen, "id", "left_anti")


@query(PAIRS_SQL + f"SELECT id_a, id_b, {R('attr_sim', 6)} AS attr_sim, {R('iou', 6)} AS iou, {R('centroid_dist', 6)} AS centroid_dist, {R('score', 6)} AS score FROM pairs")
def combined_score(spark, sf_dir):
    return scored_pairs(spark, sf_dir).select("id_a", "id_b", *(g.rounded(F.col(c), 6).alias(c) for c in ("attr_sim", "iou", "centroid_dist", "score")))


@query(PAIRS_SQL + f"SELECT id_a, id_b, {R('score', 6)} AS score FROM edges")
def match_edges(spark, sf_dir):
    return edges_of(spark, sf_dir).select("id_a", "id_b", g.rounded(F.col("score"), 6).alias("score"))


@query(PAIRS_SQL + f"SELECT id_a, id_b, {R('ga + gb - 2 * inter_area', 6)} AS symdiff, {R('inter_area', 6)} AS overlap, {R('inter_area / ga', 6)} AS ratio_a, {R('inter_area / gb', 6)} AS ratio_b FROM pairs")
def overlap_measures(spark, sf_dir):
    pairs = scoring.with_overlap(spatial_join.candidate_pairs(observations(spark, sf_dir)))
    a, b = g.box_area(g.box(suffix="_a")), g.box_area(g.box(suffix="_b"))
    i = F.col("inter_area")
    return pairs.select("id_a", "id_b", g.rounded(a + b - 2 * i, 6).alias("symdiff"), g.rounded(i, 6).alias("overlap"), g.rounded(i / a, 6).alias("ratio_a"), g.rounded(i / b, 6).alias("ratio_b"))


_IDS = """, ids AS (SELECT *, lower(trim(no_a)) AS ra, lower(trim(no_b)) AS rb,
 regexp_replace(regexp_replace(lower(no_a), '[^a-z0-9]', '', 'g'), '^(syno|surveyno|survey|plotno|plot|sy)', '') AS na,
 regexp_replace(regexp_replace(lower(no_b), '[^a-z0-9]', '', 'g'), '^(syno|surveyno|survey|plotno|plot|sy)', '') AS nb FROM pairs),
named AS (SELECT *, CASE WHEN ra = rb THEN 'EXACT_MATCH' WHEN na = nb THEN 'NORMALIZED_EQUIVALENT' WHEN contains(na, nb) OR contains(nb, na) THEN 'SUBSTRING_CONTAINMENT' ELSE 'FUZZY_STRING_SIMILARITY' END AS id_method FROM ids)"""


def named_pairs(spark, sf_dir) -> DataFrame:
    obs = scoring.with_plain_identifier(observations(spark, sf_dir), "survey_no")
    return scoring.identifier_similarity(spatial_join.candidate_pairs(obs), "survey_no_a", "survey_no_b", ("survey_no_plain_a", "survey_no_plain_b"))


@query(PAIRS_SQL + _IDS + " SELECT id_a, id_b, id_method FROM named")
def identifier_method(spark, sf_dir):
    """The rule that settles the identifiers of every candidate pair, or that they are left to string comparison."""
    return named_pairs(spark, sf_dir).select("id_a", "id_b", "id_method")


@query()
def identifier_similarity(spark, sf_dir):
    """All candidate pairs; SQL has no sequence comparison, so tests/test_brute_force.py holds the scores against difflib."""
    return named_pairs(spark, sf_dir).select("id_a", "id_b", "id_method", "id_score")


@query()
def multi_signal_score(spark, sf_dir):
    return classed_pairs(spark, sf_dir).select("id_a", "id_b", g.rounded(F.col("candidate_score"), 6).alias("candidate_score"), "match_class")


_Q = "least(1.0::DOUBLE, greatest(0.0::DOUBLE, 12.566370614359172::DOUBLE * {a} / ((2.0::DOUBLE * ({w} + {h})) * (2.0::DOUBLE * ({w} + {h})))))"
_QA, _QB = _Q.format(a="ga", w="(ax1 - ax0)", h="(ay1 - ay0)"), _Q.format(a="gb", w="(bx1 - bx0)", h="(by1 - by0)")
_PA, _PB = "(2.0::DOUBLE * ((ax1 - ax0) + (ay1 - ay0)))", "(2.0::DOUBLE * ((bx1 - bx0) + (by1 - by0)))"


def classed_pairs(spark, sf_dir) -> DataFrame:
    obs = scoring.with_plain_identifier(observations(spark, sf_dir), "survey_no")
    return scoring.multi_signal(scoring.with_overlap(spatial_join.candidate_pairs(obs)))


@query()
def match_class(spark, sf_dir):
    """Eight-signal score and class of every candidate pair; held against a plain computation in tests/test_brute_force.py."""
    return classed_pairs(spark, sf_dir).select("id_a", "id_b", g.rounded(F.col("candidate_score"), 6).alias("candidate_score"), "match_class")


@query()
def match_benchmark(spark, sf_dir):
    """Pairs of each class, of how many candidates and how many pairs of different sources there could be."""
    counts = observations(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).cast("double").alias("c"))
    possible = counts.agg(((F.sum("c") * F.sum("c") - F.sum(F.col("c") * F.col("c"))) / 2).alias("possible"))
    classes = classed_pairs(spark, sf_dir).groupBy("match_class").agg(F.count(F.lit(1)).alias("n"))
    rows = classes.withColumn("candidates", F.sum("n").over(Window.partitionBy(F.lit(1)))).join(F.broadcast(possible))
    return rows.withColumn("reduction_pct", g.rounded(100 * (1 - F.col("candidates") / F.col("possible")), 6))


@query()
def match_benchmark_by_sources(spark, sf_dir):
    """For each two sources the sizes of both sets, the candidate pairs and their classes, of how many pairs there could be."""
    counts = observations(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("c"))
    size = lambda s: counts.select(F.col("source").alias(f"source_{s}"), F.col("c").alias(f"n_{s}"))
    one, two = F.least("source_a", "source_b"), F.greatest("source_a", "source_b")
    classes = classed_pairs(spark, sf_dir).groupBy(one.alias("source_a"), two.alias("source_b"), "match_class").agg(F.count(F.lit(1)).alias("n"))
    rows = classes.withColumn("candidates", F.sum("n").over(Window.partitionBy("source_a", "source_b"))).join(size("a"), "source_a").join(size("b"), "source_b")
    rows = rows.withColumn("possible", F.col("n_a").cast("double") * F.col("n_b"))
    return rows.withColumn("reduction_pct", g.rounded(100 * (1 - F.col("candidates") / F.col("possible")), 6))


@query()
def sorted_matches(spark, sf_dir):
    """The 500 best of all candidate pairs by rounded score and ids."""
    return match_class(spark, sf_dir).orderBy(F.col("candidate_score").desc(), "id_a", "id_b").limit(500).select("id_a", "id_b", "candidate_score")


_DIFF = lambda a, b: f"CASE WHEN greatest({a}, {b}) > 0 THEN abs({a} - {b}) / greatest({a}, {b}) * 100 ELSE 0.0::DOUBLE END"


@query(
    PAIRS_SQL
    + f"""SELECT id_a, id_b, {R('iou', 4)} AS f_iou, {R('centroid_dist', 3)} AS f_drift, {R(_DIFF('ga', 'gb'), 2)} AS f_area_diff_pct, {R(_DIFF(_PA, _PB), 2)} AS f_perimeter_diff_pct,
 {R(_QA, 4)} AS f_compactness_a, {R(_QB, 4)} AS f_compactness_b, 5.0::DOUBLE AS f_vertices_a, 5.0::DOUBLE AS f_vertices_b, {R('inter_area / ga', 4)} AS f_overlap_a, {R('inter_area / gb', 4)} AS f_overlap_b,
 CASE WHEN source_a <> source_b THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS f_sources, coalesce(greatest(ext_a, ext_b), 0.85::DOUBLE) AS f_extraction FROM pairs"""
)
def pair_features_12(spark, sf_dir):
    return scoring.pair_features(scoring.with_overlap(spatial_join.candidate_pairs(observations(spark, sf_dir))))


_COMPONENTS = """, linked AS (SELECT id_a AS u, id_b AS v FROM edges UNION ALL SELECT id_b, id_a FROM edges),
walk AS (SELECT DISTINCT u AS node, u AS reach FROM linked), reached AS (
  WITH RECURSIVE r(node, reach) AS (SELECT node, reach FROM walk UNION SELECT r.node, l.v FROM r JOIN linked l ON l.u = r.reach) SELECT node, min(reach) AS component FROM r GROUP BY node)"""


@query(PAIRS_SQL + _COMPONENTS + " SELECT node, component FROM reached", name="connected_components")
def components(spark, sf_dir):
    return connected_components(edges_of(spark, sf_dir), "id_a", "id_b")


_FOLD = """, ranked AS (SELECT r.component, e.id_a, e.id_b, e.score, e.iou, row_number() OVER (PARTITION BY r.component ORDER BY e.score DESC, e.id_a, e.id_b) AS n FROM edges e JOIN reached r ON r.node = e.id_a),
nodes AS (SELECT r.component, list({'id': o.id, 'source': o.source, 'label': o.id} ORDER BY o.id) AS members FROM reached r JOIN obs o ON o.id = r.node GROUP BY r.component),
fold AS (
  WITH RECURSIVE f(component, n, members, id_a, id_b, score, iou, fits) AS (
    SELECT component, CAST(0 AS BIGINT), members, CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), false FROM nodes
    UNION ALL
    SELECT component, n, CASE WHEN fits THEN list_transform(members, lambda x: {'id': x.id, 'source': x.source, 'label': CASE WHEN x.label = la OR x.label = lb THEN least(la, lb) ELSE x.label END}) ELSE members END, id_a, id_b, score, iou, fits
    FROM (SELECT *, la = lb OR NOT list_has_any(list_transform(list_filter(members, lambda x: x.label = la), lambda x: x.source), list_transform(list_filter(members, lambda x: x.label = lb), lambda x: x.source)) AS fits
          FROM (SELECT f.component, r.n, f.members, r.id_a, r.id_b, r.score, r.iou, list_filter(f.members, lambda x: x.id = r.id_a)[1].label AS la, list_filter(f.members, lambda x: x.id = r.id_b)[1].label AS lb
                FROM f JOIN ranked r ON r.component = f.component AND r.n = f.n + 1)))
  SELECT * FROM f),
ends AS (SELECT component, unnest(arg_max(members, n)) AS x FROM fold GROUP BY component),
clusters AS MATERIALIZED (SELECT o.id, coalesce(ends.x.label, o.id) AS cluster_id FROM obs o LEFT JOIN ends ON ends.x.id = o.id),
settled AS MATERIALIZED (SELECT f.id_a, f.id_b, f.score, f.iou, c.cluster_id, f.fits AS accepted FROM fold f JOIN clusters c ON c.id = f.id_a WHERE f.n > 0)"""
#: DuckDB: the greedy rule of cluster_constrained, an edge of each component a step.
CLUSTERS_SQL = PAIRS_SQL + _COMPONENTS + _FOLD


#: Tables of this session by application, folder, files of the folder that they come from, and name: what many queries start from is
#: computed once and read from the shared folder; other files make another table.
_TABLES: dict[tuple, DataFrame] = {}


def kept(spark, sf_dir: str, name: str, make, write: bool = True) -> DataFrame:
    """make() of this session; where write is false it reads little but stored tables, and is not written again."""
    key = (spark.sparkContext.applicationId, sf_dir, files.listing(spark, f"{sf_dir}/orders.parquet"), name)
    if key not in _TABLES:
        _TABLES[key] = stored(make(), name) if write else make()
    return _TABLES[key]


def clusters_of(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(id, cluster_id) of all observations and the settled edges, matched, scored and clustered; stored once a session."""
    made: list = []

    def both():
        if not made:
            made.extend(clustering.cluster_constrained(observations(spark, sf_dir), edges_of(spark, sf_dir)))
        return made

    return kept(spark, sf_dir, "cluster_members", lambda: both()[0]), kept(spark, sf_dir, "cluster_edges", lambda: both()[1], write=False)


@query(CLUSTERS_SQL + " SELECT id, cluster_id FROM clusters")
def cluster_constrained(spark, sf_dir):
    return clustering.cluster_constrained(observations(spark, sf_dir), edges_of(spark, sf_dir))[0]


@query(CLUSTERS_SQL + " SELECT id_a, id_b, cluster_id FROM settled WHERE NOT accepted")
def rejected_edges(spark, sf_dir):
    return clusters_of(spark, sf_dir)[1].where("not accepted").select("id_a", "id_b", "cluster_id")


@query(CLUSTERS_SQL + " SELECT count(*) AS clusters, count(*) FILTER (members > sources) AS clusters_with_duplicate, max(members) AS largest FROM (SELECT cluster_id, count(*) AS members, count(DISTINCT source) AS sources FROM clusters JOIN obs USING (id) GROUP BY cluster_id)")
def duplicate_source_flag(spark, sf_dir):
    """Clusters that hold two observations of one source, of how many."""
    flags = clustering.duplicate_source_flag(observations(spark, sf_dir), clusters_of(spark, sf_dir)[0])
    return flags.agg(F.count(F.lit(1)).alias("clusters"), F.count(F.when(F.col("duplicate_source"), 1)).alias("clusters_with_duplicate"), F.max("members").alias("largest"))


_MEMBERS = CLUSTERS_SQL + ", m AS (SELECT o.*, c.cluster_id FROM obs o JOIN clusters c ON c.id = o.id)"
_RECONCILED = (
    _MEMBERS
    + """, dr AS (SELECT a.cluster_id, max(sqrt(((a.x0 + a.x1) / 2 - (b.x0 + b.x1) / 2) * ((a.x0 + a.x1) / 2 - (b.x0 + b.x1) / 2) + ((a.y0 + a.y1) / 2 - (b.y0 + b.y1) / 2) * ((a.y0 + a.y1) / 2 - (b.y0 + b.y1) / 2))) AS drift
 FROM m a JOIN m b ON a.cluster_id = b.cluster_id AND a.id < b.id GROUP BY a.cluster_id),
p AS (SELECT cluster_id, avg(score) AS avg_score, avg(iou) AS avg_iou FROM settled WHERE accepted GROUP BY cluster_id),
c AS (SELECT cluster_id, list_sort(list(DISTINCT source)) AS sources, count(*) AS source_count, (max(area_m2) - min(area_m2)) / max(area_m2) * 100 AS spread, max(extraction_confidence) AS ext FROM m GROUP BY cluster_id)"""
)


@query(_RECONCILED + f" SELECT c.cluster_id, array_to_string(sources, ',') AS sources, source_count, CASE WHEN avg_score IS NULL THEN NULL ELSE {R('avg_score', 6)} END AS avg_score, CASE WHEN avg_iou IS NULL THEN NULL ELSE {R('avg_iou', 6)} END AS avg_iou, {R('coalesce(drift, 0.0::DOUBLE)', 3)} AS centroid_drift_m, {R('spread', 6)} AS area_variance_pct FROM c LEFT JOIN p USING (cluster_id) LEFT JOIN dr USING (cluster_id)")
def reconcile_cluster(spark, sf_dir):
    found = clustering.reconcile(observations(spark, sf_dir), *clusters_of(spark, sf_dir))
    return found.select("cluster_id", F.array_join("sources", ",").alias("sources"), "source_count", g.rounded(F.col("avg_match_score"), 6).alias("avg_score"), g.rounded(F.col("avg_iou_agreement"), 6).alias("avg_iou"), g.rounded(F.col("centroid_drift_m"), 3).alias("centroid_drift_m"), g.rounded(F.col("area_variance_pct"), 6).alias("area_variance_pct"))


_CONF = R("least(1.0::DOUBLE, greatest(0.0::DOUBLE, 0.5::DOUBLE * coalesce(avg_score, 0.3::DOUBLE) + 0.35::DOUBLE * coalesce(avg_iou, 0.0::DOUBLE) + 0.15::DOUBLE * coalesce(ext, 0.5::DOUBLE)))", 4)
_ENTITIES = (
    _RECONCILED
    + f""", f AS (SELECT c.cluster_id, sources, source_count, spread, avg_iou, coalesce(drift, 0.0::DOUBLE) AS drift, {_CONF} AS confidence FROM c LEFT JOIN p USING (cluster_id) LEFT JOIN dr USING (cluster_id)),
ent AS MATERIALIZED (SELECT *, CASE WHEN {R('drift', 4)} >= 2 THEN 'conflict' WHEN confidence >= 0.85::DOUBLE THEN 'auto_reconciled' WHEN confidence >= 0.7::DOUBLE THEN 'review_required' ELSE 'conflict' END AS decision FROM f)"""
)


def reconciled(obs: DataFrame, members: DataFrame, edges: DataFrame) -> DataFrame:
    """Clusters with confidence and decision; the match score is the mean score of their accepted edges."""
    found = clustering.reconcile(obs, members, edges)
    conf = policy.confidence(F.col("avg_match_score"), F.col("avg_iou_agreement"), F.col("extraction_confidence"), F.col("duplicate_source"))
    found = found.withColumn("confidence", conf)
    return found.withColumn("decision", policy.decision(F.col("confidence"), F.col("centroid_drift_m"), F.col("duplicate_source")))


def entities(spark, sf_dir) -> DataFrame:
    """The reconciled table of all observations, stored once a session."""
    return kept(spark, sf_dir, "entities", lambda: reconciled(observations(spark, sf_dir), *clusters_of(spark, sf_dir)))


@query(_ENTITIES + f" SELECT decision, count(*) AS n, CAST(sum(source_count) AS BIGINT) AS observations, {R('100.0::DOUBLE * count(*) / sum(count(*)) OVER ()', 4)} AS pct FROM ent GROUP BY decision")
def reconcile_end_to_end(spark, sf_dir):
    """The whole run with nothing kept from before: observations, candidates, scores, edges, clusters, reconciled records, confidence, decisions, the written table, its counts."""
    obs = stored(observations(spark, sf_dir), "observations")
    edges = scoring.match_edges(scoring.combined_score(scoring.with_overlap(spatial_join.candidate_pairs(obs))))
    written = stored(reconciled(obs, *clustering.cluster_constrained(obs, edges)), "canonical")
    counts = written.groupBy("decision").agg(F.count(F.lit(1)).alias("n"), F.sum("source_count").alias("observations"))
    return counts.withColumn("pct", g.rounded(F.lit(100.0) * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 4))


@query(_ENTITIES + " SELECT cluster_id, confidence FROM ent")
def confidence(spark, sf_dir):
    return entities(spark, sf_dir).select("cluster_id", "confidence")


@query(
    _ENTITIES
    + f" SELECT cluster_id, decision, decision <> 'auto_reconciled' AS needs_review, CASE WHEN {R('drift', 4)} >= 2 THEN 'centroid drift beyond tolerance' WHEN confidence >= 0.85::DOUBLE THEN 'high agreement' WHEN confidence >= 0.7::DOUBLE THEN 'moderate agreement, verify' ELSE 'low confidence' END AS reason FROM ent"
)
def policy_decision(spark, sf_dir):
    found = entities(spark, sf_dir)
    return found.select("cluster_id", "decision", (F.col("decision") != "auto_reconciled").alias("needs_review"), policy.reason(F.col("confidence"), F.col("centroid_drift_m"), F.col("duplicate_source")).alias("reason"))


@query(PAIRS_SQL + "SELECT decision, count(*) AS n, " + R("100.0::DOUBLE * count(*) / sum(count(*)) OVER ()", 4) + " AS pct FROM judged GROUP BY decision")
def decision_counts(spark, sf_dir):
    """The flagship: observations, candidate join, scores, edges, confidence, decisions, counts."""
    counts = decided_pairs(spark, sf_dir).groupBy("decision").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("pct", g.rounded(F.lit(100.0) * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 4))


@query(
    _ENTITIES
    + """ SELECT cluster_id, CASE WHEN coalesce(avg_iou, 0) >= 0.85::DOUBLE THEN 'very high' WHEN coalesce(avg_iou, 0) >= 0.7::DOUBLE THEN 'moderate' ELSE 'low' END AS boundary_agreement,
 CASE WHEN drift < 1 THEN 'negligible' WHEN drift < 2 THEN 'acceptable' ELSE 'exceeds tolerance' END AS centroid_shift, CASE WHEN source_count > 1 THEN 'sources agree' ELSE 'single source' END AS source_agreement,
 CASE WHEN drift < 2 AND confidence >= 0.85::DOUBLE THEN 'register' WHEN drift < 2 AND confidence >= 0.7::DOUBLE THEN 'desk review' ELSE 'field validation' END AS action FROM ent"""
)
def explain_decision(spark, sf_dir):
    found = entities(spark, sf_dir)
    told = policy.explain(F.col("confidence"), F.col("centroid_drift_m"), F.coalesce("avg_iou_agreement", F.lit(0.0)), F.col("source_count"))
    return found.select("cluster_id", *(c.alias(n) for n, c in told.items()))


_MERGED = (
    _MEMBERS
    + """, g AS (SELECT cluster_id, max(x0) AS ix0, max(y0) AS iy0, min(x1) AS ix1, min(y1) AS iy1, min(x0) AS ux0, min(y0) AS uy0, max(x1) AS ux1, max(y1) AS uy1, count(*) AS members, sum((x1 - x0) * (y1 - y0)) AS single FROM m GROUP BY cluster_id),
t AS (SELECT a.cluster_id, sum(greatest(0.0::DOUBLE, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0.0::DOUBLE, least(a.y1, b.y1) - greatest(a.y0, b.y0))) AS twos FROM m a JOIN m b ON a.cluster_id = b.cluster_id AND a.id < b.id GROUP BY a.cluster_id),
j AS (SELECT *, greatest(0.0::DOUBLE, ix1 - ix0) * greatest(0.0::DOUBLE, iy1 - iy0) AS common FROM g LEFT JOIN t USING (cluster_id))"""
)


def all_members(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    return observations(spark, sf_dir), clusters_of(spark, sf_dir)[0]


@query(_MERGED + f" SELECT cluster_id, members, {R('single - coalesce(twos, 0) + CASE WHEN members = 3 THEN common ELSE 0 END', 6)} AS union_area FROM j")
def merge_geometry_union(spark, sf_dir):
    return clustering.merged_geometry(*all_members(spark, sf_dir)).select("cluster_id", "members", g.rounded(F.col("union_area"), 6).alias("union_area"))


@query(_MERGED + f" SELECT cluster_id, {R('common', 6)} AS common_area, CASE WHEN ix1 <= ix0 OR iy1 <= iy0 THEN ux0 ELSE ix0 END AS x0, CASE WHEN ix1 <= ix0 OR iy1 <= iy0 THEN ux1 ELSE ix1 END AS x1 FROM j")
def merge_geometry_intersection(spark, sf_dir):
    return clustering.merged_geometry(*all_members(spark, sf_dir)).select("cluster_id", g.rounded(F.col("common_area"), 6).alias("common_area"), "x0", "x1")


@query(_MEMBERS + " SELECT cluster_id, arg_min(building_type, id) FILTER (building_type <> 'unknown') AS building_type, arg_min(survey_no, id) AS survey_no FROM m GROUP BY cluster_id")
def merge_attributes(spark, sf_dir):
    return clustering.merge_attributes(*all_members(spark, sf_dir))
