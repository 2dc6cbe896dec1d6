"""Queries over version ledgers, snapshots, identities and conflict requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldmerge.functions import geometry as g
from fieldmerge.operators import ledger, spatial_join
from fieldmerge.plans.matching import OBS_SQL, R, observations
from fieldmerge.plans.register import query
from fieldmerge.sources.derived import CONFLICTS, REQUESTS, VERSION_ROWS, derived, sql_text

ROWS_SQL, REQUESTS_SQL, CONFLICTS_SQL = sql_text(VERSION_ROWS), sql_text(REQUESTS), sql_text(CONFLICTS)
_NUMBERED = f"WITH v AS ({ROWS_SQL}), r AS (SELECT *, x0 + w AS x1, y0 + h AS y1, row_number() OVER (PARTITION BY parcel ORDER BY recorded_at, version, x0, y0, w, h) AS n FROM v)"
_PAIR = """, p AS (SELECT parcel, n, x0, y0, x1, y1, lag(x0) OVER q AS px0, lag(y0) OVER q AS py0, lag(x1) OVER q AS px1, lag(y1) OVER q AS py1 FROM r WINDOW q AS (PARTITION BY parcel ORDER BY n)),
c AS (SELECT *, (x1 - x0) * (y1 - y0) AS b, (px1 - px0) * (py1 - py0) AS a, greatest(0.0::DOUBLE, least(x1, px1) - greatest(x0, px0)) * greatest(0.0::DOUBLE, least(y1, py1) - greatest(y0, py0)) AS i,
 (x0 + x1) / 2 - (px0 + px1) / 2 AS dx, (y0 + y1) / 2 - (py0 + py1) / 2 AS dy FROM p)"""
_MEASURES = f"""CASE WHEN px0 IS NULL THEN NULL ELSE {R('b - a', 6)} END AS area_delta, CASE WHEN px0 IS NULL THEN NULL ELSE {R('i / (a + b - i)', 6)} END AS iou,
 CASE WHEN px0 IS NULL THEN NULL ELSE {R('a + b - 2 * i', 6)} END AS symdiff, CASE WHEN px0 IS NULL THEN NULL ELSE {R('sqrt(dx * dx + dy * dy)', 6)} END AS shift, CASE WHEN px0 IS NULL THEN NULL ELSE (a + b - 2 * i) > 0.01::DOUBLE END AS changed"""


def numbered(spark, sf_dir) -> DataFrame:
    return ledger.renumbered(derived(spark, sf_dir, VERSION_ROWS))


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: g.rounded(F.col(n), 6) for n in names})


@query(_NUMBERED + _PAIR + f" SELECT parcel, CAST(n AS INTEGER) AS n, {_MEASURES} FROM c")
def version_lag_compare(spark, sf_dir):
    return _rounded(ledger.lag_compare(numbered(spark, sf_dir)), "area_delta", "iou", "symdiff", "shift").select("parcel", "n", "area_delta", "iou", "symdiff", "shift", "changed")


_FIRST_LAST = """, e AS (SELECT parcel, min(n) AS f, max(n) AS l FROM r GROUP BY parcel HAVING count(*) > 1),
p AS (SELECT e.parcel, r2.x0, r2.y0, r2.x1, r2.y1, r1.x0 AS px0, r1.y0 AS py0, r1.x1 AS px1, r1.y1 AS py1 FROM e JOIN r r1 ON r1.parcel = e.parcel AND r1.n = e.f JOIN r r2 ON r2.parcel = e.parcel AND r2.n = e.l),
c AS (SELECT *, (x1 - x0) * (y1 - y0) AS b, (px1 - px0) * (py1 - py0) AS a, greatest(0.0::DOUBLE, least(x1, px1) - greatest(x0, px0)) * greatest(0.0::DOUBLE, least(y1, py1) - greatest(y0, py0)) AS i,
 (x0 + x1) / 2 - (px0 + px1) / 2 AS dx, (y0 + y1) / 2 - (py0 + py1) / 2 AS dy FROM p)"""
_DEGREES = "(degrees(atan2(dx, dy)) + 360.0::DOUBLE)"


@query(_NUMBERED + _FIRST_LAST + f" SELECT parcel, {_MEASURES} FROM c")
def version_pair_join(spark, sf_dir):
    """First against last version of each parcel that has two or more."""
    return compared_ends(spark, sf_dir).select("parcel", "area_delta", "iou", "symdiff", "shift", "changed")


def compared_ends(spark, sf_dir) -> DataFrame:
    rows = numbered(spark, sf_dir)
    ends = rows.groupBy("parcel").agg(F.min_by(F.struct("x0", "y0", "x1", "y1"), "n").alias("a"), F.max_by(F.struct("x0", "y0", "x1", "y1"), "n").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1")
    sides = [tuple(F.col(f"{s}.{c}") for c in ("x0", "y0", "x1", "y1")) for s in "ab"]
    return _rounded(ends.select("parcel", *(c.alias(k) for k, c in ledger.compare(*sides).items())), "area_delta", "iou", "symdiff", "shift")


@query(
    _NUMBERED
    + _FIRST_LAST
    + f""" SELECT parcel, CASE WHEN sqrt(dx * dx + dy * dy) > 0.001::DOUBLE THEN {R(f'{_DEGREES} - floor({_DEGREES} / 360) * 360', 4)} END AS bearing, {R('2.0::DOUBLE * ((x1 - x0) + (y1 - y0)) - 2.0::DOUBLE * ((px1 - px0) + (py1 - py0))', 6)} AS perimeter_delta,
 CASE WHEN i / (a + b - i) >= 0.85::DOUBLE THEN 'High' WHEN i / (a + b - i) >= 0.70::DOUBLE THEN 'Moderate' ELSE 'Divergence' END AS agreement FROM c"""
)
def version_compare(spark, sf_dir):
    rows = numbered(spark, sf_dir)
    ends = rows.groupBy("parcel").agg(F.min_by(F.struct("x0", "y0", "x1", "y1"), "n").alias("a"), F.max_by(F.struct("x0", "y0", "x1", "y1"), "n").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1")
    sides = [tuple(F.col(f"{s}.{c}") for c in ("x0", "y0", "x1", "y1")) for s in "ab"]
    m = ledger.compare(*sides)
    label = F.when(m["iou"] >= 0.85, "High").when(m["iou"] >= 0.70, "Moderate").otherwise("Divergence")
    return ends.select("parcel", g.rounded(m["bearing"], 4).alias("bearing"), g.rounded(m["perimeter_delta"], 6).alias("perimeter_delta"), label.alias("agreement"))


@query(_NUMBERED + " SELECT parcel, count(*) AS versions, CAST(max(n) AS INTEGER) AS current_version, arg_max(x0, n) AS x0, arg_max(w, n) AS w, count(*) < 2 AS no_comparison FROM r GROUP BY parcel")
def current_version(spark, sf_dir):
    rows = numbered(spark, sf_dir)
    return rows.groupBy("parcel").agg(F.count(F.lit(1)).alias("versions"), F.max("n").alias("current_version"), F.max_by("x0", "n").alias("x0"), F.max_by("w", "n").alias("w")).withColumn("no_comparison", F.col("versions") < 2)


@query(_NUMBERED + " SELECT parcel, string_agg(CAST(n AS VARCHAR) || ':' || CAST(CAST(w AS BIGINT) AS VARCHAR) || 'x' || CAST(CAST(h AS BIGINT) AS VARCHAR) || ':' || CASE WHEN confidence >= 0.7::DOUBLE THEN 'VERIFIED' ELSE 'REFERENCE_ONLY' END, ',' ORDER BY n) AS timeline, count(*) > 1 AS has_history FROM r GROUP BY parcel")
def timeline(spark, sf_dir):
    """Versions in order, with what their confidence makes of them."""
    rows = numbered(spark, sf_dir)
    label = F.when(F.col("confidence") >= 0.70, "VERIFIED").otherwise("REFERENCE_ONLY")
    entry = F.concat(F.col("n").cast("string"), F.lit(":"), F.col("w").cast("long").cast("string"), F.lit("x"), F.col("h").cast("long").cast("string"), F.lit(":"), label)
    listed = F.sort_array(F.collect_list(F.struct("n", entry.alias("e"))))
    return rows.groupBy("parcel").agg(F.array_join(F.transform(listed, lambda t: t["e"]), ",").alias("timeline"), (F.count(F.lit(1)) > 1).alias("has_history"))


@query(
    f"""WITH v AS (SELECT *, CASE WHEN parcel % 4 = 0 THEN version - 1 ELSE version END AS number, lower(coalesce(source, '')) AS t FROM ({ROWS_SQL})),
 c AS (SELECT *, CASE WHEN number = 1 OR contains(t, 'cadastral') THEN 0 WHEN number = 2 OR contains(t, 'municipal') OR contains(t, 'drone') THEN 1 WHEN number >= 3 OR contains(t, 'rtk') OR contains(t, 'surveyor') THEN 2 ELSE 3 END AS c FROM v)
 SELECT parcel, version, CASE c WHEN 0 THEN 'Official Cadastral' WHEN 1 THEN 'Municipal GIS' WHEN 2 THEN 'CORS / RTK Survey' ELSE 'Verified Historical Dataset' END AS source_type,
 CASE c WHEN 0 THEN 'Karnataka Revenue Cadastral Survey' WHEN 1 THEN 'BBMP Municipal Ward GIS & ORI' WHEN 2 THEN 'Survey of India CORS RTK Baseline & Reconciled' ELSE 'Land Records Authority' END AS source_name,
 CASE c WHEN 0 THEN '2022-04-15' WHEN 1 THEN '2024-06-20' WHEN 2 THEN '2026-09-27' ELSE strftime(recorded_at, '%Y-%m-%d') END AS source_date FROM c"""
)
def history_source_label(spark, sf_dir):
    """Where each version came from; every fourth parcel's ledger counts from 0."""
    rows = derived(spark, sf_dir, VERSION_ROWS)
    number = F.when(F.col("parcel") % 4 == 0, F.col("version") - 1).otherwise(F.col("version"))
    told = ledger.history_source(number, F.col("source"), F.lit(None).cast("string"), F.col("recorded_at"))
    return rows.select("parcel", "version", *(c.alias(n) for n, c in told.items()))


@query(
    f"WITH v AS ({ROWS_SQL}), d AS (SELECT parcel, version, count(*) AS n FROM v GROUP BY parcel, version), gap AS (SELECT parcel, version, n, version - lag(version) OVER (PARTITION BY parcel ORDER BY version) AS step FROM d) SELECT parcel, version, CASE WHEN n > 1 THEN 'duplicate' ELSE 'gap' END AS violation FROM gap WHERE n > 1 OR step > 1"
)
def version_constraint_audit(spark, sf_dir):
    """Numbers that repeat, else that follow a gap."""
    counts = derived(spark, sf_dir, VERSION_ROWS).groupBy("parcel", "version").agg(F.count(F.lit(1)).alias("n"))
    step = F.col("version") - F.lag("version").over(Window.partitionBy("parcel").orderBy("version"))
    return counts.withColumn("step", step).where("n > 1 or step > 1").select("parcel", "version", F.when(F.col("n") > 1, "duplicate").otherwise("gap").alias("violation"))


_APPEND = f"""WITH v AS ({ROWS_SQL}), l AS (SELECT DISTINCT parcel, version FROM v WHERE version <= 3), q AS (SELECT DISTINCT parcel, CASE WHEN version % 2 = 0 THEN version END AS version, x0, y0, x0 + w AS x1, y0 + h AS y1 FROM v WHERE version >= 2),
m AS (SELECT parcel, max(version) AS last FROM l GROUP BY parcel), j AS (SELECT q.*, coalesce(m.last, 0) AS last, l.version IS NOT NULL AS known FROM q LEFT JOIN m ON m.parcel = q.parcel LEFT JOIN l ON l.parcel = q.parcel AND l.version = q.version),
w AS (SELECT *, CASE WHEN known THEN 'duplicate' WHEN version <= last THEN 'not monotonic' END AS why FROM j)"""


@query(_APPEND + " SELECT parcel, CAST(last + row_number() OVER (PARTITION BY parcel ORDER BY version NULLS LAST, x0, y0) AS BIGINT) AS number, 'appended' AS result FROM w WHERE why IS NULL UNION ALL SELECT parcel, version, why FROM w WHERE why IS NOT NULL")
def version_append(spark, sf_dir):
    """Requests from the later rows against a ledger of the numbers up to 3: appended numbers and violations."""
    rows = derived(spark, sf_dir, VERSION_ROWS)
    known = rows.where("version <= 3").select("parcel", "version").distinct()
    named = F.when(F.col("version") % 2 == 0, F.col("version"))
    requests = rows.where("version >= 2").select("parcel", named.alias("version"), "x0", "y0", (F.col("x0") + F.col("w")).alias("x1"), (F.col("y0") + F.col("h")).alias("y1")).distinct()
    good, bad = ledger.append_versions(known, requests)
    return good.select("parcel", F.col("number").cast("long").alias("number"), F.lit("appended").alias("result")).unionByName(bad.select("parcel", F.col("version").alias("number"), F.col("why").alias("result")))


_CHANGES = f"""WITH o AS ({OBS_SQL}), p AS (SELECT * FROM o WHERE source = 'registry' AND k % 41 <> 0), c AS (SELECT *, CASE WHEN k % 29 = 0 THEN 'review' ELSE 'reconciled' END AS status FROM o WHERE source = 'survey' AND k % 37 <> 0),
j AS (SELECT coalesce(p.k, c.k) AS k, p.k AS pk, c.k AS ck, status, (p.x1 - p.x0) * (p.y1 - p.y0) AS a, (c.x1 - c.x0) * (c.y1 - c.y0) AS b, greatest(0.0::DOUBLE, least(p.x1, c.x1) - greatest(p.x0, c.x0)) * greatest(0.0::DOUBLE, least(p.y1, c.y1) - greatest(p.y0, c.y0)) AS i,
 (c.x0 + c.x1) / 2 - (p.x0 + p.x1) / 2 AS dx, (c.y0 + c.y1) / 2 - (p.y0 + p.y1) / 2 AS dy FROM p FULL JOIN c ON p.k = c.k),
m AS (SELECT *, i / (a + b - i) AS iou, sqrt(dx * dx + dy * dy) AS shift, (b - a) / a * 100 AS pct FROM j),
t AS (SELECT *, CASE WHEN pk IS NULL THEN 'New' WHEN ck IS NULL THEN 'Missing' WHEN iou < 0.7::DOUBLE OR shift > 2 THEN 'Boundary Change' WHEN status = 'review' OR iou < 0.9::DOUBLE OR abs(pct) > 3 THEN CASE WHEN abs(pct) > 5 THEN 'Area Change' ELSE 'Building Footprint Changed' END ELSE 'No Significant Change' END AS change_type FROM m)"""


def changes(spark, sf_dir) -> DataFrame:
    """The registry as the earlier snapshot and the survey as the later one; the keys that one of them lacks are how the two are derived, so that there are new and missing parcels. A key surveyed twice is compared twice."""
    obs = observations(spark, sf_dir)
    prior = obs.where("source = 'registry' and k % 41 <> 0")
    current = obs.where("source = 'survey' and k % 37 <> 0").withColumn("status", F.when(F.col("k") % 29 == 0, "review").otherwise("reconciled"))
    return ledger.detect_changes(prior, current)


@query(_CHANGES + f" SELECT k, change_type, CASE WHEN change_type = 'No Significant Change' THEN 'ACCEPTED' ELSE 'NEEDS_REVIEW' END AS verification, CASE WHEN pk IS NULL OR ck IS NULL THEN NULL ELSE {R('iou', 6)} END AS iou FROM t")
def change_detect(spark, sf_dir):
    return changes(spark, sf_dir).select("k", "change_type", "verification", g.rounded(F.col("iou"), 6).alias("iou"))


@query(
    _CHANGES
    + " SELECT count(*) FILTER (pk IS NOT NULL AND ck IS NOT NULL) AS compared, count(*) FILTER (change_type = 'No Significant Change') AS unchanged, count(*) FILTER (change_type IN ('Boundary Change', 'Area Change', 'Building Footprint Changed')) AS changed, count(*) FILTER (change_type = 'New') AS new, count(*) FILTER (change_type = 'Missing') AS missing FROM t"
)
def change_summary(spark, sf_dir):
    kind = F.col("change_type")
    n = lambda c: F.count(F.when(c, 1))
    real = kind.isin("Boundary Change", "Area Change", "Building Footprint Changed")
    return changes(spark, sf_dir).agg(n(~kind.isin("New", "Missing")).alias("compared"), n(kind == "No Significant Change").alias("unchanged"), n(real).alias("changed"), n(kind == "New").alias("new"), n(kind == "Missing").alias("missing"))


@query(_CHANGES + " SELECT k, change_type FROM t WHERE k IN (SELECT CAST(l_orderkey AS BIGINT) FROM lineitem WHERE l_returnflag = 'R')")
def change_lookup(spark, sf_dir):
    """Changes of the parcels that a table of requests asks for (here the orders with a returned line)."""
    asked = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_returnflag = 'R'").select(F.col("l_orderkey").cast("long").alias("k")).distinct()
    return changes(spark, sf_dir).join(asked, "k", "left_semi").select("k", "change_type")


@query(_CHANGES + " SELECT change_type, count(*) AS n, " + R("100.0::DOUBLE * count(*) / sum(count(*)) OVER ()", 4) + " AS pct FROM t GROUP BY change_type")
def difference_categories(spark, sf_dir):
    counts = changes(spark, sf_dir).groupBy("change_type").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("pct", g.rounded(F.lit(100.0) * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 4))


# Fixed value: the namespace of identities.
_NS = "7e57a0de6e054c0a8d3e905c110da5e1"
_SIGNED = f"""SELECT k, id, source, survey_no, 'sig:' || CAST(FLOOR((12 + (y0 + y1) / 200000) * 100000 + 0.5::DOUBLE) / 100000 AS VARCHAR) || ':' || CAST(FLOOR((77 + (x0 + x1) / 200000) * 100000 + 0.5::DOUBLE) / 100000 AS VARCHAR) || ':' || CAST(CAST(FLOOR(area_m2) AS BIGINT) AS VARCHAR) AS sig FROM ({OBS_SQL})"""


def signed(spark, sf_dir) -> DataFrame:
    """Observations with the signature of their place: latitude and longitude of the centre to five digits, whole square metres."""
    at = lambda base, a, b: g.rounded(F.lit(float(base)) + (F.col(a) + F.col(b)) / 200000, 5).cast("string")
    sig = F.concat_ws(":", F.lit("sig"), at(12, "y0", "y1"), at(77, "x0", "x1"), F.floor("area_m2").cast("long").cast("string"))
    return observations(spark, sf_dir).select("k", "id", "source", "survey_no", sig.alias("sig"))


@query(
    f"""WITH s AS (SELECT id, sig, sha1(unhex('{_NS}') || encode(sig)) AS h FROM ({_SIGNED}))
SELECT id, sig, lower(substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || printf('%02x', (CAST('0x' || substr(h, 17, 2) AS INTEGER) & 63) | 128) || substr(h, 19, 2) || '-' || substr(h, 21, 12)) AS uuid FROM s"""
)
def deterministic_uuid(spark, sf_dir):
    return signed(spark, sf_dir).select("id", "sig", ledger.deterministic_uuid(_NS, F.col("sig")).alias("uuid"))


@query(f"SELECT id, regexp_replace(upper(trim(survey_no)), '[\\s\\-_/]+', '', 'g') AS clean FROM ({OBS_SQL})")
def clean_id(spark, sf_dir):
    return observations(spark, sf_dir).select("id", ledger.clean_id(F.col("survey_no")).alias("clean"))


_IDENTITY = f"""WITH o AS ({OBS_SQL}), q AS (SELECT * FROM o WHERE source = 'survey'), g AS (SELECT *, CAST(FLOOR(x0 / 160) AS BIGINT) + dx AS gx, CAST(FLOOR(y0 / 160) AS BIGINT) + dy AS gy FROM o, (SELECT unnest([-1, 0, 1]) AS dx), (SELECT unnest([-1, 0, 1]) AS dy) WHERE source = 'registry'),
c AS (SELECT q.id AS request_id, g.id AS registry_id, greatest(0.0::DOUBLE, least(q.x1, g.x1) - greatest(q.x0, g.x0)) * greatest(0.0::DOUBLE, least(q.y1, g.y1) - greatest(q.y0, g.y0)) AS i, (q.x1 - q.x0) * (q.y1 - q.y0) AS a, (g.x1 - g.x0) * (g.y1 - g.y0) AS b,
 sqrt(((q.x0 + q.x1) / 2 - (g.x0 + g.x1) / 2) * ((q.x0 + q.x1) / 2 - (g.x0 + g.x1) / 2) + ((q.y0 + q.y1) / 2 - (g.y0 + g.y1) / 2) * ((q.y0 + q.y1) / 2 - (g.y0 + g.y1) / 2)) AS drift, g.survey_no AS sb, q.survey_no AS sa
 FROM q JOIN g ON CAST(FLOOR(q.x0 / 160) AS BIGINT) = g.gx AND CAST(FLOOR(q.y0 / 160) AS BIGINT) = g.gy WHERE q.x0 - 66.7::DOUBLE <= g.x1 AND q.x1 + 66.7::DOUBLE >= g.x0 AND q.y0 - 66.7::DOUBLE <= g.y1 AND q.y1 + 66.7::DOUBLE >= g.y0),
n AS (SELECT *, i / (a + b - i) AS iou FROM c WHERE i > 0), x AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY iou DESC, registry_id) AS r FROM n),
d AS (SELECT q.id AS request_id, x.registry_id, x.iou, x.drift, x.sa, x.sb, x.a - x.b AS area_delta, CASE WHEN x.registry_id IS NULL OR x.iou < 0.15::DOUBLE THEN 'NEW' WHEN x.iou < 0.7::DOUBLE OR x.drift >= 2 THEN 'UNCERTAIN' ELSE 'CONTINUITY' END AS action FROM q LEFT JOIN x ON x.request_id = q.id AND x.r = 1)"""


def identity_candidates(spark, sf_dir) -> DataFrame:
    """Survey observations as requests against the registry, within 66.7 m, those that truly overlap."""
    obs = observations(spark, sf_dir)
    requests, registry = obs.where("source = 'survey'"), obs.where("source = 'registry'")
    pairs = spatial_join.range_pairs(requests, registry, 66.7, cell=160.0)
    a, b = g.box(suffix="_a"), g.box(suffix="_b")
    pairs = pairs.withColumn("inter", g.intersection_area(a, b)).where(spatial_join.after_join(F.col("inter") > 0))
    found = pairs.select(
        F.col("id_a").alias("request_id"), F.col("id_b").alias("registry_id"), g.iou(a, b, F.col("inter")).alias("iou"), g.centroid_distance(a, b).alias("drift"),
        (g.box_area(a) - g.box_area(b)).alias("area_delta"), F.col("survey_no_a").alias("survey_after"), F.col("survey_no_b").alias("survey_before"),
    )
    return requests.select(F.col("id").alias("request_id")).join(found, "request_id", "left")


@query(_IDENTITY + f" SELECT request_id, registry_id, CASE WHEN iou IS NULL THEN NULL ELSE {R('iou', 6)} END AS iou FROM d")
def identity_candidate_join(spark, sf_dir):
    best = ledger.resolve_identity(identity_candidates(spark, sf_dir))
    return best.select("request_id", "registry_id", g.rounded(F.col("iou"), 6).alias("iou"))


@query(_IDENTITY + f" SELECT request_id, action, action = 'UNCERTAIN' AS needs_review, {R('''CASE action WHEN 'NEW' THEN 1.0::DOUBLE WHEN 'UNCERTAIN' THEN greatest(0.4::DOUBLE, iou) ELSE iou END''', 6)} AS confidence FROM d")
def identity_resolve(spark, sf_dir):
    best = ledger.resolve_identity(identity_candidates(spark, sf_dir))
    return best.select("request_id", "action", "needs_review", g.rounded(F.col("confidence"), 6).alias("confidence"))


@query(
    _IDENTITY
    + " SELECT request_id, CASE WHEN request_id % 3 = 0 AND iou >= 0.98::DOUBLE AND drift <= 0.2::DOUBLE THEN 'DUPLICATE' WHEN iou < 0.96::DOUBLE OR drift > 0.3::DOUBLE OR abs(area_delta) > 5 THEN 'GEOMETRY_REVISED' WHEN sa <> sb THEN 'SURVEY_NUMBER_EVOLVED' ELSE 'MATCHED' END AS continuity FROM d WHERE action = 'CONTINUITY'"
)
def identity_continuity_action(spark, sf_dir):
    best = ledger.resolve_identity(identity_candidates(spark, sf_dir)).where("action = 'CONTINUITY'")
    best = best.withColumns({"same_record": F.col("request_id") % 3 == 0, "municipal_before": F.lit(None).cast("string"), "municipal_after": F.lit(None).cast("string")})
    return ledger.continuity_action(best).select("request_id", "continuity")


@query(
    f"""WITH s AS ({_SIGNED}), q AS (SELECT k, sig, survey_no, unnest(['register', 'resurvey']) AS dataset FROM s WHERE source = 'registry'), r AS (SELECT sig, survey_no FROM s WHERE source = 'registry' AND k % 3 = 0)
 SELECT q.k, q.dataset, CASE WHEN q.sig NOT IN (SELECT sig FROM r) THEN 'new' WHEN q.dataset = 'register' AND EXISTS (SELECT 1 FROM r WHERE r.sig = q.sig AND r.survey_no = q.survey_no) THEN 'duplicate' ELSE 'matched' END AS outcome FROM q"""
)
def identity_duplicate_or_match(spark, sf_dir):
    """Registry parcels sent again by their register and by a resurvey, against those already there (every third key): by identity of place a duplicate if that data set sent that id before, else a match; new where the place is unknown."""
    rows = signed(spark, sf_dir).where("source = 'registry'").select("k", "survey_no", ledger.deterministic_uuid(_NS, F.col("sig")).alias("uuid"))
    known = rows.where("k % 3 = 0")
    places = known.select("uuid").distinct().withColumn("there", F.lit(True))
    sent = known.select("uuid", "survey_no", F.lit("register").alias("dataset"), F.lit(True).alias("sent")).distinct()
    asked = rows.select("k", "survey_no", "uuid", F.explode(F.array(F.lit("register"), F.lit("resurvey"))).alias("dataset"))
    found = asked.join(places, "uuid", "left").join(sent, ["uuid", "survey_no", "dataset"], "left")
    return found.select("k", "dataset", F.when(F.col("there").isNull(), "new").when(F.col("sent"), "duplicate").otherwise("matched").alias("outcome"))


_RULES = "VALUES ('DETECTED','UNDER_REVIEW'),('UNDER_REVIEW','SURVEY_REQUIRED'),('UNDER_REVIEW','RESOLVED'),('UNDER_REVIEW','REJECTED'),('SURVEY_REQUIRED','SURVEY_RECEIVED'),('SURVEY_REQUIRED','UNDER_REVIEW'),('SURVEY_RECEIVED','RECONCILIATION_PENDING'),('SURVEY_RECEIVED','UNDER_REVIEW'),('RECONCILIATION_PENDING','RESOLVED'),('RECONCILIATION_PENDING','UNDER_REVIEW'),('RESOLVED','APPROVED'),('RESOLVED','UNDER_REVIEW'),('APPROVED','REOPENED'),('REJECTED','REOPENED'),('REOPENED','UNDER_REVIEW')"
_FOLD = f"""WITH RECURSIVE q AS ({REQUESTS_SQL}), legal(a, b) AS ({_RULES}), o AS (SELECT *, row_number() OVER (PARTITION BY conflict_id ORDER BY ts, event_id) AS n FROM q),
f(conflict_id, n, event_id, previous_state, requested_state, state, accepted) AS (
  SELECT conflict_id, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), '', '', 'DETECTED', false FROM (SELECT DISTINCT conflict_id FROM o)
  UNION ALL
  SELECT o.conflict_id, o.n, o.event_id, f.state, o.requested_state, CASE WHEN l.a IS NOT NULL THEN o.requested_state ELSE f.state END, l.a IS NOT NULL FROM f JOIN o ON o.conflict_id = f.conflict_id AND o.n = f.n + 1 LEFT JOIN legal l ON l.a = f.state AND l.b = o.requested_state)"""


@query(_FOLD + " SELECT conflict_id, arg_max(state, n) AS final_state, count(*) FILTER (accepted) AS accepted, count(*) FILTER (NOT accepted AND n > 0) AS rejected FROM f GROUP BY conflict_id")
def conflict_fsm(spark, sf_dir):
    log = ledger.fold_lifecycle(derived(spark, sf_dir, REQUESTS))
    return log.groupBy("conflict_id").agg(F.max_by("state", F.struct("ts", "event_id", "requested_state", "actor")).alias("final_state"), F.count(F.when(F.col("accepted"), 1)).alias("accepted"), F.count(F.when(~F.col("accepted"), 1)).alias("rejected"))


@query(_FOLD + " SELECT conflict_id, event_id, previous_state, requested_state, accepted FROM f WHERE n > 0")
def transition_audit(spark, sf_dir):
    return ledger.fold_lifecycle(derived(spark, sf_dir, REQUESTS)).select("conflict_id", "event_id", "previous_state", "requested_state", "accepted")


@query(f"WITH q AS ({REQUESTS_SQL}), r AS (SELECT DISTINCT conflict_id % 100 AS s, conflict_id FROM q), n AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY conflict_id) AS i FROM r) SELECT conflict_id, 'CNF-' || CAST(s AS VARCHAR) || CASE WHEN i > 1 THEN '-' || CAST(i AS VARCHAR) ELSE '' END AS name, 'DETECTED' AS state FROM n")
def conflict_create(spark, sf_dir):
    """Names of new conflicts: a suffix where the source id is taken."""
    rows = derived(spark, sf_dir, REQUESTS).select("conflict_id", (F.col("conflict_id") % 100).alias("s")).distinct()
    i = F.row_number().over(Window.partitionBy("s").orderBy("conflict_id"))
    return rows.withColumn("i", i).select("conflict_id", F.concat(F.lit("CNF-"), F.col("s").cast("string"), F.when(F.col("i") > 1, F.concat(F.lit("-"), F.col("i").cast("string"))).otherwise("")).alias("name"), F.lit("DETECTED").alias("state"))


_LAST = _FOLD + f", z AS (SELECT conflict_id, arg_max(state, n) AS state FROM f GROUP BY conflict_id), r AS (SELECT * FROM ({CONFLICTS_SQL}) JOIN z USING (conflict_id))"


def conflicts(spark, sf_dir) -> DataFrame:
    """Conflict records with the state that their requests have led to."""
    state = conflict_fsm(spark, sf_dir).select("conflict_id", F.col("final_state").alias("state"))
    return derived(spark, sf_dir, CONFLICTS).join(state, "conflict_id")


def listed_conflicts(rows: DataFrame, state: str | None = None, severity: str | None = None, near: str | None = None) -> DataFrame:
    """Records by state and severity, in any case of letters, and by parcel or source id; a filter that is not given lets all pass."""
    for column, wanted in (("state", state), ("severity", severity)):
        if wanted is not None:
            rows = rows.where(F.upper(column) == wanted.upper())
    return rows if near is None else rows.where((F.col("parcel_id") == near) | (F.col("source_id") == near))


@query(_LAST + " SELECT 'state and severity' AS asked, conflict_id, conflict_type, severity, parcel_id, source_id, state FROM r WHERE state = 'UNDER_REVIEW' AND severity = 'HIGH' UNION ALL SELECT 'source', conflict_id, conflict_type, severity, parcel_id, source_id, state FROM r WHERE source_id = 'S-7' OR parcel_id = 'S-7'")
def conflict_list(spark, sf_dir):
    """Grave conflicts under review, and all of one source."""
    rows, names = conflicts(spark, sf_dir), ("conflict_id", "conflict_type", "severity", "parcel_id", "source_id", "state")
    parts = (("state and severity", listed_conflicts(rows, "Under_Review", "high")), ("source", listed_conflicts(rows, near="S-7")))
    told = [df.select(F.lit(name).alias("asked"), *names) for name, df in parts]
    return told[0].unionByName(told[1])


@query(_LAST + " SELECT conflict_type, count(*) AS n, count(*) FILTER (state NOT IN ('RESOLVED', 'APPROVED', 'REJECTED')) AS open, row_number() OVER (ORDER BY count(*) DESC, conflict_type) AS place FROM r GROUP BY conflict_type")
def conflict_breakdown(spark, sf_dir):
    """Counts by type, the commonest first."""
    rows = conflicts(spark, sf_dir).groupBy("conflict_type").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(~F.col("state").isin("RESOLVED", "APPROVED", "REJECTED"), 1)).alias("open"))
    return rows.withColumn("place", F.row_number().over(Window.orderBy(F.col("n").desc(), "conflict_type")).cast("long"))


@query(f"WITH q AS (SELECT DISTINCT conflict_id FROM ({REQUESTS_SQL})), w AS (SELECT conflict_id, 'cnf-' || CAST(conflict_id AS VARCHAR) AS wanted FROM q) SELECT w.wanted, q.conflict_id AS found FROM w JOIN q ON upper(w.wanted) = 'CNF-' || CAST(q.conflict_id AS VARCHAR)")
def conflict_lookup_cascade(spark, sf_dir):
    """Names as people type them, found by exact name, then source id, then upper-cased name; the first kind that hits wins."""
    ids = derived(spark, sf_dir, REQUESTS).select("conflict_id").distinct()
    names = ids.select(F.col("conflict_id").alias("found"), F.concat(F.lit("CNF-"), F.col("conflict_id").cast("string")).alias("name"))
    wanted = ids.select(F.concat(F.lit("cnf-"), F.col("conflict_id").cast("string")).alias("wanted"))
    keys = names.select("found", F.explode(F.array(F.struct(F.lit(1).alias("kind"), F.col("name").alias("key")), F.struct(F.lit(2).alias("kind"), F.col("found").cast("string").alias("key")))).alias("e")).select("found", "e.*")
    tries = wanted.select("wanted", F.explode(F.array(F.struct(F.lit(1).alias("rank"), F.col("wanted").alias("key")), F.struct(F.lit(3).alias("rank"), F.upper("wanted").alias("key")))).alias("t")).select("wanted", "t.*")
    hits = tries.join(keys, "key").withColumn("r", F.row_number().over(Window.partitionBy("wanted").orderBy("rank", "kind", "found")))
    return hits.where("r = 1").select("wanted", "found")
