"""Closed-form cases."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldmerge.config import MatchConfig
from fieldmerge.functions import geometry as g
from fieldmerge.operators import clustering, crs, policy, quantiles, scoring, spatial_join
from fieldmerge.operators.graph import connected_components
from fieldmerge.plans import matching


def test_weights_must_sum_to_one():
    with pytest.raises(ValueError):
        MatchConfig(w_iou=0.9)


@pytest.mark.parametrize(("conf", "drift", "want"), [(0.85, 1.99, "auto_reconciled"), (0.8499, 0.0, "review_required"), (0.70, 1.99, "review_required"), (0.6999, 0.0, "conflict"), (0.95, 2.0, "conflict")])
def test_policy_boundaries(spark, conf, drift, want):
    assert spark.range(1).select(policy.decision(F.lit(conf), F.lit(drift)).alias("d")).first()["d"] == want


def test_polygon_overlap():
    square = np.array([(0, 0), (2, 0), (2, 2), (0, 2)], float)
    diamond = np.array([(1, 0), (2, 1), (1, 2), (0, 1)], float)
    triangle = np.array([(0, 0), (4, 0), (0, 4)], float)
    assert g.polygon_overlap(square, diamond) == pytest.approx(2.0)
    assert g.polygon_overlap(square, triangle) == pytest.approx(4.0)
    assert g.polygon_overlap(square, square + 5) == 0
    assert g.polygon_overlap(square + [1, 1], triangle) == pytest.approx(2.0)


@pytest.mark.parametrize("cell", [7.0, 40.0, 400.0])
def test_range_join_equals_brute_force(spark, cell):
    rng = random.Random(5)
    rows = []
    for i in range(120):
        x, y = rng.uniform(-100, 300), rng.uniform(-100, 300)
        big = 400 if i % 40 == 0 else 20
        rows.append((i, "ab"[i % 2], x, y, x + rng.uniform(0, big), y + rng.uniform(0, big)))
    rows.append((500, "a", None, None, None, None))
    obs = spark.createDataFrame(rows, "id long, source string, x0 double, y0 double, x1 double, y1 double")
    got = [(r["id_a"], r["id_b"]) for r in spatial_join.candidate_pairs(obs, 15.0, cell).select("id_a", "id_b").collect()]
    want = {(a[0], b[0]) for a in rows[:-1] for b in rows[:-1] if a[0] < b[0] and a[1] != b[1] and a[2] - 15 <= b[4] and a[4] + 15 >= b[2] and a[3] - 15 <= b[5] and a[5] + 15 >= b[3]}
    assert len(got) == len(set(got)) and set(got) == want


def test_shifted_grid_is_all_strong(spark):
    rows = []
    for i in range(10):
        for j in range(10):
            for s, d in (("a", 0.0), ("b", 1.0)):
                x, y = 70.0 * i + d, 70.0 * j + d
                rows.append((len(rows), s, x, y, x + 50, y + 50, 2500.0, "unknown", f"P{i}-{j}"))
    obs = spark.createDataFrame(rows, "id long, source string, x0 double, y0 double, x1 double, y1 double, area_m2 double, building_type string, survey_no string")
    pairs = scoring.multi_signal(scoring.with_overlap(spatial_join.candidate_pairs(obs)))
    assert pairs.count() < 500 and pairs.where("match_class = 'STRONG_MATCH'").count() == 100


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(0, i) for i in range(1, 50)] + [(900, 900), (901, 902), (902, 901), (None, 5)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert all(got[i] == 100 for i in range(100, 161)) and all(got[i] == 0 for i in range(50))
    assert got[900] == 900 and got[901] == got[902] == 901 and len(got) == 61 + 50 + 3
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_clusters_hold_one_of_a_source(spark):
    obs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (4, "c"), (5, "a")], "id long, source string")
    edges = spark.createDataFrame([(1, 2, "a", "b", 0.9, 0.8), (1, 3, "a", "b", 0.8, 0.7), (3, 4, "b", "c", 0.7, 0.6)], "id_a long, id_b long, source_a string, source_b string, score double, iou double")
    members, judged = clustering.cluster_constrained(obs, edges)
    assert {r["id"]: r["cluster_id"] for r in members.collect()} == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5}
    assert [(r["id_a"], r["id_b"]) for r in judged.where("not accepted").collect()] == [(1, 3)]


def test_projection_round_trip(spark):
    points = spark.createDataFrame([(77.6, 12.97), (-70.1, -33.4), (179.9, 60.0), (3.0, 0.0)], "lon double, lat double")
    zone = crs.utm_zone(F.col("lon"))
    p = points.select("lon", "lat", zone.alias("z"), crs.project(F.col("lon"), F.col("lat")).alias("p"))
    back = p.select("lon", "lat", crs.unproject(F.col("p.x"), F.col("p.y"), F.col("z"), F.col("lat") < 0).alias("q")).collect()
    assert all(abs(r["lon"] - r["q"]["lon"]) < 1e-5 and abs(r["lat"] - r["q"]["lat"]) < 1e-5 for r in back)
    assert points.where("lon = 3").select(crs.utm_epsg(F.col("lon"), F.col("lat")).alias("e")).first()["e"] == "EPSG:32631"


def test_ranks_among_values_that_differ_in_their_last_digit(spark):
    """Many values on two neighbouring doubles: of one order of magnitude, so the round by size cannot part them and must not divide by nothing."""
    near = math.nextafter(0.7, 1.0)
    rows = [(0.7,)] * 1500 + [(near,)] * 1501 + [(0.0,), (1.0,)]
    df = spark.createDataFrame(rows, "v double")
    got = quantiles.at_ranks(df, [], {"first": ("v", lambda n: F.lit(1)), "low": ("v", lambda n: F.lit(1501)), "high": ("v", lambda n: F.lit(1502)), "last": ("v", lambda n: n)}).first()
    assert tuple(got) == (0.0, 0.7, near, 1.0)


def test_boxes_listed_by_cells_are_not_broadcast(spark):
    """A few long boxes come in many rows, which Spark does not foresee: the join must exchange them, whatever it takes them for."""
    many = spark.range(2000).selectExpr("id", "id * 10.0D as x0", "0D as y0", "id * 10.0D + 5 as x1", "5D as y1")
    long = spark.range(3).selectExpr("id", "0D as x0", "id * 1.0D as y0", "400D as x1", "id * 1.0D as y1")
    pairs = spatial_join.range_pairs(many, long, 0.0, cell=60.0)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and pairs.count() == 3 * 41


def test_identifiers_are_normalised_below_the_join(spark):
    """Once an observation, not for each of its pairs and again for every rule."""
    plan = matching.named_pairs(spark, "/root/testdata/sf0.001").select("id_a", "id_b", "id_method")._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Join Inner", 1)
    assert "regexp_replace" not in above and "regexp_replace" in below
    rows = spark.createDataFrame([("Sy No 12/A", "sy.no. 12a"), ("Plot 7", "plot 71"), ("x1", "y2"), (None, "a")], "a string, b string")
    assert [r["id_method"] for r in scoring.identifier_similarity(rows, "a", "b").collect()] == ["NORMALIZED_EQUIVALENT", "SUBSTRING_CONTAINMENT", "FUZZY_STRING_SIMILARITY", "NEUTRAL_MISSING"]


def test_small_components_need_no_rounds(spark, monkeypatch):
    """Trees of all tasks meet in their nodes: components of a few nodes, whose edges lie in different tasks, take no round of stars."""
    from fieldmerge.operators import graph

    rounds = []
    whole = graph._with_minimum
    monkeypatch.setattr(graph, "_with_minimum", lambda edges: rounds.append(1) or whole(edges))
    edges = [(10 * c + a, 10 * c + a + 1) for a in range(4) for c in range(200)] + [(7, 7), (None, 3), (5000, 5000)]
    frame = spark.createDataFrame(edges, "src long, dst long").repartition(7, F.xxhash64("dst"))
    got = {r["node"]: r["component"] for r in connected_components(frame).collect()}
    assert got == {n: n - n % 10 for c in range(200) for n in range(10 * c, 10 * c + 5)} | {7: 7, 5000: 5000}
    assert not rounds


def test_a_long_chain_is_one_component(spark):
    order = list(range(1500))
    random.Random(3).shuffle(order)
    frame = spark.createDataFrame(list(zip(order, order[1:], strict=False)), "src long, dst long").repartition(5)
    assert {r["component"] for r in connected_components(frame).collect()} == {0} and connected_components(frame).count() == 1500


def test_boxes_joined_with_themselves_are_shuffled_once(spark):
    rows = [(i, f"s{i % 3}", x, y, x + 10.0, y + 10.0) for i in range(300) for x, y in [((i % 20) * 12.5, (i // 20) * 12.5)]]
    obs = spark.createDataFrame(rows, "id long, source string, x0 double, y0 double, x1 double, y1 double").repartition(3)
    pairs = spatial_join.candidate_pairs(obs, 15.0)
    got = {(r["id_a"], r["id_b"]) for r in pairs.collect()}
    meet = lambda a, b: a[2] - 15 <= b[4] and a[4] + 15 >= b[2] and a[3] - 15 <= b[5] and a[5] + 15 >= b[3]
    assert got == {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] != b[1] and meet(a, b)}
    assert "ReusedExchange" in pairs._jdf.queryExecution().executedPlan().toString()


def test_pair_features_lie_outside_the_code_of_the_join(spark):
    rows = [(1, "a", 0.0, 0.0, 10.0, 10.0, None), (2, "b", 1.0, 0.0, 11.0, 12.0, 0.7), (3, "b", None, 0.0, 1.0, 1.0, 0.5)]
    obs = spark.createDataFrame(rows, "id long, source string, x0 double, y0 double, x1 double, y1 double, extraction_confidence double")
    found = scoring.pair_features(scoring.with_overlap(spatial_join.candidate_pairs(obs)))
    row = found.first().asDict()
    assert (row["f_area_diff_pct"], row["f_vertices_a"], row["f_sources"], row["f_extraction"], row["f_overlap_a"]) == (16.67, 5.0, 2.0, 0.7, 0.9)
    lines = [line.lstrip(" :+-") for line in found._jdf.queryExecution().executedPlan().toString().splitlines()]
    assert any(line.startswith("Project [") and "exists(" in line for line in lines)  # without the star of generated code
