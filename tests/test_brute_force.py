"""Queries that SQL cannot express, against plain loops over the same rows."""

import difflib
import itertools
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from fieldmerge.config import SIGNALS
from fieldmerge.functions import geometry as g
from fieldmerge.operators import clustering
from fieldmerge.plans import matching, registry, reports
from fieldmerge.sources import files
from fieldmerge.streaming import lifecycle

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def boxes(spark):
    return {r["id"]: r for r in matching.observations(spark, SF).collect()}


@pytest.fixture(scope="module")
def pairs(boxes):
    """Every two boxes of different sources that are within 15 m by axis."""
    found, ids = [], sorted(boxes)
    by_row: dict = {}
    for i in ids:
        by_row.setdefault((int(boxes[i]["x0"] // 100), int(boxes[i]["y0"] // 100)), []).append(i)
    for (cx, cy), members in by_row.items():
        near = [j for dx in (-1, 0, 1) for dy in (-1, 0, 1) for j in by_row.get((cx + dx, cy + dy), [])]
        for i, j in itertools.product(members, near):
            a, b = boxes[i], boxes[j]
            if i < j and a["source"] != b["source"] and a["x0"] - 15 <= b["x1"] and a["x1"] + 15 >= b["x0"] and a["y0"] - 15 <= b["y1"] and a["y1"] + 15 >= b["y0"]:
                found.append((i, j))
    return found


def _identifiers(a, b):
    plain = lambda x: re.sub("^(syno|surveyno|survey|plotno|plot|sy)", "", re.sub("[^a-z0-9]", "", x.lower()))
    ra, rb, na, nb = a.strip().lower(), b.strip().lower(), plain(a), plain(b)
    if ra == rb:
        return "EXACT_MATCH", 1.0
    if na == nb:
        return "NORMALIZED_EQUIVALENT", 0.95
    if na in nb or nb in na:
        return "SUBSTRING_CONTAINMENT", 0.85
    return "FUZZY_STRING_SIMILARITY", round(difflib.SequenceMatcher(None, ra, rb).ratio() * 0.8, 4)


def _overlap(a, b):
    return max(0.0, min(a["x1"], b["x1"]) - max(a["x0"], b["x0"])) * max(0.0, min(a["y1"], b["y1"]) - max(a["y0"], b["y0"]))


def test_identifiers_of_all_candidate_pairs(spark, boxes, pairs):
    got = {(r["id_a"], r["id_b"]): (r["id_method"], r["id_score"]) for r in registry.QUERIES["identifier_similarity"](spark, SF).collect()}
    assert set(got) == set(pairs)
    for (i, j), (method, score) in got.items():
        want = _identifiers(boxes[i]["survey_no"], boxes[j]["survey_no"])
        assert method == want[0] and score == pytest.approx(want[1], abs=1.01e-4)
    assert {m for m, _ in got.values()} >= {"NORMALIZED_EQUIVALENT", "FUZZY_STRING_SIMILARITY"}


def test_scores_and_classes_of_all_candidate_pairs(spark, boxes, pairs):
    want = {}
    for i, j in pairs:
        a, b = boxes[i], boxes[j]
        size = lambda o: ((o["x1"] - o["x0"]), (o["y1"] - o["y0"]))
        (wa, ha), (wb, hb) = size(a), size(b)
        o = _overlap(a, b)
        iou = o / (wa * ha + wb * hb - o)
        d = math.hypot((a["x0"] + a["x1"] - b["x0"] - b["x1"]) / 2, (a["y0"] + a["y1"] - b["y0"] - b["y1"]) / 2)
        like = lambda p, q: min(p, q) / max(p, q)
        q = lambda w, h: min(1.0, 4 * math.pi * w * h / (2 * (w + h)) ** 2)
        score = 0.30 * iou + 0.25 * max(0, 1 - min(d / 15, 1)) + 0.12 * like(wa * ha, wb * hb) + 0.10 * like(q(wa, ha), q(wb, hb)) + 0.08 * like(wa + ha, wb + hb) + 0.05 * iou + 0.05 * 1.0
        score += 0.05 * _identifiers(a["survey_no"], b["survey_no"])[1]
        kind = "STRONG_MATCH" if score >= 0.82 and iou >= 0.7 and d < 2 else "POSSIBLE_MATCH" if score >= 0.6 and d < 5 else "WEAK_MATCH" if score >= 0.4 and iou > 0.05 else "NO_MATCH"
        want[i, j] = (score, kind)
    assert SIGNALS.radius_m == 15
    for name in ("match_class", "multi_signal_score"):
        got = {(r["id_a"], r["id_b"]): r for r in registry.QUERIES[name](spark, SF).collect()}
        assert set(got) == set(want)
        near = [k for k in want if any(abs(want[k][0] - edge) < 1e-5 for edge in (0.82, 0.6, 0.4))]
        assert all(got[k]["candidate_score"] == pytest.approx(want[k][0], abs=1.2e-5) for k in want)
        assert all(got[k]["match_class"] == want[k][1] for k in want if k not in near) and len(near) < 5
    counts = {r["match_class"]: r for r in registry.QUERIES["match_benchmark"](spark, SF).collect()}
    assert sum(r["n"] for r in counts.values()) == len(pairs) and {"NO_MATCH", "STRONG_MATCH"} <= set(counts)
    sizes = [sum(b["source"] == s for b in boxes.values()) for s in ("registry", "survey", "imagery")]
    possible = sum(a * b for a, b in itertools.combinations(sizes, 2))
    assert all(r["candidates"] == len(pairs) and r["reduction_pct"] == pytest.approx(100 * (1 - len(pairs) / possible), abs=1e-6) for r in counts.values())
    of_pairs = {}
    for r in registry.QUERIES["match_benchmark_by_sources"](spark, SF).collect():
        assert (r["n_a"], r["n_b"]) == tuple(sum(b["source"] == s for b in boxes.values()) for s in (r["source_a"], r["source_b"]))
        of_pairs[r["source_a"], r["source_b"], r["match_class"]] = r["n"]
    told = [(*sorted((boxes[i]["source"], boxes[j]["source"])), want[i, j][1]) for i, j in pairs]
    assert sum(of_pairs.values()) == len(told) and all(abs(n - told.count(k)) < 5 for k, n in of_pairs.items())
    best = [r["candidate_score"] for r in registry.QUERIES["sorted_matches"](spark, SF).collect()]
    assert best == sorted(best, reverse=True) and best[-1] == pytest.approx(sorted((s for s, _ in want.values()), reverse=True)[499], abs=1.2e-5)


def test_constrained_clusters_of_a_tangled_graph(spark):
    rng = random.Random(3)
    nodes = {i: rng.choice("abcd") for i in range(150)}
    edges = {}
    for _ in range(260):
        i, j = sorted(rng.sample(range(150), 2))
        if nodes[i] != nodes[j]:
            edges[i, j] = round(rng.uniform(0.5, 1), 2)
    label = dict.fromkeys(nodes)
    label = {i: i for i in nodes}
    fits = {}
    for (i, j), _ in sorted(edges.items(), key=lambda e: (-e[1], e[0])):
        a, b = label[i], label[j]
        of = lambda x: {nodes[k] for k in nodes if label[k] == x}  # noqa: E731, B023
        fits[i, j] = a == b or not of(a) & of(b)
        if fits[i, j]:
            label = {k: min(a, b) if v in (a, b) else v for k, v in label.items()}
    obs = spark.createDataFrame(list(nodes.items()), "id long, source string")
    told = spark.createDataFrame([(i, j, nodes[i], nodes[j], s, s) for (i, j), s in edges.items()], "id_a long, id_b long, source_a string, source_b string, score double, iou double")
    members, settled = clustering.cluster_constrained(obs, told)
    assert {r["id"]: r["cluster_id"] for r in members.collect()} == label
    assert {(r["id_a"], r["id_b"]): r["accepted"] for r in settled.collect()} == fits
    assert not all(fits.values())


def _identities(rows):
    known, out = {}, {}
    cells: dict = {}
    for r in rows:
        best, chosen = 0.0, None
        at = {(x, y) for x in range(int(r["x0"] // 50), int(r["x1"] // 50) + 1) for y in range(int(r["y0"] // 50), int(r["y1"] // 50) + 1)}
        for i in sorted({i for c in at for i in cells.get(c, [])}):
            o = _overlap(known[i], r)
            iou = o / ((known[i]["x1"] - known[i]["x0"]) * (known[i]["y1"] - known[i]["y0"]) + (r["x1"] - r["x0"]) * (r["y1"] - r["y0"]) - o)
            if iou > best:
                best, chosen = iou, i
        action = "NEW" if best < 0.15 else "UNCERTAIN" if best < 0.70 else "CONTINUITY"
        out[r["id"]] = (action, None if action == "NEW" else chosen)
        if action != "CONTINUITY":
            known[r["id"]] = r
            for c in at:
                cells.setdefault(c, []).append(r["id"])
    return out


def test_identity_stream_equals_a_loop(spark, boxes):
    want = _identities([boxes[i] for i in sorted(boxes)])
    got = {r["request_id"]: (r["action"], r["registry_id"]) for r in registry.QUERIES["identity_stream"](spark, SF).collect()}
    assert got == want and {a for a, _ in want.values()} == {"NEW", "UNCERTAIN", "CONTINUITY"}


def test_identity_batches_see_earlier_ones_across_any_edge(spark, tmp_path):
    rng = random.Random(9)
    rows = []
    for i in range(300):
        x, y = rng.uniform(0, 700), rng.uniform(0, 700)
        rows.append({"id": i, "x0": x, "y0": y, "x1": x + rng.uniform(5, 60), "y1": y + rng.uniform(5, 60)})
    write, schema = lifecycle.identity_batches(str(tmp_path / "t")), "request_id long, x0 double, y0 double, x1 double, y1 double"
    for epoch, part in enumerate((rows[:120], rows[120:121], rows[121:])):
        write(spark.createDataFrame([tuple(r.values()) for r in part], schema), epoch)
    write(spark.createDataFrame([tuple(r.values()) for r in rows[121:]], schema), 2)
    got = {r["request_id"]: (r["action"], r["registry_id"]) for r in lifecycle.decisions(spark, str(tmp_path / "t")).collect()}
    assert got == _identities(rows)


def test_overlap_of_turned_boxes(spark, boxes):
    """Clipping the diamond by the box, side by side."""

    def clip(points, inside, meet):
        out = []
        for p, q in zip(points, points[1:] + points[:1], strict=True):
            if inside(p) != inside(q):
                out.append(meet(p, q))
            if inside(q):
                out.append(q)
        return out

    got = {r["id"]: r["overlap"] for r in registry.QUERIES["polygon_overlap"](spark, SF).collect()}
    by_key = {b["k"]: b for b in boxes.values() if b["source"] == "registry"}
    assert set(got) == {i for i, b in boxes.items() if b["source"] == "survey"}
    for i, area in got.items():
        b, a = boxes[i], by_key[boxes[i]["k"]]
        mx, my = (b["x0"] + b["x1"]) / 2, (b["y0"] + b["y1"]) / 2
        points = [(b["x0"], my), (mx, b["y0"]), (b["x1"], my), (mx, b["y1"])]
        for axis, limit, sign in ((0, a["x0"], 1), (0, a["x1"], -1), (1, a["y0"], 1), (1, a["y1"], -1)):
            at = lambda p, q, axis=axis, limit=limit: tuple(p[k] + (q[k] - p[k]) * (limit - p[axis]) / (q[axis] - p[axis]) for k in (0, 1))
            points = clip(points, lambda p, axis=axis, limit=limit, sign=sign: sign * (p[axis] - limit) >= 0, at) if points else points
        want = abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(points, points[1:] + points[:1], strict=True))) / 2 if points else 0.0
        assert area == pytest.approx(want, abs=1e-5)


def test_metres_on_the_ellipsoid(spark):
    """Neighbouring points by the radii of curvature of WGS 84, which short distances follow to a thousandth."""
    from fieldmerge.sources.derived import POINTS, derived

    a, e2 = 6378137.0, 0.00669437999014
    at = {r["k"]: r for r in derived(spark, SF, POINTS).collect()}
    radii = lambda lat: (a * (1 - e2) / (1 - e2 * math.sin(lat) ** 2) ** 1.5, a / math.sqrt(1 - e2 * math.sin(lat) ** 2))
    found = {r["k"]: r["metres"] for r in registry.QUERIES["metric_distance"](spark, SF).collect()}
    for k, metres in found.items():
        p, q = at[k], at[k + 1]
        lat = math.radians((p["lat"] + q["lat"]) / 2)
        m, n = radii(lat)
        want = math.hypot(math.radians(p["lat"] - q["lat"]) * m, math.radians(p["lon"] - q["lon"]) * n * math.cos(lat))
        if want < 5000:
            assert metres == pytest.approx(want, rel=3e-3)
    for r in registry.QUERIES["metric_area"](spark, SF).collect():
        lat = math.radians(at[r["k"]]["lat"] + 0.0005)
        m, n = radii(lat)
        assert r["area_m2"] == pytest.approx(math.radians(0.001) ** 2 * m * n * math.cos(lat), rel=3e-3)


def test_rings(spark):
    rng = random.Random(2)
    rows = [(i, [(float(rng.randint(0, 6)), float(rng.randint(0, 6))) for _ in range(rng.randint(3, 6))]) for i in range(300)]
    rings = spark.createDataFrame([(i, p + p[:1]) for i, p in rows], "i int, ring array<struct<x:double,y:double>>")
    got = {r["i"]: r["c"] for r in rings.select("i", g.ring_crosses(F.col("ring")).alias("c")).collect()}
    turn = lambda p, q, r: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
    on = lambda p, q, r: turn(p, q, r) == 0 and min(p[0], q[0]) <= r[0] <= max(p[0], q[0]) and min(p[1], q[1]) <= r[1] <= max(p[1], q[1])
    for i, points in rows:
        sides = list(zip(points, points[1:] + points[:1], strict=True))
        want = False
        for m, n in itertools.combinations(range(len(sides)), 2):
            if n - m > 1 and not (m == 0 and n == len(sides) - 1):
                (a, b), (c, d) = sides[m], sides[n]
                want |= (turn(a, b, c) * turn(a, b, d) < 0 and turn(c, d, a) * turn(c, d, b) < 0) or on(a, b, c) or on(a, b, d) or on(c, d, a) or on(c, d, b)
        assert got[i] == want, points
    raw = spark.createDataFrame([(1, [(0.0, 0.0), (0.0, 0.0), (1.0, 0.0), (1.0, 1.0)]), (2, []), (3, [(2.0, 2.0)])], "i int, ring array<struct<x:double,y:double>>")
    fixed = {r["i"]: [tuple(p) for p in r["f"]] for r in raw.select("i", g.repaired_ring(F.col("ring")).alias("f")).collect()}
    assert fixed == {1: [(0, 0), (1, 0), (1, 1), (0, 0)], 2: [], 3: [(2, 2)]}


def test_union_of_many_boxes(spark):
    rng = random.Random(6)
    obs, clusters, want = [], [], {}
    for c in range(40):
        cells, members = set(), rng.randint(1, 7)
        for _ in range(members):
            x, y, w, h = rng.randint(0, 9), rng.randint(0, 9), rng.randint(1, 6), rng.randint(1, 6)
            obs.append((len(obs), float(x), float(y), float(x + w), float(y + h)))
            clusters.append((len(clusters), c))
            cells |= {(i, j) for i in range(x, x + w) for j in range(y, y + h)}
        want[c] = (members, len(cells))
    found = clustering.merged_geometry(spark.createDataFrame(obs, "id long, x0 double, y0 double, x1 double, y1 double"), spark.createDataFrame(clusters, "id long, cluster_id long"))
    assert {r["cluster_id"]: (r["members"], r["union_area"]) for r in found.collect()} == want


def test_line_distance_and_classifier(spark, monkeypatch):
    near = {(r["id"], r["line_id"]): r["d"] for r in __import__("fieldmerge.plans.quality", fromlist=["x"]).infra_pairs(spark, SF).where("h = 0").collect()}
    rows = registry.QUERIES["parcel_line_distance"](spark, SF).collect()
    hits = [r for r in rows if (r["id"], r["line_id"]) in near]
    assert len(hits) > 100 and all(r["distance_m"] == pytest.approx(near[r["id"], r["line_id"]], abs=1e-9) for r in hits)
    found = {r["label"]: r for r in registry.QUERIES["train_match_classifier"](spark, SF).collect()}
    assert set(found) == {0.0, 1.0} and all(r["accuracy"] > 0.95 and r["n"] > 100 for r in found.values())
    monkeypatch.setattr(reports, "MIN_LABELS", 10**9)
    assert registry.QUERIES["train_match_classifier"](spark, SF).count() == 0


def test_a_forest_in_parts_has_all_its_trees(spark, monkeypatch):
    """Pairs are joined once, and where draws are many each fit has few trees, on all rows, and all votes count."""
    from pyspark.ml.classification import RandomForestClassifier

    data = reports.labelled_pairs(spark, SF)
    plan = data._jdf.queryExecution().optimizedPlan().toString()
    assert len([line for line in plan.splitlines() if "Join" in line]) == 1
    keys = {r["id_a"]: r["k_a"] for r in reports.observations(spark, SF).select(F.col("id").alias("id_a"), F.col("k").alias("k_a")).collect()}
    rows = data.collect()
    assert len(rows) > 1000 and all(r["k_a"] == keys[r["id_a"]] and r["fold"] == r["k_a"] % 5 and r["label"] == (keys[r["id_b"]] == r["k_a"]) for r in rows)
    learnt, fitted, fit = sum(r["fold"] != 0 for r in rows), [], RandomForestClassifier.fit
    monkeypatch.setattr(RandomForestClassifier, "fit", lambda self, df: fitted.append((self.getNumTrees(), self.getSeed(), df.count())) or fit(self, df))
    whole = {r["label"]: (r["n"], r["accuracy"]) for r in reports.train_match_classifier(spark, SF).collect()}
    assert fitted == [(100, 42, learnt)]
    monkeypatch.setattr(reports, "DRAWS", 40 * learnt)
    parts = {r["label"]: (r["n"], r["accuracy"]) for r in reports.train_match_classifier(spark, SF).collect()}
    assert [x for x, _, _ in fitted[1:]] == [40, 40, 20] and len({x for _, x, _ in fitted[1:]}) == 3 and all(n == learnt for _, _, n in fitted)
    assert {k: n for k, (n, _) in parts.items()} == {k: n for k, (n, _) in whole.items()} and all(x > 0.95 for _, x in parts.values())


def test_versions_of_a_table(spark, tmp_path):
    path = str(tmp_path / "t")
    assert files.replace(spark.range(3), path) and files.current(spark, path).count() == 3
    assert not files.replace(spark.range(0), path) and files.current(spark, path).count() == 3
    assert files.replace(spark.range(9), path) and files.current(spark, path).count() == 9
    rows = lambda *r: spark.createDataFrame(r, "k long, a string, b string")
    path = str(tmp_path / "u")
    files.upsert(rows((1, "x", "x"), (2, "y", "y")), path, "k", ["a"])
    files.upsert(rows((2, "new", "new"), (3, "z", "z")), path, "k", ["a"])
    assert sorted(map(tuple, files.current(spark, path).collect())) == [(1, "x", "x"), (2, "new", "y"), (3, "z", "z")]


def _clipped(a, b, ring):
    """Length of a segment in a simple ring by small steps of exact cuts: crossings with each side in turn, then the middle of each part by winding."""
    cuts = [0.0, 1.0]
    for p, q in zip(ring, ring[1:] + ring[:1], strict=True):
        d = (b[0] - a[0]) * (q[1] - p[1]) - (b[1] - a[1]) * (q[0] - p[0])
        if d:
            t = ((p[0] - a[0]) * (q[1] - p[1]) - (p[1] - a[1]) * (q[0] - p[0])) / d
            cuts += [t] if 0 < t < 1 else []
    total, cuts = 0.0, sorted(cuts)
    for s, t in zip(cuts, cuts[1:], strict=False):
        x, y = (a[i] + (s + t) / 2 * (b[i] - a[i]) for i in (0, 1))
        angle = 0.0
        for p, q in zip(ring, ring[1:] + ring[:1], strict=True):
            one, two = math.atan2(p[1] - y, p[0] - x), math.atan2(q[1] - y, q[0] - x)
            angle += (two - one + math.pi) % (2 * math.pi) - math.pi
        total += (t - s) * (abs(angle) > math.pi)
    return total * math.dist(a, b)


def test_lines_clipped_by_any_ring():
    import numpy as np

    from fieldmerge.functions.clipping import lengths_inside

    rng = random.Random(17)
    segments, rings = [], []
    for _ in range(3000):
        n = rng.randint(3, 9)  # a star around a point is simple and mostly not convex
        turns = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
        rings.append([(10 + r * math.cos(t), 10 + r * math.sin(t)) for t in turns for r in [rng.uniform(1, 9)]])
        segments.append([rng.uniform(-5, 25) for _ in range(4)])
    got = lengths_inside(np.array(segments), [np.array(r) for r in rings])
    assert np.abs(got - [_clipped(s[:2], s[2:], r) for s, r in zip(segments, rings, strict=True)]).max() < 1e-6
    box = np.array([(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)], float)
    odd = [[-1, 2, 9, 2], [1, 1, 1, 1], [9, 9, 12, 9], [0, 0, 4, 4], [1, 1, 3, 2]]
    assert lengths_inside(np.array(odd, float), [box] * 5).round(9).tolist() == [4.0, 0.0, 0.0, round(32**0.5, 9), round(5**0.5, 9)]
    assert lengths_inside(np.array([[0, 0, 1, 1]], float), [np.empty((0, 2))]).tolist() == [0.0] and len(lengths_inside(np.empty((0, 4)), [])) == 0


def test_slanted_lines_in_turned_parcels(spark):
    from fieldmerge.plans import flows

    got = {(r["id"], r["line_id"]): r["length_m"] for r in registry.QUERIES["infra_line_clip"](spark, SF).collect()}
    parcels = [(r["id"], [(p["x"], p["y"]) for p in r["ring"]]) for r in flows.turned_parcels(spark, SF).collect()]
    whole = {r["line_id"]: (r["ay"], r["last"]) for r in flows.line_pieces(spark, SF).groupBy("line_id").agg(F.min_by("ay", "piece").alias("ay"), F.max_by("by", "piece").alias("last")).collect()}
    want = {}
    for i, ring in parcels:
        ys = [y for _, y in ring]
        for line, (a, b) in whole.items():
            if min(a, b) <= max(ys) and max(a, b) >= min(ys) and (length := _clipped((0.0, a), (12_000.0, b), ring)) > 0:
                want[i, line] = length
    assert len(want) > 200 and {k for k in want if want[k] > 1e-6} <= set(got)
    assert all(abs(got[k] - want.get(k, 0.0)) < 1e-6 for k in got)


def _common(rings):
    """Area common to convex rings that run counter-clockwise, by clipping one with the sides of the others."""
    out = rings[0]
    for ring in rings[1:]:
        for p, q in zip(ring, ring[1:] + ring[:1], strict=True):
            side = lambda r, p=p, q=q: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
            kept = []
            for a, b in zip(out, out[1:] + out[:1], strict=True):
                if side(a) >= 0:
                    kept.append(a)
                if side(a) * side(b) < 0:
                    t = side(a) / (side(a) - side(b))
                    kept.append((a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])))
            out = kept
            if not out:
                return 0.0
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(out, out[1:] + out[:1], strict=True))) / 2


def _covered(rings):
    return sum((-1) ** (n + 1) * _common(list(some)) for n in range(1, len(rings) + 1) for some in itertools.combinations(rings, n))


def test_union_of_turned_polygons(spark):
    import numpy as np

    from fieldmerge.functions.clipping import union_areas
    from fieldmerge.plans import flows

    rng, clusters = random.Random(23), []
    for _ in range(400):
        rings = []
        for _ in range(rng.randint(1, 4)):
            cx, cy, w, h, t = rng.uniform(0, 10), rng.uniform(0, 10), rng.uniform(1, 6), rng.uniform(1, 6), rng.choice([0, 0, rng.uniform(0, 3)])
            rings.append([(cx + a * w * math.cos(t) - b * h * math.sin(t), cy + a * w * math.sin(t) + b * h * math.cos(t)) for a, b in ((-1, -1), (1, -1), (1, 1), (-1, 1))])
        clusters.append(rings if rng.random() < 0.9 else rings + rings[:1])
    got = union_areas([[np.array(r) for r in c] for c in clusters])
    assert np.abs(got - [_covered(c) for c in clusters]).max() < 1e-6
    notch = np.array([(0, 0), (4, 0), (4, 4), (2, 1), (0, 4)], float)  # not convex
    assert union_areas([[notch], [notch, notch[::-1]], [], [np.array([(0, 0), (4, 0), (4, 4), (0, 4)], float), notch]]).round(9).tolist() == [10.0, 10.0, 0.0, 16.0]
    rows = {r["cluster_id"]: r for r in registry.QUERIES["merge_polygon_union"](spark, SF).collect()}
    members = {}
    for r in flows.turned_members(spark, SF).collect():
        members.setdefault(r["cluster_id"], []).append([(p["x"], p["y"]) for p in r["ring"]])
    assert set(rows) == set(members) and max(map(len, members.values())) >= 3
    assert all(rows[c]["members"] == len(m) and abs(rows[c]["union_area"] - _covered(m)) < 1e-6 for c, m in members.items())
