"""Clusters settled in rounds, identities and lifecycles over many batches, tables that are written in buckets, sequence comparison."""

import datetime
import difflib
import math
import random
import statistics
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_brute_force import _identities

from fieldmerge.config import TRANSITIONS
from fieldmerge.functions.sequences import sequence_ratios
from fieldmerge.operators import clustering, quantiles
from fieldmerge.sources import files
from fieldmerge.streaming import lifecycle

BOX = "request_id long, x0 double, y0 double, x1 double, y1 double"


def test_sequence_ratios_equal_the_standard_library():
    rng = random.Random(3)

    def word(letters, most):
        return "".join(rng.choice(letters) for _ in range(rng.randint(0, most)))

    first, second = [], []
    for _ in range(100_000):
        letters = rng.choice(["ab", "abc1", "0123456789/-ab", "é漢a😀b"])
        a = word(letters, 16)
        first.append(a)
        second.append(word(letters, 16) if rng.random() < 0.5 else "".join(c for c in a if rng.random() < 0.8) + word(letters, 3))
    for _ in range(60):  # long ones, where common letters start no block
        a = word(rng.choice(["ab", "abcdefghijklmnop", "".join(map(chr, range(200, 400)))]), 500)
        first.append(a)
        second.append("".join(c if rng.random() < 0.9 else "x" for c in a) + a[:99])
    assert sequence_ratios(first, second).tolist() == [difflib.SequenceMatcher(None, a, b).ratio() for a, b in zip(first, second, strict=True)]
    assert sequence_ratios([], []).tolist() == []


@pytest.mark.parametrize(("nodes", "links", "kinds", "group"), [(120, 500, 8, 10), (1500, 1800, 3, 60), (40, 60, 4, 10**6)])
def test_rounds_equal_the_sequential_rule(spark, nodes, links, kinds, group):
    rng = random.Random(nodes)
    source = {i: f"s{rng.randrange(kinds)}" for i in range(nodes)}
    pairs = {tuple(sorted(rng.sample(range(nodes), 2))) for _ in range(links)}
    rows = [(a, b, source[a], source[b], round(rng.random(), 2), rng.random()) for a, b in pairs]
    edges = spark.createDataFrame(rows, "id_a long, id_b long, source_a string, source_b string, score double, iou double")
    plain = edges.toPandas()
    plain["la"], plain["lb"] = plain.id_a, plain.id_b
    plain["sa"], plain["sb"] = [[x] for x in plain.source_a], [[x] for x in plain.source_b]
    want = clustering._greedy(plain)
    members = {r.id: r.cluster_id for r in want[want.kind == "member"].itertuples()}
    told = {(r.id, r.other): (int(r.cluster_id), bool(r.accepted)) for r in want[want.kind == "edge"].itertuples()}
    found, settled = clustering.cluster_constrained(spark.createDataFrame(list(source.items()), "id long, source string"), edges, group)
    assert {r["id"]: r["cluster_id"] for r in found.collect()} == {i: members.get(i, i) for i in source}
    assert {(r["id_a"], r["id_b"]): (r["cluster_id"], r["accepted"]) for r in settled.collect()} == told


def _boxes(n, seed, width=700, size=60):
    rng, rows = random.Random(seed), []
    for i in range(n):
        x, y = rng.uniform(0, width), rng.uniform(0, width)
        rows.append({"id": i, "x0": x, "y0": y, "x1": x + rng.uniform(5, size), "y1": y + rng.uniform(5, size)})
    return rows


def test_twenty_batches_equal_the_plain_loop(spark, tmp_path, monkeypatch):
    rows, opened = _boxes(400, 5, 3000, 400), []
    read = files.read_buckets

    def watched(spark, path, written):
        found = read(spark, path, written)
        opened.append((len(found.inputFiles()), len(written)))
        return found

    monkeypatch.setattr(files, "read_buckets", watched)
    write = lifecycle.identity_batches(str(tmp_path / "t"), buckets=8)
    for epoch in range(20):
        write(spark.createDataFrame([tuple(r.values()) for r in rows[20 * epoch : 20 * epoch + 20]], BOX), epoch)
    got = {r["request_id"]: (r["action"], r["registry_id"]) for r in lifecycle.decisions(spark, str(tmp_path / "t")).collect()}
    assert got == _identities(rows)
    assert max(n for n, _ in opened) <= 8 and all(n <= buckets for n, buckets in opened)


def test_large_groups_of_requests_are_halved(spark):
    rows = _boxes(200, 8, 300)
    df = spark.createDataFrame([tuple(r.values()) for r in rows], BOX)
    got = {r["request_id"]: (r["action"], r["registry_id"]) for r in lifecycle.resolve_batch(df, None, group_rows=60).collect()}
    assert got == _identities(rows)


def _plain_log(events):
    states, log = {}, set()
    for conflict, event, _, wanted in sorted(events, key=lambda e: (e[0], e[2], e[1])):
        before = states.get(conflict, "DETECTED")
        legal = wanted in TRANSITIONS[before]
        states[conflict] = wanted if legal else before
        log.add((conflict, event, before, wanted, legal, False))
    return log


def test_lifecycle_follows_event_time(spark, tmp_path):
    rng, start = random.Random(2), datetime.datetime(2020, 1, 1)
    names = sorted(TRANSITIONS)
    events = [(rng.randrange(12), k, start + datetime.timedelta(hours=rng.randrange(24 * 60)), rng.choice(names)) for k in range(300)]
    arrivals = sorted(events, key=lambda e: (e[2] + datetime.timedelta(hours=rng.uniform(0, 47)), e[1]))
    late = (3, 999, start + datetime.timedelta(hours=1), "UNDER_REVIEW")
    batches = [arrivals[k : k + 75] for k in range(0, 300, 75)] + [[late, (None, None, start + datetime.timedelta(days=70), None)]]
    schema = "conflict_id long, event_id long, ts timestamp, requested_state string"
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = lifecycle.stream_lifecycle_in_order(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), wait="2 days")
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    logged_late = {r for r in got if r[5]}
    assert {(r[0], r[1], r[3], r[4]) for r in logged_late} == {(3, 999, "UNDER_REVIEW", False)}
    assert got - logged_late == _plain_log(events)


def test_upsert_writes_only_buckets_with_changed_keys(spark, tmp_path):
    path = str(tmp_path / "t")
    files.upsert(spark.range(1000).select("id", (F.col("id") * 2).alias("a"), F.lit("x").alias("b")), path, "id", ["a"], buckets=16)
    before = files.manifest(spark, path)
    bucket = F.pmod(F.xxhash64("id"), F.lit(16))
    few = spark.range(1000).where(bucket == 3).select("id", F.lit(-1).cast("long").alias("a"), F.lit("y").alias("b"))
    files.upsert(few, path, "id", ["a"], buckets=16)
    after = files.manifest(spark, path)
    assert {b for b in after if after[b] != before.get(b)} == {3}
    rows = files.current(spark, path).select("id", "a", "b").collect()
    changed = {r["id"] for r in few.collect()}
    assert sorted(map(tuple, rows)) == [(i, -1 if i in changed else 2 * i, "x") for i in range(1000)]
    # a run that fails before its manifest is written changes nothing for readers
    broken = few.select("id", F.raise_error(F.lit("stop")).cast("long").alias("a"), "b")
    with pytest.raises(Exception, match="stop"):
        files.upsert(broken, path, "id", ["a"], buckets=16)
    assert files.manifest(spark, path) == after and files.current(spark, path).count() == 1000
    files.upsert(few.limit(0), path, "id", ["a"], buckets=16)
    assert files.manifest(spark, path) == after


def test_ranks_are_exact(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "BINS", 64)
    monkeypatch.setattr(quantiles, "FEW", 5)
    rng = random.Random(4)
    draw = {"a": lambda: rng.gauss(0, 1), "b": lambda: float(rng.randrange(4)), "c": lambda: rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300), "d": lambda: 7.0}
    rows = [(k, f()) for k, f in draw.items() for _ in range(300)] + [("e", None), ("a", math.nan), (None, 2.0), (None, 5.0)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(4)
    wanted = quantiles.medians("v", "low", "high") | {"p95": ("v", lambda n: F.floor(F.lit(0.95) * n) + 1)}
    got = {r["k"]: r for r in quantiles.at_ranks(df, ["k"], wanted).withColumn("m", quantiles.median("low", "high")).collect()}
    for k in ("a", "b", "c", "d", None):
        mine = sorted(v for x, v in rows if x == k and not math.isnan(v))
        assert got[k]["low"] == mine[(len(mine) - 1) // 2] and got[k]["high"] == mine[len(mine) // 2] and got[k]["p95"] == mine[int(0.95 * len(mine))]
        if k != "c":
            assert got[k]["m"] == pytest.approx(statistics.median(mine))
    assert "e" not in got
    assert quantiles.at_ranks(df.limit(0), [], wanted).count() == 0


def test_many_small_groups_of_requests_are_settled_in_one_pass():
    """20,000 requests, of which two or one make a group: a frame for each group took most of the stream's time."""
    n = 20_000
    k = np.arange(n)
    part = np.where(k % 5 == 4, k, k - k % 5 % 2)  # two, two and one of every five
    x0 = part * 100.0 + (k - part) * 2.0
    group = pd.DataFrame({"request_id": k, "part": part, "x0": x0, "y0": 0.0, "x1": x0 + 10, "y1": 10.0, "iou": np.nan, "found": np.nan}).sample(frac=1, random_state=1)
    began = time.process_time()
    told = lifecycle._settled(group).set_index("request_id").sort_index()
    assert time.process_time() - began < 2.0
    second = k != part  # 8 of 12 in common
    assert (told["action"] == np.where(second, "UNCERTAIN", "NEW")).all()
    assert told["registry_id"].isna().eq(~second).all() and (told["registry_id"][second] == part[second]).all()
