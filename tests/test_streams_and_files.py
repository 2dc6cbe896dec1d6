import json

from pyspark.sql import functions as F

from fieldmerge.operators import ledger
from fieldmerge.sources import files
from fieldmerge.sources.derived import REQUESTS, derived
from fieldmerge.streaming import lifecycle

SF = "/root/testdata/sf0.001"


def _run(stream, name, tmp_path):
    q = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination()


def test_stream_equals_batch_fold(spark, tmp_path):
    requests = derived(spark, SF, REQUESTS)
    requests.coalesce(1).write.parquet(str(tmp_path / "requests"))
    stream = spark.readStream.schema(requests.schema).parquet(str(tmp_path / "requests"))
    _run(lifecycle.stream_lifecycle(stream), "lifecycle_log", tmp_path)
    columns = ["conflict_id", "event_id", "previous_state", "requested_state", "accepted"]
    want = ledger.fold_lifecycle(requests).select(*columns)
    got = spark.table("lifecycle_log").select(*columns)
    assert got.count() == want.count() > 0
    assert got.exceptAll(want).count() == 0


def test_identities_see_earlier_requests(spark, tmp_path):
    rows = [(1, 0.0, 0.0, 10.0, 10.0), (2, 0.0, 0.0, 10.0, 10.0), (3, 5.0, 0.0, 15.0, 10.0), (4, 500.0, 0.0, 510.0, 10.0), (5, None, 0.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "request_id long, x0 double, y0 double, x1 double, y1 double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = stream.writeStream.foreachBatch(lifecycle.identity_batches(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r["request_id"]: (r["action"], r["registry_id"]) for r in lifecycle.decisions(spark, str(tmp_path / "out")).collect()}
    assert got == {1: ("NEW", None), 2: ("CONTINUITY", 1), 3: ("UNCERTAIN", 1), 4: ("NEW", None), 5: ("NEW", None)}


def test_incremental_sync_keeps_the_last_version(spark, tmp_path):
    write = lifecycle.incremental_sync(str(tmp_path / "ds"))
    write(spark.range(5), 0)
    write(spark.range(7), 1)
    write(spark.range(0), 2)
    assert lifecycle.active(spark, str(tmp_path / "ds")).count() == 7


def test_geojson_forms(spark, tmp_path):
    ring = [[0, 0], [4, 0], [4, 3], [0, 3], [0, 0]]
    feature = {"type": "Feature", "properties": {"parcel_id": "CAD-1"}, "geometry": {"type": "Polygon", "coordinates": [ring]}}
    for name, body in (("a", {"type": "FeatureCollection", "features": [feature, {"type": "Feature", "properties": {}, "geometry": None}]}), ("b", feature), ("c", {"type": "Polygon", "coordinates": [ring]})):
        (tmp_path / f"{name}.geojson").write_text(json.dumps(body))
    rows = files.read_geojson(spark, str(tmp_path))
    assert rows.count() == 3
    from fieldmerge.functions import geometry as g

    areas = rows.select(g.ring_area(files.outer_ring(F.col("geometry_type"), F.col("coordinates"))).alias("a")).collect()
    assert {r["a"] for r in areas} == {12.0}
    kept, aside = files.import_layer(rows, "road")
    assert kept.count() == 3 and aside.count() == 0


def test_append_ignores_known_keys(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(3).write.parquet(path)
    files.append_new(spark.range(5).union(spark.range(5)), path, ["id"])
    assert spark.read.parquet(path).count() == 5
