"""The lifecycle of conflicts and identities as streams with keyed state, and data-set versions written by micro-batches."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fieldmerge.config import TRANSITIONS
from fieldmerge.functions import geometry as g
from fieldmerge.functions.session import stored
from fieldmerge.operators import spatial_join
from fieldmerge.operators.graph import connected_components
from fieldmerge.sources import files

LOG = "conflict_id long, event_id long, previous_state string, requested_state string, accepted boolean"


def _transitions(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Requests of one conflict in order of (ts, event_id); the state is the conflict's current one."""
    current = state.get[0] if state.exists else "DETECTED"
    rows = []
    for event in pd.concat(list(batches)).sort_values(["ts", "event_id"]).itertuples():
        legal = event.requested_state in TRANSITIONS[current]
        rows.append((key[0], event.event_id, current, event.requested_state, legal))
        current = event.requested_state if legal else current
    state.update((current,))
    yield pd.DataFrame(rows, columns=["conflict_id", "event_id", "previous_state", "requested_state", "accepted"])


def stream_lifecycle(requests: DataFrame) -> DataFrame:
    """Accepted and rejected transitions of a stream (conflict_id, event_id, ts, requested_state).

    Within a micro-batch requests are put in order; across batches they count in the order in which they arrive.
    """
    return requests.groupBy("conflict_id").applyInPandasWithState(_transitions, LOG, "state string", "append", GroupStateTimeout.NoTimeout)


_HELD = "state string, ts array<long>, event_id array<long>, requested array<string>"


def stream_lifecycle_in_order(requests: DataFrame, wait: str = "31 days", lateness: str = "3650 days") -> DataFrame:
    """LOG and late: the transitions of a stream (conflict_id, event_id, ts, requested_state) in order of event time.

    A request is held in its conflict's state until the stream has seen a time `wait` later than its own; a timer of the conflict
    then releases it and all before it, by (ts, event_id). A request that comes after its time was released changes nothing and is
    logged as late. Rows with a null conflict_id move time on and do nothing else: a source that has ended sends one `wait` after its
    last request. Spark's own watermark, behind which it drops rows unseen, lies `lateness` back.
    """
    apart = int((pd.Timedelta(lateness) - pd.Timedelta(wait)).total_seconds() * 1000)

    def held(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if key[0] is None or pd.isna(key[0]):
            return
        mark = state.getCurrentWatermarkMs()
        released = mark + apart if mark > 0 else -(2**62)
        current, *lists = state.get if state.exists else ("DETECTED", [], [], [])
        waiting, rows = list(zip(*lists, strict=True)), []
        for batch in [] if state.hasTimedOut else batches:
            for event_id, ts, wanted in zip(batch["event_id"], batch["ts"].astype("datetime64[ms]").astype("int64"), batch["requested_state"], strict=True):
                if ts <= released:
                    rows.append((key[0], event_id, current, wanted, False, True))
                else:
                    waiting.append((ts, event_id, wanted))
        waiting.sort()
        due = [x for x in waiting if x[0] <= released]
        for _, event_id, wanted in due:
            legal = wanted in TRANSITIONS[current]
            rows.append((key[0], event_id, current, wanted, legal, False))
            current = wanted if legal else current
        waiting = waiting[len(due) :]
        state.update((current, *([x[k] for x in waiting] for k in range(3))))
        if waiting:
            state.setTimeoutTimestamp(max(waiting[0][0] - apart, mark + 1))
        yield pd.DataFrame(rows, columns=["conflict_id", "event_id", "previous_state", "requested_state", "accepted", "late"])

    timed = requests.select("conflict_id", "event_id", "ts", "requested_state").withWatermark("ts", lateness)
    return timed.groupBy("conflict_id").applyInPandasWithState(held, LOG + ", late boolean", _HELD, "append", GroupStateTimeout.EventTimeTimeout)


#: A decided request; registry_id: the box that it continues or may continue.
DECIDED = "request_id long, action string, registry_id long, x0 double, y0 double, x1 double, y1 double"
#: Requests that one call settles, and the side of the squares in which it looks for boxes.
GROUP_ROWS, SQUARE = 20_000, 60.0


class _Boxes:
    """Boxes by the squares that they meet; those of more than 64 squares are looked at every time."""

    def __init__(self):
        self.boxes, self.squares, self.wide = [], {}, []

    def _met(self, x0: float, y0: float, x1: float, y1: float) -> list[tuple[int, int]] | None:
        if not all(map(math.isfinite, (x0, y0, x1, y1))):
            return []
        i0, j0, i1, j1 = (int(v // SQUARE) for v in (x0, y0, x1, y1))
        return None if (i1 - i0 + 1) * (j1 - j0 + 1) > 64 else [(i, j) for i in range(i0, i1 + 1) for j in range(j0, j1 + 1)]

    def add(self, name: int, *box: float) -> None:
        met = self._met(*box)
        for place in [self.wide] if met is None else [self.squares.setdefault(s, []) for s in met]:
            place.append(len(self.boxes))
        self.boxes.append((name, *box))

    def near(self, *box: float) -> list[tuple]:
        """The boxes that share a square with box, in the order in which they were added."""
        met = self._met(*box)
        if met is None:
            return self.boxes
        return [self.boxes[k] for k in sorted({k for s in met for k in self.squares.get(s, ())} | set(self.wide))]


class _Few(_Boxes):
    """The boxes of a small group, all looked at every time: cheaper than squares."""

    def add(self, name: int, *box: float) -> None:
        if all(map(math.isfinite, box)):
            self.boxes.append((name, *box))

    def near(self, *box: float) -> list[tuple]:
        return self.boxes if all(map(math.isfinite, box)) else []


#: Requests of a group that are compared without squares.
_SMALL = 16


def _settled(group: pd.DataFrame) -> pd.DataFrame:
    """Requests of whole components in order of request_id; each sees its best box of the registry and the boxes that earlier ones registered."""
    group = group.sort_values(["part", "request_id"])
    part = group["part"].to_numpy()
    size = np.diff(np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))) if len(part) else np.empty(0, np.int64)
    # at first by the registry alone, which is all that a request without neighbours sees
    best = group["iou"].astype(float).fillna(0.0).to_numpy(copy=True)
    chosen = group["found"].astype("Int64").where(group["iou"].notna(), None).tolist()
    ids, boxes = group["request_id"].tolist(), list(zip(*(group[c].tolist() for c in ("x0", "y0", "x1", "y1")), strict=True))
    for begin, n in zip((np.cumsum(size) - size)[size > 1].tolist(), size[size > 1].tolist(), strict=True):
        known = _Few() if n <= _SMALL else _Boxes()
        for k in range(begin, begin + n):
            x0, y0, x1, y1 = boxes[k]
            top = float(best[k])
            for i, a0, b0, a1, b1 in known.near(x0, y0, x1, y1):
                over = max(0.0, min(a1, x1) - max(a0, x0)) * max(0.0, min(b1, y1) - max(b0, y0))
                iou = over / ((a1 - a0) * (b1 - b0) + (x1 - x0) * (y1 - y0) - over) if over else 0.0
                if iou > top:
                    top, chosen[k] = iou, i
            best[k] = top
            if top < 0.70:
                known.add(ids[k], x0, y0, x1, y1)
    told = group[["request_id", "x0", "y0", "x1", "y1"]].copy()
    told["action"] = np.where(best < 0.15, "NEW", np.where(best < 0.70, "UNCERTAIN", "CONTINUITY"))
    told["registry_id"] = pd.array([None if low else c for low, c in zip(best < 0.15, chosen, strict=True)], dtype="Int64")
    return told[["request_id", "action", "registry_id", "x0", "y0", "x1", "y1"]]


def resolve_batch(requests: DataFrame, registry: DataFrame | None, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Identity decisions of requests (request_id, x0, y0, x1, y1) as if each came alone, in order of request_id.

    A request is compared with every box that it overlaps, wherever cells end: those of the registry by a range join, which leaves one
    best box each (the smaller id wins ties), and those that earlier requests register by a fold over each group of requests
    that overlap one another, directly or by others. Only such groups are in sequence. Where one is larger than group_rows, the
    requests are halved by request_id and the second half meets what the first has registered, so no call holds more. Requests with
    a null side, or without area, overlap nothing and are NEW.
    """
    requests = stored(requests.select(F.col("request_id").alias("id"), "x0", "y0", "x1", "y1"), "requests")
    a, b = g.box(suffix="_a"), g.box(suffix="_b")
    within = spatial_join.range_pairs(requests, requests, 0.0, cell=60.0, extra=F.col("id_a") < F.col("id_b")).where(spatial_join.after_join(g.intersection_area(a, b) > 0))
    parts = connected_components(within.select("id_a", "id_b"), "id_a", "id_b").select(F.col("node").alias("id"), F.col("component").alias("part"))
    rows = requests.join(parts, "id", "left").withColumn("part", F.coalesce("part", "id"))
    sizes = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("low"), F.max("id").alias("high"))
    total, largest = sizes.agg(F.sum("n"), F.max(F.struct("n", "low", "high"))).first()
    if largest and largest["n"] > group_rows and largest["low"] < largest["high"]:
        middle = (largest["low"] + largest["high"]) // 2
        named = requests.withColumnRenamed("id", "request_id")
        first = stored(resolve_batch(named.where(F.col("request_id") <= middle), registry, group_rows), "first-half")
        fresh = first.where("action <> 'CONTINUITY'").select(F.col("request_id").alias("registry_id"), "x0", "y0", "x1", "y1", F.lit(1).alias("age"))
        older = registry if registry is None or "age" in registry.columns else registry.withColumn("age", F.lit(0))
        second = resolve_batch(named.where(F.col("request_id") > middle), fresh if older is None else older.unionByName(fresh), group_rows)
        return first.unionByName(second)
    if registry is None:
        rows = rows.withColumns({"iou": F.lit(None).cast("double"), "found": F.lit(None).cast("long")})
    else:  # what an earlier batch registered wins ties over what this one did
        age = F.col("age") if "age" in registry.columns else F.lit(0)
        known = registry.select(F.col("registry_id").alias("id"), "x0", "y0", "x1", "y1", age.alias("age"))
        met = spatial_join.range_pairs(requests, known, 0.0, cell=60.0).withColumn("iou", g.iou(a, b)).where(spatial_join.after_join(F.col("iou") > 0))
        best = met.groupBy(F.col("id_a").alias("id")).agg(F.max_by(F.struct("iou", F.col("id_b").alias("found")), F.struct("iou", -F.col("age_b"), -F.col("id_b"))).alias("m"))
        rows = rows.join(best.select("id", "m.iou", "m.found"), "id", "left")
    groups = max(1, -(-(total or 0) // group_rows))
    grouped = rows.withColumnRenamed("id", "request_id").withColumn("group", F.pmod(F.xxhash64("part"), F.lit(groups)))
    return grouped.groupBy("group").applyInPandas(_settled, DECIDED)


#: The registry of identities lies in so many buckets, by a hash of the cells of this side that a box meets.
BUCKETS, CELL = 64, 1_000.0


def _buckets(buckets: int, cell: float) -> Column:
    """The buckets of all cells that a box meets; 0 for a box with a null side, which meets none."""
    at = lambda c: F.floor(F.col(c) / F.lit(cell)).cast("long")
    cells = (at("x1") - at("x0") + 1) * (at("y1") - at("y0") + 1)
    inner = lambda x: F.transform(F.sequence(at("y0"), at("y1")), lambda y: F.pmod(F.xxhash64(x, y), F.lit(buckets)).cast("int"))
    few = F.array_distinct(F.flatten(F.transform(F.sequence(at("x0"), at("x1")), inner)))
    return F.when(cells.isNull() | (cells < 1), F.array(F.lit(0))).when(cells > 4 * buckets, F.sequence(F.lit(0), F.lit(buckets - 1))).otherwise(few)


def identity_batches(path: str, buckets: int = BUCKETS, cell: float = CELL):
    """A function for foreachBatch: decides the requests of each batch against all that earlier ones registered.

    The registry is a bucketed table: a box stands in the bucket of every cell that it meets, so a batch reads the buckets of its own
    cells and no others, and writes again only those in which it registers something. A bucket lies in the files of one version,
    however many batches there were. Decisions are one folder per batch; a batch that runs again replaces its own and
    sees the registry as it was before it.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark, at = batch.sparkSession, f"{path}/registry"
        requests = stored(batch.select("request_id", "x0", "y0", "x1", "y1"), "batch")
        before = files.manifest(spark, at, upto=epoch)
        asked = [r[0] for r in requests.select(F.explode(_buckets(buckets, cell))).distinct().collect()]
        held = {b: before[b] for b in asked if b in before}
        registry = files.read_buckets(spark, at, held) if held else None
        decided = stored(resolve_batch(requests, None if registry is None else registry.drop("bucket").dropDuplicates(["registry_id"])), "decided")
        decided.select("request_id", "action", "registry_id").write.mode("overwrite").parquet(f"{path}/decisions/{epoch}")
        fresh = decided.where("action <> 'CONTINUITY'").select(F.col("request_id").alias("registry_id"), "x0", "y0", "x1", "y1")
        fresh = stored(fresh.withColumn("bucket", F.explode(_buckets(buckets, cell))), "fresh")
        changed = [r[0] for r in fresh.select("bucket").distinct().collect()]
        older = {b: before[b] for b in changed if b in before}
        if changed:
            files.write_buckets(fresh.unionByName(files.read_buckets(spark, at, older)) if older else fresh, at, epoch + 1, before)

    return write


def decisions(spark, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/decisions/*")


def incremental_sync(path: str):
    """A function for foreachBatch: each batch that has rows becomes a version of the data set, its catalogue row written last.

    A batch that fails or is empty leaves the active version as it was; a batch that runs again replaces its own version.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        n = batch.count()
        if not n:
            return
        batch.write.mode("overwrite").parquet(f"{path}/versions/version={epoch}")
        entry = batch.sparkSession.range(1).select(F.lit(epoch).cast("long").alias("version"), F.lit(n).cast("long").alias("records"))
        entry.write.mode("overwrite").parquet(f"{path}/catalog/entry={epoch}")

    return write


def active(spark, path: str) -> DataFrame:
    """The rows of the version that the catalogue names last."""
    last = spark.read.parquet(f"{path}/catalog").agg(F.max("version")).first()[0]
    return spark.read.parquet(f"{path}/versions/version={last}")
