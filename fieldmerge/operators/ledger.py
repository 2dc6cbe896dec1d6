"""Version ledgers, change detection, identities and the lifecycle of conflicts."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldmerge.config import TRANSITIONS
from fieldmerge.functions import geometry as g


# Kind, name and date of the sources of the first, the second and later versions.
HISTORY_SOURCES = (
    ("Official Cadastral", "Karnataka Revenue Cadastral Survey", "2022-04-15"),
    ("Municipal GIS", "BBMP Municipal Ward GIS & ORI", "2024-06-20"),
    ("CORS / RTK Survey", "Survey of India CORS RTK Baseline & Reconciled", "2026-09-27"),
)


def compare(before: g.Box, after: g.Box) -> dict[str, Column]:
    """Measures of a change from one box to another; null where a box is missing."""
    a, b = g.box_area(before), g.box_area(after)
    inter = g.intersection_area(before, after)
    dx = (after[0] + after[2]) / 2 - (before[0] + before[2]) / 2
    dy = (after[1] + after[3]) / 2 - (before[1] + before[3]) / 2
    both = before[0].isNotNull() & after[0].isNotNull()
    only = lambda x: F.when(both, x)
    return {
        "area_delta": only(b - a),
        "area_delta_pct": only(F.when(a > 0, (b - a) / a * 100)),
        "iou": only(g.iou(before, after, inter)),
        "symdiff": only(a + b - 2 * inter),
        "perimeter_delta": only(g.box_perimeter(after) - g.box_perimeter(before)),
        "shift": only(F.sqrt(dx * dx + dy * dy)),
        "bearing": only(g.bearing(dx, dy)),
        "changed": only((a + b - 2 * inter) > 0.01),
    }


def renumbered(rows: DataFrame) -> DataFrame:
    """Ledger rows numbered by time within their parcel."""
    by = Window.partitionBy("parcel").orderBy("recorded_at", "version", "x0", "y0", "w", "h")
    return rows.withColumn("n", F.row_number().over(by)).withColumns({"x1": F.col("x0") + F.col("w"), "y1": F.col("y0") + F.col("h")})


def lag_compare(rows: DataFrame) -> DataFrame:
    """Each version of a renumbered ledger against the one before it."""
    by = Window.partitionBy("parcel").orderBy("n")
    before = F.lag(F.struct("x0", "y0", "x1", "y1")).over(by)
    rows = rows.withColumn("prev", before)
    old = tuple(F.col(f"prev.{c}") for c in ("x0", "y0", "x1", "y1"))
    return rows.select("parcel", "n", *(c.alias(k) for k, c in compare(old, g.box()).items()))


def append_versions(ledger: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to append with their numbers, rejected rows with the reason).

    A request (parcel, version or null, box) gets the next number if it names none; a named number must not exist and must be over
    the last. Requests of one parcel are taken in order of their named number, then box.
    """
    last = ledger.groupBy("parcel").agg(F.max("version").alias("last"))
    known = ledger.select(F.col("parcel").alias("__parcel"), F.col("version").alias("known")).distinct()
    rows = requests.join(last, "parcel", "left").join(known, (F.col("parcel") == F.col("__parcel")) & (F.col("version") == F.col("known")), "left").drop("__parcel")
    rows = rows.withColumn("last", F.coalesce("last", F.lit(0)))
    why = F.when(F.col("known").isNotNull(), "duplicate").when(F.col("version").isNotNull() & (F.col("version") <= F.col("last")), "not monotonic").when((F.col("x1") <= F.col("x0")) | (F.col("y1") <= F.col("y0")), "invalid geometry")
    rows = rows.withColumn("why", why)
    order = Window.partitionBy("parcel").orderBy(F.col("version").asc_nulls_last(), "x0", "y0")
    good = rows.where("why is null").withColumn("number", F.col("last") + F.row_number().over(order))
    return good.select("parcel", "number", "x0", "y0", "x1", "y1"), rows.where("why is not null").select("parcel", "version", "why")


def detect_changes(prior: DataFrame, current: DataFrame, key: str = "k") -> DataFrame:
    """Full outer comparison of two snapshots (key, x0, y0, x1, y1; current also status) with change type and status."""
    p = prior.select(F.col(key).alias("pk"), *(F.col(c).alias(f"p{c}") for c in ("x0", "y0", "x1", "y1")))
    c = current.select(F.col(key).alias("ck"), *(F.col(x).alias(f"c{x}") for x in ("x0", "y0", "x1", "y1")), "status")
    rows = p.join(c, F.col("pk") == F.col("ck"), "full_outer")
    m = compare(tuple(F.col(f"p{x}") for x in ("x0", "y0", "x1", "y1")), tuple(F.col(f"c{x}") for x in ("x0", "y0", "x1", "y1")))
    rows = rows.select(F.coalesce("pk", "ck").alias(key), "pk", "ck", "status", *(m[n].alias(n) for n in ("iou", "shift", "area_delta_pct", "symdiff")))
    kind = (
        F.when(F.col("pk").isNull(), "New").when(F.col("ck").isNull(), "Missing")
        .when((F.col("status") == "conflict") | (F.col("iou") < 0.70) | (F.col("shift") > 2.0), "Boundary Change")
        .when((F.col("status") == "review") | (F.col("iou") < 0.90) | (F.abs("area_delta_pct") > 3.0), F.when(F.abs("area_delta_pct") > 5.0, "Area Change").otherwise("Building Footprint Changed"))
        .otherwise("No Significant Change")
    )
    rows = rows.withColumn("change_type", kind)
    return rows.withColumn("verification", F.when(F.col("change_type") == "No Significant Change", "ACCEPTED").otherwise("NEEDS_REVIEW")).drop("pk", "ck")


_LOG = "conflict_id long, event_id long, ts timestamp, previous_state string, requested_state string, actor string, accepted boolean, state string"


def _folded(batches):
    """Requests sorted by conflict and order, each with the state before and after it; only the last conflict's state is remembered."""
    conflict, state = None, "DETECTED"
    for batch in batches:
        before, after, legal = [], [], []
        for this, wanted in zip(batch["conflict_id"].to_pylist(), batch["requested_state"].to_pylist(), strict=True):
            if this != conflict:
                conflict, state = this, "DETECTED"
            before.append(state)
            legal.append(wanted in TRANSITIONS[state])
            state = wanted if legal[-1] else state
            after.append(state)
        columns = [batch["conflict_id"], batch["event_id"], batch["ts"], pa.array(before, pa.string()), batch["requested_state"], batch["actor"], pa.array(legal, pa.bool_()), pa.array(after, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, ["conflict_id", "event_id", "ts", "previous_state", "requested_state", "actor", "accepted", "state"])


def fold_lifecycle(requests: DataFrame) -> DataFrame:
    """Accepted and rejected transitions in order of (ts, event_id): conflict_id, event_id, ts, previous_state, requested_state, actor, accepted, state.

    A conflict starts DETECTED; state is the one after the request. Requests are sorted within partitions by conflict and pass a task in
    order, so a conflict with any number of events needs no more memory than one with two. A null conflict_id is ignored.
    """
    rows = requests.select("conflict_id", F.col("event_id").cast("long").alias("event_id"), F.col("ts").cast("timestamp").alias("ts"), "requested_state", "actor").where("conflict_id is not null")
    return rows.repartition("conflict_id").sortWithinPartitions("conflict_id", "ts", "event_id", "requested_state", "actor").mapInArrow(_folded, _LOG)


def history_source(number: Column, source: Column, reviewer: Column, recorded: Column) -> dict[str, Column]:
    """Kind, name and date of the source of a version by its number or by what its source is called."""
    told = F.lower(F.coalesce(source, F.lit("")))
    chosen = F.when((number == 1) | told.contains("cadastral"), 0).when((number == 2) | told.contains("municipal") | told.contains("drone"), 1).when((number >= 3) | told.contains("rtk") | told.contains("surveyor"), 2).otherwise(3)
    pick = lambda i, other: F.when(chosen == 3, other).otherwise(F.element_at(F.array(*(F.lit(x[i]) for x in HISTORY_SOURCES)), F.least(chosen, F.lit(2)) + 1))
    return {"source_type": pick(0, F.lit("Verified Historical Dataset")), "source_name": pick(1, F.coalesce(reviewer, F.lit("Land Records Authority"))), "source_date": pick(2, F.date_format(recorded, "yyyy-MM-dd"))}


def deterministic_uuid(namespace_hex: str, name: Column) -> Column:
    """Version 5 UUID of a name."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), name.cast("binary")))
    part = lambda a, n: F.substring(h, a, n)
    variant = F.lpad(F.hex(F.conv(part(17, 2), 16, 10).cast("int").bitwiseAND(63).bitwiseOR(128)), 2, "0")
    return F.lower(F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(19, 2), F.lit("-"), part(21, 12)))


def clean_id(raw: Column) -> Column:
    return F.regexp_replace(F.upper(F.trim(raw)), r"[\s\-_/]+", "")


def resolve_identity(candidates: DataFrame) -> DataFrame:
    """Best registry candidate per request (request_id, registry_id or null, iou, drift) and what it means.

    None or little overlap: NEW. Some overlap but less than 0.70, or a drift of 2 m or more: UNCERTAIN. Else CONTINUITY. Equal
    identifiers alone never merge.
    """
    by = Window.partitionBy("request_id").orderBy(F.col("iou").desc_nulls_last(), "registry_id")
    best = candidates.withColumn("r", F.row_number().over(by)).where("r = 1").drop("r")
    found = F.coalesce("iou", F.lit(0.0))
    action = F.when(F.col("registry_id").isNull() | (found < 0.15), "NEW").when((found < 0.70) | (F.col("drift") >= 2.0), "UNCERTAIN").otherwise("CONTINUITY")
    best = best.withColumn("action", action)
    conf = F.when(F.col("action") == "UNCERTAIN", F.greatest(F.lit(0.40), found)).when(F.col("action") == "NEW", F.lit(1.0)).otherwise(found)
    return best.withColumns({"confidence": conf, "needs_review": F.col("action") == "UNCERTAIN"})


def continuity_action(df: DataFrame) -> DataFrame:
    """Adds continuity: what a request that continues a parcel changed; the last change that holds names it.

    Needs same_record, iou, drift, area_delta, survey_before/after, municipal_before/after.
    """
    revised = (F.col("iou") < 0.96) | (F.col("drift") > 0.30) | (F.abs("area_delta") > 5)
    changed = lambda c: F.col(f"{c}_after").isNotNull() & ~F.col(f"{c}_after").eqNullSafe(F.col(f"{c}_before"))
    name = (
        F.when(F.col("same_record") & (F.col("iou") >= 0.98) & (F.col("drift") <= 0.20), "DUPLICATE")
        .when(revised, "GEOMETRY_REVISED").when(changed("municipal"), "MUNICIPAL_ID_EVOLVED").when(changed("survey"), "SURVEY_NUMBER_EVOLVED").otherwise("MATCHED")
    )
    return df.withColumn("continuity", name)
