"""Clusters of observations: at most one observation of a source in each."""

from __future__ import annotations

import functools

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldmerge.functions.session import stored
from fieldmerge.operators.graph import connected_components

#: Edges that one call settles: whole components together, since the rule is the same for a union of them.
EDGES_A_GROUP = 20_000
_CLUSTERED = "kind string, id long, other long, score double, iou double, cluster_id long, accepted boolean"


def _greedy(group: pd.DataFrame) -> pd.DataFrame:
    """Edges by falling score: two clusters merge unless they share a source; an edge within one cluster is accepted.

    Edges lie between clusters la and lb, which hold the sources sa and sb.
    """
    edges = group.sort_values(["score", "id_a", "id_b"], ascending=[False, True, True], kind="stable")
    parent: dict[int, int] = {}
    sources: dict[int, set] = {}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, held in [*zip(edges["la"], edges["sa"], strict=True), *zip(edges["lb"], edges["sb"], strict=True)]:
        parent.setdefault(i, i)
        sources.setdefault(i, set(held))
    rows = []
    for a, b, la, lb, score, iou in zip(edges["id_a"], edges["id_b"], edges["la"], edges["lb"], edges["score"], edges["iou"], strict=True):
        ra, rb = root(la), root(lb)
        fits = ra == rb or not sources[ra] & sources[rb]
        if fits and ra != rb:
            low, high = min(ra, rb), max(ra, rb)
            parent[high] = low
            sources[low] |= sources.pop(high)
        rows.append(("edge", a, b, score, iou, la, fits))
    out = [(kind, a, b, score, iou, root(la), fits) for kind, a, b, score, iou, la, fits in rows]
    out += [("member", i, None, None, None, root(i), None) for i in parent]
    return pd.DataFrame(out, columns=["kind", "id", "other", "score", "iou", "cluster_id", "accepted"]).astype({"other": "Int64", "accepted": "boolean"})


def _between_clusters(edges: DataFrame) -> DataFrame:
    """edges with the clusters la, lb of one observation each that they lie between, and their sources sa, sb."""
    held = lambda c: F.array(F.coalesce(F.col(c), F.lit("\0")))
    return edges.withColumns({"la": F.col("id_a"), "lb": F.col("id_b"), "sa": held("source_a"), "sb": held("source_b")})


def _merged_best(live: DataFrame) -> DataFrame:
    """(old, new, held): clusters of the edges that are the best left at both their ends. No cluster is in two of them."""
    edge = F.struct((-F.col("score")).alias("s"), "id_a", "id_b", "la", "lb", "sa", "sb")
    ends = live.select(edge.alias("edge"), F.explode(F.array("la", "lb")).alias("end"))
    best = ends.groupBy("end").agg(F.min("edge").alias("edge")).select("edge.*")
    both = best.groupBy("id_a", "id_b", "la", "lb").agg(F.count(F.lit(1)).alias("n"), F.first("sa").alias("sa"), F.first("sb").alias("sb")).where("n = 2")
    return both.select(F.explode(F.array("la", "lb")).alias("old"), F.least("la", "lb").alias("new"), F.concat("sa", "sb").alias("held"))


def _relabelled(live: DataFrame, merges: DataFrame) -> DataFrame:
    """live after the merges, with accepted: true inside a cluster, false where the two share a source, else null."""
    for end, held in (("la", "sa"), ("lb", "sb")):
        # the second key makes both sides exchange in the join itself, so that AQE may split a hub
        one = merges.select(F.col("old").alias("__old"), F.xxhash64("old").alias("__hash"), F.col("new").alias("__new"), F.col("held").alias("__held"))
        rows = live.join(one, (F.col(end) == F.col("__old")) & (F.xxhash64(end) == F.col("__hash")), "left")
        live = rows.withColumns({end: F.coalesce("__new", end), held: F.coalesce("__held", held)}).drop("__old", "__hash", "__new", "__held")
    return live.withColumn("accepted", F.when(F.col("la") == F.col("lb"), True).when(F.arrays_overlap("sa", "sb"), False))


def settle_in_rounds(edges: DataFrame, group_edges: int = EDGES_A_GROUP) -> tuple[DataFrame, DataFrame]:
    """(id, cluster_id) of the ends of edges, and (id_a, id_b, score, iou, cluster_id, accepted): the rule of _greedy without its one order.

    An edge that is the best left at both its clusters comes before all others that touch them, wherever else it stands in the
    order, so all such edges are settled at once. After that, edges inside a cluster are accepted, and edges between clusters that
    share a source can never be: both go. What is left is settled in calls of at most group_edges edges once its components are as
    small as that. Edges in long chains of falling scores take as many rounds as the chain is long until then. Clusters hold a
    source once, so the lists of sources are short. The driver sees two counts a round.
    """
    edges = edges.select("id_a", "id_b", "source_a", "source_b", "score", "iou")
    live = stored(_between_clusters(edges).withColumn("accepted", F.when(F.col("id_a") == F.col("id_b"), True).when(F.col("source_a").eqNullSafe(F.col("source_b")), False)), "live")
    settled, joined, rounds = [], [], 0
    while True:
        settled.append(live.where("accepted is not null").select("id_a", "id_b", "score", "iou", "accepted"))
        live = live.where("accepted is null").drop("accepted")
        left = live.count()
        if left <= group_edges:
            break
        if rounds % 6 == 5:
            parts = connected_components(live, "la", "lb")
            within = live.join(parts.withColumnRenamed("node", "la"), "la")
            if within.groupBy("component").count().agg(F.max("count")).first()[0] <= group_edges:
                live = within
                break
        merges = stored(_merged_best(live), "merges")
        joined.append(merges.where("old <> new").select("old", "new"))
        live, rounds = stored(_relabelled(live, merges), "live"), rounds + 1
    if left:
        key = F.pmod(F.xxhash64("component"), F.lit(max(1, left // group_edges))) if "component" in live.columns else F.lit(0)
        last = stored(live.withColumn("group", key).groupBy("group").applyInPandas(_greedy, _CLUSTERED), "last")
        settled.append(last.where("kind = 'edge'").select(F.col("id").alias("id_a"), F.col("other").alias("id_b"), "score", "iou", "accepted"))
        joined.append(last.where("kind = 'member' and id <> cluster_id").select(F.col("id").alias("old"), F.col("cluster_id").alias("new")))
    nodes = edges.select(F.explode(F.array("id_a", "id_b")).alias("id")).distinct()
    if joined:  # a cluster is named by its smallest member, so the components of the merges are the clusters
        roots = connected_components(functools.reduce(DataFrame.unionByName, joined), "old", "new")
        nodes = nodes.join(roots.select(F.col("node").alias("id"), F.col("component").alias("cluster_id")), "id", "left")
        nodes = nodes.select("id", F.coalesce("cluster_id", "id").alias("cluster_id"))
    else:
        nodes = nodes.select("id", F.col("id").alias("cluster_id"))
    nodes = stored(nodes, "cluster-members")
    told = functools.reduce(DataFrame.unionByName, settled).join(nodes.withColumnRenamed("id", "id_a"), "id_a")
    return nodes, told.select("id_a", "id_b", "score", "iou", "cluster_id", "accepted")


def cluster_constrained(obs: DataFrame, edges: DataFrame, group_edges: int = EDGES_A_GROUP) -> tuple[DataFrame, DataFrame]:
    """(id, cluster_id) for every observation, and the edges with cluster_id and accepted.

    A cluster is named by its smallest id. The greedy rule never looks beyond a connected component, so components are found
    first. One that holds no source twice is a cluster as it is; the others are settled edge by edge, whole components in a call,
    many at once; components of more than group_edges edges are settled in rounds over all tasks (settle_in_rounds). Edges need
    id_a, id_b, source_a, source_b, score, iou.
    """
    edges = stored(edges.select("id_a", "id_b", "source_a", "source_b", "score", "iou"), "edges")
    parts = stored(connected_components(edges, "id_a", "id_b"), "parts")
    marked = stored(edges.join(parts.withColumnRenamed("node", "id_a"), "id_a"), "placed")
    ends = marked.select("component", F.explode(F.array(*(F.struct(F.col(f"id_{c}").alias("id"), F.col(f"source_{c}").alias("source")) for c in "ab"))).alias("e"))
    # two ends of one source in a component are two observations, unless the smallest is the largest
    held = ends.groupBy("component", F.col("e.source").alias("source")).agg(F.min("e.id").alias("low"), F.max("e.id").alias("high"))
    twice = stored(held.where("low <> high").select("component").distinct(), "twice")
    sizes = stored(marked.join(twice, "component").groupBy("component").agg(F.count(F.lit(1)).alias("edges")), "sizes")
    total, largest = sizes.agg(F.sum("edges"), F.max("edges")).first()
    members = parts.join(twice, "component", "left_anti").select(F.col("node").alias("id"), F.col("component").alias("cluster_id"))
    plain = marked.join(twice, "component", "left_anti")
    told = plain.select("id_a", "id_b", "score", "iou", F.col("component").alias("cluster_id"), F.lit(True).alias("accepted"))
    joined = marked.join(sizes, "component")
    if total:
        small = _between_clusters(joined.where(F.col("edges") <= group_edges))
        groups = max(1, total // group_edges)
        grouped = small.withColumn("group", F.pmod(F.xxhash64("component"), F.lit(groups)))
        settled = stored(grouped.groupBy("group").applyInPandas(_greedy, _CLUSTERED), "clusters")
        members = members.unionByName(settled.where("kind = 'member'").select("id", "cluster_id"))
        told = told.unionByName(settled.where("kind = 'edge'").select(F.col("id").alias("id_a"), F.col("other").alias("id_b"), "score", "iou", "cluster_id", "accepted"))
    if total and largest > group_edges:
        nodes, rest = settle_in_rounds(joined.where(F.col("edges") > group_edges), group_edges)
        members, told = members.unionByName(nodes), told.unionByName(rest)
    everyone = obs.select("id").join(members, "id", "left").select("id", F.coalesce("cluster_id", "id").alias("cluster_id"))
    return everyone, told


def duplicate_source_flag(obs: DataFrame, clusters: DataFrame) -> DataFrame:
    """(cluster_id, members, duplicate_source): whether two members share a source."""
    joined = clusters.join(obs.select("id", "source"), "id")
    return joined.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("members"), (F.count("source") != F.size(F.collect_set("source"))).alias("duplicate_source"))


def reconcile(obs: DataFrame, clusters: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per cluster: sources, members, mean score and overlap of its accepted edges (null for one member), drift, area spread."""
    members = clusters.join(obs, "id").withColumns({"cx": (F.col("x0") + F.col("x1")) / 2, "cy": (F.col("y0") + F.col("y1")) / 2})
    basic = members.groupBy("cluster_id").agg(
        F.sort_array(F.collect_set("source")).alias("sources"),
        F.count(F.lit(1)).alias("source_count"),
        (F.count("source") != F.size(F.collect_set("source"))).alias("duplicate_source"),
        F.max("extraction_confidence").alias("extraction_confidence"),
        F.when(F.max("area_m2") > 0, (F.max("area_m2") - F.min("area_m2")) / F.max("area_m2") * 100).otherwise(0.0).alias("area_variance_pct"),
        F.collect_list(F.struct("cx", "cy")).alias("places"),
    )
    scores = edges.where("accepted").groupBy("cluster_id").agg(F.avg("score").alias("avg_match_score"), F.avg("iou").alias("avg_iou_agreement"))
    # members are few, one of a source, so their distances are taken from their list and no pair is shuffled
    apart = lambda p, q: F.sqrt((p["cx"] - q["cx"]) * (p["cx"] - q["cx"]) + (p["cy"] - q["cy"]) * (p["cy"] - q["cy"]))
    drift = F.array_max(F.transform("places", lambda p: F.array_max(F.transform("places", lambda q: apart(p, q)))))
    basic = basic.withColumn("centroid_drift_m", F.coalesce(drift, F.lit(0.0))).drop("places")
    return basic.join(scores, "cluster_id", "left").select("cluster_id", "sources", "source_count", "duplicate_source", "extraction_confidence", "area_variance_pct", "avg_match_score", "avg_iou_agreement", "centroid_drift_m")


def merged_geometry(obs: DataFrame, clusters: DataFrame) -> DataFrame:
    """Per cluster of boxes: the area of their union and their common box, for any number of members.

    The union is summed over strips between the sides of the boxes along x; in a strip the boxes that span it are merged along y.
    The common box falls back to the extent of all where it is empty.
    """
    members = clusters.join(obs.select("id", "x0", "y0", "x1", "y1"), "id")
    folded = members.groupBy("cluster_id").agg(
        *(F.max(c).alias(f"i_{c}") for c in ("x0", "y0")), *(F.min(c).alias(f"i_{c}") for c in ("x1", "y1")), *(F.min(c).alias(f"u_{c}") for c in ("x0", "y0")), *(F.max(c).alias(f"u_{c}") for c in ("x1", "y1")),
        F.count(F.lit(1)).alias("members"), F.sort_array(F.collect_list(F.struct("y0", "y1", "x0", "x1"))).alias("boxes"),
    )
    sides = F.array_sort(F.array_distinct(F.concat(F.transform("boxes", lambda b: b["x0"]), F.transform("boxes", lambda b: b["x1"]))))

    def merged(spanning):
        start = F.struct(F.lit(0.0).alias("total"), F.lit(float("-inf")).alias("top"))
        step = lambda s, b: F.struct((s["total"] + F.greatest(F.lit(0.0), b["y1"] - F.greatest(b["y0"], s["top"]))).alias("total"), F.greatest(s["top"], b["y1"]).alias("top"))
        return F.aggregate(spanning, start, step, lambda s: s["total"])

    def strip(i):
        left, right = F.get("sides", i - 1), F.get("sides", i)
        return (right - left) * merged(F.filter("boxes", lambda b: (b["x0"] <= left) & (b["x1"] >= right)))

    strips = F.when(F.size("sides") > 1, F.sequence(F.lit(1), F.size("sides") - 1)).otherwise(F.array().cast("array<int>"))
    union = F.aggregate(F.transform(strips, strip), F.lit(0.0), lambda a, x: a + x)
    common = F.greatest(F.lit(0.0), F.col("i_x1") - F.col("i_x0")) * F.greatest(F.lit(0.0), F.col("i_y1") - F.col("i_y0"))
    empty = (F.col("i_x1") <= F.col("i_x0")) | (F.col("i_y1") <= F.col("i_y0"))
    rows = folded.withColumn("sides", sides)
    return rows.select("cluster_id", "members", union.alias("union_area"), common.alias("common_area"), *(F.when(empty, F.col(f"u_{c}")).otherwise(F.col(f"i_{c}")).alias(c) for c in ("x0", "y0", "x1", "y1")))


def merge_attributes(obs: DataFrame, clusters: DataFrame, columns: tuple[str, ...] = ("building_type", "survey_no")) -> DataFrame:
    """Per cluster the first value of each column that is not null, empty or 'unknown', by member id."""
    joined = clusters.join(obs.select("id", *columns), "id")
    known = lambda c: F.col(c).isNotNull() & ~F.col(c).isin("", "unknown")
    return joined.groupBy("cluster_id").agg(*(F.min_by(F.when(known(c), F.col(c)), F.when(known(c), F.col("id"))).alias(c) for c in columns))


def best_per_group(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    return df.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__rank = 1").drop("__rank")
