"""Connected components of an edge table as an iteration of joins and aggregations."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldmerge.functions.session import shared_dir, stored


def _neighbour_minimum(edges: DataFrame) -> DataFrame:
    """(u, m): the smallest of u and its neighbours. Aggregated map-side, so a hub costs one row a task."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _with_minimum(edges: DataFrame) -> DataFrame:
    """edges with m beside them. The second key makes both sides exchange in the join itself, so that AQE may split a hub."""
    low = _neighbour_minimum(edges).select(F.col("u").alias("lu"), F.xxhash64("u").alias("lh"), "m")
    high = edges.withColumn("h", F.xxhash64("u"))
    return high.join(low, (high.u == low.lu) & (high.h == low.lh)).select("u", "v", "m")


#: Edges whose trees a task remembers at once, and the most contractions before the rounds.
_REMEMBERED, _CONTRACTIONS = 200_000, 8


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For the edges (u, v) of a task, _REMEMBERED at a time, an edge from each node, itself included, to the smallest that they reach: the same components."""
    parent: dict[int, int] = {}
    seen = 0

    def root(x: int) -> int:
        while (up := parent[x]) != x:
            parent[x] = x = parent[up]
        return x

    def told() -> pa.RecordBatch:
        nodes = list(parent)
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], ["u", "v"])

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            parent.setdefault(u, u)
            parent.setdefault(v, v)
            a, b = root(u), root(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
        seen += batch.num_rows
        if seen >= _REMEMBERED:
            yield told()
            parent, seen = {}, 0
    if parent:
        yield told()


def _contracted(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, low) with the smallest root that a task found for each node, and the edges (u, v) that are left between such roots.

    A node whose tasks agree on its root is settled with it; only roots that meet in a node, or are nodes of another tree, have edges
    left. So each node is shuffled once, and a root that no edge is left at is the smallest node of its component.
    """
    own = Window.partitionBy("u").orderBy("v")
    rows = edges.mapInArrow(_trees, "u long, v long").select("u", "v", F.first("v").over(own).alias("low"), F.row_number().over(own).alias("n"))
    found = stored(rows.where("n = 1 or v <> low"), "trees")
    return found.where("n = 1").select(F.col("u").alias("node"), "low"), found.where("n > 1").select(F.col("v").alias("u"), F.col("low").alias("v"))


def _in_rounds(edges: DataFrame, max_rounds: int) -> DataFrame:
    """(node, component) of edges (u, v) by alternate large-star and small-star steps, whose number grows with the logarithm of the component size."""
    now = edges.mapInArrow(_trees, "u long, v long").where("u <> v").distinct().checkpoint()
    told = lambda edges: edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = told(now)
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_minimum(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = _with_minimum(large)
        now = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct().checkpoint()
        row = told(now)
        if row == before:
            break
        before = row
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable over edges, itself included, for every node that has an edge.

    Each task first joins what its own edges connect; a shuffle of the nodes then shows which trees meet, and only the edges between
    the roots of such trees are left. That is done again as long as it at least halves what is left, which for components of a few
    nodes it does to the end; long ones go on in rounds of large-star and small-star steps. The driver sees a count a contraction and
    two sums a round. Edges with a null end are ignored, repeated edges and self loops are harmless, an empty table gives an
    empty table. Raises if max_rounds is not enough.
    """
    shared_dir(edges.sparkSession)
    pairs = edges.select(F.col(src).cast("long").alias("u"), F.col(dst).cast("long").alias("v")).where("u is not null and v is not null")
    levels, above, before = [], None, None
    while True:
        level, pairs = _contracted(pairs)
        levels.append(level)
        left = pairs.count()
        if not left:
            break
        if len(levels) == _CONTRACTIONS or (before is not None and 2 * left > before):
            above = _in_rounds(pairs, max_rounds)
            break
        before, pairs = left, pairs.repartition("v")  # trees that share a root lie together
    for level in reversed(levels):
        if above is None:
            above = level.select("node", F.col("low").alias("component"))
            continue
        # the second key makes both sides exchange in the join itself, so that AQE may split a giant component
        high = above.select(F.col("node").alias("__node"), F.xxhash64("node").alias("__hash"), "component")
        joined = level.join(high, (F.col("low") == F.col("__node")) & (F.xxhash64("low") == F.col("__hash")), "left")
        above = joined.select("node", F.coalesce("component", "low").alias("component"))
    return above
