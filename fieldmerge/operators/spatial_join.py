"""Range joins of boxes as equi-joins on grid cells.

A box is listed in every cell that it meets; two boxes that meet share at least one cell and are kept in one of them only, the
one that is, by axis, the larger of their two lowest cells. So no distinct and no Cartesian product is needed. Boxes come in
levels by their size, each with a grid as many times coarser, so that none is listed in more than a few cells; boxes of two
levels are joined on the coarser grid. Only levels that occur are joined, and mostly there is one.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Times the cell size of its level beyond which a box goes to the next, how many times coarser that is, and the levels there are.
LARGE, COARSER, LEVELS = 8, 64, 8


def _listed(df: DataFrame, radius: float, cell: float, side: str) -> DataFrame:
    """df with every column suffixed and one row per cell (gx, gy), with the box's lowest cell."""
    at = lambda c, r: F.floor((F.col(c) + F.lit(r)) / F.lit(cell)).cast("long")
    renamed = df.select(*(F.col(c).alias(f"{c}_{side}") for c in df.columns), at("x0", -radius).alias(f"cx_{side}"), at("y0", -radius).alias(f"cy_{side}"), at("x1", radius).alias("__hx"), at("y1", radius).alias("__hy"))
    rows = renamed.withColumn("gx", F.explode(F.sequence(F.col(f"cx_{side}"), F.col("__hx"))))
    return rows.withColumn("gy", F.explode(F.sequence(F.col(f"cy_{side}"), F.col("__hy")))).drop("__hx", "__hy")


def _meet(radius: float) -> Column:
    r = F.lit(radius)
    return (F.col("x0_a") - r <= F.col("x1_b")) & (F.col("x1_a") + r >= F.col("x0_b")) & (F.col("y0_a") - r <= F.col("y1_b")) & (F.col("y1_a") + r >= F.col("y0_b"))


def _grid(a: DataFrame, b: DataFrame, radius: float, cell: float, keys: list[str], extra: Column | None) -> DataFrame:
    # boxes that are joined with themselves are widened by half on both sides, a little more for last digits: the sides are one, and
    # Spark shuffles them once
    wide = (radius / 2 + 1e-6,) * 2 if a is b else (radius, 0.0)
    left, right = _listed(a, wide[0], cell, "a"), _listed(b, wide[1], cell, "b")
    on = (left["gx"] == right["gx"]) & (left["gy"] == right["gy"])
    for key in keys:
        on = on & (F.col(f"{key}_a") == F.col(f"{key}_b"))
    first = (left["gx"] == F.greatest(F.col("cx_a"), F.col("cx_b"))) & (left["gy"] == F.greatest(F.col("cy_a"), F.col("cy_b")))
    on = on & first & _meet(radius)
    # Spark takes a side for as small as it was before its rows were listed by cells, or cut into pieces; broadcast, it would not fit
    joined = left.hint("merge").join(right, on if extra is None else on & extra)
    return joined.select(*(f"{c}_a" for c in a.columns), *(f"{c}_b" for c in b.columns))


def _levelled(df: DataFrame, cell: float) -> DataFrame:
    """df with the level of each box, from 0 on; the last level takes whatever is larger."""
    size = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) / F.lit(LARGE * cell)
    return df.withColumn("__level", F.when(size <= 1, 0).otherwise(F.least(F.lit(LEVELS), F.ceil(F.log(size) / F.log(F.lit(float(COARSER)))).cast("int"))))


def _levels(df: DataFrame) -> list[int]:
    """The levels that occur, at most LEVELS + 1 numbers."""
    return sorted(df.agg(F.collect_set("__level")).first()[0])


def range_pairs(a: DataFrame, b: DataFrame, radius: float, cell: float | None = None, keys: list[str] = (), extra: Column | None = None) -> DataFrame:
    """Every pair whose boxes, one of them widened by radius, meet; columns suffixed _a and _b. Boxes with a null side match nothing.

    keys: columns that must be equal; extra: a further condition on suffixed columns.
    """
    cell = float(cell or 2 * (radius + 15))
    whole = "x0 is not null and y0 is not null and x1 is not null and y1 is not null"
    one, keys = _levelled(a.where(whole), cell), list(keys)
    two = one if b is a else _levelled(b.where(whole), cell)
    first = _levels(one)
    second = first if two is one else _levels(two)
    left = {p: one.where(F.col("__level") == p).drop("__level") for p in first or [0]}
    right = left if two is one else {q: two.where(F.col("__level") == q).drop("__level") for q in second or [0]}
    parts = [_grid(left[p], right[q], radius, cell * COARSER ** max(p, q), keys, extra) for p in left for q in right]
    return functools.reduce(DataFrame.unionByName, parts)


def after_join(value: Column) -> Column:
    """value, computed once for each pair that the join lets through.

    Catalyst would copy the expression into every one that uses it, and move filters on it into the join, in front of the comparison of
    cells and boxes there, where it is computed for all pairs of a cell. It does neither with what depends on the task.
    """
    return F.when(F.spark_partition_id() >= 0, value)


def candidate_pairs(obs: DataFrame, radius: float = 15.0, cell: float | None = None) -> DataFrame:
    """Unordered pairs of observations of different sources within reach, once each, with id_a < id_b."""
    return range_pairs(obs, obs, radius, cell, extra=(F.col("id_a") < F.col("id_b")) & (F.col("source_a") != F.col("source_b")))
