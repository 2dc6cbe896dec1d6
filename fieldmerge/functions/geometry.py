"""Measures of axis-aligned boxes (columns x0, y0, x1, y1) and of rings (arrays of points), and exact polygon overlap."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldmerge.functions import clipping

Box = tuple[Column, Column, Column, Column]


def box(prefix: str = "", suffix: str = "") -> Box:
    return tuple(F.col(f"{prefix}{c}{suffix}") for c in ("x0", "y0", "x1", "y1"))


def box_area(b: Box) -> Column:
    return (b[2] - b[0]) * (b[3] - b[1])


def box_perimeter(b: Box) -> Column:
    return F.lit(2.0) * ((b[2] - b[0]) + (b[3] - b[1]))


def intersection_area(a: Box, b: Box) -> Column:
    """Null-safe only where both boxes are given: a null box has no overlap."""
    w = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    return F.when(a[0].isNull() | b[0].isNull(), F.lit(0.0)).otherwise(w * h)


def iou(a: Box, b: Box, inter: Column | None = None) -> Column:
    """Intersection over union, 0 where the union is empty or a box is missing."""
    inter = intersection_area(a, b) if inter is None else inter
    union = box_area(a) + box_area(b) - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def centroid_distance(a: Box, b: Box) -> Column:
    """Between centres; infinite where a box is missing."""
    dx, dy = (a[0] + a[2]) / 2 - (b[0] + b[2]) / 2, (a[1] + a[3]) / 2 - (b[1] + b[3]) / 2
    return F.coalesce(F.sqrt(dx * dx + dy * dy), F.lit(float("inf")))


def compactness(area: Column, perimeter: Column) -> Column:
    """Isoperimetric quotient within 0 and 1; 0 for a degenerate shape."""
    q = F.lit(4 * math.pi) * area / (perimeter * perimeter)
    return F.when((area > 0) & (perimeter > 0), F.greatest(F.lit(0.0), F.least(F.lit(1.0), q))).otherwise(F.lit(0.0))


def ratio(a: Column, b: Column, missing: float) -> Column:
    """Smaller over larger; `missing` where either is null or not positive."""
    return F.when((a > 0) & (b > 0), F.least(a, b) / F.greatest(a, b)).otherwise(F.lit(missing))


def rounded(x: Column, digits: int) -> Column:
    """floor(x * 10^n + 0.5) / 10^n, which both engines compute alike."""
    scale = F.lit(float(10**digits))
    return F.floor(x * scale + F.lit(0.5)).cast("double") / scale


def bearing(dx: Column, dy: Column) -> Column:
    """Degrees clockwise from north; null for a shift of a millimetre or less."""
    angle = F.degrees(F.atan2(dx, dy)) + F.lit(360.0)
    return F.when(F.sqrt(dx * dx + dy * dy) > 0.001, angle - F.floor(angle / 360) * 360)


#: Points of the closed ring of a box.
BOX_POINTS = 5.0


def box_ring(b: Box) -> Column:
    """The closed ring of a box: array of struct(x, y)."""
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return F.array(corner(b[0], b[1]), corner(b[2], b[1]), corner(b[2], b[3]), corner(b[0], b[3]), corner(b[0], b[1]))


def _edges(ring: Column, term) -> Column:
    """Sum of term(p, q) over the edges of a closed ring."""
    return F.aggregate(F.sequence(F.lit(1), F.size(ring) - 1), F.lit(0.0), lambda acc, i: acc + term(F.element_at(ring, i), F.element_at(ring, i + 1)))


def ring_area(ring: Column) -> Column:
    """Shoelace area; 0 for fewer than 4 points."""
    cross = _edges(ring, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
    return F.when(F.size(ring) >= 4, F.abs(cross) / 2).otherwise(F.lit(0.0))


def ring_length(ring: Column) -> Column:
    """Length of a line or perimeter of a closed ring; 0 for fewer than 2 points."""
    dist = lambda p, q: F.sqrt((q["x"] - p["x"]) * (q["x"] - p["x"]) + (q["y"] - p["y"]) * (q["y"] - p["y"]))
    return F.when(F.size(ring) >= 2, _edges(ring, dist)).otherwise(F.lit(0.0))


def ring_centroid(ring: Column) -> Column:
    """struct(x, y) of a closed ring; the mean of its points if it has no area."""
    cross = lambda p, q: p["x"] * q["y"] - q["x"] * p["y"]
    twice = _edges(ring, cross)
    cx = _edges(ring, lambda p, q: (p["x"] + q["x"]) * cross(p, q)) / (3 * twice)
    cy = _edges(ring, lambda p, q: (p["y"] + q["y"]) * cross(p, q)) / (3 * twice)
    mean = lambda c: F.aggregate(ring, F.lit(0.0), lambda acc, p: acc + p[c]) / F.size(ring)
    return F.struct(F.when(twice != 0, cx).otherwise(mean("x")).alias("x"), F.when(twice != 0, cy).otherwise(mean("y")).alias("y"))


def ring_crosses(ring: Column) -> Column:
    """Whether two edges of a closed ring that are no neighbours cross or touch; in the JVM, every pair of edges of the ring."""
    turn = lambda p, q, r: F.signum((q["x"] - p["x"]) * (r["y"] - p["y"]) - (q["y"] - p["y"]) * (r["x"] - p["x"]))
    n = F.size(ring) - 1

    def cross(i, j):
        a, b, c, d = F.get(ring, i), F.get(ring, i + 1), F.get(ring, j), F.get(ring, j + 1)
        on = lambda p, q, r: (turn(p, q, r) == 0) & r["x"].between(F.least(p["x"], q["x"]), F.greatest(p["x"], q["x"])) & r["y"].between(F.least(p["y"], q["y"]), F.greatest(p["y"], q["y"]))
        proper = (turn(a, b, c) * turn(a, b, d) < 0) & (turn(c, d, a) * turn(c, d, b) < 0)
        return proper | on(a, b, c) | on(a, b, d) | on(c, d, a) | on(c, d, b)

    later = lambda i: F.sequence(i + 2, n - F.when(i == 0, 2).otherwise(1))
    # sequence() counts down where its end is below its start; those edges have no partner
    last = lambda i: n - F.when(i == 0, 2).otherwise(1)
    some = lambda i: F.when(i + 2 <= last(i), F.exists(later(i), lambda j: cross(i, j))).otherwise(F.lit(False))
    return F.when(n >= 4, F.exists(F.sequence(F.lit(0), n - 3), some)).otherwise(F.lit(False))


def repaired_ring(ring: Column) -> Column:
    """The ring without points that repeat the one before, closed where it is open; other faults are left as they are.

    ring should be a stored column: it is looked at once for each of its points.
    """
    first, last = F.get(ring, F.lit(0)), F.get(ring, F.size(ring) - 1)
    points = F.filter(ring, lambda p, i: (i == 0) | (F.get(ring, i - 1)["x"] != p["x"]) | (F.get(ring, i - 1)["y"] != p["y"]))
    open_ = (first["x"] != last["x"]) | (first["y"] != last["y"])
    return F.when(F.size(ring) == 0, ring).otherwise(F.concat(points, F.when(open_, F.array(first)).otherwise(F.slice(ring, 1, 0))))


def point_to_box_boundary(x: Column, y: Column, b: Box) -> Column:
    """Distance of a point to the outline of a box."""
    dx = F.greatest(b[0] - x, F.lit(0.0), x - b[2])
    dy = F.greatest(b[1] - y, F.lit(0.0), y - b[3])
    inside = F.least(x - b[0], b[2] - x, y - b[1], b[3] - y)
    return F.when((x >= b[0]) & (x <= b[2]) & (y >= b[1]) & (y <= b[3]), inside).otherwise(F.sqrt(dx * dx + dy * dy))


# ---- polygons of any shape, a batch at a time: see clipping ------------------------------------------------------------------


def polygon_overlap(a: np.ndarray, b: np.ndarray) -> float:
    """Exact area common to two simple polygons."""
    return float(clipping.overlaps([a], [b])[0])


def _points(ring) -> np.ndarray:
    return np.array([(p["x"], p["y"]) for p in ring], float).reshape(-1, 2) if ring is not None else np.empty((0, 2))


@F.pandas_udf(T.DoubleType())
def ring_overlap(a: pd.Series, b: pd.Series) -> pd.Series:
    """Overlap area of two ring columns; 0 where a ring is missing."""
    return pd.Series(clipping.overlaps([_points(p) for p in a], [_points(q) for q in b]))


@F.pandas_udf(T.DoubleType())
def _flat_distance(ring: pd.Series, line: pd.Series) -> pd.Series:
    points = lambda flat: np.empty((0, 2)) if flat is None else np.asarray(flat, float).reshape(-1, 2)
    found = clipping.line_distances([points(r) for r in ring], [points(x) for x in line])
    return pd.Series(found).where(~np.isnan(found), None)


def ring_line_distance(ring: Column | str, line: Column | str) -> Column:
    """Distance of a polygon and a line, 0 where the line touches or lies within it; null where either is missing."""
    # numbers in a row reach Python as an array, points as a dictionary each
    flat = lambda points: F.flatten(F.transform(points, lambda p: F.array(p["x"], p["y"])))
    return _flat_distance(flat(ring), flat(line))
