"""Lines within polygons, in Arrow batches without a loop over rows: lengths of segments inside simple rings of any shape and turn."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _edges(rings: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(owner, (x0, y0, x1, y1)) of the sides of all rings, closed where they are not; a ring of fewer than 3 points has none."""
    sizes = np.array([len(r) if len(r) > 2 else 0 for r in rings], np.int64)
    points = np.concatenate([r for r in rings if len(r) > 2] or [np.empty((0, 2))])
    ends = np.cumsum(sizes)
    following = np.arange(1, len(points) + 1)
    following[ends[sizes > 0] - 1] = (ends - sizes)[sizes > 0]
    return np.repeat(np.arange(len(rings)), sizes), np.hstack([points, points[following]])


def _inside(x: np.ndarray, y: np.ndarray, of: np.ndarray, owner: np.ndarray, edges: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether each point (x, y) lies inside ring `of`, by the number of sides to its right; sides of ring r start at first[r]."""
    n = first[of + 1] - first[of]
    point = np.repeat(np.arange(len(x)), n)
    side = edges[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[of], n)]
    px, py = x[point], y[point]
    spans = (side[:, 1] > py) != (side[:, 3] > py)
    with np.errstate(divide="ignore", invalid="ignore"):
        at = side[:, 0] + (py - side[:, 1]) * (side[:, 2] - side[:, 0]) / (side[:, 3] - side[:, 1])
    return np.bincount(point, spans & (at > px), len(x)).astype(np.int64) % 2 == 1


def lengths_inside(segments: np.ndarray, rings: list[np.ndarray]) -> np.ndarray:
    """How much of each segment (x0, y0, x1, y1) lies inside the ring beside it.

    The segment is cut where it meets a side of the ring; each part counts if its middle is inside. Sides that run along the segment
    cut it at their ends only, so a part along the outline counts as neither more nor less than the point in its middle does.
    """
    owner, edges = _edges(rings)
    first = np.searchsorted(owner, np.arange(len(rings) + 1))
    ax, ay, bx, by = segments[owner].T
    ux, uy = bx - ax, by - ay
    vx, vy = edges[:, 2] - edges[:, 0], edges[:, 3] - edges[:, 1]
    wx, wy = edges[:, 0] - ax, edges[:, 1] - ay
    cross, length2 = ux * vy - uy * vx, ux * ux + uy * uy
    with np.errstate(divide="ignore", invalid="ignore"):
        t, s = (wx * vy - wy * vx) / cross, (wx * uy - wy * ux) / cross
        along = (wx * ux + wy * uy) / length2  # where the side begins, seen from the segment
    hit = (cross != 0) & (t > 0) & (t < 1) & (s >= -1e-12) & (s <= 1 + 1e-12)
    lies = (cross == 0) & (wx * uy - wy * ux == 0) & (along > 0) & (along < 1)
    every = np.arange(len(rings))
    at = np.concatenate([np.zeros(len(rings)), np.ones(len(rings)), t[hit], along[lies]])
    of = np.concatenate([every, every, owner[hit], owner[lies]])
    order = np.lexsort((at, of))
    at, of = at[order], of[order]
    part = np.flatnonzero(of[1:] == of[:-1])
    of, low, high = of[part], at[part], at[part + 1]
    middle = (low + high) / 2
    x = segments[of, 0] + middle * (segments[of, 2] - segments[of, 0])
    y = segments[of, 1] + middle * (segments[of, 3] - segments[of, 1])
    share = np.bincount(of, (high - low) * _inside(x, y, of, owner, edges, first), len(rings))
    return share * np.hypot(segments[:, 2] - segments[:, 0], segments[:, 3] - segments[:, 1])


@F.pandas_udf(T.DoubleType())
def _clip(x0: pd.Series, y0: pd.Series, x1: pd.Series, y1: pd.Series, xs: pd.Series, ys: pd.Series) -> pd.Series:
    none = np.empty((0, 2))
    rings = [none if x is None or y is None else np.column_stack([x, y]).astype(float) for x, y in zip(xs, ys, strict=True)]
    segments = np.column_stack([c.to_numpy(float) for c in (x0, y0, x1, y1)])
    known = ~np.isnan(segments).any(axis=1)
    out = lengths_inside(np.where(known[:, None], segments, 0.0), rings)
    return pd.Series(np.where(known, out, np.nan)).where(known, None)


def length_inside(segment: tuple[Column, Column, Column, Column], ring: Column) -> Column:
    """Length of a segment (x0, y0, x1, y1) inside a simple ring, an array of struct(x, y); 0 for a null ring, null for a null side."""
    return _clip(*segment, F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"]))


#: Rows (slab, side) that a union looks at together.
_ROWS = 1 << 21


def _pairs(n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, i, j) of all i < n_a[group] and j < n_b[group]."""
    n = n_a * n_b
    group = np.repeat(np.arange(len(n)), n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return group, k // n_b[group], k % n_b[group]


def _union_areas(of: np.ndarray, owner: np.ndarray, edges: np.ndarray, groups: int) -> np.ndarray:
    """Areas of the unions of the polygons of each group; edges are those of polygon `owner` in group `of`, groups in order."""
    n = np.bincount(of, minlength=groups)
    first = np.cumsum(n) - n
    group, i, j = _pairs(n, n)
    keep = i < j
    group, a, b = group[keep], edges[(first[group] + i)[keep]], edges[(first[group] + j)[keep]]
    ux, uy, vx, vy = a[:, 2] - a[:, 0], a[:, 3] - a[:, 1], b[:, 2] - b[:, 0], b[:, 3] - b[:, 1]
    cross = ux * vy - uy * vx
    wx, wy = b[:, 0] - a[:, 0], b[:, 1] - a[:, 1]
    with np.errstate(divide="ignore", invalid="ignore"):
        t, s = (wx * vy - wy * vx) / cross, (wx * uy - wy * ux) / cross
    meet = (cross != 0) & (t >= 0) & (t <= 1) & (s >= 0) & (s <= 1)
    # between these x no two sides cross and none begins or ends
    x = np.concatenate([edges[:, 0], a[meet, 0] + t[meet] * ux[meet]])
    at = np.concatenate([of, group[meet]])
    order = np.lexsort((x, at))
    x, at = x[order], at[order]
    slab = np.flatnonzero((at[1:] == at[:-1]) & (x[1:] > x[:-1]))
    low, high, at = x[slab], x[slab + 1], at[slab]
    slabs = np.bincount(at, minlength=groups)
    begin = np.cumsum(slabs) - slabs
    group, i, j = _pairs(slabs, n)
    s, e = begin[group] + i, first[group] + j
    left, right = np.minimum(edges[e, 0], edges[e, 2]), np.maximum(edges[e, 0], edges[e, 2])
    spans = (left <= low[s]) & (right >= high[s]) & (right > left)
    s, e = s[spans], e[spans]
    middle = (low[s] + high[s]) / 2
    y = edges[e, 1] + (middle - edges[e, 0]) * (edges[e, 3] - edges[e, 1]) / (edges[e, 2] - edges[e, 0])
    order = np.lexsort((y, owner[e], s))
    s, y = s[order][::2], y[order].reshape(-1, 2)  # every polygon is entered and left in turn
    order = np.lexsort((y[:, 0], s))
    s, y = s[order], y[order]
    if not len(s):
        return np.zeros(groups)
    base = y.min()
    y, tall = y - base, float(y.max() - base) + 1.0
    # tops so far within a slab: slabs are lifted above one another
    top = np.maximum.accumulate(y[:, 1] + s * tall) - s * tall
    before = np.where(np.concatenate([[True], s[1:] != s[:-1]]), 0.0, np.concatenate([[0.0], top[:-1]]))
    told = np.maximum(0.0, y[:, 1] - np.maximum(y[:, 0], before))
    return np.bincount(at, np.bincount(s, told, len(low)) * (high - low), groups)


def union_areas(clusters: list[list[np.ndarray]]) -> np.ndarray:
    """The area that the simple polygons of each cluster cover together, any number of them and any shape.

    The plane is cut into slabs at every corner and every crossing of two sides; in a slab the sides are lines that do not cross, so
    the covered length in its middle times its width is its area. Clusters are taken together as far as _ROWS allows.
    """
    out, k = np.zeros(len(clusters)), 0
    sides = np.array([sum(len(r) for r in c) for c in clusters], np.int64)
    while k < len(clusters):
        size = np.cumsum(sides[k:] ** 2 * 3)
        to = k + max(1, int(np.searchsorted(size, _ROWS, "right")))
        rings = [r - clusters[c][0][0] for c in range(k, to) for r in clusters[c]]  # near the origin figures are exact
        of_ring = np.repeat(np.arange(to - k), [len(clusters[c]) for c in range(k, to)])
        owner, edges = _edges(rings)
        if len(owner):
            out[k:to] = _union_areas(of_ring[owner], owner, edges, to - k)
        k = to
    return out


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """The area common to each two simple polygons: what they cover each, less what they cover together; 0 where one has no area."""
    alone = lambda rings: union_areas([[r] if len(r) > 2 else [] for r in rings])
    both = union_areas([[r for r in pair if len(r) > 2] for pair in zip(a, b, strict=True)])
    return np.maximum(0.0, alone(a) + alone(b) - both)


def _to_segments(p: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Distance of each point to the segment (x0, y0, x1, y1) beside it."""
    d = s[:, 2:] - s[:, :2]
    t = np.clip(((p - s[:, :2]) * d).sum(axis=1) / np.maximum((d**2).sum(axis=1), 1e-300), 0, 1)
    return np.hypot(*(s[:, :2] + t[:, None] * d - p).T)


def line_distances(rings: list[np.ndarray], lines: list[np.ndarray]) -> np.ndarray:
    """Distance of each polygon and the line beside it, 0 where the line touches or lies within it; NaN where either has too few points."""
    out, k = np.full(len(rings), np.nan), 0
    good = np.array([i for i, (r, x) in enumerate(zip(rings, lines, strict=True)) if len(r) > 2 and len(x) > 1], np.int64)
    while k < len(good):
        size = np.cumsum([len(rings[i]) * len(lines[i]) for i in good[k:]])
        some = good[k : k + max(1, int(np.searchsorted(size, _ROWS, "right")))]
        k += len(some)
        owner, edges = _edges([rings[i] for i in some])
        n = np.bincount(owner, minlength=len(some))
        paths = np.vstack([np.hstack([lines[i][:-1], lines[i][1:]]) for i in some])
        m = np.array([len(lines[i]) - 1 for i in some], np.int64)
        first, begin = np.cumsum(n) - n, np.cumsum(m) - m
        group, i, j = _pairs(n, m)
        e, s = edges[first[group] + i], paths[begin[group] + j]
        u, v, w = e[:, 2:] - e[:, :2], s[:, 2:] - s[:, :2], s[:, :2] - e[:, :2]
        cross = u[:, 0] * v[:, 1] - u[:, 1] * v[:, 0]
        with np.errstate(divide="ignore", invalid="ignore"):
            t, r = (w[:, 0] * v[:, 1] - w[:, 1] * v[:, 0]) / cross, (w[:, 0] * u[:, 1] - w[:, 1] * u[:, 0]) / cross
        meet = (cross != 0) & (t >= 0) & (t <= 1) & (r >= 0) & (r <= 1)
        near = np.minimum.reduce([_to_segments(e[:, :2], s), _to_segments(e[:, 2:], s), _to_segments(s[:, :2], e), _to_segments(s[:, 2:], e)])
        least = np.minimum.reduceat(np.where(meet, 0.0, near), np.cumsum(n * m) - n * m)
        start = np.array([lines[i][0] for i in some])
        every = np.arange(len(some))
        within = _inside(start[:, 0], start[:, 1], every, owner, edges, np.append(first, len(edges)))
        out[some] = np.where(within, 0.0, least)
    return out


@F.pandas_udf(T.DoubleType())
def _covered(xs: pd.Series, ys: pd.Series) -> pd.Series:
    return pd.Series(union_areas([[np.column_stack([x, y]).astype(float) for x, y in zip(a, b, strict=True) if len(x)] for a, b in zip(xs, ys, strict=True)]))


def union_area(rings: Column) -> Column:
    """The area that simple rings, an array of arrays of struct(x, y), cover together."""
    part = lambda c: F.transform(rings, lambda r: F.transform(r, lambda p: p[c]))
    return _covered(part("x"), part("y"))
