"""Geometry as column expressions.

POINT = struct<x, y>, LINE = array<struct<x, y>>, POLYGON = array of rings (the first is the
shell, the others are holes), all doubles in a plane (metres) unless stated otherwise.  A mixed layer holds
SHAPE = struct<kind, parts>: ``kind`` names the geometry type, ``parts`` are polygons whatever the kind - a line is a part of
one ring that need not close, a point a part of one ring of one point.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

# Fixed value: radius of the projection sphere.
RADIUS_M = 6371008.8
_M_PER_DEG = RADIUS_M * math.pi / 180


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def line(*points: Column) -> Column:
    return F.array(*points)


def norm(dx: Column, dy: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy)


def first_point(shape: Column) -> Column:
    return F.element_at(shape, 1)


def last_point(shape: Column) -> Column:
    return F.element_at(shape, -1)


def project_xy(p: Column, lat0: float, lon0: float = 0.0) -> Column:
    """Degrees to metres: equirectangular around (lon0, lat0)."""
    return point((p.x - lon0) * _M_PER_DEG * math.cos(math.radians(lat0)), (p.y - lat0) * _M_PER_DEG)


def unproject_xy(p: Column, lat0: float, lon0: float = 0.0) -> Column:
    """Metres back to degrees."""
    return point(p.x / (_M_PER_DEG * math.cos(math.radians(lat0))) + lon0, p.y / _M_PER_DEG + lat0)


def map_points(shape: Column, fn, depth: int = 1) -> Column:
    """``fn`` on every point of a line (depth 1) or polygon (depth 2)."""
    if depth == 1:
        return F.transform(shape, fn)
    return F.transform(shape, lambda part: map_points(part, fn, depth - 1))


def segments(shape: Column) -> Column:
    """The straight pieces of a line as array<struct<x1, y1, x2, y2>>."""
    n = F.size(shape)
    return F.zip_with(
        F.slice(shape, F.lit(1), F.greatest(n - 1, F.lit(0))),
        F.slice(shape, F.lit(2), F.greatest(n - 1, F.lit(0))),
        lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")),
    )


def explode_segments(df: DataFrame, shape: str) -> DataFrame:
    """One row per straight piece, with plain columns x1, y1, x2, y2; the shape itself is dropped.

    Spatial joins work on these columns, inside compiled code.
    """
    keep = [c for c in df.columns if c != shape]
    return df.select(*keep, F.inline(segments(F.col(shape))))


def length(shape: Column) -> Column:
    return F.aggregate(
        segments(shape), F.lit(0.0), lambda acc, s: acc + norm(s["x2"] - s["x1"], s["y2"] - s["y1"])
    )


def segment_distance(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """From a point to a straight piece (which may be a single point)."""
    dx, dy = x2 - x1, y2 - y1
    size = dx * dx + dy * dy
    along = ((px - x1) * dx + (py - y1) * dy) / F.when(size > 0, size)
    t = F.coalesce(F.least(F.greatest(along, F.lit(0.0)), F.lit(1.0)), F.lit(0.0))
    return norm(px - (x1 + t * dx), py - (y1 + t * dy))


def piece_distance(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Between two straight pieces (x1, y1, x2, y2 each; either may be a point): 0 where they meet."""
    (ax, ay, bx, by), (cx, cy, dx, dy) = a, b
    apart = F.least(
        segment_distance(ax, ay, cx, cy, dx, dy), segment_distance(bx, by, cx, cy, dx, dy),
        segment_distance(cx, cy, ax, ay, bx, by), segment_distance(dx, dy, ax, ay, bx, by),
    )
    return F.when(segments_cross(ax, ay, bx, by, cx, cy, dx, dy), F.lit(0.0)).otherwise(apart)


def line_distance(p: Column, shape: Column) -> Column:
    return F.array_min(
        F.transform(segments(shape), lambda s: segment_distance(p.x, p.y, s["x1"], s["y1"], s["x2"], s["y2"]))
    )


def within_distance(p: Column, shape: Column, radius: float) -> Column:
    """Does the line meet the disc?  (An exact disc, not a polygon that approximates one.)"""
    return line_distance(p, shape) <= radius


def _side(ax: Column, ay: Column, bx: Column, by: Column, px: Column, py: Column) -> Column:
    return F.signum((bx - ax) * (py - ay) - (by - ay) * (px - ax))


def _on_box(ax: Column, ay: Column, bx: Column, by: Column, px: Column, py: Column) -> Column:
    return (
        (px >= F.least(ax, bx)) & (px <= F.greatest(ax, bx)) & (py >= F.least(ay, by)) & (py <= F.greatest(ay, by))
    )


def segments_cross(
    ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column, dx: Column, dy: Column
) -> Column:
    """Do the pieces a-b and c-d share a point?"""
    s1, s2 = _side(ax, ay, bx, by, cx, cy), _side(ax, ay, bx, by, dx, dy)
    s3, s4 = _side(cx, cy, dx, dy, ax, ay), _side(cx, cy, dx, dy, bx, by)
    return (
        ((s1 * s2 < 0) & (s3 * s4 < 0))
        | ((s1 == 0) & _on_box(ax, ay, bx, by, cx, cy))
        | ((s2 == 0) & _on_box(ax, ay, bx, by, dx, dy))
        | ((s3 == 0) & _on_box(cx, cy, dx, dy, ax, ay))
        | ((s4 == 0) & _on_box(cx, cy, dx, dy, bx, by))
    )


def lines_cross(a: Column, b: Column) -> Column:
    return F.exists(
        segments(a),
        lambda s: F.exists(
            segments(b),
            lambda t: segments_cross(s["x1"], s["y1"], s["x2"], s["y2"], t["x1"], t["y1"], t["x2"], t["y2"]),
        ),
    )


def _ring_segments(polygon: Column) -> Column:
    return F.flatten(F.transform(polygon, segments))


def point_in_polygon(p: Column, polygon: Column) -> Column:
    """Strictly inside (ray cast over shell and holes); a point on an edge counts as inside on the lower-left side only."""

    def crossed(acc: Column, s: Column) -> Column:
        spans = (s["y1"] > p.y) != (s["y2"] > p.y)
        meet = (s["x2"] - s["x1"]) * (p.y - s["y1"]) / F.when(spans, s["y2"] - s["y1"]) + s["x1"]
        return F.when(spans & (p.x < meet), ~acc).otherwise(acc)

    return F.aggregate(_ring_segments(polygon), F.lit(False), crossed)


def polygons_intersect(a: Column, b: Column) -> Column:
    """Any edges that cross, or one polygon inside the other."""
    edges_cross = F.exists(
        _ring_segments(a),
        lambda s: F.exists(
            _ring_segments(b),
            lambda t: segments_cross(s["x1"], s["y1"], s["x2"], s["y2"], t["x1"], t["y1"], t["x2"], t["y2"]),
        ),
    )
    inside = point_in_polygon(a.getItem(0).getItem(0), b) | point_in_polygon(b.getItem(0).getItem(0), a)
    return edges_cross | inside


def _once(value: Column, fn) -> Column:
    """``fn`` of a value that is worked out once a row, however often ``fn`` names it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def _sums(a: Column, cx: Column, cy: Column) -> Column:
    return F.struct(a.alias("a"), cx.alias("cx"), cy.alias("cy"))


def _added(items: Column) -> Column:
    zero = _sums(F.lit(0.0), F.lit(0.0), F.lit(0.0))
    return F.aggregate(items, zero, lambda acc, s: _sums(acc["a"] + s["a"], acc["cx"] + s["cx"], acc["cy"] + s["cy"]))


def _area_sums(polygon: Column, x0: Column, y0: Column) -> Column:
    """Area (times 2) and moments (times 6) of shell less holes, relative to (x0, y0), which keeps the digits."""

    def ring_sum(ring: Column) -> Column:
        def piece(s: Column) -> Column:
            x1, y1, x2, y2 = s["x1"] - x0, s["y1"] - y0, s["x2"] - x0, s["y2"] - y0
            w = x1 * y2 - x2 * y1
            return _sums(w, (x1 + x2) * w, (y1 + y2) * w)

        return _added(F.transform(segments(ring), piece))

    def signed(total: Column, i: Column) -> Column:
        # orientation is not given: the shell counts positive, holes negative
        flip = F.signum(total["a"]) * F.when(i == 0, F.lit(1.0)).otherwise(F.lit(-1.0))
        return _sums(flip * total["a"], flip * total["cx"], flip * total["cy"])

    return _added(F.transform(F.transform(polygon, ring_sum), signed))


def _length_sums(pieces: Column, x0: Column, y0: Column) -> Column:
    """Length and moments of straight pieces relative to (x0, y0)."""

    def piece(s: Column) -> Column:
        size = norm(s["x2"] - s["x1"], s["y2"] - s["y1"])
        return _sums(size, size * ((s["x1"] + s["x2"]) / 2 - x0), size * ((s["y1"] + s["y2"]) / 2 - y0))

    return _added(F.transform(pieces, piece))


def _mean_point(points: Column) -> Column:
    mean = lambda c: F.aggregate(F.transform(points, lambda q: q[c]), F.lit(0.0), lambda s, v: s + v) / F.size(points)
    return point(mean("x"), mean("y"))


def centroid(polygon: Column) -> Column:
    """Area centroid of shell and holes; shapes without an area give the mean of their points."""
    first = polygon.getItem(0).getItem(0)
    return _once(
        _area_sums(polygon, first.x, first.y),
        lambda total: F.when(
            total["a"] != 0, point(first.x + total["cx"] / (3 * total["a"]), first.y + total["cy"] / (3 * total["a"]))
        ).otherwise(_mean_point(F.flatten(polygon))),
    )


def shape_centroid(shape: Column) -> Column:
    """Centroid of a SHAPE: by area over all parts of polygons, by length over lines, the mean of points.

    Polygons without an area are taken as lines, lines without a length as points; a shape without a point has none.
    """
    def middle(shape: Column) -> Column:
        parts, polygonal = shape["parts"], shape["kind"].endswith("Polygon")
        return _once(F.flatten(F.flatten(parts)), lambda points: _once(F.get(points, F.lit(0)), lambda first: by_area(parts, polygonal, points, first)))

    def by_area(parts: Column, polygonal: Column, points: Column, first: Column) -> Column:
        area = _added(F.transform(F.when(polygonal, parts), lambda p: _area_sums(p, first["x"], first["y"])))
        pieces = F.flatten(F.transform(F.flatten(parts), segments))
        return _once(
            area,
            lambda area: F.when(
                polygonal & (area["a"] != 0), point(first["x"] + area["cx"] / (3 * area["a"]), first["y"] + area["cy"] / (3 * area["a"]))
            ).otherwise(_once(_length_sums(pieces, first["x"], first["y"]), lambda size: by_length(size, points, first))),
        )

    def by_length(size: Column, points: Column, first: Column) -> Column:
        return F.when(size["a"] > 0, point(first["x"] + size["cx"] / size["a"], first["y"] + size["cy"] / size["a"])).otherwise(
            F.when(F.size(points) > 0, _mean_point(points))
        )

    return _once(shape, middle)


def point_along(shape: Column, distance: Column) -> Column:
    """The point at a distance along the line, held between its two ends."""
    start = F.struct(
        F.greatest(distance, F.lit(0.0)).alias("left"), first_point(shape).x.alias("x"), first_point(shape).y.alias("y")
    )

    def walk(acc: Column, s: Column) -> Column:
        size = norm(s["x2"] - s["x1"], s["y2"] - s["y1"])
        t = F.least(acc["left"] / F.when(size > 0, size), F.lit(1.0))
        moved = F.struct(
            F.greatest(acc["left"] - size, F.lit(0.0)).alias("left"),
            (s["x1"] + t * (s["x2"] - s["x1"])).alias("x"),
            (s["y1"] + t * (s["y2"] - s["y1"])).alias("y"),
        )
        return F.when((acc["left"] > 0) & (size > 0), moved).otherwise(acc)

    end = F.aggregate(segments(shape), start, walk)
    return point(end["x"], end["y"])


def bbox(points: Column) -> Column:
    """struct<minx, miny, maxx, maxy> of an array of points."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(
        F.array_min(xs).alias("minx"), F.array_min(ys).alias("miny"), F.array_max(xs).alias("maxx"), F.array_max(ys).alias("maxy")
    )
