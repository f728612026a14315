"""Points in polygons by the edge index, against a ray cast over all vertices of all polygons."""

import math
import random

from pyspark.sql import functions as F

from sparkwalk.functions import geometry as G
from sparkwalk.operators.polygons import edge_index, points_in_polygons

POLYGON = "array<array<struct<x:double,y:double>>>"
SHAPE = f"struct<kind:string,parts:array<{POLYGON}>>"


def ring(rnd, cx, cy, size, n, lattice):
    at = [(cx + (r := size * rnd.uniform(0.3, 1)) * math.cos(6.283 * i / n), cy + r * math.sin(6.283 * i / n)) for i in range(n)]
    at = [(float(round(x)), float(round(y))) if lattice else (x, y) for x, y in at]
    return [*at, at[0]]


def inside(rings, x, y):
    odd = False
    for r in rings:
        for (x1, y1), (x2, y2) in zip(r, [*r[1:], r[0]]):
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                odd = not odd
    return odd


def test_rings_of_all_sizes_with_points_on_corners_and_edges(spark):
    rnd, zones = random.Random(3), []
    for i in range(40):
        cx, cy, size = rnd.randrange(-40, 40), rnd.randrange(-40, 40), rnd.choice([3, 9, 40])
        rings = [ring(rnd, cx, cy, size, rnd.choice([3, 4, 12, 90]), i % 3 > 0)]
        if i % 4 == 0:
            rings.append(ring(rnd, cx, cy, size / 4, 7, True))
        zones.append((i, rings))
    zones += [(40, [[(0.0, 0.0), (8.0, 0.0), (8.0, 8.0), (0.0, 8.0), (0.0, 0.0)]]), (41, [[(0.0, 0.0), (8.0, 0.0), (8.0, 8.0)]])]  # the last not closed
    points = [(i, float(rnd.randrange(-60, 60)), float(rnd.randrange(-60, 60))) for i in range(700)]
    points += [(700 + i, *zones[i % 42][1][0][i % 3]) for i in range(200)] + [(900 + i, rnd.uniform(-60, 60), rnd.uniform(-60, 60)) for i in range(100)]
    got = points_in_polygons(spark.createDataFrame(points, "pt int, x double, y double"), spark.createDataFrame(zones, f"zone int, geometry {POLYGON}"))
    assert sorted((r.pt, r.zone) for r in got.collect()) == sorted((i, z) for i, x, y in points for z, rings in zones if inside(rings, x, y))


def test_parts_kinds_and_empty_places(spark):
    box = lambda a, b: [(a, a), (b, a), (b, b), (a, b), (a, a)]
    nan, inf = float("nan"), float("inf")
    shapes = [
        (1, ("MultiPolygon", [[box(0.0, 4.0), box(1.0, 2.0)], [box(10.0, 12.0)]])), (2, ("LineString", [[box(0.0, 4.0)]])), (3, None),
        (4, ("Polygon", [])), (5, ("Polygon", [[[]]])), (6, ("Polygon", [[box(3.0, 3.0)]])), (7, ("Polygon", [[box(0.0, nan)]])), (8, ("Polygon", [[box(0.0, inf)]])),
    ]
    zones = spark.createDataFrame(shapes, f"zone int, geometry {SHAPE}")
    points = spark.createDataFrame([(1, 0.5, 0.5), (2, 1.5, 1.5), (3, 11.0, 11.0), (4, 7.0, 7.0), (5, None, 1.0), (6, nan, 1.0), (7, 1.0, inf), (1, 0.5, 0.5)], "pt int, x double, y double")
    rows = lambda df: sorted((r.pt, r.zone) for r in df.collect())
    assert rows(points_in_polygons(points, zones)) == [(1, 1), (1, 1), (3, 1)]
    assert rows(points_in_polygons(points, zones.limit(0))) == [] == rows(points_in_polygons(points.limit(0), zones))
    both = zones.unionByName(zones.filter("zone = 1"))
    assert points_in_polygons(points, both.select("geometry")).columns == ["pt", "x", "y"]
    assert points_in_polygons(points, both).count() == 6


def test_a_long_boundary_does_not_multiply_the_work(spark):
    n = 5000
    at = F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: G.point(1000 * F.cos(i % n * (2 * math.pi / n)), 1000 * F.sin(i % n * (2 * math.pi / n))))
    zones = spark.range(1).select(F.array(at).alias("geometry"))
    index = edge_index(zones).select(F.coalesce(F.size("_edges"), F.lit(0)).alias("n")).collect()
    sizes = [max(r.n, 0) for r in index]
    assert len(sizes) < n / 2 and sum(sizes) < 3 * n and max(sizes) < n / 20
    points = spark.range(20000).select((F.col("id") * 7919 % 2003 - 1001).cast("double").alias("x"), (F.col("id") * 104729 % 1999 - 999).cast("double").alias("y"))
    assert points_in_polygons(points, zones).count() == points.filter(F.hypot("x", "y") < 999.9998).count()
