"""Mixed shapes from file to centroid, and nearest pieces of whole lines, against plain Python."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from sparkwalk.functions import geometry as G
from sparkwalk.operators import spatial
from sparkwalk.plans import demand
from sparkwalk.sources import features

SQUARE = [[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]]
CASES = [
    ("Point", [3, 5], (3, 5)),
    ("MultiPoint", [[0, 0], [2, 4]], (1, 2)),
    ("LineString", [[0, 0], [6, 0], [6, 2]], ((3 * 6 + 6 * 2) / 8, (0 * 6 + 1 * 2) / 8)),
    ("LineString", [[7, 7], [7, 7]], (7, 7)),
    ("MultiLineString", [[[0, 0], [2, 0]], [[10, 0], [10, 6]]], ((1 * 2 + 10 * 6) / 8, (3 * 6) / 8)),
    ("Polygon", [SQUARE], (2, 2)),
    ("Polygon", [SQUARE[::-1], [[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]]], ((16 * 2 - 4 * 1) / 12, (16 * 2 - 4 * 1) / 12)),
    ("Polygon", [[[0, 0], [4, 0], [0, 0]]], (2, 0)),
    ("MultiPolygon", [[SQUARE], [[[10, 0], [12, 0], [12, 2], [10, 2], [10, 0]]]], ((16 * 2 + 4 * 11) / 20, (16 * 2 + 4 * 1) / 20)),
]


@pytest.fixture(scope="module")
def layer(tmp_path_factory):
    path = tmp_path_factory.mktemp("shapes") / "mixed.json"
    rows = [(i, {"type": kind, "coordinates": at}) for i, (kind, at, _) in enumerate(CASES)] + [(98, None)]
    path.write_text("\n".join(json.dumps({"type": "Feature", "properties": {"osmid": i, "shop": f"s{i}", "element_type": "way"}, "geometry": g}) for i, g in rows))
    return str(path)


def test_one_row_and_one_centroid_a_feature(spark, layer, tmp_path):
    shapes = features.read_shapes(spark, layer, "element_type string, osmid int, shop string, building string")
    assert shapes.count() == len(CASES)  # the feature without a shape is left out
    got = {r.osmid: (r.x, r.y) for r in demand.poi_points(shapes, ["shop"]).collect()}
    assert got == {i: pytest.approx(want) for i, (_, _, want) in enumerate(CASES)}
    assert {r.osmid: (r.x, r.y) for r in demand.building_points(shapes).collect()} == got
    features.write_shapes(shapes, str(tmp_path / "again"))
    again = features.read_shapes(spark, str(tmp_path / "again"), "element_type string, osmid int, shop string, building string")
    assert sorted(map(repr, again.collect())) == sorted(map(repr, shapes.collect()))


def test_collections_fail_or_drop(spark, tmp_path):
    path = tmp_path / "odd.json"
    path.write_text(
        '{"type":"Feature","properties":{"osmid":1},"geometry":{"type":"GeometryCollection","geometries":[]}}\n'
        '{"type":"Feature","properties":{"osmid":2},"geometry":{"type":"Point","coordinates":[1,2]}}\n'
        '{"type":"Feature","properties":{"osmid":3},"geometry":{"type":"MultiPoint","coordinates":[]}}\n'
    )
    with pytest.raises(Exception, match="without coordinates of its own"):
        features.read_shapes(spark, str(path), "osmid int").collect()
    kept = features.read_shapes(spark, str(path), "osmid int", others="drop")
    rows = kept.select("osmid", G.shape_centroid(F.col("geometry")).alias("p")).collect()
    assert {r.osmid: r.p and (r.p.x, r.p.y) for r in rows} == {2: (1, 2), 3: None}


def piece_distance(a, b):
    def spot(px, py, x1, y1, x2, y2):
        dx, dy = x2 - x1, y2 - y1
        t = min(max(((px - x1) * dx + (py - y1) * dy) / (dx * dx + dy * dy), 0), 1) if dx or dy else 0
        return math.hypot(px - x1 - t * dx, py - y1 - t * dy)

    side = lambda x1, y1, x2, y2, px, py: (x2 - x1) * (py - y1) - (y2 - y1) * (px - x1)
    if side(*a, *b[:2]) * side(*a, *b[2:]) < 0 and side(*b, *a[:2]) * side(*b, *a[2:]) < 0:
        return 0.0
    return min(spot(*a[:2], *b), spot(*a[2:], *b), spot(*b[:2], *a), spot(*b[2:], *a))


def test_nearest_piece_of_whole_lines(spark):
    rng = random.Random(4)
    spot = lambda s: (rng.uniform(0, s), rng.uniform(0, s))
    pieces = [(i % 60, *spot(300), *spot(300)) if i % 9 else (i % 60, *(p := spot(300)), *p) for i in range(40)]
    lines = []
    for i in range(80):
        x, y = spot(2000 if i % 7 == 0 else 300)
        for _ in range(rng.randrange(1, 4)):
            nx, ny = x + rng.uniform(-25, 25), y + rng.uniform(-25, 25)
            lines.append((i, x, y, nx, ny))
            x, y = nx, ny
    lines += [(500, float("nan"), 0.0, 1.0, 1.0), (501, None, 0.0, 1.0, 1.0)]
    cols = "x1 double, y1 double, x2 double, y2 double"
    got = spatial.nearest_to_lines(spark.createDataFrame(lines, f"line int, {cols}"), spark.createDataFrame(pieces, f"road int, {cols}"), "line", "road")
    want = {}
    for i, *a in lines[:-2]:
        best = min((piece_distance(a, b), k) for k, *b in pieces)
        want[i] = min(want.get(i, best), best)
    rows = {r.line: (r.dist, r.road) for r in got.collect()}
    assert set(rows) == set(want)
    assert all(rows[i][0] == pytest.approx(d, abs=1e-9) and (rows[i][1] == k or d == 0) for i, (d, k) in want.items())
    none = spatial.nearest_to_lines(spark.createDataFrame(lines, f"line int, {cols}"), spark.createDataFrame([], f"road int, {cols}"), "line", "road")
    assert none.count() == 0 and none.columns == ["line", "road", "dist"]


def test_a_centroid_is_worked_out_once(spark):
    """The plan names the sums over a ring once, not once for every use of them."""
    ring = F.array(F.array(*[G.point(F.col("id") + a, F.lit(b)) for a, b in ((0, 0), (4, 0), (4, 4), (0, 0))]))
    shape = F.struct(F.lit("Polygon").alias("kind"), F.array(ring).alias("parts"))
    for expression, most in ((G.centroid(ring), 6), (G.shape_centroid(shape), 12)):
        plan = spark.range(1).select(expression.alias("p"))._jdf.queryExecution().analyzed().toString()
        assert plan.count("aggregate(") <= most
