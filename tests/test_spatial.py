"""Spatial joins and geometry expressions against plain Python and hand-made shapes."""

import math
import random

import pytest
from pyspark.sql import functions as F

from sparkwalk.functions import geometry as G
from sparkwalk.operators import relational, spatial
from sparkwalk.operators.skew import skew_join
from sparkwalk.plans import crosswalks


def test_box_join_over_mixed_sizes(spark):
    rnd = random.Random(1)
    box = lambda i, s: (i, (x := rnd.uniform(-50, 50)), (y := rnd.uniform(-50, 50)), x + rnd.random() * s, y + rnd.random() * s)
    a, b = [box(i, rnd.choice([0, 1, 30])) for i in range(80)], [box(i, rnd.choice([0.5, 9, 200])) for i in range(60)]
    df = lambda rows, k: spark.createDataFrame(rows, f"{k} int, minx double, miny double, maxx double, maxy double")
    got = sorted((r.a, r.b) for r in spatial.box_join(df(a, "a"), df(b, "b"), cell=2.0).select("a", "b").collect())
    assert got == sorted((p[0], q[0]) for p in a for q in b if p[1] <= q[3] and q[1] <= p[3] and p[2] <= q[4] and q[2] <= p[4])


def test_nearest_in_crowds_and_deserts(spark):
    rnd = random.Random(2)
    pieces = [(i, rnd.gauss(0, 1), rnd.gauss(0, 1)) for i in range(150)] + [(200, 900.0, 900.0), (201, 900.0, 900.0)]
    pieces = [(i, x, y, x + rnd.random(), y) for i, x, y in pieces]
    points = [(i, rnd.uniform(-3, 3), rnd.uniform(-3, 3)) for i in range(60)] + [(60, 880.0, 890.0), (61, -700.0, 5.0)]
    got = spatial.nearest(
        spark.createDataFrame(points, "pt int, x double, y double"),
        spark.createDataFrame(pieces, "id int, x1 double, y1 double, x2 double, y2 double"), "id", cell=0.01,
    )

    def dist(p, s):
        t = min(max((p[1] - s[1]) / (s[3] - s[1]), 0), 1)
        return math.hypot(p[1] - s[1] - t * (s[3] - s[1]), p[2] - s[2])

    want = {p[0]: min((dist(p, s), s[0]) for s in pieces) for p in points}
    rows = got.collect()
    assert {r.pt: r.id for r in rows} == {k: v[1] for k, v in want.items()}
    assert {r.pt: r.dist for r in rows} == pytest.approx({k: v[0] for k, v in want.items()})


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_plain_join(spark, how):
    big = spark.range(400).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 11).alias("k"))
    small = spark.range(9).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    rows = lambda df: sorted(map(tuple, df.select(sorted(df.columns)).fillna(-1).collect()))
    assert rows(skew_join(big, small, ["k"], how, hot_rows=20)) == rows(big.join(small, "k", how))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_of_ties_equal_rows_and_nulls(spark, how):
    keys = [k for k in range(50) for _ in range(30)] + [None] * 200 + [99]
    big = spark.createDataFrame([(k,) for k in keys], "k int")  # only a key: all rows of it are equal
    small = spark.createDataFrame([(k,) for k in [*range(40), 3, None]], "k int")
    rows = lambda df: sorted(map(str, df.collect()))
    joined = skew_join(big, small, ["k"], how, hot_rows=20)
    assert rows(joined) == rows(big.join(small, "k", how))


def test_nearest_leaves_out_what_is_nowhere(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, None, 1.0), (3, float("nan"), 1.0), (4, float("inf"), 0.0)], "pt int, x double, y double")
    pieces = spark.createDataFrame([(7, 1.0, 0.0, 1.0, 1.0), (8, None, 0.0, 0.0, 0.0), (9, float("nan"), 0.0, 0.0, 0.0)], "id int, x1 double, y1 double, x2 double, y2 double")
    assert [(r.pt, r.id, r.dist) for r in spatial.nearest(points, pieces, "id").collect()] == [(1, 7, 1.0)]


def one(spark, col):
    return spark.range(1).select(col.alias("c")).first().c


def shape(points):
    return F.array(*[G.point(F.lit(x), F.lit(y)) for x, y in points])


def test_expressions(spark):
    path = shape([(0, 0), (3, 4), (3, 10)])
    assert one(spark, G.length(path)) == 11
    assert tuple(one(spark, G.point_along(path, F.lit(8.0)))) == (3, 7)
    assert tuple(one(spark, G.point_along(path, F.lit(99.0)))) == (3, 10)
    assert one(spark, G.line_distance(G.point(F.lit(6), F.lit(8)), path)) == 3
    assert one(spark, G.within_distance(G.point(F.lit(6), F.lit(8)), path, 3.0))
    assert tuple(one(spark, G.bbox(path))) == (0, 0, 3, 10)
    assert one(spark, G.lines_cross(path, shape([(0, 7), (5, 7)])))
    assert not one(spark, G.lines_cross(path, shape([(4, 7), (5, 7)])))
    there = G.project_xy(G.point(F.lit(-97.7), F.lit(30.3)), 30.3, -97.0)
    assert one(spark, there).x == pytest.approx(-67203, abs=5)
    assert tuple(one(spark, G.unproject_xy(there, 30.3, -97.0))) == pytest.approx((-97.7, 30.3))


def test_polygon_with_a_hole(spark):
    ring = lambda a, b: shape([(a, a), (b, a), (b, b), (a, b), (a, a)])
    holed = F.array(ring(0, 10), ring(2, 4))
    at = lambda x, y: one(spark, G.point_in_polygon(G.point(F.lit(x), F.lit(y)), holed))
    assert (at(1, 1), at(3, 3), at(5, 5), at(11, 5)) == (True, False, True, False)
    c = one(spark, G.centroid(holed))
    assert (c.x, c.y) == pytest.approx(((500 - 12) / 96, (500 - 12) / 96))
    assert one(spark, G.polygons_intersect(holed, F.array(ring(5, 6))))
    assert not one(spark, G.polygons_intersect(holed, F.array(ring(11, 12))))


def test_loop_road_counts_twice(spark):
    roads = spark.range(1).select(F.col("id").cast("int"), shape([(0, 0), (5, 5), (0, 5), (0, 0)]).alias("geometry"))
    assert [(r.x, r.y) for r in crosswalks.intersections(roads).collect()] == [(0, 0)]


def test_ends_of_a_link_are_no_single_number_in_a_join(spark):
    """Two short numbers alone would be one key of a hash table, in which ends close to each other collide."""
    links = spark.createDataFrame([(1, 1, 2), (2, 3, 2), (3, 5, 6), (4, None, 6)], "id int, src_vid int, trg_vid int")
    known = spark.createDataFrame([(2, 1), (2, 3), (None, 6)], "src_vid int, trg_vid int")
    out = relational.anti_join_either_order(links, known, "src_vid", "trg_vid")
    assert sorted(r.id for r in out.collect()) == [3]
    assert "xxhash64" in out._jdf.queryExecution().optimizedPlan().toString()


def test_start_radius_takes_each_piece_once_a_pass(spark, monkeypatch):
    """The largest fitting size, and no copy of the pieces for every size."""
    rnd = random.Random(9)
    spots = [(x, y, x, y) for x, y in ((rnd.gauss(0, s), rnd.gauss(0, s)) for s in (1, 40, 900) for _ in range(300))]
    targets = spark.createDataFrame(spots, "minx double, miny double, maxx double, maxy double")
    fits = [1.0]
    for k in range(13):
        cells = [(x // 2**k, y // 2**k) for x, y, _, _ in spots]
        if max(map(cells.count, set(cells))) <= 64:
            fits.append(2.0**k)
    monkeypatch.setattr(spatial.F, "explode", None)
    assert spatial.start_radius(targets, 4000.0, 1.0) == fits[-1]


def test_nearest_measures_behind_the_join(spark, monkeypatch):
    """No distance in the join's condition, which is not compiled well once it is long."""
    asked, plain = [], spatial.box_join
    monkeypatch.setattr(spatial, "box_join", lambda a, b, where=None, *rest, **more: asked.append(where) or plain(a, b, where, *rest, **more))
    pieces = spark.createDataFrame([(1, 0.0, 0.0, 9.0, 0.0), (2, 0.0, 70.0, 9.0, 70.0)], "k int, x1 double, y1 double, x2 double, y2 double")
    points = spark.createDataFrame([(1, 5.0, 2.0), (2, 5.0, 40.0)], "p int, x double, y double")
    assert sorted((r.p, r.k, r.dist) for r in spatial.nearest(points, pieces, "k").collect()) == [(1, 1, 2.0), (2, 2, 30.0)]
    lines = pieces.withColumnRenamed("k", "line").withColumns({"y1": F.col("y1") + 3, "y2": F.col("y2") + 3})
    assert sorted((r.line, r.k, r.dist) for r in spatial.nearest_to_lines(lines, pieces, "line", "k").collect()) == [(1, 1, 3.0), (2, 2, 3.0)]
    assert asked and all(where is None for where in asked)
