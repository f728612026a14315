"""Layers and feature files."""

import gzip
import json
import math

import pytest
from pyspark.sql import functions as F, types as T

from sparkwalk.functions import geometry as G, projections as P
from sparkwalk.sources import features, layers, snapshots


def test_only_written_partitions_are_replaced(spark, tmp_path):
    row = lambda n: spark.createDataFrame([(n, 1.0, 2.0)], "vid int, x double, y double")
    for city, n in (("Austin, TX", 1), ("City of Toronto", 2), ("Austin, TX", 3)):
        layers.save_layer(row(n), str(tmp_path), "network_nodes", city)
    got = {(r.city, r.vid) for r in layers.load_layer(spark, str(tmp_path), "network_nodes").collect()}
    assert got == {("austin", 3), ("city_of_toronto", 2)}
    assert layers.load_layer(spark, str(tmp_path), "network_nodes", "Austin, TX").count() == 1


def test_missing_columns_become_nulls(spark, tmp_path):
    roads = spark.createDataFrame([(1, "street")], "id int, kind string")
    layers.save_layer(roads, str(tmp_path), "roads", "Austin, TX")
    row = layers.load_layer(spark, str(tmp_path), "roads", "Austin, TX").first()
    assert (row.id, row.kind, row.slope_pct, row.geometry) == (1, "street", None, None)


def test_multi_part_features(spark, tmp_path):
    lines = [
        {"type": "Feature", "properties": {"id": 1}, "geometry": {"type": "LineString", "coordinates": [[0, 0], [1, 1]]}},
        {"type": "Feature", "properties": {"id": 2}, "geometry": {"type": "MultiLineString", "coordinates": [[[0, 0], [1, 0]], [[5, 5], [6, 5]]]}},
        {"type": "Feature", "properties": {"id": 3}, "geometry": None},
    ]
    path = tmp_path / "roads.geojsonl"
    path.write_text("\n".join(map(json.dumps, lines)))
    rows = features.read_features(spark, str(path), "id int", "LineString").collect()
    assert sorted((r.id, r.geometry[0].x) for r in rows) == [(1, 0.0), (2, 0.0), (2, 5.0)]


def test_features_of_another_shape_are_not_lost_silently(spark, tmp_path):
    path = tmp_path / "mixed.geojsonl"
    shapes = [("Point", [0, 0]), ("LineString", [[0, 0], [1, 1]])]
    path.write_text("\n".join(json.dumps({"type": "Feature", "properties": {"id": i}, "geometry": {"type": t, "coordinates": c}}) for i, (t, c) in enumerate(shapes)))
    with pytest.raises(Exception, match="a feature that is no LineString: Point"):
        features.read_features(spark, str(path), "id int", "LineString").collect()
    assert [r.id for r in features.read_features(spark, str(path), "id int", "LineString", others="drop").collect()] == [1]


def test_gzip_pois(spark, tmp_path):
    for i in range(2):
        with gzip.open(tmp_path / f"p{i}.csv.gz", "wt") as f:
            f.write(f"placekey,latitude,longitude\nk{i},30.{i},-97.5\n")
    pois = features.read_pois(spark, str(tmp_path), "placekey string, latitude double, longitude double")
    assert sorted((r.placekey, r.latitude) for r in pois.collect()) == [("k0", 30.0), ("k1", 30.1)]


def test_projections_there_and_back(spark):
    tower = G.point(F.lit(-79.387139), F.lit(43.642567))
    kind = T.StructType.fromDDL("x double, y double")
    one = lambda c: spark.range(1).select(c.alias("c")).first().c
    there = lambda crs: P.reproject(tower, kind, P.DEGREES, crs)
    assert tuple(one(there("EPSG:32617"))) == pytest.approx((630084, 4833438), abs=1.5)
    assert tuple(one(there("EPSG:3857"))) == pytest.approx((6378137 * math.radians(-79.387139), 6378137 * math.asinh(math.tan(math.radians(43.642567)))))
    assert one(there("EPSG:32717")).y - one(there("EPSG:32617")).y == pytest.approx(1e7)
    for crs in ("EPSG:32617", "EPSG:32717", "EPSG:3857", "local:43:-79", "EPSG:4326"):
        assert tuple(one(P.reproject(there(crs), kind, crs, P.DEGREES))) == pytest.approx((-79.387139, 43.642567), abs=1e-9)
    for wrong in ("EPSG:32699", "EPSG:1", "local:x:y"):
        with pytest.raises(ValueError):
            P.moves(wrong)


def test_layers_move_to_the_system_asked_for(spark, tmp_path):
    spot = lambda x, y: spark.createDataFrame([(1, x, y), (2, None, None)], "vid int, x double, y double")
    layers.save_layer(spot(-79.0, 43.0), str(tmp_path), "network_nodes", "A", crs="EPSG:4326")
    layers.save_layer(spot(0.0, 0.0), str(tmp_path), "network_nodes", "B", crs="local:43:-79")
    rows = layers.load_layer(spark, str(tmp_path), "network_nodes", crs="EPSG:32617").collect()
    a, b = [next(r for r in rows if r.city == c and r.vid == 1) for c in "ab"]
    assert (a.x, a.y) == pytest.approx((b.x, b.y)) and a.y > 4.7e6
    layers.save_layer(spot(0.0, 0.0), str(tmp_path), "network_nodes", "C")
    assert layers.load_layer(spark, str(tmp_path), "network_nodes").count() == 6
    with pytest.raises(ValueError, match="without a coordinate"):
        layers.load_layer(spark, str(tmp_path), "network_nodes", crs="EPSG:4326")
    shape = "struct<kind:string,parts:array<array<array<struct<x:double,y:double>>>>>"
    df = spark.createDataFrame([(1, ("Point", [[[(-79.0, 43.0)]]])), (2, None)], f"id int, geometry {shape}")
    moved = df.select("id", P.reproject(F.col("geometry"), df.schema["geometry"].dataType, P.DEGREES, "local:43:-79").alias("g")).collect()
    assert (moved[0].g.kind, moved[0].g.parts[0][0][0].x, moved[1].g) == ("Point", 0.0, None)


def test_snapshots_as_of_a_step(spark, tmp_path):
    pairs = spark.createDataFrame([(1, 2, 5), (1, 3, 7)], "vid_o int, vid_d int, n_ods bigint")
    profile = lambda rows: spark.createDataFrame(rows, "vid_o int, vid_d int, step int, d bigint")
    old, new = [(1, 2, 0, 1)], [(1, 2, 0, 10), (1, 2, 3, 40), (1, 3, 0, 5)]
    for kind, rows, last in (("a", old, 9), ("a", new, 4), ("b", old, 1)):
        snapshots.save_snapshots(profile(rows), pairs, str(tmp_path), "Town, X", kind, last)
    read = lambda *a: sorted(map(tuple, snapshots.load_snapshots(spark, str(tmp_path), "town", *a).collect()))
    assert read(["a"], [2]) == [("a", 2, 1, 2, 5, 10, False), ("a", 2, 1, 3, 7, 5, False)]
    assert read(["a"], [4, 3]) == [("a", 3, 1, 2, 5, 40, True), ("a", 3, 1, 3, 7, 5, False), ("a", 4, 1, 2, 5, 40, False), ("a", 4, 1, 3, 7, 5, False)]
    assert read(["b", "a"], [0]) == [("a", 0, 1, 2, 5, 10, False), ("a", 0, 1, 3, 7, 5, False), ("b", 0, 1, 2, 5, 1, False)]
    for kinds, steps in ((["a"], [5]), (["c"], [0]), (["a"], [])):
        with pytest.raises(ValueError):
            snapshots.load_snapshots(spark, str(tmp_path), "town", kinds, steps)
    snapshots.save_snapshots(profile([]), pairs, str(tmp_path), "Town, X", "none", 0)
    assert read(["none"], [0]) == []
