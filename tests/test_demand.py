"""Demand model: shares, clipping, sampling."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from sparkwalk.operators import ranking
from sparkwalk.plans import demand


def square(x0, x1, y1=10.0):
    return [[(x0, 0.0), (x1, 0.0), (x1, y1), (x0, y1), (x0, 0.0)]]


def test_od_points_edge_cases(spark):
    poly = "geometry array<array<struct<x:double,y:double>>>"
    bld = spark.createDataFrame([("a", 1.0, 1.0), ("b", 2.0, 1.0), ("c", 12.0, 1.0), ("d", 25.0, 1.0), ("e", 99.0, 1.0)], "base_id string, x double, y double")
    lu = spark.createDataFrame(
        [("Home", "O", square(0.0, 10.0)), ("Shop", "D", square(10.0, 30.0)), ("Late", "O", square(2.0, 3.0))], f"category string, dmd_kind string, {poly}"
    )
    acs = spark.createDataFrame([("1", 3000, square(0.0, 20.0)), ("2", 70, square(20.0, 30.0)), ("3", 0, square(90.0, 100.0))], f"geoid string, popu int, {poly}")
    pois = spark.createDataFrame([("p", "cafe", "osm", 1.0, 1.0)], "base_id string, category string, source string, x double, y double")
    rows = [(r.base_id, r.category, r.origin, r.weight) for r in demand.od_points(bld, lu, acs, pois).orderBy("id").collect()]
    # 3000 people over a, b and b again (two zones) = 1000 each, clipped; d lies in an area without homes, e outside
    assert rows == [
        ("a", "HOME", True, 500.0), ("b", "HOME", True, 500.0), ("b", "LATE", True, 500.0), ("c", "SHOP", False, 0.0), ("p", "CAFE", False, 0.0),
    ]
    kept = demand.od_points(bld, lu, acs, pois, keep_unpopulated=True)
    assert kept.filter("base_id = 'd'").count() == 1


def test_sample_follows_the_weights(spark):
    origins = spark.createDataFrame([(1, 0.0, 0.0, 1.0), (2, 500.0, 0.0, 3.0), (3, 9e6, 0.0, 50.0), (4, 0.0, 0.0, 0.0)], "odpt_id int, x double, y double, weight double")
    dests = spark.createDataFrame([(10, 50.0, 0.0), (11, 450.0, 0.0), (12, 560.0, 60.0)], "odpt_id int, x double, y double")
    trips = demand.sample_trips(origins, dests, 4000, max_dist=100.0, seed=3).collect()
    assert sorted(r.od_id for r in trips) == list(range(4000))
    seen = Counter((r.orig_odpt, r.dest_odpt) for r in trips)
    assert set(seen) == {(1, 10), (2, 11), (2, 12)}
    assert seen[1, 10] / 4000 == pytest.approx(1 / 7, abs=0.03)
    assert seen[2, 11] / 4000 == pytest.approx(3 / 7, abs=0.04)
    anywhere = demand.sample_trips(origins, dests, 500, seed=3).collect()
    assert len(anywhere) == 500 and {r.dest_odpt for r in anywhere} == {10, 11, 12}


def test_sample_in_degrees(spark):
    origins = spark.createDataFrame([(1, -97.7, 30.3, 2.0)], "odpt_id int, x double, y double, weight double")
    dests = spark.createDataFrame([(5, -97.708, 30.3), (6, -97.71, 30.3), (7, -97.7, 30.3071)], "odpt_id int, x double, y double")
    trips = demand.sample_trips(origins, dests, 300, max_dist=800.0, metric="haversine")
    assert {r.dest_odpt for r in trips.collect()} == {5, 7}  # 768 m and 789 m; the other is 960 m away


@pytest.mark.parametrize("lon, lat, to_lon", [(179.999, 10.0, -179.999), (-179.9995, -45.0, 179.9995), (10.0, 89.9, 20.0), (0.0, 89.9999, 180.0)])
def test_sample_across_the_date_line_and_near_a_pole(spark, lon, lat, to_lon):
    origins = spark.createDataFrame([(1, lon, lat, 1.0)], "odpt_id int, x double, y double, weight double")
    dests = spark.createDataFrame([(5, lon, lat), (6, to_lon, lat), (7, lon, lat - 1.0)], "odpt_id int, x double, y double")
    trips = demand.sample_trips(origins, dests, 200, max_dist=2100.0, metric="haversine", seed=2).collect()
    assert {r.dest_odpt for r in trips} == {5, 6} and len(trips) == 200


def test_no_pair_in_range_is_told(spark):
    origins = spark.createDataFrame([(1, 0.0, 0.0, 1.0)], "odpt_id int, x double, y double, weight double")
    dests = spark.createDataFrame([(5, 80.0, 80.0)], "odpt_id int, x double, y double")
    with pytest.raises(ValueError):
        demand.sample_trips(origins, dests, 5, max_dist=100.0)


def test_lots_meet(spark):
    frame = spark.range(3000).select("id", (F.rand(3) * 1e-3 + 1e-9).alias("w")).repartition(7)
    lots = ranking.running(frame, ["id"], {"to": "w"}, keep_range=True)
    rows = ranking.with_start(lots, ["id"], "to", "since").orderBy("id").collect()
    assert rows[0].since == 0 and all(a.to == b.since for a, b in zip(rows, rows[1:]))


def test_gaps_and_running_sums(spark):
    rows = [(i, v) for i, v in enumerate([None, 2.0, None, None, 8.0, None])]
    out = ranking.interpolate_gaps(spark.createDataFrame(rows, "k int, v double"), "k", ["v"]).orderBy("k")
    assert [r.v for r in out.collect()] == [None, 2.0, 4.0, 6.0, 8.0, 8.0]
    df = spark.range(1000).select("id", (F.col("id") % 7).alias("w"))
    got = ranking.running(df, [F.desc("w"), "id"], {"total": "w"}, rank="rank").orderBy("rank").collect()
    total = 0
    for i, (w, k) in enumerate(sorted(((k % 7, k) for k in range(1000)), key=lambda t: (-t[0], t[1]))):
        total += w
        assert (got[i].id, got[i]["rank"], got[i].total) == (k, i + 1, total)
