"""The queries of the package over the generated tables, one per operator or job.

Each takes (spark, folder of the tables) and reads whole tables.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkwalk.fixtures import network, table
from sparkwalk.functions import geometry as G
from sparkwalk.functions.scalar import haversine_m, metres_to_miles, pedscore, stops_along
from sparkwalk.operators import ranking, relational, routing, spatial
from sparkwalk.operators.components import connected_components, connected_trips, edge_components
from sparkwalk.operators.contract import contract_chains, degrees
from sparkwalk.operators.polygons import points_in_polygons
from sparkwalk.plans import benefit, crosswalks, demand, scores
from sparkwalk.session import checkpoint_dir, cut
from sparkwalk.sources import features, layers, snapshots

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


# ---------------------------------------------------------------- inputs


def _variants(spark: SparkSession, d: str) -> DataFrame:
    return cut(relational.variant_edges(network(spark, d)))


def _od(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "od").groupBy("vid_o", "vid_d").agg(F.sum("n_ods").alias("n_ods"))


def _components(edges: DataFrame) -> DataFrame:
    return cut(connected_components(edges, ["variant"]))


def _routes(spark: SparkSession, d: str) -> tuple[DataFrame, routing.Routes]:
    edges = _variants(spark, d)
    return edges, scores.variant_routes(table(spark, d, "od"), _components(edges), edges)


def _current(spark: SparkSession, d: str) -> DataFrame:
    return network(spark, d).filter("`exists`")


def _scored(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Current and crosswalk networks with a score that has ties."""
    edges = cut(network(spark, d).withColumn("pedscore", (F.col("id") * 37 % 101).cast("double")))
    return edges.filter("`exists`"), edges.filter("`exists` or is_xwalk")


def _interval(spark: SparkSession, d: str) -> int:
    """A seventh of the number of parts: a handful of unequal steps at every scale."""
    return max(table(spark, d, "part").count() // 14, 1)


def _zones(spark: SparkSession, d: str) -> DataFrame:
    p = lambda x, y: G.point(F.col(x), F.col(y))
    ring = F.array(p("x0", "y0"), p("x1", "y0"), p("x1", "y1"), p("x0", "y1"), p("x0", "y0"))
    return table(spark, d, "zones").withColumn("geometry", F.array(ring))


def _spots(spark: SparkSession, d: str) -> DataFrame:
    """Customers at scattered places: (odpt_id, x, y) in millimetres."""
    rows = table(spark, d, "part").count()  # the size of the lattice
    return table(spark, d, "customer").select(
        F.col("c_custkey").alias("odpt_id"),
        (F.col("c_custkey") * 7919 % 1999993).cast("double").alias("x"),
        (F.col("c_custkey") * 104729 % (rows * 5000 - 7)).cast("double").alias("y"),
        F.when(F.col("c_acctbal") > 0, F.round(F.col("c_acctbal") * 100)).otherwise(0).cast("bigint").alias("weight"),
        "c_custkey",
    )


def _shops(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").count()
    return table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("odpt_id"),
        (F.col("s_suppkey") * 15485863 % 1999993).cast("double").alias("x"),
        (F.col("s_suppkey") * 32452843 % (rows * 5000 - 7)).cast("double").alias("y"),
    )


def _edge_lines(spark: SparkSession, d: str) -> DataFrame:
    """Edges as straight lines in millimetres, (eid, src_vid, trg_vid, len, geometry)."""
    at = table(spark, d, "net_nodes").select("vid", G.point(F.col("x_mm"), F.col("y_mm")).alias("p"))
    rows = relational.attach_ends(table(spark, d, "net_edges"), at, ("src_vid", "trg_vid"), "vid", ["p"])
    shape = F.array("p_o", "p_d")
    return rows.select(F.col("id").alias("eid"), "src_vid", "trg_vid", G.length(shape).alias("len"), shape.alias("geometry"))


def _street(spark: SparkSession, d: str, name: str) -> DataFrame:
    ends = F.array(G.point(F.col("x1"), F.col("y1")), G.point(F.col("x2"), F.col("y2")))
    return table(spark, d, name).select("id", ends.alias("geometry"))


def _streets(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(cut(_street(spark, d, f"street_{n}")) for n in ("roads", "sidewalks", "crosswalks"))


# ---------------------------------------------------------------- tables and keys


@query
def variant_edges(spark, d):
    return relational.variant_edges(network(spark, d)).select("variant", "id", "src_vid", "trg_vid", "len", "is_xwalk")


@query
def label_edges(spark, d):
    return relational.label_edges(network(spark, d)).select("id", "category")


@query
def used_nodes(spark, d):
    return relational.used_nodes(relational.variant_edges(network(spark, d)), ["variant"])


@query
def od_aggregate(spark, d):
    return relational.od_counts(table(spark, d, "od_raw"))


@query
def od_attach(spark, d):
    at = table(spark, d, "odpt2node").withColumnRenamed("dist_mm", "dist")
    trips = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    trips = trips.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("od_id"),
        F.concat(F.lit("c"), F.col("o_custkey")).alias("orig_odpt"),
        F.concat(F.lit("s"), F.col("l_suppkey")).alias("dest_odpt"),
    )
    return scores.od_table(trips, at).select("od_id", "orig_odpt", "dest_odpt", "n_ods", "vid_o", "vid_d", "dist")


@query
def node_degrees(spark, d):
    return degrees(network(spark, d)).select("vid", "degree")


@query
def dense_node_ids(spark, d):
    places = table(spark, d, "net_nodes").select("x_mm", "y_mm", "vid")
    return ranking.dense_ids(places, "id", ["y_mm", "x_mm", "vid"]).select("id", "vid")


@query
def best_links_first(spark, d):
    low, high = _scored(spark, d)
    links = benefit.new_links(high, low).select("id", "pedscore", "len")
    return ranking.running(links, [F.desc("pedscore"), F.asc("id")], {"length": "len"}, rank="n_links").select("id", "n_links", "length")


@query
def removal_batches(spark, d):
    low, high = _scored(spark, d)
    edges, _, _ = benefit.removal_steps(low, high, _interval(spark, d))
    return edges.select("id", "gone_at")


@query
def shortest_link_per_node(spark, d):
    arcs = routing.arc_table(network(spark, d)).select("u", "len", "id")
    return ranking.top_per_group(arcs, ["u"], ["len", "id"])


@query
def filled_gaps(spark, d):
    months = table(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyyMM").cast("int").alias("month")).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("o_custkey").alias("m")
    )
    gappy = months.select(
        "month", F.when(F.col("n") % 3 == 0, F.col("n")).cast("double").alias("n"), F.when(F.col("m") % 4 == 1, F.col("m")).cast("double").alias("m")
    )
    out = ranking.interpolate_gaps(gappy, "month", ["n", "m"])
    return out.select("month", F.round("n", 6).alias("n"), F.round("m", 6).alias("m"))


@query
def poi_tags(spark, d):
    """Suppliers as tagged squares; null tags drop, the tag name stays as category."""
    spots = _shops(spark, d).withColumnRenamed("odpt_id", "osmid")
    p = lambda dx, dy: G.point(F.col("x") + dx, F.col("y") + dy)
    square = F.array(F.array(p(0, 0), p(4, 0), p(4, 4), p(0, 4), p(0, 0)))
    tag = lambda name, every: F.when(F.col("osmid") % every == 0, F.concat(F.lit(name + " "), F.col("osmid") % 5)).alias(name)
    shapes = spots.select(
        F.lit("way").alias("element_type"), "osmid", square.alias("geometry"),
        tag("amenity", 2), tag("healthcare", 7), tag("leisure", 3), tag("office", 5), tag("shop", 4),
    )
    return demand.poi_points(shapes).select(
        "element_type", "osmid", "subcategory", "category", F.round("x", 3).alias("x"), F.round("y", 3).alias("y")
    )


@query
def mixed_poi_points(spark, d):
    """A file of points, lines, polygons with holes and multi-part shapes, read in one pass to a point per feature and tag."""
    p = lambda dx, dy: G.point(F.col("x") + dx, F.col("y") + dy)
    square = lambda at, size: F.array(*[p(at + a * size, b * size) for a, b in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))])
    shapes = {
        "Point": F.array(F.array(F.array(p(0, 0)))),
        "LineString": F.array(F.array(F.array(p(0, 0), p(30, 0), p(30, 10)))),
        "Polygon": F.array(F.array(square(0, 8), F.transform(square(1, 2), lambda q: G.point(q["x"], q["y"] + 1)))),
        "MultiPoint": F.array(F.array(F.array(p(0, 0))), F.array(F.array(p(5, 1)))),
        "MultiLineString": F.array(F.array(F.array(p(0, 0), p(10, 0))), F.array(F.array(p(20, 0), p(20, 30)))),
        "MultiPolygon": F.array(F.array(square(0, 2)), F.array(square(10, 4))),
    }
    shape = None
    for i, (kind, parts) in enumerate(shapes.items()):
        made, own = F.struct(F.lit(kind).alias("kind"), parts.alias("parts")), F.col("osmid") % len(shapes) == i
        shape = F.when(own, made) if shape is None else shape.when(own, made)
    spots = _spots(spark, d).withColumnRenamed("odpt_id", "osmid")
    tag = lambda name, every: F.when(F.col("osmid") % every == 0, F.concat(F.lit(name + " "), F.col("osmid") % 5)).alias(name)
    rows = spots.select(F.lit("way").alias("element_type"), "osmid", *[tag(n, k) for n, k in zip(demand.POI_TAGS, (2, 7, 3, 5, 4))], shape.alias("geometry"))
    path = f"{checkpoint_dir(spark)}/{uuid.uuid4().hex}"
    features.write_shapes(rows, path)
    back = features.read_shapes(spark, path, "element_type string, osmid bigint, " + ", ".join(f"{n} string" for n in demand.POI_TAGS))
    out = demand.poi_points(back)
    return out.select("osmid", "subcategory", "category", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


@query
def gzip_pois(spark, d):
    """Points of interest written as gzip CSV files with a header and read back under a schema, never inferred."""
    path = f"{checkpoint_dir(spark)}/{uuid.uuid4().hex}"
    spots = _spots(spark, d).select(F.concat(F.lit("p"), "odpt_id").alias("placekey"), F.col("y").alias("latitude"), F.col("x").alias("longitude"))
    spots.repartition(3).write.option("header", True).option("compression", "gzip").csv(path)
    return features.read_pois(spark, path, "placekey string, latitude double, longitude double")


@query
def projected_lengths(spark, d):
    """Lines given in degrees around 30 N 97 W, projected point by point and measured in metres."""
    lines = _edge_lines(spark, d)
    degrees = G.map_points(F.col("geometry"), lambda p: G.point(p["x"] / 1e8 - 97, p["y"] / 1e9 + 30))
    flat = G.map_points(degrees, lambda p: G.project_xy(p, 30.0, -97.0))
    return lines.select("eid", F.round(G.length(flat), 3).alias("metres"))


@query
def building_centroids(spark, d):
    """L-shaped buildings around every node."""
    nodes = table(spark, d, "net_nodes")
    p = lambda dx, dy: G.point(F.col("x_mm") + dx, F.col("y_mm") + dy)
    shape = F.array(F.array(p(0, 0), p(6000, 0), p(6000, 2000), p(2000, 2000), p(2000, 6000), p(0, 6000), p(0, 0)))
    rows = nodes.select(F.col("vid").alias("osmid"), F.lit("way").alias("element_type"), F.lit("yes").alias("building"), shape.alias("geometry"))
    return demand.building_points(rows).select("osmid", "kind", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


@query
def line_measures(spark, d):
    """Length, midpoint, bounding box and stops of every edge drawn as a line."""
    shape = F.col("geometry")
    mid = G.point_along(shape, F.col("len") / 2)
    box = G.bbox(shape)
    return _edge_lines(spark, d).select(
        "eid", F.round("len", 3).alias("len"), F.round(metres_to_miles(F.col("len") / 1000), 6).alias("miles"),
        F.round(mid.x, 3).alias("mid_x"), F.round(mid.y, 3).alias("mid_y"), box.minx.alias("minx"), box.maxy.alias("maxy"),
        F.size(stops_along(F.col("len"), 5000.0)).alias("stops"),
    )


@query
def great_circle(spark, d):
    """Customers to the places their orders come from, in degrees."""
    lat = lambda k: (F.col(k) % 120 - 60).cast("double")
    lon = lambda k: (F.col(k) * 7 % 360 - 180).cast("double")
    pairs = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey").distinct()
    dist = haversine_m(lat("l_partkey"), lon("l_partkey"), lat("l_suppkey"), lon("l_suppkey"))
    return pairs.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(dist) / 1000, 3).alias("km"))


# ---------------------------------------------------------------- spatial joins


@query
def node_in_zone(spark, d):
    nodes = table(spark, d, "net_nodes").select("vid", F.col("x_mm").cast("double").alias("x"), F.col("y_mm").cast("double").alias("y"))
    zones = _zones(spark, d).select("zone_id", "dmd_kind", "geometry")
    return points_in_polygons(nodes, zones).select("vid", "zone_id", "dmd_kind")


@query
def multi_part_zone(spark, d):
    """Nodes in zones of two parts each, the first with a hole, the second turned into a triangle."""
    p = lambda a, b: G.point(F.col("x0") + a * (F.col("x1") - F.col("x0")), F.col("y0") + b * (F.col("y1") - F.col("y0")))
    box = lambda a, b, c, e: F.array(p(a, b), p(c, b), p(c, e), p(a, e), p(a, b))
    parts = F.array(F.array(box(0, 0, 0.5, 1), box(0.125, 0.25, 0.375, 0.75)), F.array(F.array(p(0.75, 0), p(1, 0), p(1, 1), p(0.75, 0))))
    shape = F.struct(F.lit("MultiPolygon").alias("kind"), parts.alias("parts"))
    zones = table(spark, d, "zones").select("zone_id", shape.alias("geometry"))
    nodes = table(spark, d, "net_nodes").select("vid", F.col("x_mm").cast("double").alias("x"), F.col("y_mm").cast("double").alias("y"))
    return points_in_polygons(nodes, zones).select("vid", "zone_id")


@query
def zones_meet(spark, d):
    """Every zone with the zones it touches or overlaps."""
    a = _zones(spark, d).select(F.col("zone_id").alias("a"), F.col("geometry").alias("ga"))
    b = _zones(spark, d).select(F.col("zone_id").alias("b"), F.col("geometry").alias("gb"))
    return spatial.polygons_meet(a, b, "ga", "gb", cell=100000.0).select("a", "b")


@query
def edges_near_shops(spark, d):
    """Edges within 30 m of a shop."""
    pieces = G.explode_segments(_edge_lines(spark, d).select("eid", "geometry"), "geometry")
    shops = _shops(spark, d).withColumnRenamed("odpt_id", "shop")
    return spatial.pieces_near_points(pieces, shops, 30000.0).select("eid", "shop")


@query
def nearest_node(spark, d):
    nodes = table(spark, d, "net_nodes").select("vid", *[F.col(f"{c}_mm").cast("double").alias(f"{c}{i}") for i in (1, 2) for c in "xy"])
    return spatial.nearest(_spots(spark, d), nodes, "vid", cell=1000.0).select("odpt_id", "vid", F.round("dist", 3).alias("dist"))


@query
def nearest_edge(spark, d):
    pieces = G.explode_segments(_edge_lines(spark, d).select("eid", "geometry"), "geometry")
    return spatial.nearest(_spots(spark, d), pieces, "eid", cell=1000.0).select("odpt_id", F.round("dist", 3).alias("dist"))


@query
def city_pois(spark, d):
    """Customers as POIs, inside the L-shaped union of two zones."""
    pois = _spots(spark, d).select(
        F.concat(F.lit("p"), F.col("odpt_id")).alias("placekey"), F.col("y").alias("latitude"), F.col("x").alias("longitude"),
        (F.col("odpt_id") % 50).cast("int").alias("naics_code"),
    )
    classes = table(spark, d, "nation").select(
        F.col("n_nationkey").cast("string").alias("naics_code"), F.col("n_name").alias("poi_class")
    )
    return demand.city_pois(pois, _zones(spark, d).filter("zone_id in (6, 7, 12)"), classes).select("placekey", "poi_class")


@query
def land_use(spark, d):
    """Parts as land-use features, their size as the code."""
    feats = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("land_use"), F.lit(None).cast("string").alias("geometry"))
    codes = features.dimension(
        spark, [(1, "Single Family", "O"), (2, "Duplex", "O"), (5, "Office", "D"), (7, "Hospital", "D")],
        "lu_code int, category string, dmd_kind string",
    )
    layer = demand.land_use_layer(feats, codes, "lu_code", {"land_use": "lu_code"})
    return layer.groupBy("lu_code", "category", "dmd_kind").agg(F.count(F.lit(1)).alias("n"))


@query
def census(spark, d):
    """Zones as block groups, rows of five zones as counties, one zone row as the city."""
    zones = _zones(spark, d)
    county = zones.select(
        F.lit("17").alias("STATEFP"), F.lpad(F.floor(F.col("zone_id") / 5).cast("string"), 3, "0").alias("COUNTYFP"), "geometry"
    )
    groups = zones.select(F.concat(F.lit("17"), F.lpad(F.floor(F.col("zone_id") / 5).cast("string"), 3, "0"), F.lit("0001"), F.col("zone_id") % 5).alias("GEOID"), "geometry")
    acs = zones.select(
        F.lit("17").alias("state"), F.lpad(F.floor(F.col("zone_id") / 5).cast("string"), 3, "0").alias("county"),
        F.lit("0001").alias("tract"), (F.col("zone_id") % 5).cast("string").alias("block_group"), F.col("popu_cbg").alias("popu"),
    )
    city = zones.filter("zone_id = 12").select("geometry")
    return demand.census_layer(county, city, groups, acs).select("geoid", "popu")


@query
def od_points(spark, d):
    nodes = table(spark, d, "net_nodes")
    bld = nodes.select(F.concat(F.lit("b"), F.col("vid")).alias("base_id"), F.col("x_mm").cast("double").alias("x"), F.col("y_mm").cast("double").alias("y"))
    zones = _zones(spark, d)
    lu = zones.select(F.concat(F.lit("zone "), F.col("n_regionkey")).alias("category"), "dmd_kind", "geometry")
    acs = zones.select(F.col("zone_id").cast("string").alias("geoid"), F.col("popu_cbg").alias("popu"), "geometry")
    pois = _shops(spark, d).select(F.concat(F.lit("s"), F.col("odpt_id")).alias("base_id"), F.lit("Shop").alias("category"), F.lit("osm").alias("source"), "x", "y")
    out = demand.od_points(bld, lu, acs, pois, max_people_per_bld=50)
    return out.select("id", "origin", "base_id", "category", F.round("weight", 6).alias("weight"), "source")


@query
def odpt_to_node(spark, d):
    out = demand.odpt_to_node(_spots(spark, d), _edge_lines(spark, d), spacing=5000.0)
    return out.select(
        "odpt_id", "vid", "is_source", F.round("dist_odpt2cp", 3).alias("dist_odpt2cp"), F.round("dist_cp2node", 3).alias("dist_cp2node")
    )


@query
def sample_od(spark, d):
    """Trips of at most 800 m; the draws come from the orders."""
    given = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("draw_id"), (F.col("o_orderkey") * 7919 % 100003 / 100003.0).alias("u_o"),
        (F.col("o_orderkey") * 104729 % 99991 / 99991.0).alias("u_d"),
    )
    n = table(spark, d, "orders").count() // 3
    return demand.sample_trips(_spots(spark, d), _shops(spark, d), n, 800000.0, given=given).select("od_id", "orig_odpt", "dest_odpt")


@query
def sample_round_trip(spark, d):
    """Two samples of a city stored side by side, one of them found again by its size, seed and range."""
    root = f"{checkpoint_dir(spark)}/{uuid.uuid4().hex}"
    sample = cut(sample_od(spark, d))
    n = table(spark, d, "orders").count() // 3
    for seed, rows in ((1234, sample), (4321, sample.withColumn("od_id", F.col("od_id") + n))):
        named = rows.withColumns({"n": F.lit(n), "seed": F.lit(seed), "max_dist": F.lit(800)})
        layers.save_layer(named, root, "samples", "Test City, TX", by=["n", "seed", "max_dist"])
    back = layers.load_layer(spark, root, "samples", "Test City").filter((F.col("n") == n) & (F.col("seed") == 1234) & (F.col("max_dist") == 800))
    return back.select("od_id", "orig_odpt", "dest_odpt")


# ---------------------------------------------------------------- streets


@query
def intersections(spark, d):
    roads = _street(spark, d, "street_roads")
    return crosswalks.intersections(roads).select(F.col("ixn_id").cast("int").alias("ixn_id"), "x", "y")


def _candidates(spark, d, own):
    roads, walks, known = _streets(spark, d)
    out = crosswalks.candidate_crosswalks(roads, walks, known, own_intersection=own)
    a, b = F.element_at("geometry", 1), F.element_at("geometry", 2)
    return out.select(
        F.col("ixn_id").cast("int").alias("ixn_id"), "road_id", F.round("len", 6).alias("len"), "sw_id_x", "sw_id_y",
        a.x.alias("x1"), a.y.alias("y1"), b.x.alias("x2"), b.y.alias("y2"),
    )


@query
def candidate_crosswalks(spark, d):
    return _candidates(spark, d, False)


@query
def candidate_crosswalks_own_intersection(spark, d):
    return _candidates(spark, d, True)


@query
def base_network(spark, d):
    _, walks, known = _streets(spark, d)
    new = known.select("id", F.transform("geometry", lambda p: G.point(p["x"] + 84, p["y"])).alias("geometry"))
    nodes, edges = crosswalks.base_network(walks, known, new)
    at = nodes.select("vid", "x", "y")
    out = relational.attach_ends(edges, at, ("src_vid", "trg_vid"), "vid", ["x", "y"])
    return out.select("eid", "orig_id", "exists", "is_xwalk", F.round("len", 6).alias("len"), "src_vid", "trg_vid", "x_o", "y_o", "x_d", "y_d")


@query
def snapped_crosswalks(spark, d):
    _, walks, known = _streets(spark, d)
    off = known.select("id", F.transform("geometry", lambda p: G.point(p["x"] + 3, p["y"] - 1)).alias("geometry"))
    out = crosswalks.snap_crosswalks(off, walks)
    a, b = F.element_at("geometry", 1), F.element_at("geometry", 2)
    return out.select("id", a.x.alias("x1"), a.y.alias("y1"), b.x.alias("x2"), b.y.alias("y2"))


@query
def nearest_road(spark, d):
    """Whole crosswalks, half of them pushed off their road."""
    roads, _, known = _streets(spark, d)
    off = F.when(F.col("id") % 16 == 0, 9.0).otherwise(0.0)
    moved = known.withColumn("geometry", F.transform("geometry", lambda p: G.point(p["x"] + 3, p["y"] + off)))
    return crosswalks.nearest_road(moved, roads).select("id", "road_id", F.round("road_dist", 6).alias("dist"))


@query
def part_flags(spark, d):
    parts = spark.read.parquet(f"{d}/part.parquet")
    return parts.select(
        "p_partkey", relational.flag_equal("p_brand", "Brand#13").alias("is_brand"), relational.flag_in("p_size", [1, 5, 24]).alias("is_size")
    )


@query
def parts_exploded(spark, d):
    """Two-part lines, a part a row; the rows without a shape drop."""
    x, y = F.col("p_partkey").cast("double"), F.col("p_size").cast("double")
    line = lambda a, b: F.array(G.point(x, a), G.point(x, b))
    shaped = spark.read.parquet(f"{d}/part.parquet").select(
        "p_partkey", F.when(F.col("p_size") > 10, F.array(line(F.lit(0.0), y), line(y, y * 2))).alias("geometry")
    )
    out = relational.explode_parts(shaped, "geometry")
    a, b = G.first_point(F.col("geometry")), G.last_point(F.col("geometry"))
    return out.select("p_partkey", a.x.alias("x1"), a.y.alias("y1"), b.x.alias("x2"), b.y.alias("y2"))


@query
def unlinked_pairs(spark, d):
    """Proposed links between nodes that no existing link joins, in either direction."""
    edges = network(spark, d)
    turned = _current(spark, d).select(F.col("trg_vid").alias("src_vid"), F.col("src_vid").alias("trg_vid"))
    return relational.anti_join_either_order(edges.filter("not `exists`"), turned, "src_vid", "trg_vid").select("id", "src_vid", "trg_vid")


@query
def chains_contracted(spark, d):
    trips = table(spark, d, "od")  # nodes at which a trip starts or ends stay
    demanded = trips.select(F.explode(F.array("vid_o", "vid_d")).alias("vid")).distinct()
    out = contract_chains(_current(spark, d), demanded)
    return out.select(F.concat_ws(",", "eids").alias("eids"), "orig_id", "is_xwalk", "src_vid", "trg_vid", "len")


@query
def chain_shapes(spark, d):
    """Contracted chains with the shapes of all links they replace."""
    lines = _edge_lines(spark, d).select(F.col("eid").alias("id"), "geometry")
    demanded = table(spark, d, "od").select(F.explode(F.array("vid_o", "vid_d")).alias("vid")).distinct()
    out = contract_chains(_current(spark, d).join(lines, "id"), demanded, "geometry")
    total = F.aggregate(F.transform("geometry", G.length), F.lit(0.0), lambda a, b: a + b)
    return out.select(F.concat_ws(",", "eids").alias("eids"), F.size("geometry").alias("n_parts"), F.round(total, 3).alias("length"))


# ---------------------------------------------------------------- graphs


@query
def components(spark, d):
    return connected_components(_variants(spark, d), ["variant"])


@query
def edges_by_component(spark, d):
    edges = _variants(spark, d)
    out = edge_components(edges, _components(edges), ["variant"])
    return out.groupBy("variant", "cid").agg(F.count(F.lit(1)).alias("n_edges"), F.sum("len").alias("len"))


@query
def trips_connected(spark, d):
    return connected_trips(_od(spark, d), _components(_variants(spark, d)), ["variant"])


@query
def shortest_distances(spark, d):
    _, routes = _routes(spark, d)
    return routes.lengths().select("variant", "vid_o", "vid_d", "n_ods", "d")


@query
def shortest_paths(spark, d):
    _, routes = _routes(spark, d)
    return routes.paths().select("variant", "vid_o", "vid_d", "edge_id", "hop")


@query
def edge_trips(spark, d):
    edges, routes = _routes(spark, d)
    trips = edges.join(routes.edge_trips(), ["variant", "id"], "left").fillna({"n_trips": 0})
    return trips.select("variant", "id", "n_trips")


def _current_routes(spark: SparkSession, d: str) -> tuple[DataFrame, routing.Routes]:
    edges = cut(_current(spark, d))
    pairs = cut(routing.routable_pairs(_od(spark, d), cut(connected_components(edges))))
    return edges, routing.Routes(pairs, edges)


@query
def shortest_distances_current(spark, d):
    return _current_routes(spark, d)[1].lengths().select("vid_o", "vid_d", "n_ods", "d")


@query
def shortest_paths_current(spark, d):
    return _current_routes(spark, d)[1].paths().select("vid_o", "vid_d", "edge_id", "hop")


@query
def edge_trips_current(spark, d):
    edges, routes = _current_routes(spark, d)
    return edges.join(routes.edge_trips(), "id", "left").fillna({"n_trips": 0}).select("id", "n_trips")


@query
def betweenness_current(spark, d):
    out = routing.edge_betweenness(cut(_current(spark, d)))
    return out.select("id", F.round("bwness", 4).alias("bwness"))


@query
def pedscore_current(spark, d):
    edges = cut(_current(spark, d))
    nodes = cut(connected_components(edges))
    pairs = cut(routing.routable_pairs(_od(spark, d), nodes))
    used = routing.edge_trips(pairs, edges, nodes=nodes)
    central = routing.edge_betweenness(edges).select("id", "bwness")
    out = used.join(central, "id")
    return out.select("id", "n_trips", F.round(pedscore(F.col("n_trips"), F.col("bwness")), 6).alias("pedscore"))


def _rerouted(spark, d):
    """Crosswalk network after its worst-scored new links are removed at once."""
    low, high = _scored(spark, d)
    pairs = cut(routing.routable_pairs(_od(spark, d), cut(connected_components(low))))
    edges, _, _ = benefit.removal_steps(low, high, _interval(spark, d))
    return routing.reroute(routing.Routes(pairs, high), edges.filter("gone_at > 1"), edges.filter("gone_at = 1"))


@query
def rerouted(spark, d):
    return _rerouted(spark, d)[0].select("vid_o", "vid_d", "n_ods", "d")


@query
def rerouted_paths(spark, d):
    return _rerouted(spark, d)[1].select("vid_o", "vid_d", "edge_id", "hop")


# ---------------------------------------------------------------- benefit


@query
def links_vs_trips(spark, d):
    low, high = _scored(spark, d)
    out = benefit.links_vs_trips(_od(spark, d), low, high, _interval(spark, d))
    return out.select(
        "n_links", F.round("pct_links", 6).alias("pct_links"), F.round("pct_new_trips", 6).alias("pct_new_trips"), "length", "n_trips"
    )


def _distance_change(spark, d):
    low, high = _scored(spark, d)
    pairs = cut(routing.routable_pairs(_od(spark, d), cut(connected_components(low))))
    edges, last, n_links = benefit.removal_steps(low, high, _interval(spark, d))
    return pairs, cut(benefit.distance_profile(pairs, edges, last)), last, n_links


@query
def distance_steps(spark, d):
    pairs, profile, last, _ = _distance_change(spark, d)
    return benefit.distance_snapshots(pairs, profile, last).select("step", "vid_o", "vid_d", "n_ods", "d")


@query
def mean_distance(spark, d):
    _, profile, last, n_links = _distance_change(spark, d)
    out = benefit.mean_distance(profile, last, _interval(spark, d), n_links)
    return out.select("step", "n_links", "n_left", F.round("d_mean", 4).alias("d_mean"), F.round("delta_mean", 4).alias("delta_mean"))


@query
def benefit_cost(spark, d):
    low, high = _scored(spark, d)
    interval = _interval(spark, d)
    trips = benefit.links_vs_trips(_od(spark, d), low, high, interval)
    _, profile, last, n_links = _distance_change(spark, d)
    out = benefit.benefit_cost(trips, benefit.mean_distance(profile, last, interval, n_links), unit=0.001)
    return out.select(
        "n_links", F.round("pct_new_trips", 4).alias("pct_new_trips"), F.round("delta_mean", 4).alias("delta_mean"),
        F.round("pct_length", 4).alias("pct_length"), F.round("length_mi", 4).alias("length_mi"),
    )


# ---------------------------------------------------------------- layers and files


@query
def layer_round_trip(spark, d):
    """Edges of every variant saved as a layer and read back for one of them."""
    root = f"{checkpoint_dir(spark)}/{uuid.uuid4().hex}"
    layers.save_layer(_variants(spark, d), root, "edges", "Test City, TX", by=["variant"])
    back = layers.load_layer(spark, root, "edges", "Test City").filter("variant = 'sidewalks'")
    return back.select("id", "src_vid", "trg_vid", "len", "exists", "is_xwalk")


@query
def reprojected_layer(spark, d):
    """Two cities saved in degrees and in metres around a place, loaded together in Web Mercator."""
    root = f"{checkpoint_dir(spark)}/{uuid.uuid4().hex}"
    lines = _edge_lines(spark, d).select("eid", G.map_points(F.col("geometry"), lambda p: G.point(p["x"] / 1e8 - 97, p["y"] / 1e9 + 30)).alias("geometry"))
    layers.save_layer(lines.filter("eid % 2 = 0"), root, "network_edges", "Test City, TX", crs="EPSG:4326")
    flat = lines.withColumn("geometry", G.map_points(F.col("geometry"), lambda p: G.project_xy(p, 30.0, -97.0)))
    layers.save_layer(flat.filter("eid % 2 = 1"), root, "network_edges", "Other City, TX", crs="local:30:-97")
    back = layers.load_layer(spark, root, "network_edges", crs="EPSG:3857")
    return back.select("eid", "city", F.round(G.length(F.col("geometry")), 2).alias("metres"))


@query
def snapshot_round_trip(spark, d):
    """Distances of two kinds stored as changes, one kind saved twice, and read as of three steps."""
    root = f"{checkpoint_dir(spark)}/{uuid.uuid4().hex}"
    pairs, profile, last, _ = _distance_change(spark, d)
    doubled = profile.withColumn("d", F.col("d") * 2)
    for kind, rows in (("usage", doubled), ("usage", profile), ("twice", doubled)):
        snapshots.save_snapshots(rows, pairs, root, "Test City, TX", kind, last)
    return snapshots.load_snapshots(spark, root, "Test City", ["usage", "twice"], [0, last // 2, last]).drop("changed")


@query
def feature_round_trip(spark, d):
    """Labelled edges exported as features and read back."""
    path = f"{checkpoint_dir(spark)}/{uuid.uuid4().hex}"
    lines = _edge_lines(spark, d).join(network(spark, d).select(F.col("id").alias("eid"), "exists", "is_xwalk"), "eid")
    features.write_features(relational.label_edges(lines).select("eid", "category", "geometry"), path)
    back = features.read_features(spark, path, "eid int, category string", "LineString")
    return back.select("eid", "category", F.round(G.length(F.col("geometry")), 3).alias("len"))
