"""Demand: places people leave from and go to, their network nodes, and sampled trips.

Coordinates are columns x, y in metres unless a function says otherwise.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from sparkwalk.functions import geometry as G
from sparkwalk.functions.scalar import clip, geoid, haversine_m, stops_along
from sparkwalk.operators import spatial
from sparkwalk.operators.polygons import points_in_polygons
from sparkwalk.operators.ranking import dense_ids, running, with_start
from sparkwalk.operators.relational import bbox_filter, lower_names, tags_long
from sparkwalk.operators.skew import skew_join
from sparkwalk.session import counted_cut, cut

# The POI tags kept, in this order.
POI_TAGS = ("amenity", "healthcare", "leisure", "office", "shop")
#: Smallest grid cell of joins in degrees, about a kilometre; larger shapes lie on coarser levels of their own.
DEGREES = 1 / 128


def _middle(shapes: DataFrame) -> Column:
    """Centroid of the geometry column, a polygon or a SHAPE of any kind."""
    mixed = isinstance(shapes.schema["geometry"].dataType, T.StructType)
    return G.shape_centroid(F.col("geometry")) if mixed else G.centroid(F.col("geometry"))


def building_points(shapes: DataFrame, kind: str = "building") -> DataFrame:
    """Buildings (polygons, or SHAPEs of any kind) to centroids: (osmid, element_type, kind, x, y)."""
    return shapes.select("osmid", "element_type", F.col(kind).alias("kind"), _middle(shapes).alias("p")).select(
        "osmid", "element_type", "kind", "p.x", "p.y"
    )


def poi_points(shapes: DataFrame, tags: Sequence[str] = POI_TAGS) -> DataFrame:
    """Tagged features (polygons, or SHAPEs of any kind) to one centroid row per non-null tag: (element_type, osmid, subcategory, category, x, y)."""
    spots = shapes.withColumn("p", _middle(shapes)).select("element_type", "osmid", "p.x", "p.y", *tags)
    return tags_long(spots, tags, ["element_type", "osmid", "x", "y"])


def city_pois(
    pois: DataFrame, boundary: DataFrame, classes: DataFrame | None = None, x: str = "longitude", y: str = "latitude"
) -> DataFrame:
    """POI rows inside a city: box test at the scan, optional class dimension, exact boundary.

    ``boundary`` is a table of the city's polygons (geometry); its box is a single row.
    """
    edge = boundary.select(G.bbox(F.flatten("geometry")).alias("b")).agg(
        F.min("b.minx"), F.min("b.miny"), F.max("b.maxx"), F.max("b.maxy")
    )
    rows = bbox_filter(pois, tuple(edge.first()), x, y)
    if classes is None:
        keep = [c for c in ("placekey", y, x, "naics_code", "top_category") if c in rows.columns]
        rows = rows.select(*keep)
    else:
        rows = rows.join(classes.withColumn("naics_code", F.col("naics_code").cast("int")), "naics_code")
        rows = rows.select("placekey", y, x, "poi_class")
    return points_in_polygons(rows, boundary.select("geometry"), "geometry", x, y)


def land_use_layer(features: DataFrame, categories: DataFrame, on: str, rename: dict[str, str] | None = None) -> DataFrame:
    """Land-use shapes with category and O/D kind; shapes of no listed category drop.

    ``categories`` is a literal dimension of a few dozen codes.
    """
    shapes = features.withColumnsRenamed(rename or {}).dropna(subset=[on])
    if dict(categories.dtypes)[on] in ("int", "bigint"):
        shapes = shapes.withColumn(on, F.col(on).cast("int")).dropna(subset=[on])
        categories = categories.withColumn(on, F.col(on).cast("int"))
    columns = [c for c in (on, *[c for c in categories.columns if c != on], "geometry")]
    return shapes.join(categories, on).select(*columns)


def census_layer(counties: DataFrame, boundary: DataFrame, block_groups: DataFrame, acs: DataFrame) -> DataFrame:
    """Census rows of the block groups that meet the city: (geoid, geometry, census columns), a row for each part.

    ``acs`` (state, county, tract, block_group, ...) is the census table; only counties of the
    city's first state are used.
    """
    city = boundary.select(F.col("geometry").alias("_city"))
    touched = spatial.polygons_meet(lower_names(counties), city, "geometry", "_city", DEGREES).select("statefp", "countyfp").distinct()
    state = touched.agg(F.min("statefp").alias("statefp"))
    codes = touched.join(state, "statefp").select(F.col("statefp").alias("state"), F.col("countyfp").alias("county"))
    rows = acs.join(codes, ["state", "county"], "left_semi")
    ids = ["state", "county", "tract", "block_group"]
    rows = rows.withColumn("geoid", geoid(*[F.col(c) for c in ids])).drop(*ids)
    areas = lower_names(block_groups).select(F.col("geoid").cast("string").alias("geoid"), "geometry")
    inside = spatial.polygons_meet(areas, city, "geometry", "_city", DEGREES).select("geoid").distinct()
    return areas.join(inside, "geoid", "left_semi").join(rows, "geoid")


def od_points(
    buildings: DataFrame,
    land_use: DataFrame,
    census: DataFrame,
    pois: DataFrame,
    max_people_per_bld: float = 500,
    keep_unpopulated: bool = False,
) -> DataFrame:
    """Origins and destinations: (id, origin, base_id, category, weight, source, x, y).

    ``buildings`` (base_id, x, y); ``land_use`` (category, dmd_kind, geometry); ``census``
    (geoid, popu, geometry); ``pois`` (base_id, category, source, x, y).

    The people of an area are split evenly over its origin buildings, at most
    ``max_people_per_bld`` each.  Areas without people are left out first; buildings of areas
    without an origin building drop too, unless ``keep_unpopulated``.
    """
    used = points_in_polygons(buildings, land_use.select("category", "dmd_kind", "geometry"))
    used = cut(used.withColumn("origin", F.col("dmd_kind").eqNullSafe("O")))
    people = census.select("geoid", F.col("popu").cast("double").alias("popu"), "geometry").filter("popu > 0")
    people = people.withColumn("popu_cbg", F.col("popu").cast("bigint")).drop("popu")
    placed = cut(points_in_polygons(used, people))
    share = placed.filter("origin").groupBy("geoid").agg((F.min("popu_cbg") / F.count(F.lit(1))).alias("weight"))
    share = share.withColumn("weight", clip(F.col("weight"), 0.0, float(max_people_per_bld)))
    homes = skew_join(placed, share, ["geoid"], "left" if keep_unpopulated else "inner")
    homes = homes.select("origin", "base_id", "category", "weight", F.lit("building").alias("source"), "x", "y")
    others = pois.select(F.lit(False).alias("origin"), "base_id", "category", "source", "x", "y")
    points = homes.unionByName(others, allowMissingColumns=True)
    points = points.withColumns(
        {"category": F.upper("category"), "weight": F.when(F.col("origin"), F.col("weight")).otherwise(0.0)}
    )
    return dense_ids(points, "id", ["source", "base_id", "category", "x", "y"])


def odpt_to_node(points: DataFrame, edges: DataFrame, spacing: float = 5.0) -> DataFrame:
    """OD points with the network node they are reached from:
    (odpt_id, vid, is_source, dist_odpt2cp, dist_cp2node, geometry).

    Every point takes its nearest edge; all edges so taken get stops every ``spacing`` metres;
    the stop nearest to the point (perhaps on another edge) is its entry, and the nearer end
    of that stop's edge is its node.  ``points`` (odpt_id, x, y); ``edges`` (eid, geometry,
    len, src_vid, trg_vid).
    """
    points = cut(points.select("odpt_id", "x", "y"))
    pieces = G.explode_segments(edges.select("eid", "geometry"), "geometry")
    near = cut(spatial.nearest(points, pieces, "eid", "dist_odpt2cp"))
    taken = edges.join(near.select("eid").distinct(), "eid", "left_semi")
    stops = taken.select(
        "eid", "geometry", "len", "src_vid", "trg_vid", F.explode(stops_along(F.col("len").cast("double"), spacing)).alias("at")
    )
    stops = stops.withColumn("p", G.point_along(F.col("geometry"), F.col("at")))
    stop = F.struct("eid", "at", F.col("len").cast("double").alias("len"), "src_vid", "trg_vid", "p").alias("stop")
    stops = stops.select(stop, F.col("p.x").alias("x1"), F.col("p.y").alias("y1"), F.col("p.x").alias("x2"), F.col("p.y").alias("y2"))
    entry = spatial.nearest(near.drop("eid"), stops, "stop", "_d")
    at, size = F.col("stop.at"), F.col("stop.len")
    is_source = at <= size / 2
    return entry.select(
        "odpt_id",
        F.when(is_source, F.col("stop.src_vid")).otherwise(F.col("stop.trg_vid")).alias("vid"),
        is_source.alias("is_source"),
        "dist_odpt2cp",
        F.when(is_source, at).otherwise(size - at).alias("dist_cp2node"),
        F.array(F.struct("x", "y"), F.col("stop.p")).alias("geometry"),
    )


def draws(spark, start: int, count: int, seed: int) -> DataFrame:
    """(draw_id, u_o, u_d): two independent numbers in [0, 1) per id, the same on every run."""
    unit = lambda k: (F.shiftrightunsigned(F.xxhash64("draw_id", F.lit(seed), F.lit(k)), 11) / float(1 << 53))
    return spark.range(start, start + count).select(F.col("id").alias("draw_id")).withColumns({"u_o": unit(1), "u_d": unit(2)})


def _cell_sizes(max_dist: float, metric: str, max_lat: float) -> tuple[float, float, int, int]:
    """Cell width, cell height, how many cells the distance can span on either side, and columns around the globe (0: a plane).

    In degrees the width follows from the widest reach in longitude of a circle around a point as far north or south
    as any; a circle that holds a pole reaches all longitudes, and all cells lie in one column.
    """
    side = max_dist / 4
    if metric == "planar":
        return side, side, 4, 0
    reach, lat = max_dist / G.RADIUS_M, math.radians(min(max_lat, 90.0))
    inside = reach + lat < math.pi / 2
    span = math.degrees(math.asin(min(1.0, math.sin(reach) / math.cos(lat)))) if inside else 360.0
    columns = max(1, int(4 * 360 / span)) if inside else 1
    return 360 / columns, math.degrees(side / G.RADIUS_M), 5, columns


class TripSampler:
    """Trips with the origin drawn by weight and the destination uniformly, kept if in range.

    Accepted pairs have probability proportional to weight x (distance <= max_dist).  A draw
    proposes a destination only from the grid cells its origin's cell can reach, so most
    proposals are accepted, and neither all pairs in range nor one long loop is needed: the
    work is the draws plus a bounded number of cells per occupied cell.
    """

    def __init__(self, origins: DataFrame, dests: DataFrame, max_dist: float, metric: str = "planar"):
        """``origins`` (odpt_id, x, y, weight), ``dests`` (odpt_id, x, y); for the metric
        "haversine" x, y are longitude and latitude in degrees and the distance metres."""
        self.max_dist, self.metric = float(max_dist), metric
        tall = lambda df: counted_cut(df, lat=F.max(F.abs("y")))
        origins, seen_o = tall(origins.filter("weight > 0").select(F.col("odpt_id").alias("orig_odpt"), "x", "y", "weight"))
        dests, seen_d = tall(dests.select(F.col("odpt_id").alias("dest_odpt"), F.col("x").alias("dx"), F.col("y").alias("y")))
        dests = dests.withColumnRenamed("y", "dy")
        if not seen_o["n"] or not seen_d["n"]:
            raise ValueError("sampling needs an origin with a weight and a destination")
        wide, high, ring, columns = _cell_sizes(self.max_dist, metric, max(seen_o["lat"], seen_d["lat"]))

        def cell(c: str, size: float) -> Column:
            if columns and c in ("x", "dx"):  # longitudes meet behind the last column
                return F.least(F.floor(F.pmod(F.col(c), F.lit(360.0)) / size), F.lit(columns - 1).cast("bigint"))
            return F.floor(F.col(c) / size)

        placed = dests.withColumns({"dcx": cell("dx", wide), "dcy": cell("dy", high)})
        ranked = cut(running(placed, ["dcx", "dcy", "dest_odpt"], rank="pos"))
        counts = cut(ranked.groupBy("dcx", "dcy").agg(F.count(F.lit(1)).alias("cnt"), F.min("pos").alias("base")))
        self.dests = cut(ranked.join(counts.select("dcx", "dcy", "base"), ["dcx", "dcy"]).select(
            "dcx", "dcy", (F.col("pos") - F.col("base")).alias("idx"), "dest_odpt", "dx", "dy"
        ))

        homes = origins.withColumns({"ocx": cell("x", wide), "ocy": cell("y", high)})
        self.homes = homes = cut(homes)
        around = F.sequence(F.lit(-ring), F.lit(ring))
        wrapped = lambda c: F.pmod(c, F.lit(columns)).cast("bigint") if columns else c
        reach = (
            homes.select("ocx", "ocy").distinct()
            .withColumn("dcx", F.explode(F.array_distinct(F.transform(around, lambda i: wrapped(F.col("ocx") + i)))))
            .withColumn("dcy", F.explode(F.transform(around, lambda i: F.col("ocy") + i)))
            .join(counts.select("dcx", "dcy", "cnt"), ["dcx", "dcy"])
        )
        in_cell = Window.partitionBy("ocx", "ocy").orderBy("dcx", "dcy")  # at most (2 ring + 1)^2 rows
        self.reach = cut(
            reach.withColumn("upto", F.sum("cnt").over(in_cell)).withColumn("since", F.col("upto") - F.col("cnt"))
        )
        choices = self.reach.groupBy("ocx", "ocy").agg(F.sum("cnt").alias("choices"))
        weighted = skew_join(homes, choices, ["ocx", "ocy"])
        lots, seen = counted_cut(
            running(weighted, ["orig_odpt"], {"w_to": F.col("weight") * F.col("choices")}, keep_range=True), total=F.max("w_to")
        )
        if not seen["n"]:
            raise ValueError("no destination lies within reach of any origin")
        self.total, self.n_lots = float(seen["total"]), seen["n"]
        width = self.total / self.n_lots
        lots = with_start(lots, ["orig_odpt"], "w_to", "w_from")
        slots = F.sequence(F.floor(F.col("w_from") / width), F.floor(F.col("w_to") / width))
        # a heavy origin fills many slots, but all origins together at most 2 x n_lots
        self.lots = cut(lots.withColumn("slot", F.explode(slots)))
        self.width = width

    def take(self, draws: DataFrame) -> DataFrame:
        """(draw_id, orig_odpt, dest_odpt) of the draws whose proposal is in range."""
        aim = F.col("u_o") * self.total
        aimed = draws.withColumns({"aim": aim, "slot": F.floor(aim / self.width)})
        chosen = skew_join(
            aimed, self.lots, ["slot"], where=(F.col("aim") >= F.col("w_from")) & (F.col("aim") < F.col("w_to"))
        ).select("draw_id", "orig_odpt", "x", "y", "ocx", "ocy", F.floor(F.col("u_d") * F.col("choices")).alias("k"))
        reach = self.reach.select("ocx", "ocy", "dcx", "dcy", "since", "upto")
        spot = skew_join(chosen, reach, ["ocx", "ocy"], where=(F.col("k") >= F.col("since")) & (F.col("k") < F.col("upto")))
        spot = spot.withColumn("idx", F.col("k") - F.col("since"))
        pair = spot.join(self.dests, ["dcx", "dcy", "idx"])
        return pair.filter(self._distance() <= self.max_dist).select("draw_id", "orig_odpt", "dest_odpt")

    def possible(self) -> bool:
        """Whether any pair lies within range (looks until it finds one)."""
        pairs = self.homes.join(self.reach.select("ocx", "ocy", "dcx", "dcy"), ["ocx", "ocy"]).join(self.dests, ["dcx", "dcy"])
        return bool(pairs.filter(self._distance() <= self.max_dist).limit(1).count())

    def _distance(self) -> Column:
        if self.metric == "planar":
            return G.norm(F.col("x") - F.col("dx"), F.col("y") - F.col("dy"))
        return haversine_m(F.col("y"), F.col("x"), F.col("dy"), F.col("dx"))


def sample_trips(
    origins: DataFrame, dests: DataFrame, n: int, max_dist: float | None = None, seed: int = 0, metric: str = "planar",
    given: DataFrame | None = None,
) -> DataFrame:
    """``n`` trips (od_id, orig_odpt, dest_odpt), with replacement.

    ``given`` draws (draw_id, u_o, u_d) make the sample exact and repeatable elsewhere; the
    first ``n`` accepted ones are returned, fewer if they run out.  Without them draws are
    made from ``seed`` until there are enough.
    """
    if max_dist is None:
        return _sample_anywhere(origins, dests, n, seed, given)
    sampler = TripSampler(origins, dests, max_dist, metric)
    if given is not None:
        trips = sampler.take(given)
    else:
        trips, have, start, rate = None, 0, 0, 0.5
        while have < n:
            count = int((n - have) / rate * 1.1) + 100
            part, seen = counted_cut(sampler.take(draws(origins.sparkSession, start, count, seed)))
            trips = part if trips is None else trips.unionByName(part)
            have, start = have + seen["n"], start + count
            rate = max(have / start, 1e-3)
            if not have and trips is part and not sampler.possible():
                raise ValueError("no origin with a weight has a destination within range")
    return dense_ids(trips, "od_id", ["draw_id"]).filter(F.col("od_id") < n).drop("draw_id")


def _sample_anywhere(origins: DataFrame, dests: DataFrame, n: int, seed: int, given: DataFrame | None) -> DataFrame:
    """Origin by weight and destination uniformly, without a distance limit."""
    lots, seen = counted_cut(
        running(origins.filter("weight > 0").select(F.col("odpt_id").alias("orig_odpt"), "weight"), ["orig_odpt"], {"w_to": "weight"}, keep_range=True),
        total=F.max("w_to"),
    )
    width = float(seen["total"]) / seen["n"]
    lots = with_start(lots, ["orig_odpt"], "w_to", "w_from")
    lots = lots.withColumn("slot", F.explode(F.sequence(F.floor(F.col("w_from") / width), F.floor(F.col("w_to") / width))))
    places, ranked = counted_cut(dests.select(F.col("odpt_id").alias("dest_odpt")))
    places = running(places, ["dest_odpt"], rank="pos")
    drawn = draws(origins.sparkSession, 0, n, seed) if given is None else given.filter(F.col("draw_id") < n)
    aim = F.col("u_o") * float(seen["total"])
    drawn = drawn.withColumns(
        {"aim": aim, "slot": F.floor(aim / width), "pos": F.floor(F.col("u_d") * ranked["n"]) + 1}
    )
    chosen = skew_join(drawn, lots, ["slot"], where=(F.col("aim") >= F.col("w_from")) & (F.col("aim") < F.col("w_to")))
    return chosen.join(places, "pos").select(F.col("draw_id").alias("od_id"), "orig_odpt", "dest_odpt")
