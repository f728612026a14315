"""Missing crosswalks: end points near intersections, paired across their road.

All layers are in metres (``functions.geometry.project_xy``): roads (id, geometry), sidewalks
(id, geometry), crosswalks (id, geometry).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sparkwalk.functions import geometry as G
from sparkwalk.operators import spatial
from sparkwalk.operators.ranking import dense_ids
from sparkwalk.operators.skew import skew_join
from sparkwalk.session import cut, known_rows


def _ends(lines: DataFrame, key: str) -> DataFrame:
    """Both end points of each line as rows (key, x, y); a loop gives its point twice."""
    shape = F.col("geometry")
    return lines.select(F.col("id").alias(key), F.inline(F.array(G.first_point(shape), G.last_point(shape))))


def intersections(roads: DataFrame) -> DataFrame:
    """(ixn_id, x, y): end points that more than one road end shares."""
    shared = _ends(roads, "road_id").groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return cut(dense_ids(shared.select("x", "y"), "ixn_id", ["x", "y"]))


def intersection_roads(roads: DataFrame, ixns: DataFrame) -> DataFrame:
    """(ixn_id, road_id), one row per road that ends there."""
    return skew_join(cut(_ends(roads, "road_id")), ixns, ["x", "y"]).select("ixn_id", "road_id").distinct()


def candidate_endpoints(roads: DataFrame, sidewalks: DataFrame, buffer: float = 20.0) -> tuple[DataFrame, DataFrame]:
    """(points, candidates): sidewalk end points (sw_pt_id, x, y) and their roles
    (sw_pt_id, sw_id, ixn_id, road_id, ixn_uid).

    A sidewalk belongs to the road nearest to both its ends (least mean distance) among those
    of the intersections it touches.  ``ixn_id`` is any intersection the *sidewalk* touches on
    that road, ``ixn_uid`` one whose disc the *point* lies in.
    """
    roads = cut(roads.select("id", "geometry").dropna(subset=["geometry"]))
    ixns = intersections(roads)
    ixn_road = cut(intersection_roads(roads, ixns))
    pieces = cut(G.explode_segments(sidewalks.select(F.col("id").alias("sw_id"), "geometry"), "geometry"))
    sw_ixn = cut(spatial.pieces_near_points(pieces, ixns, buffer).select("sw_id", "ixn_id").distinct())
    inside = sidewalks.join(sw_ixn.select(F.col("sw_id").alias("id")).distinct(), "id", "left_semi")
    ends = cut(_ends(inside, "sw_id"))
    points = cut(dense_ids(ends.select("x", "y").distinct(), "sw_pt_id", ["x", "y"]))
    sw_pt = cut(skew_join(ends, points, ["x", "y"]).select("sw_pt_id", "sw_id", "x", "y"))
    discs = points.select("sw_pt_id", F.col("x").alias("px"), F.col("y").alias("py"))
    pt_ixn = cut(spatial.points_near_points(ixns, discs, buffer).select("sw_pt_id", F.col("ixn_id").alias("ixn_uid")))

    sw_road = cut(skew_join(sw_ixn, ixn_road, ["ixn_id"]).select("sw_id", "road_id").distinct())
    road_pieces = G.explode_segments(roads.select(F.col("id").alias("road_id"), "geometry"), "geometry")
    d = G.segment_distance(*[F.col(c) for c in ("x", "y", "x1", "y1", "x2", "y2")])
    apart = (
        skew_join(skew_join(sw_road, sw_pt.distinct(), ["sw_id"]), road_pieces, ["road_id"], rows=2 * sw_road._rows)
        .groupBy("sw_id", "road_id", "sw_pt_id")
        .agg(F.min(d).alias("d"))
    )
    # a looped sidewalk lists its one point twice, which leaves the mean as it is
    mean = apart.groupBy("sw_id", "road_id").agg(F.round(F.avg("d"), 9).alias("mean"))
    own_road = cut(mean.groupBy("sw_id").agg(F.min(F.struct("mean", "road_id")).alias("b")).select("sw_id", "b.road_id"))
    touches = skew_join(sw_ixn, own_road, ["sw_id"]).join(ixn_road, ["ixn_id", "road_id"], "left_semi")
    roles = cut(sw_pt.select("sw_pt_id", "sw_id").distinct().join(touches, "sw_id"))
    return points, skew_join(roles, pt_ixn, ["sw_pt_id"]).select("sw_pt_id", "sw_id", "ixn_id", "road_id", "ixn_uid").distinct()


def candidate_segments(
    points: DataFrame, candidates: DataFrame, roads: DataFrame, crosswalks: DataFrame, buffer: float = 20.0,
    own_intersection: bool = False,
) -> DataFrame:
    """The shortest new segment across each road of each intersection.

    Pairs two end points of different sidewalks of one road inside one intersection's disc;
    keeps those that cross their road and are not yet crosswalks; of these the shortest
    (then the first by coordinates) per (ixn_id, road_id).

    A point keeps its two least sidewalk ids: that is enough to tell whether two points have
    different sidewalks, and which the least are.  Only points on opposite sides of a piece of
    the road are paired, nearest first: the search radius doubles for the groups without a
    segment yet, up to the width of a disc, so a crowded disc is not paired all with all.
    With ``own_intersection`` the disc must be that of ``ixn_id`` itself.
    """
    group = ["ixn_id", "ixn_uid", "road_id"]
    member = candidates.filter("ixn_id = ixn_uid") if own_intersection else candidates
    least = member.groupBy(*group, "sw_pt_id").agg(F.min("sw_id").alias("sw1"))
    second = skew_join(member, least, [*group, "sw_pt_id"], rows=known_rows(candidates)).filter("sw_id > sw1")
    second = second.groupBy(*group, "sw_pt_id").agg(F.min("sw_id").alias("sw2"))
    spots = cut(least.join(second, [*group, "sw_pt_id"], "left").join(points, "sw_pt_id"))
    pieces = G.explode_segments(roads.select(F.col("id").alias("road_id"), "geometry"), "geometry")
    sided = cut(
        skew_join(spots, pieces, ["road_id"]).withColumn(
            "side",
            F.signum(
                (F.col("x2") - F.col("x1")) * (F.col("y") - F.col("y1"))
                - (F.col("y2") - F.col("y1")) * (F.col("x") - F.col("x1"))
            ),
        )
    )
    group = [*group, "x1", "y1", "x2", "y2"]
    known = crosswalks.select(G.first_point(F.col("geometry")).alias("_a"), G.last_point(F.col("geometry")).alias("_b"))
    known = cut(known.select(F.least("_a", "_b").alias("_f"), F.greatest("_a", "_b").alias("_t")).distinct())
    found, radius = None, 2 * buffer
    if sided._rows:
        spread = cut(spatial.with_box(points, spatial.point_box()))
        radius = min(radius, spatial.start_radius(spread, 2 * buffer, buffer / 16))
    while True:
        seg = _crossing_pairs(sided, group, radius)
        fresh = seg.join(known, (F.col("f.p") == F.col("_f")) & (F.col("t.p") == F.col("_t")), "left_anti")
        best = cut(_shortest(fresh))
        found = best if found is None else found.unionByName(best)
        if radius >= 2 * buffer:
            break
        sided = cut(sided.join(best.select("ixn_id", "road_id"), ["ixn_id", "road_id"], "left_anti"))
        if not sided._rows:
            break
        radius *= 2
    out = found.withColumn("geometry", F.array("src", "trg")).drop("src", "trg")
    return dense_ids(out, "id", ["ixn_id", "road_id"])


def _crossing_pairs(sided: DataFrame, group: list[str], radius: float) -> DataFrame:
    """Pairs at most ``radius`` apart that cross a piece of their road: (ixn_id, road_id, f, t)."""
    # one order of each pair suffices: left of the piece to right of it; a point on it is both
    a = sided.filter("side >= 0").drop("side")
    b = sided.filter("side <= 0").select(
        *group, F.col("sw_pt_id").alias("sw_pt_b"), F.col("x").alias("bx"), F.col("y").alias("by"),
        F.col("sw1").alias("sb1"), F.col("sw2").alias("sb2"),
    )
    a._rows = b._rows = sided._rows  # an upper bound
    crossing = G.segments_cross(*[F.col(c) for c in ("x", "y", "bx", "by")], *[F.col(c) for c in ("x1", "y1", "x2", "y2")])
    differ = (F.col("sw_pt_id") != F.col("sw_pt_b")) & (
        (F.col("sw1") != F.col("sb1")) | F.col("sw2").isNotNull() | F.col("sb2").isNotNull()
    )
    near = G.norm(F.col("x") - F.col("bx"), F.col("y") - F.col("by")) <= radius
    pairs = spatial.box_join(
        spatial.with_box(a, spatial.point_box("x", "y")),
        spatial.with_box(b, spatial.point_box("bx", "by"), radius),
        differ & near, radius * 2, on=group,
    )
    p, q = F.struct("x", "y"), F.struct(F.col("bx").alias("x"), F.col("by").alias("y"))
    here = F.struct(p.alias("p"), F.col("sw_pt_id").alias("pt"), F.col("sw1").alias("s1"), F.col("sw2").alias("s2"))
    there = F.struct(q.alias("p"), F.col("sw_pt_b").alias("pt"), F.col("sb1").alias("s1"), F.col("sb2").alias("s2"))
    pair = F.struct(F.least(here, there).alias("f"), F.greatest(here, there).alias("t"))
    # asked of the near pairs only, behind the join: inside its condition the long test of two pieces slows every row it looks at
    told = pairs.select("ixn_id", "road_id", F.explode_outer(F.when(crossing, F.array(pair))).alias("s"))
    return told.filter("s is not null").select("ixn_id", "road_id", "s.f", "s.t")


def _shortest(segments: DataFrame) -> DataFrame:
    """The shortest segment per (ixn_id, road_id), the first by coordinates among equals."""
    f, t = F.col("f"), F.col("t")
    ids = F.array_min(
        F.filter(
            F.array(*[F.struct(u.alias("sx"), v.alias("sy")) for u in (f.s1, f.s2) for v in (t.s1, t.s2)]),
            lambda s: s["sx"].isNotNull() & s["sy"].isNotNull() & (s["sx"] != s["sy"]),
        )
    )
    row = F.struct(
        G.norm(f.p.x - t.p.x, f.p.y - t.p.y).alias("len"), f.p.alias("src"), t.p.alias("trg"),
        f.pt.alias("sw_pt_id_x"), t.pt.alias("sw_pt_id_y"), ids.sx.alias("sw_id_x"), ids.sy.alias("sw_id_y"),
    )
    return segments.groupBy("ixn_id", "road_id").agg(F.min(row).alias("r")).select("ixn_id", "road_id", "r.*")


def candidate_crosswalks(
    roads: DataFrame, sidewalks: DataFrame, crosswalks: DataFrame, buffer: float = 20.0, own_intersection: bool = False
) -> DataFrame:
    points, candidates = candidate_endpoints(roads, sidewalks, buffer)
    return candidate_segments(points, cut(candidates), roads, crosswalks, buffer, own_intersection)


def base_network(sidewalks: DataFrame, crosswalks: DataFrame, candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of sidewalks, crosswalks and candidates; node ids from exact end points.

    Links without length are dropped.  Sidewalks without an ``exists`` column all exist.
    """
    sw = sidewalks.withColumnRenamed("id", "orig_id").withColumn("is_xwalk", F.lit(False))
    if "exists" not in sidewalks.columns:
        sw = sw.withColumn("exists", F.lit(True))
    xw = crosswalks.withColumnRenamed("id", "orig_id").withColumns({"is_xwalk": F.lit(True), "exists": F.lit(True)})
    new = candidates.select(F.col("id").alias("orig_id"), "geometry").withColumns(
        {"is_xwalk": F.lit(True), "exists": F.lit(False)}
    )
    links = sw.unionByName(xw, allowMissingColumns=True).unionByName(new, allowMissingColumns=True)
    links = links.withColumn("len", G.length(F.col("geometry"))).filter("len > 0")
    links = links.withColumns({"src": G.first_point(F.col("geometry")), "trg": G.last_point(F.col("geometry"))})
    links = cut(dense_ids(links, "eid", ["is_xwalk", F.desc("exists"), "orig_id", "src", "trg"]))
    spots = links.select(F.inline(F.array("src", "trg"))).distinct()
    nodes = cut(dense_ids(spots, "vid", ["x", "y"])).withColumn("vid", F.col("vid").cast("int"))
    at = lambda end: nodes.select(F.col("vid").alias(f"{end}_vid"), F.struct("x", "y").alias(end))
    edges = skew_join(skew_join(links, at("src"), ["src"]), at("trg"), ["trg"]).drop("src", "trg")
    return nodes, edges.withColumn("eid", F.col("eid").cast("int"))


def nearest_road(crosswalks: DataFrame, roads: DataFrame) -> DataFrame:
    """Crosswalks with ``road_id``, the road nearest to the whole line of each (0 if they meet; then the least id)."""
    lines = G.explode_segments(crosswalks.select(F.col("id"), "geometry"), "geometry")
    pieces = G.explode_segments(roads.select(F.col("id").alias("road_id"), "geometry"), "geometry")
    return crosswalks.join(spatial.nearest_to_lines(lines, pieces, "id", "road_id", "road_dist"), "id")


def snap_crosswalks(crosswalks: DataFrame, sidewalks: DataFrame) -> DataFrame:
    """Crosswalks as straight lines between the sidewalk ends nearest to their own ends."""
    return spatial.snap_lines(crosswalks, _ends(sidewalks, "sw_id").select("x", "y"))
