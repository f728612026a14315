"""Spatial joins: shapes meet through grid cells, an equi-join Spark can shuffle."""

from __future__ import annotations

import functools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from sparkwalk.functions import geometry as G
from sparkwalk.operators.skew import skew_join
from sparkwalk.session import counted_cut, cut, known_rows

BOX = ("minx", "miny", "maxx", "maxy")
# Cells of a shape's own level are at least as wide as the shape, so it touches at most 2 x 2.
_BUSY_CELL = 64  # targets per cell at which the nearest search starts


def with_box(df: DataFrame, box: Column, margin: Column | float = 0.0) -> DataFrame:
    """Add the bounding box (struct of BOX), widened by ``margin``, as four columns."""
    m = margin if isinstance(margin, Column) else F.lit(float(margin))
    out = df.withColumn("_box", box).select(
        *df.columns,
        (F.col("_box.minx") - m).alias("minx"), (F.col("_box.miny") - m).alias("miny"),
        (F.col("_box.maxx") + m).alias("maxx"), (F.col("_box.maxy") + m).alias("maxy"),
    )
    out._rows = known_rows(df)
    return out


def point_box(x: str = "x", y: str = "y") -> Column:
    return F.struct(F.col(x).alias("minx"), F.col(y).alias("miny"), F.col(x).alias("maxx"), F.col(y).alias("maxy"))


def piece_box() -> Column:
    """Box of a straight piece in columns x1, y1, x2, y2."""
    return F.struct(
        F.least("x1", "x2").alias("minx"), F.least("y1", "y2").alias("miny"),
        F.greatest("x1", "x2").alias("maxx"), F.greatest("y1", "y2").alias("maxy"),
    )


def _level(cell: float) -> Column:
    extent = F.greatest(F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny"))
    return F.greatest(F.ceil(F.log2(F.greatest(extent, F.lit(cell)) / cell)), F.lit(0)).cast("int")


def _levels(df: DataFrame, cell: float) -> list[int]:
    """The levels in use, ascending; extents are doubles, so there are never many."""
    return sorted(r[0] for r in df.select(_level(cell).alias("l")).distinct().collect() if r[0] is not None)


def _cells(df: DataFrame, cell: float, other_levels: Sequence[int], prefix: str) -> DataFrame:
    """One row per cell at the shape's own level and at every coarser level the other side uses."""
    own = _level(cell)
    coarser = F.filter(F.array(*[F.lit(l) for l in other_levels]).cast("array<int>"), lambda l: l > F.col("_own"))
    rows = df.withColumn("_own", own).withColumn("_level", F.explode(F.array_union(F.array("_own"), coarser)))
    size = F.lit(cell) * F.pow(F.lit(2.0), F.col("_level"))
    span = lambda lo, hi: F.sequence(F.floor(F.col(lo) / size), F.floor(F.col(hi) / size))
    rows = rows.withColumn("_cx", F.explode(span("minx", "maxx"))).withColumn("_cy", F.explode(span("miny", "maxy")))
    names = {b: f"{prefix}{b}" for b in BOX} | {"_own": f"{prefix}own"}
    return rows.withColumnsRenamed(names)


def box_join(
    left: DataFrame, right: DataFrame, where: Column | None = None, cell: float = 64.0, on: Sequence[str] = ()
) -> DataFrame:
    """Pairs whose boxes (columns BOX on both sides) overlap and that meet ``where``.

    Every shape sits on the grid level that fits its own size, where it covers at most four
    cells, whatever mix of sizes there is; two shapes meet on the coarser of their levels.
    A pair is reported only in the cell that holds the lower left corner of the overlap, so
    no duplicate has to be removed afterwards.  Cells crowded on the left side are salted.
    ``on`` names columns that must be equal too; other columns need different names.
    """
    left_levels, right_levels = _levels(left, cell), _levels(right, cell)
    a = _cells(left, cell, right_levels, "_l_")
    b = _cells(right, cell, left_levels, "_r_")
    size = F.lit(cell) * F.pow(F.lit(2.0), F.greatest("_l_own", "_r_own"))
    x, y = F.greatest("_l_minx", "_r_minx"), F.greatest("_l_miny", "_r_miny")
    meet = (
        (F.floor(x / size) == F.col("_cx"))
        & (F.floor(y / size) == F.col("_cy"))
        & (F.col("_level") == F.greatest("_l_own", "_r_own"))
        & (x <= F.least("_l_maxx", "_r_maxx"))
        & (y <= F.least("_l_maxy", "_r_maxy"))
    )
    if where is not None:
        meet = meet & where
    rows = known_rows(left)
    if rows is not None:
        rows *= 4 * (1 + len(right_levels))
    out = skew_join(a, b, [*on, "_level", "_cx", "_cy"], where=meet, rows=rows)
    return out.drop("_level", "_cx", "_cy", *[f"{p}{c}" for p in ("_l_", "_r_") for c in (*BOX, "own")])


def polygons_meet(left: DataFrame, right: DataFrame, left_polygon: str, right_polygon: str, cell: float = 64.0) -> DataFrame:
    return box_join(
        with_box(left, G.bbox(F.flatten(left_polygon))),
        with_box(right, G.bbox(F.flatten(right_polygon))),
        G.polygons_intersect(F.col(left_polygon), F.col(right_polygon)),
        cell,
    )


def pieces_near_points(pieces: DataFrame, points: DataFrame, radius: float, x: str = "x", y: str = "y") -> DataFrame:
    """Straight pieces (x1, y1, x2, y2) within ``radius`` of points: one row per such pair."""
    near = G.segment_distance(F.col(x), F.col(y), *[F.col(c) for c in ("x1", "y1", "x2", "y2")]) <= radius
    return box_join(with_box(points, point_box(x, y), radius), with_box(pieces, piece_box()), near, max(radius, 1e-9) * 2)


def points_near_points(left: DataFrame, right: DataFrame, radius: float) -> DataFrame:
    """Pairs of points at most ``radius`` apart; left columns x, y and right columns px, py."""
    near = G.norm(F.col("x") - F.col("px"), F.col("y") - F.col("py")) <= radius
    return box_join(with_box(left, point_box("x", "y")), with_box(right, point_box("px", "py"), radius), near, max(radius, 1e-9) * 2)


def nearest(points: DataFrame, pieces: DataFrame, key: str, distance: str = "dist", cell: float = 1.0) -> DataFrame:
    """Points (any columns, x and y among them) with their nearest piece and its distance.

    ``pieces`` (key, x1, y1, x2, y2) are straight pieces or, with both ends equal, points;
    several pieces may share one key.  Of equally near keys the least wins.

    Equal places are searched once, equal pieces keep their least key.  The search starts with
    a radius small enough that a cell of that size holds few pieces even where they are
    densest, accepts only answers within the radius, and doubles it for the places still
    open, so crowded areas never build all pairs and empty ones only take more rounds.  Points and pieces with a
    coordinate that is null or no finite number are nowhere near anything and are left out.
    """
    placed = lambda *names: functools.reduce(Column.__and__, [F.col(c) - F.col(c) == 0 for c in names])
    points, pieces = points.filter(placed("x", "y")), pieces.filter(placed("x1", "y1", "x2", "y2"))
    targets = pieces.groupBy("x1", "y1", "x2", "y2").agg(F.min(key).alias(key))
    targets, seen = counted_cut(
        with_box(targets, piece_box()),
        n=F.count(F.lit(1)), minx=F.min("minx"), miny=F.min("miny"), maxx=F.max("maxx"), maxy=F.max("maxy"),
    )
    places, box = counted_cut(
        points.select("x", "y").distinct(),
        n=F.count(F.lit(1)), minx=F.min("x"), miny=F.min("y"), maxx=F.max("x"), maxy=F.max("y"),
    )
    keyed = points.schema.names
    if not seen["n"] or not box["n"]:
        empty = targets.select(F.col(key), F.lit(0.0).alias(distance)).limit(0)
        return points.limit(0).join(empty, F.lit(True))
    extent = math.hypot(
        max(seen["maxx"], box["maxx"]) - min(seen["minx"], box["minx"]), max(seen["maxy"], box["maxy"]) - min(seen["miny"], box["miny"])
    )
    radius = start_radius(targets, max(extent, cell), cell)
    found = None
    left = box["n"]
    while left:
        d = G.segment_distance(*[F.col(c) for c in ("x", "y", "x1", "y1", "x2", "y2")])
        near = box_join(with_box(places, point_box(), radius), targets, None, radius * 2)
        # the radius is asked of the least distance only, so that a distance is worked out once a pair and not inside the join
        best, seen = counted_cut(
            near.groupBy("x", "y").agg(F.min(F.struct(d.alias(distance), F.col(key))).alias("_best")).select("x", "y", "_best.*")
            .filter(F.col(distance) <= radius)
        )
        found = best if found is None else found.unionByName(best)
        left -= seen["n"]
        if left:
            places = cut(places.join(best, ["x", "y"], "left_anti"))
            radius *= 2 if seen["n"] else 8  # nothing near at all: larger strides
    on = ["x", "y"]
    return skew_join(points, found, on).select(*keyed, key, distance)


def nearest_to_lines(lines: DataFrame, pieces: DataFrame, line: str, key: str, distance: str = "dist", cell: float = 1.0) -> DataFrame:
    """(line, key, distance): for each line the nearest piece, by the least distance between any two points of them.

    ``lines`` (line, x1, y1, x2, y2) and ``pieces`` (key, x1, y1, x2, y2) are straight pieces, several of which may share one
    name.  Lines that meet a piece have distance 0; of equally near keys the least wins.  The search grows its radius as
    ``nearest`` does, and only for the lines that found nothing yet.  Pieces without finite coordinates are left out.
    """
    corners = ("x1", "y1", "x2", "y2")
    placed = functools.reduce(Column.__and__, [F.col(c) - F.col(c) == 0 for c in corners])
    box = {"minx": F.min("minx"), "miny": F.min("miny"), "maxx": F.max("maxx"), "maxy": F.max("maxy")}
    targets = pieces.filter(placed).groupBy(*corners).agg(F.min(key).alias(key))
    targets, seen = counted_cut(with_box(targets, piece_box()), **box)
    probes = with_box(lines.filter(placed).select(line, *corners), piece_box())
    probes, own = counted_cut(probes.withColumnsRenamed({c: f"_{c}" for c in corners}), **box)
    if not seen["n"] or not own["n"]:
        return probes.select(line).limit(0).join(targets.select(key, F.lit(0.0).alias(distance)).limit(0), F.lit(True))
    extent = math.hypot(*[max(seen[f"max{c}"], own[f"max{c}"]) - min(seen[f"min{c}"], own[f"min{c}"]) for c in "xy"])
    radius = start_radius(targets, max(extent, cell), cell)
    d = G.piece_distance([F.col(f"_{c}") for c in corners], [F.col(c) for c in corners])
    found, left = None, own["n"]
    while left:
        wide = probes.withColumns({"minx": F.col("minx") - radius, "miny": F.col("miny") - radius, "maxx": F.col("maxx") + radius, "maxy": F.col("maxy") + radius})
        wide._rows = known_rows(probes)
        near = box_join(wide, targets, None, radius * 2)
        best, seen = counted_cut(
            near.groupBy(line).agg(F.min(F.struct(d.alias(distance), F.col(key))).alias("_best")).select(line, f"_best.{key}", f"_best.{distance}")
            .filter(F.col(distance) <= radius)
        )
        found = best if found is None else found.unionByName(best)
        probes, own = counted_cut(probes.join(best, line, "left_anti"))
        left = own["n"]
        radius *= 2 if seen["n"] else 8
    return found


def start_radius(targets: DataFrame, extent: float, cell: float) -> float:
    """The largest radius, ``cell`` times a power of two, whose cells hold at most _BUSY_CELL pieces each (``cell`` if none does).

    A larger cell holds all of the smaller ones it is made of, so the fitting sizes are found by halving: a few passes
    with one row a piece each, however many sizes there are.
    """
    mid = lambda a, b: (F.col(a) + F.col(b)) / 2
    fits, crowded = 0, max(int(math.ceil(math.log2(extent / cell))), 0) + 1
    while crowded - fits > 1:
        k = (fits + crowded) // 2
        size = F.lit(float(cell * 2**k))
        cells = targets.groupBy(F.floor(mid("minx", "maxx") / size).alias("cx"), F.floor(mid("miny", "maxy") / size).alias("cy"))
        most = cells.count().agg(F.max("count").alias("most")).first()["most"]
        fits, crowded = (k, crowded) if (most or 0) <= _BUSY_CELL else (fits, k)
    return float(cell * 2**fits)


def snap_lines(lines: DataFrame, targets: DataFrame, geometry: str = "geometry") -> DataFrame:
    """Both ends of each line moved to the nearest of the target points (x, y); the line becomes straight."""
    places = targets.select("x", "y").distinct()
    spots = places.select(
        F.struct("x", "y").alias("_spot"), F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("x").alias("x2"), F.col("y").alias("y2")
    )
    rest = [c for c in lines.columns if c != geometry]
    ends = lines.select(*rest, F.posexplode(F.array(G.first_point(F.col(geometry)), G.last_point(F.col(geometry)))).alias("_end", "_p"))
    ends = ends.select(*rest, "_end", "_p.x", "_p.y")
    snapped = nearest(ends, spots, "_spot", "_dist")
    pick = lambda i: F.max(F.when(F.col("_end") == i, F.col("_spot")))
    return snapped.groupBy(*rest).agg(F.array(pick(0), pick(1)).alias(geometry))
