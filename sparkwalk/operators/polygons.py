"""Points in polygons by an index of ring edges, so that work follows edges near a point, not all vertices of a boundary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from sparkwalk.functions import geometry as G
from sparkwalk.operators.skew import skew_join
from sparkwalk.session import cut, known_rows


def _rings(zones: DataFrame, polygon: str) -> Column:
    """All closed rings of a POLYGON or, over all parts, of a polygonal SHAPE."""
    rings = F.col(polygon)
    if isinstance(zones.schema[polygon].dataType, T.StructType):
        rings = F.when(F.col(polygon)["kind"].endswith("Polygon"), F.flatten(F.col(polygon)["parts"]))
    close = lambda r: F.when(F.get(r, F.lit(0)) == F.element_at(r, -1), r).otherwise(F.concat(r, F.slice(r, 1, 1)))
    return F.transform(F.filter(rings, lambda r: F.size(r) > 2), close)


def edge_index(zones: DataFrame, polygon: str = "geometry") -> DataFrame:
    """A row per grid cell that a polygon touches: (_k, _cx, _cy, _odd, _edges, _zone), ``_zone`` the other columns.

    A polygon of n vertices lies on square cells of 2^_k, about n / 4 of them.  ``_edges`` are the ring edges whose box
    touches the cell.  A ray that leaves a point of the cell to the right as far as the cell's border, then goes straight
    up, meets these edges and, above the cell, only edges that straddle the border: ``_odd`` tells whether these are
    odd in number.  So cells without edges are inside as a whole, or are not stored.  Holes and parts need no care, as
    every ring counts alike.  Null shapes, shapes without an area or with coordinates that are no finite numbers hold
    nothing.  An edge is stored once for each cell its box touches, so only long slanted edges take many rows.
    """
    rest = [c for c in zones.columns if c != polygon]
    named = F.struct(*rest) if rest else F.struct(F.lit(True).alias("_any"))
    shapes = zones.select(named.alias("_zone"), _rings(zones, polygon).alias("_rings")).withColumn("_pid", F.monotonically_increasing_id())
    extent = F.greatest(F.col("_box.maxx") - F.col("_box.minx"), F.col("_box.maxy") - F.col("_box.miny"))
    vertices = F.aggregate("_rings", F.lit(0), lambda n, r: n + F.size(r))
    boxed = shapes.withColumn("_box", G.bbox(F.flatten("_rings")))
    finite = (extent > 0) & (extent - extent == 0)
    scale = F.ceil(F.log2(extent / F.greatest(F.sqrt(vertices) / 2, F.lit(1.0)))).cast("int")
    boxed = cut(boxed.filter(finite).withColumn("_k", scale))
    size = F.pow(F.lit(2.0), F.col("_k"))
    at = lambda c: F.floor(c / size)  # noqa: E731 - exact: the size is a power of two
    span = lambda lo, hi: F.explode(F.sequence(lo, hi))
    cells = boxed.select("_pid", "_k", "_zone", "_box", span(at(F.col("_box.minx")), at(F.col("_box.maxx"))).alias("_cx"))
    cells = cells.select("_pid", "_k", "_zone", "_cx", span(at(F.col("_box.miny")), at(F.col("_box.maxy"))).alias("_cy"))

    pieces = boxed.select("_pid", "_k", F.explode(F.flatten(F.transform("_rings", G.segments))).alias("s")).filter("s.x1 <> s.x2 or s.y1 <> s.y2")
    left, right = at(F.least("s.x1", "s.x2")), at(F.greatest("s.x1", "s.x2"))
    low, high = at(F.least("s.y1", "s.y2")), at(F.greatest("s.y1", "s.y2"))
    near = pieces.select("_pid", "s", low.alias("_low"), high.alias("_high"), span(left, right).alias("_cx"))
    near = near.select("_pid", "s", "_cx", span(F.col("_low"), F.col("_high")).alias("_cy"))
    near = near.groupBy("_pid", "_cx", "_cy").agg(F.collect_list("s").alias("_edges"))

    # an edge that straddles the right border of column cx lies above all cells below its own lowest one
    straddling = pieces.filter(left < right).select("_pid", (low - 1).alias("_cy"), span(left, right - 1).alias("_cx"))
    counts = straddling.groupBy("_pid", "_cx", "_cy").agg(F.count(F.lit(1)).alias("_n"))
    marks = cells.select("_pid", "_cx", "_cy", F.lit(0).cast("bigint").alias("_n"), F.lit(True).alias("_cell"))
    marks = marks.unionByName(counts.withColumn("_cell", F.lit(False)).select(marks.columns))
    column = Window.partitionBy("_pid", "_cx").orderBy(F.desc("_cy")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    odd = marks.withColumn("_odd", F.sum("_n").over(column) % 2 == 1).filter("_cell").select("_pid", "_cx", "_cy", "_odd")

    on = ["_pid", "_cx", "_cy"]
    index = cells.join(odd, on).join(near, on, "left").filter("_odd or _edges is not null")
    return cut(index.select("_k", "_cx", "_cy", "_odd", "_edges", "_zone"))


def points_in_polygons(points: DataFrame, zones: DataFrame, polygon: str = "geometry", x: str = "x", y: str = "y") -> DataFrame:
    """Every point with the other columns of every polygon around it: overlaps repeat the point, points outside drop.

    ``polygon`` is a POLYGON or a SHAPE, of which only polygons hold points, in all their parts.  A point on an edge is inside on
    the lower left side only.  Points without finite coordinates lie nowhere; zones have other column names than points.
    """
    index = edge_index(zones, polygon)
    scales = sorted(r[0] for r in index.select("_k").distinct().collect())  # powers of two: few, whatever the data
    size = F.pow(F.lit(2.0), F.col("_k"))
    px, py = F.col(x).cast("double"), F.col(y).cast("double")
    placed = points.filter((px - px == 0) & (py - py == 0))
    placed = placed.withColumn("_k", F.explode(F.array(*[F.lit(k) for k in scales]).cast("array<int>")))
    placed = placed.withColumns({"_cx": F.floor(px / size), "_cy": F.floor(py / size)})
    rows = known_rows(points)
    met = skew_join(placed, index, ["_k", "_cx", "_cy"], rows=None if rows is None else rows * len(scales))
    border = (F.col("_cx") + 1) * size

    def flipped(odd: Column, s: Column) -> Column:
        spans = (s["y1"] > py) != (s["y2"] > py)
        meet = (s["x2"] - s["x1"]) * (py - s["y1"]) / F.when(spans, s["y2"] - s["y1"]) + s["x1"]
        beyond = s["x1"] >= border
        straddles = beyond != (s["x2"] >= border)
        above = F.when(beyond, s["y1"]).otherwise(s["y2"]) > py
        return (odd != (spans & (px < meet))) != (straddles & above)

    inside = F.when(F.col("_edges").isNull(), F.col("_odd")).otherwise(F.aggregate("_edges", F.col("_odd"), flipped))
    kept = [f"_zone.{c}" for c in zones.columns if c != polygon]
    return met.filter(inside).select(*points.columns, *kept)
