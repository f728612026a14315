"""Files: features as GeoJSON lines, POI tables as gzip CSV, small dimensions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

# How deep the coordinate arrays of each geometry type nest.
_DEPTH = {"Point": 0, "MultiPoint": 1, "LineString": 1, "MultiLineString": 2, "Polygon": 2, "MultiPolygon": 3}


def _points(col: Column, depth: int) -> Column:
    if depth == 0:
        return F.struct(F.element_at(col, 1).alias("x"), F.element_at(col, 2).alias("y"))
    return F.transform(col, lambda c: _points(c, depth - 1))


def _numbers(col: Column, depth: int) -> Column:
    if depth == 0:
        return F.array(col["x"], col["y"])
    return F.transform(col, lambda c: _numbers(c, depth - 1))


def read_features(spark: SparkSession, path: str | Sequence[str], properties: str, shape: str, others: str = "fail") -> DataFrame:
    """Line-delimited GeoJSON: the properties (DDL) and one ``geometry`` column per single part.

    ``shape`` is "Point", "LineString" or "Polygon"; multi-part features come out as one row
    per part.  Features without a shape are dropped; those of another shape fail the job, or are
    dropped if ``others`` is "drop".
    """
    fields = T.StructType.fromDDL(properties)
    line = T.StructType([
        T.StructField("properties", fields),
        T.StructField("geometry", T.StructType([T.StructField("type", T.StringType()), T.StructField("coordinates", T.StringType())])),
    ])
    rows = spark.read.schema(line).json(path).select("properties.*", F.col("geometry.type").alias("_t"), F.col("geometry.coordinates").alias("_c"))
    depth = _DEPTH[shape]
    nested = lambda d: "array<" * (d + 1) + "double" + ">" * (d + 1)
    one = F.when(F.col("_t") == shape, F.array(_points(F.from_json("_c", nested(depth)), depth)))
    many = F.when(F.col("_t") == f"Multi{shape}", _points(F.from_json("_c", nested(depth + 1)), depth + 1))
    if others == "fail":
        told = F.concat(F.lit(f"a feature that is no {shape}: "), F.col("_t"))
        many = F.coalesce(many, F.when(F.col("_t").isNotNull() & (F.col("_t") != shape), F.raise_error(told)))
    return rows.select(*fields.names, F.explode(F.coalesce(one, many)).alias("geometry"))


def read_shapes(spark: SparkSession, path: str | Sequence[str], properties: str, others: str = "fail") -> DataFrame:
    """Line-delimited GeoJSON of any mix of types in one pass: the properties (DDL) and one ``geometry`` (a SHAPE) per feature.

    Multi-part features stay one row.  Features without a shape are dropped; those of a type that has no coordinates of its own
    (collections) fail the job, or are dropped if ``others`` is "drop".
    """
    fields = T.StructType.fromDDL(properties)
    line = T.StructType([
        T.StructField("properties", fields),
        T.StructField("geometry", T.StructType([T.StructField("type", T.StringType()), T.StructField("coordinates", T.StringType())])),
    ])
    rows = spark.read.schema(line).json(path).select("properties.*", F.col("geometry.type").alias("_t"), F.col("geometry.coordinates").alias("_c"))
    nested = lambda d: "array<" * (d + 1) + "double" + ">" * (d + 1)

    def parts(kind: str) -> Column:
        depth = _DEPTH[kind]
        shape = _points(F.from_json("_c", nested(depth)), depth)
        if kind.startswith("Multi"):  # each member a part
            return shape if kind == "MultiPolygon" else F.transform(shape, lambda m: F.array(m) if kind == "MultiLineString" else F.array(F.array(m)))
        return F.array(shape if kind == "Polygon" else F.array(shape) if kind == "LineString" else F.array(F.array(shape)))

    whole = None
    for kind in _DEPTH:
        is_kind = F.col("_t") == kind
        whole = F.when(is_kind, parts(kind)) if whole is None else whole.when(is_kind, parts(kind))
    rows = rows.filter(F.col("_t").isNotNull() & F.col("_c").isNotNull()) if others == "drop" else rows.filter(F.col("_t").isNotNull())
    if others == "fail":
        whole = whole.otherwise(F.raise_error(F.concat(F.lit("a feature without coordinates of its own: "), F.col("_t"))))
    shaped = rows.select(*fields.names, F.struct(F.col("_t").alias("kind"), whole.alias("parts")).alias("geometry"))
    return shaped.filter(F.col("geometry.parts").isNotNull())


def write_shapes(df: DataFrame, path: str, geometry: str = "geometry") -> None:
    """Rows whose geometry is a SHAPE as line-delimited GeoJSON features of their own types."""
    props, parts, kind = F.struct(*[c for c in df.columns if c != geometry]), F.col(geometry)["parts"], F.col(geometry)["kind"]
    lines, spots = F.transform(parts, lambda p: p[0]), F.transform(parts, lambda p: p[0][0])
    told = F.to_json  # the coordinates of each type nest at a depth of their own
    text = (
        F.when(kind == "Point", told(_numbers(spots[0], 0))).when(kind == "MultiPoint", told(_numbers(spots, 1)))
        .when(kind == "LineString", told(_numbers(lines[0], 1))).when(kind == "MultiLineString", told(_numbers(lines, 2)))
        .when(kind == "Polygon", told(_numbers(parts[0], 2))).when(kind == "MultiPolygon", told(_numbers(parts, 3)))
    )
    feature = F.concat(
        F.lit('{"type":"Feature","properties":'), F.to_json(props), F.lit(',"geometry":{"type":"'), kind, F.lit('","coordinates":'), text, F.lit("}}")
    )
    df.select(feature.alias("value")).write.mode("overwrite").text(path)


def write_features(df: DataFrame, path: str, shape: str = "LineString", geometry: str = "geometry") -> None:
    """Rows as line-delimited GeoJSON features; ``shape`` names the type of the geometry column."""
    props = F.struct(*[c for c in df.columns if c != geometry])
    geom = F.struct(F.lit(shape).alias("type"), _numbers(F.col(geometry), _DEPTH[shape]).alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), props.alias("properties"), geom.alias("geometry"))
    df.select(F.to_json(feature).alias("value")).write.mode("overwrite").text(path)


def read_pois(spark: SparkSession, files: str | Sequence[str], schema: str | T.StructType) -> DataFrame:
    """Many (gzip) CSV files with a header; never inferred."""
    return spark.read.schema(schema).option("header", True).csv(files)


def dimension(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A small literal table, such as land-use codes."""
    return spark.createDataFrame(list(rows), schema)
