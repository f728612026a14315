"""Layer catalog: parquet at ``root/layer=<name>/city=<label>[/...]``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from sparkwalk.functions import geometry as G
from sparkwalk.functions.projections import reproject
from sparkwalk.schemas import LAYERS, schema as layer_schema


def city_label(name: str) -> str:
    """"City of Toronto" -> city_of_toronto; of "Austin, TX" only the part before the comma."""
    return name.split(",")[0].lower().replace(" ", "_")


def fit_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of the schema in its order; missing ones as typed nulls."""
    have = set(df.columns)
    return df.select(
        *[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]
    )


def load_layer(
    spark: SparkSession, root: str, layer: str, city: str | Sequence[str] | None = None, schema: T.StructType | None = None,
    crs: str | None = None,
) -> DataFrame:
    """A layer of one, several or all cities; ``city`` stays a column.

    The city is a partition, so only the folders asked for are read.  With ``crs`` the shapes (``geometry``, or else x and y) are moved
    to that system from the one each city was saved in; a city saved without one is an error then.
    """
    fields = schema or (layer_schema(layer) if layer in LAYERS else None)
    reader = spark.read
    if fields is not None:
        extra = [] if "city" in fields.names else [T.StructField("city", T.StringType())]
        reader = reader.schema(T.StructType([*fields.fields, *extra]))
    df = reader.parquet(f"{root}/layer={layer}")
    if city is not None:
        labels = [city_label(c) for c in ([city] if isinstance(city, str) else city)]
        df = df.filter(F.col("city").isin(labels))
    if crs is None:
        return df
    held = [r[0] for r in df.select("city").distinct().collect()]  # a partition column: one value a city
    systems: dict[str, list[str]] = {}
    for label in held:
        systems.setdefault(stored_crs(spark, root, layer, label), []).append(label)
    out = None
    for own, labels in systems.items():
        part = _moved(df.filter(F.col("city").isin(labels)), own, crs)
        out = part if out is None else out.unionByName(part)
    return df if out is None else out


def _located(df: DataFrame) -> str:
    """The column that carries the layer's coordinate reference system."""
    return "geometry" if "geometry" in df.columns else "x"


def stored_crs(spark: SparkSession, root: str, layer: str, city: str) -> str:
    """The coordinate reference system a layer of a city was saved in, from the footer of one of its files."""
    df = spark.read.parquet(f"{root}/layer={layer}/city={city_label(city)}")
    crs = df.schema[_located(df)].metadata.get("crs")
    if crs is None:
        raise ValueError(f"layer {layer} of {city} was saved without a coordinate reference system")
    return crs


def _moved(df: DataFrame, source: str, target: str) -> DataFrame:
    if "geometry" in df.columns:
        return df.withColumn("geometry", reproject(F.col("geometry"), df.schema["geometry"].dataType, source, target))
    spot = reproject(F.col("_p"), T.StructType.fromDDL("x double, y double"), source, target)
    return df.withColumn("_p", G.point(F.col("x"), F.col("y"))).withColumn("_p", spot).withColumns({"x": F.col("_p.x"), "y": F.col("_p.y")}).drop("_p")


def save_layer(df: DataFrame, root: str, layer: str, city: str | None = None, by: Sequence[str] = (), crs: str | None = None) -> None:
    """Overwrite a layer, but only in the partitions ``df`` holds.

    ``by`` adds partition columns below the city, such as (n, seed, max_dist) of a sample,
    the variant of edges and paths, or (kind, step) of snapshots.  ``crs`` names the system of the coordinates and is stored
    with the column, so that ``load_layer`` can move them to another one.
    """
    if city is not None:
        df = df.withColumn("city", F.lit(city_label(city)))
    known = layer_schema(layer) if layer in LAYERS else None
    if known is not None:
        df = fit_schema(df, T.StructType([*known.fields, *[f for f in df.schema if f.name not in known.names]]))
    if crs is not None:
        df = df.withMetadata(_located(df), {"crs": crs})
    keys = ["city", *by]
    df.write.partitionBy(*keys).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{root}/layer={layer}")
