"""Filters, labels, unpivots and key operations of the layer tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

# The network variants, as predicates over the edge flags.
VARIANTS: dict[str, str | None] = {
    "current": "`exists`",
    "sidewalks": "`exists` OR NOT is_xwalk",
    "crosswalks": "`exists` OR is_xwalk",
    "both": None,
}


def variant_edges(edges: DataFrame, variants: Mapping[str, str | None] = VARIANTS) -> DataFrame:
    """Every edge once per variant whose predicate it meets, in one pass over the edges."""
    tags = [
        F.lit(name) if pred is None else F.when(F.coalesce(F.expr(pred), F.lit(False)), F.lit(name))
        for name, pred in variants.items()
    ]
    return edges.select(F.explode(F.array_compact(F.array(*tags))).alias("variant"), *edges.columns)


def label_edges(edges: DataFrame, name: str = "category") -> DataFrame:
    """Existing/proposed x crosswalk/sidewalk."""
    state = F.when(F.col("exists"), "Existing").otherwise("Proposed")
    kind = F.when(F.col("is_xwalk"), "crosswalk").otherwise("sidewalk")
    return edges.withColumn(name, F.concat_ws(" ", state, kind))


def used_nodes(edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The distinct end points of the edges."""
    return edges.select(*keys, F.explode(F.array("src_vid", "trg_vid")).alias("vid")).distinct()


def lower_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


def flag_equal(col: Column | str, value: object) -> Column:
    """Equality as a two-valued flag: null is False."""
    return (F.col(col) if isinstance(col, str) else col).eqNullSafe(F.lit(value))


def flag_in(col: Column | str, values: Sequence[object]) -> Column:
    """Membership as a two-valued flag: null is False."""
    return F.coalesce((F.col(col) if isinstance(col, str) else col).isin(*values), F.lit(False))


def with_missing(df: DataFrame, defaults: Mapping[str, Column]) -> DataFrame:
    """Add the columns of ``defaults`` that ``df`` lacks."""
    return df.withColumns({k: v for k, v in defaults.items() if k not in df.columns})


def bbox_filter(df: DataFrame, box: tuple[float, float, float, float], x: str, y: str) -> DataFrame:
    """Rows inside (minx, miny, maxx, maxy); plain comparisons, so they reach the scan."""
    minx, miny, maxx, maxy = box
    return df.filter(F.col(x).between(minx, maxx) & F.col(y).between(miny, maxy))


def tags_long(df: DataFrame, tags: Sequence[str], ids: Sequence[str]) -> DataFrame:
    """Tag columns to rows: one row per non-null tag, its name kept as ``category``."""
    long = df.unpivot(list(ids), list(tags), "category", "subcategory")
    return long.dropna(subset=["subcategory"])


def explode_parts(df: DataFrame, col: str) -> DataFrame:
    """One row per part of a multi-part shape; rows without a shape are dropped."""
    others = [c for c in df.columns if c != col]
    return df.select(*others, F.explode(col).alias(col))


def either_order(a: Column, b: Column) -> tuple[Column, Column]:
    """The two ends of an undirected pair in a fixed order."""
    return F.least(a, b), F.greatest(a, b)


def anti_join_either_order(df: DataFrame, known: DataFrame, src: str, trg: str) -> DataFrame:
    """Rows whose (src, trg) is not in ``known`` in either orientation.

    The ends are joined together with a hash of both: a hash table over two short numbers alone takes them as one long
    number, and ends that lie close to each other then pile up in few places of it.
    """
    a, b = either_order(F.col(src), F.col(trg))
    ends = {"_a": a, "_b": b, "_h": F.xxhash64(a, b)}
    seen = known.select(*[c.alias(n) for n, c in ends.items()]).distinct()
    return df.withColumns(ends).join(seen, list(ends), "left_anti").drop(*ends)


def attach_ends(pairs: DataFrame, attrs: DataFrame, pairs_on: tuple[str, str], key: str, cols: Sequence[str]) -> DataFrame:
    """Attributes of both ends of a pair, suffixed _o and _d; unmatched pairs drop."""
    out = pairs
    for on, suffix in zip(pairs_on, ("_o", "_d")):
        side = attrs.select(F.col(key).alias(on), *[F.col(c).alias(c + suffix) for c in cols])
        out = out.join(side, on)
    return out


def od_counts(od: DataFrame, od_id: str | None = None) -> DataFrame:
    """Distinct (orig_odpt, dest_odpt) with its number of trips and, if asked, its first id."""
    aggs = [F.count(F.lit(1)).alias("n_ods")]
    if od_id is not None:
        aggs.append(F.min(od_id).alias(od_id))
    return od.groupBy("orig_odpt", "dest_odpt").agg(*aggs)
