"""Contraction of sidewalk chains that no trip starts, ends or branches on."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sparkwalk.operators.components import connected_components
from sparkwalk.session import cut


def degrees(edges: DataFrame) -> DataFrame:
    """(vid, degree); a loop counts twice."""
    return edges.select(F.explode(F.array("src_vid", "trg_vid")).alias("vid")).groupBy("vid").agg(
        F.count(F.lit(1)).alias("degree")
    )


def _both_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return edges.join(nodes.select(F.col("vid").alias("src_vid")), "src_vid", "left_semi").join(
        nodes.select(F.col("vid").alias("trg_vid")), "trg_vid", "left_semi"
    )


def induced_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """All edges with both ends among the nodes."""
    return _both_ends(edges, nodes)


def contract_chains(edges: DataFrame, demanded: DataFrame, geometry: str | None = None) -> DataFrame:
    """Each chain of plain sidewalks becomes one edge.

    A sidewalk takes part if it exists and neither of its ends is a junction (degree above 2)
    or in ``demanded`` (vid).  The nodes of these sidewalks are clustered over *all* edges
    between them.  A cluster is contracted if exactly two of its nodes touch a single one of
    the chosen sidewalks; these two become the ends of the new edge.

    Output: (eids, orig_id, kind, is_xwalk, exists, src_vid, trg_vid, len[, geometry]) where
    ``eids`` lists the ids a new edge replaces; geometry is then a list of lines.
    """
    degree = degrees(edges).filter("degree <= 2")
    free = degree.join(demanded.select("vid").distinct(), "vid", "left_anti")
    chain = cut(_both_ends(edges.filter("`exists` and not is_xwalk"), free))
    nodes = chain.select(F.explode(F.array("src_vid", "trg_vid")).alias("vid")).distinct()
    label = connected_components(induced_edges(edges, nodes))
    chain = cut(chain.join(label.select(F.col("vid").alias("src_vid"), "cid"), "src_vid"))
    touched = (
        chain.select("cid", F.explode(F.array("src_vid", "trg_vid")).alias("vid"))
        .groupBy("cid", "vid")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter("n = 1")
    )
    ends = touched.groupBy("cid").agg(
        F.count(F.lit(1)).alias("n"), F.min("vid").alias("src_vid"), F.max("vid").alias("trg_vid")
    )
    ends = ends.filter("n = 2").drop("n")
    members = [F.array_sort(F.collect_list("id")).alias("eids"), F.sum("len").alias("len")]
    if geometry is not None:
        parts = F.array_sort(F.collect_list(F.struct("id", F.col(geometry).alias("line"))))
        members.append(F.transform(parts, lambda p: p["line"]).alias(geometry))
    # only clusters that are contracted are collected, and each becomes one row of the result
    merged = ends.join(chain.join(ends.select("cid"), "cid", "left_semi").groupBy("cid").agg(*members), "cid")
    shape = [] if geometry is None else [geometry]
    orig = F.col("orig_id") if "orig_id" in edges.columns else F.col("id")
    kind = F.col("kind") if "kind" in edges.columns else F.lit(None).cast("string")
    gone = chain.join(ends.select("cid"), "cid", "left_semi").select("id")
    kept = edges.join(gone, "id", "left_anti").select(
        F.array("id").alias("eids"), orig.cast("int").alias("orig_id"), kind.alias("kind"), "is_xwalk", "exists",
        "src_vid", "trg_vid", "len", *[F.array(g).alias(g) for g in shape],
    )
    fresh = merged.select(
        "eids", F.lit(-1).alias("orig_id"), F.lit(None).cast("string").alias("kind"),
        F.lit(False).alias("is_xwalk"), F.lit(True).alias("exists"), "src_vid", "trg_vid", "len", *shape,
    )
    return kept.unionByName(fresh)
