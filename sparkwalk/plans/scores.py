"""Network variants, their routes and the usage-based score of every link."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from sparkwalk.functions.scalar import pedscore
from sparkwalk.operators.components import connected_components, edge_components
from sparkwalk.operators.relational import VARIANTS, attach_ends, od_counts, variant_edges
from sparkwalk.operators.routing import Routes, edge_betweenness, routable_pairs
from sparkwalk.session import cut


def od_table(od: DataFrame, odpt2node: DataFrame) -> DataFrame:
    """Trips per distinct pair, with the nodes of both ends and the access distance of both.

    ``od`` (od_id, orig_odpt, dest_odpt) holds one row per trip; ``odpt2node`` maps a point to
    its node (odpt_id, vid, dist).
    """
    pairs = attach_ends(od_counts(od, "od_id"), odpt2node, ("orig_odpt", "dest_odpt"), "odpt_id", ["vid", "dist"])
    return pairs.withColumn("dist", F.col("dist_o") + F.col("dist_d")).drop("dist_o", "dist_d")


def network_variants(edges: DataFrame, variants: Mapping[str, str | None] = VARIANTS) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of all variants, both with their component label ``cid``."""
    tagged = cut(variant_edges(edges, variants))
    nodes = cut(connected_components(tagged, ["variant"]))
    return nodes, edge_components(tagged, nodes, ["variant"])


def variant_routes(od: DataFrame, nodes: DataFrame, edges: DataFrame) -> Routes:
    """Routes of all variants; pairs that a variant does not connect are left out before routing."""
    return Routes(cut(routable_pairs(od, nodes, ["variant"])), edges, ["variant"])


def link_scores(edges: DataFrame, routes: Routes) -> DataFrame:
    """Edges with ``n_trips``, ``bwness`` and ``pedscore`` per variant."""
    used = edges.join(routes.edge_trips(), ["variant", "id"], "left").fillna({"n_trips": 0})
    central = edge_betweenness(edges, ["variant"]).select("variant", "id", "bwness")
    return used.join(central, ["variant", "id"]).withColumn("pedscore", pedscore(F.col("n_trips"), F.col("bwness")))
