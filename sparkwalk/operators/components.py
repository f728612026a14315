"""Connected components by contraction, all variants in one job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from sparkwalk.operators.skew import skew_join
from sparkwalk.session import counted_cut, discard, known_rows


def symmetric(edges: DataFrame, keys: Sequence[str] = (), extra: Sequence[str] = ()) -> DataFrame:
    """Both directions of each edge as (keys, u, w, extra); a loop comes out once."""
    ends = F.when(
        F.col("src_vid") == F.col("trg_vid"), F.array(F.struct(F.col("src_vid").alias("u"), F.col("trg_vid").alias("w")))
    ).otherwise(
        F.array(
            F.struct(F.col("src_vid").alias("u"), F.col("trg_vid").alias("w")),
            F.struct(F.col("trg_vid").alias("u"), F.col("src_vid").alias("w")),
        )
    )
    return edges.select(*keys, *extra, F.inline(ends))


def _choice(vid: str) -> Column:
    """A node under this round's pseudo-random order (the id breaks equal hashes).

    The round number is a column, not a literal, so every round runs the same compiled code.
    """
    return F.struct(F.xxhash64("turn", vid).alias("h"), F.col(vid).alias("v"))


def connected_components(edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, vid, cid) for every node with an edge; ``cid`` is the least vid of the component.

    Randomised contraction (Boegeholz, Brand & Todor, "In-database connected component
    analysis", 2020): every round each node follows its least neighbour in a fresh
    pseudo-random order, the links between the clusters so formed become the next,
    geometrically smaller graph, and the labels are carried back down at the end.  The
    number of rounds grows with the logarithm of the node count, not with the diameter.
    """
    keys = list(keys)
    arcs, seen = counted_cut(
        symmetric(edges, keys).distinct().withColumn("turn", F.lit(0))  # a loop keeps its node; copies of a link count once
    )
    arcs_left = seen["n"]
    levels: list[tuple[DataFrame, DataFrame, int]] = []
    low = None  # least original vid of each node of the current level, none at the start
    while arcs_left:
        chosen, seen = counted_cut(
            arcs.groupBy(*keys, "turn", "u")
            .agg(F.min(F.least(_choice("u"), _choice("w"))).alias("c"), F.count(F.lit(1)).alias("n"))
            .select(*keys, "u", F.col("c.v").alias("rep"), "n"),
            most=F.max("n"),
        )
        most = seen["most"]  # arcs at the busiest node; as they lead both ways, as many arrive as leave
        step = chosen.drop("n")
        for _ in range(2):  # follow the choices of the choices: fewer, larger clusters
            hop = step.select(*keys, F.col("u").alias("rep"), F.col("rep").alias("_far"))
            step = step.join(hop, [*keys, "rep"]).select(*keys, "u", F.col("_far").alias("rep"))
        if low is None:
            step = step.withColumn("low", F.col("u"))
        else:
            step = step.join(low.withColumnRenamed("rep", "u"), [*keys, "u"])
        step, seen = counted_cut(step)
        nodes_left = seen["n"]
        low = step.groupBy(*keys, "rep").agg(F.min("low").alias("low"))
        levels.append((step, low, nodes_left))
        before = arcs
        to = step.select(*keys, "u", "rep")
        arcs, seen = counted_cut(
            skew_join(
                skew_join(arcs, to, [*keys, "u"], rows=most).select(*keys, "turn", F.col("rep").alias("u"), "w"),
                to.withColumnsRenamed({"u": "w", "rep": "_w"}),
                [*keys, "w"],
                rows=most,
            )
            .select(*keys, (F.col("turn") + 1).alias("turn"), "u", F.col("_w").alias("w"))
            .filter(F.col("u") != F.col("w"))
            .distinct()
        )
        arcs_left = seen["n"]
        discard(before)
        discard(chosen)
    labels = None
    for step, low, n in reversed(levels):
        top = low if labels is None else low.join(
            labels.withColumnsRenamed({"vid": "rep", "cid": "_cid"}), [*keys, "rep"], "left"
        ).select(*keys, "rep", F.coalesce("_cid", "low").alias("low"))
        labels = skew_join(step.select(*keys, F.col("u").alias("vid"), "rep"), top, [*keys, "rep"], rows=n).select(
            *keys, "vid", F.col("low").alias("cid")
        )
    if labels is None:
        empty = edges.limit(0)
        return empty.select(*keys, F.col("src_vid").alias("vid"), F.col("src_vid").alias("cid"))
    return labels


def edge_components(edges: DataFrame, nodes: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The component label on each edge (both ends share it, so the source end is enough)."""
    label = nodes.select(*keys, F.col("vid").alias("src_vid"), "cid")
    return skew_join(edges, label, [*keys, "src_vid"]).select(*edges.columns, "cid")


def pair_components(pairs: DataFrame, nodes: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Pairs (vid_o, vid_d) with the labels of both ends; pairs with an unused node drop.

    ``pairs`` need not carry the keys: without them each pair meets every key its nodes have.
    """
    keys = list(keys)
    origin = nodes.select(*keys, F.col("vid").alias("vid_o"), F.col("cid").alias("cid_o"))
    dest = nodes.select(*keys, F.col("vid").alias("vid_d"), F.col("cid").alias("cid_d"))
    on_o = ["vid_o"] + [k for k in keys if k in pairs.columns]
    rows = known_rows(pairs)
    with_origin = skew_join(pairs, origin, on_o)
    if rows is not None and "vid_o" in on_o and len(on_o) == 1 and keys:
        rows = None  # each pair may now stand under several keys
    return skew_join(with_origin, dest, [*keys, "vid_d"], rows=rows)


def connected_trips(pairs: DataFrame, nodes: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Trips whose two ends lie in one component, for every key that has nodes (0 if there are none)."""
    joined = pair_components(pairs, nodes, keys)
    trips = joined.filter("cid_o = cid_d").groupBy(*keys).agg(F.sum("n_ods").alias("n_trips"))
    zero = F.coalesce("n_trips", F.lit(0).cast("bigint")).alias("n_trips")
    if not keys:
        return trips.select(zero)
    return nodes.select(*keys).distinct().join(trips, list(keys), "left").select(*keys, zero)
