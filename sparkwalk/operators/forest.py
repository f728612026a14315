"""Least spanning forests, and the weakest link that any two vertices need, in rounds that grow with log(vertices)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, functions as F

from sparkwalk.operators.skew import skew_join
from sparkwalk.session import counted_cut, discard


def _rounds(edges: DataFrame, weight: str, link: str | None, keys: list[str]) -> Iterator[DataFrame]:
    """A stored table (keys, u, rep, weight, link) per round: each vertex with the cluster it joins and the link it chose.

    Boruvka: every vertex of the contracted graph picks its least link in one order of all links (weight, then a hash of
    the ends), so the picks form trees whose two lowest vertices picked each other.  Doubling carries all of a tree to the
    lesser of these two; the links between clusters, the least of each pair, are the next round's graph.  Vertices
    without a link to another one are in no table: their component is complete.
    """
    named = F.col(link) if link else F.lit(None).cast("int")
    least = F.min(F.struct(F.col("weight"), F.col("link"))).alias("_least")
    ends = [F.least("u", "w").alias("u"), F.greatest("u", "w").alias("w")]
    links, seen = counted_cut(
        edges.select(*keys, F.col("src_vid").alias("u"), F.col("trg_vid").alias("w"), F.col(weight).alias("weight"), named.alias("link"))
        .filter("u <> w").groupBy(*keys, *ends).agg(least).select(*keys, "u", "w", "_least.*")
    )
    while n := seen["n"]:
        order = F.struct("weight", F.xxhash64("u", "w").alias("h"), "u", "w", "link").alias("c")
        picks = links.select(*keys, order, F.explode(F.array("u", "w")).alias("at")).groupBy(*keys, "at").agg(F.min("c").alias("c"))
        other = F.when(F.col("c.u") == F.col("at"), F.col("c.w")).otherwise(F.col("c.u"))
        first, seen = counted_cut(picks.select(*keys, F.col("at").alias("u"), other.alias("rep"), "c.weight", "c.link"))
        vertices, columns = seen["n"], [*keys, "u", "weight", "link"]
        back = first.select(*keys, F.col("u").alias("rep"), F.col("rep").alias("_far"))
        lowest = (F.col("_far") == F.col("u")) & (F.col("u") < F.col("rep"))
        up, seen = counted_cut(
            skew_join(first, back, [*keys, "rep"], rows=vertices).select(*columns, F.when(lowest, F.col("u")).otherwise(F.col("rep")).alias("rep"))
        )
        discard(first)
        moved = 1
        while moved:
            hop = up.select(*keys, F.col("u").alias("rep"), F.col("rep").alias("_far"))
            twice = skew_join(up, hop, [*keys, "rep"], rows=vertices).select(*columns, F.col("_far").alias("rep"))
            again = hop.withColumnRenamed("_far", "_end")
            far, seen = counted_cut(
                skew_join(twice, again, [*keys, "rep"], rows=vertices).select(*columns, F.col("_end").alias("rep"), F.col("rep").alias("_was")),
                moved=F.sum((F.col("rep") != F.col("_was")).cast("int")),
            )
            moved = seen["moved"]
            discard(up)
            up, stored_at = far.drop("_was"), far._stored_at
            up._stored_at, up._rows = stored_at, vertices
        yield up
        to = up.select(*keys, "u", F.col("rep").alias("_u"))
        moved_links = skew_join(skew_join(links, to, [*keys, "u"], rows=n), to.withColumnsRenamed({"u": "w", "_u": "_w"}), [*keys, "w"], rows=n)
        before = links
        links, seen = counted_cut(
            moved_links.filter("_u <> _w").select(*keys, F.col("_u").alias("u"), F.col("_w").alias("w"), "weight", "link")
            .groupBy(*keys, *ends).agg(least).select(*keys, "u", "w", "_least.*")
        )
        discard(before)


def spanning_forest(edges: DataFrame, weight: str, link: str = "id", keys: Sequence[str] = ()) -> DataFrame:
    """(keys, link): the links of a spanning forest of least total ``weight``.

    ``edges`` (keys, link, src_vid, trg_vid, weight) without nulls; loops are never part of it, of equal links the least id may be.
    """
    keys, chosen = list(keys), None
    for up in _rounds(edges, weight, link, keys):
        own = up.select(*keys, F.col("link").alias(link)).distinct()  # the two lowest vertices picked the same link
        chosen = own if chosen is None else chosen.unionByName(own)
    return edges.select(*keys, link).limit(0) if chosen is None else chosen


def bottlenecks(pairs: DataFrame, edges: DataFrame, weight: str, keys: Sequence[str] = ()) -> DataFrame:
    """``pairs`` (keys, vid_o, vid_d, ...) with ``weight``: the least that connects them, their links no heavier than it.

    That is the largest weight on the path of a least spanning forest between the two.  The path is never built: the
    largest pick of all clusters that hold one end but not the other, over all rounds, is the same (every path has to leave
    these clusters, and none leaves by less than its pick).  So each pair climbs two tables a round, and is done when both
    its ends are in one cluster.  Pairs that nothing connects drop; ends that are one vertex have no weight and drop too.
    """
    keys = list(keys)
    columns = pairs.columns
    waiting, seen = counted_cut(
        pairs.filter("vid_o <> vid_d").withColumns({"_a": F.col("vid_o"), "_b": F.col("vid_d"), "_most": F.lit(None)})
        .withColumn("_most", F.col("_most").cast(edges.schema[weight].dataType))
    )
    done, last, n = None, None, seen["n"]
    for up in _rounds(edges, weight, None, keys) if n else ():
        at = lambda end: up.select(*keys, F.col("u").alias(f"_{end}"), F.col("rep").alias(f"_{end}2"), F.col("weight").alias(f"_{end}w"))  # noqa: B023, E731
        climbed = skew_join(skew_join(waiting, at("a"), [*keys, "_a"], rows=n), at("b"), [*keys, "_b"], rows=n)
        stored, seen = counted_cut(
            climbed.select(
                *columns, F.col("_a2").alias("_a"), F.col("_b2").alias("_b"), F.greatest("_most", "_aw", "_bw").alias("_most")
            ),
            left=F.sum((F.col("_a") != F.col("_b")).cast("int")),
        )
        if last is not None:
            discard(last)  # the links of this round are built, nothing reads the clusters of the one before
        last = up
        met = stored.filter("_a = _b").select(*columns, F.col("_most").alias(weight))
        done = met if done is None else done.unionByName(met)
        waiting, n = stored.filter("_a <> _b"), seen["left"]
        if not n:
            break
    return waiting.limit(0).select(*columns, F.col("_most").alias(weight)) if done is None else done
