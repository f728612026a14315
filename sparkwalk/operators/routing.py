"""Shortest paths, link usage and betweenness as rounds of joins and aggregates.

Lengths are positive integers (millimetres), so ties are exact and sums do not depend on
their order.  All keys (network variants) run in the same rounds.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from sparkwalk.operators import bands
from sparkwalk.operators.components import connected_components, edge_components, pair_components, symmetric
from sparkwalk.operators.skew import HOT_ROWS, hot_keys, skew_join
from sparkwalk.session import bucketed, counted_cut, cut, discard, known_rows, remove, stored

#: Pairs of arcs that one doubling of ``shortcuts`` may join, and arcs from which on a search keeps them in buckets.
SHORTCUT_PAIRS, BUCKET_ARCS = 20_000_000, 1_000_000
#: Rows (origin, arc) that one batch of betweenness may hold.
BATCH_ROWS = 2_000_000_000
#: Moves along links in one job of a sweep.
MOVES = 6
#: Links from which on dead ends are folded, rounds of it in one job, and the part of the nodes (one in so many) that a job must take off for another.
FOLD_LINKS, FOLDS, FOLD_WORTH = 10_000, 4, 16
#: Nodes of a component that may be worked out in one task, and steps (nodes squared, times nodes and arcs) that one may take.
SMALL, SMALL_STEPS = 100, 4_000_000

def arc_table(edges: DataFrame, keys: Sequence[str] = (), carry: Sequence[str] = ()) -> DataFrame:
    """Directed arcs (keys, u, w, len, id, carry) of undirected links; loops lead nowhere and are left out.

    Lengths are positive whole numbers (such as millimetres): ties must be exact, and along links of no length two
    nodes could be each other's predecessor.  A length that is not fails the job where it is read.
    """
    kind = dict(edges.dtypes)["len"]
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"lengths must be whole numbers, not {kind}")
    sound = F.when(F.col("len") > 0, F.col("len")).otherwise(F.raise_error(F.lit("a link without a positive length")))
    return symmetric(edges.withColumn("len", sound.cast(kind)), keys, ["id", "len", *carry]).filter("u <> w")


def shortcuts(arcs: DataFrame, keys: Sequence[str] = (), carry: Sequence[str] = (), doublings: int = 2) -> tuple[DataFrame, int]:
    """Arcs joined end to end (2, 4, ... links per arc), the shortest per pair of ends kept.

    They only save rounds: every distance is also reached link by link, so leaving out the
    ones that would pass through a busy node loses nothing, and no node ever emits more
    than a fixed number of pairs.  ``carry`` columns tell arcs of one pair apart; of two
    joined arcs the least value counts (the arc is gone as soon as one of its parts is).
    Where a doubling would join more than ``SHORTCUT_PAIRS`` pairs of arcs, it costs more than the rounds it saves: it and those
    after it are left out, and their number is returned beside the arcs.
    """
    keys, carry = list(keys), list(carry)
    best, seen = counted_cut(arcs.groupBy(*keys, "u", "w", *carry).agg(F.min("len").alias("len")))
    by = [*keys, "u"]
    for k in range(doublings):
        many = seen["n"] > BUCKET_ARCS
        if many:
            plain, (best, _) = best, bucketed(best, by)
            discard(plain)
        quiet = best.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= 8 << k)
        quiet, seen = counted_cut(quiet, pairs=F.sum(F.col("n") * F.col("n")))
        if (seen["pairs"] or 0) > SHORTCUT_PAIRS:
            discard(quiet)
            return best, doublings - k
        # arcs lead both ways: those that leave a quiet node, turned, are those that arrive there
        near = best.join(quiet.select(*by), by, "left_semi").groupBy(*by).agg(F.collect_list(F.struct("w", "len", *carry)).alias("_out"))
        pairs = near.select(*keys, "_out", F.explode("_out").alias("_a")).select(*keys, "_a", F.explode("_out").alias("_b"))
        joined = pairs.filter("_a.w <> _b.w").select(
            *keys, F.col("_a.w").alias("u"), F.col("_b.w").alias("w"), *[F.least(f"_a.{c}", f"_b.{c}").alias(c) for c in carry],
            (F.col("_a.len") + F.col("_b.len")).alias("len"),
        )
        both = best.unionByName(joined)
        both = both.repartition(*by) if many else both  # in place of a shuffle by both ends
        before, (best, seen) = best, counted_cut(both.groupBy(*keys, "u", "w", *carry).agg(F.min("len").alias("len")))
        discard(before)
        discard(quiet)
    return best, 0


class _Arcs:
    """Arcs laid out for repeated joins: the arcs of a hub are spread over salts.

    Arcs that are followed ``often`` are stored in buckets by the node they leave, where there are many: a round
    then moves its front to the arcs and shuffles no arc.
    """

    in_a_band = 4  # arcs of mean length

    def __init__(self, arcs: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS, often: bool = False):
        self.keys = list(keys)
        rows, by = known_rows(arcs), [*keys, "u"]
        often = often and rows is not None and rows > BUCKET_ARCS
        metrics = {"longest": F.max("len"), "total": F.sum("len")}
        arcs, seen = bucketed(arcs, by, **metrics) if often else counted_cut(arcs, **metrics)
        self.longest, self.mean = seen["longest"] or 0, -(-(seen["total"] or 0) // max(seen["n"], 1))
        self.hubs = None
        if seen["n"] > hot_rows:
            hubs, count = hot_keys(arcs, [*keys, "u"], hot_rows)
            if count:
                self.hubs = hubs
        if self.hubs is not None:
            salts = F.coalesce(F.col("_salts"), F.lit(1))
            arcs = (
                arcs.join(self.hubs, [*keys, "u"], "left")
                .withColumn("_salt", F.pmod(F.xxhash64("w"), salts).cast("int"))
                .drop("_salts")
            )
            arcs = bucketed(arcs, [*by, "_salt"])[0] if often else cut(arcs)
        self.arcs = arcs

    @classmethod
    def with_shortcuts(cls, arcs: DataFrame, keys: Sequence[str], carry: Sequence[str] = (), doublings: int = 2) -> _Arcs:
        """The net of a search; where doublings were left out, a band has as many more arcs in a row."""
        rows, left = shortcuts(arcs, keys, carry, doublings)
        net = cls(rows, keys, often=True)
        net.in_a_band <<= left
        return net

    def follow(self, front: DataFrame) -> DataFrame:
        """``front`` (with column v) joined to the arcs that leave v; adds w, len and the carried columns."""
        front = front.withColumnRenamed("v", "u")
        on = [*self.keys, "u"]
        if self.hubs is not None:
            salts = F.coalesce(F.col("_salts"), F.lit(1))
            front = front.join(self.hubs, on, "left")
            front = front.withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
            on = [*on, "_salt"]
        return front.join(self.arcs, on).drop("_salt")


def distances(
    pairs: DataFrame,
    arcs: DataFrame,
    keys: Sequence[str] = (),
    scenario: Sequence[str] = (),
    usable: str | None = None,
    carry: Sequence[str] = (),
    doublings: int = 2,
    cutoff: int | None = None,
    width: int | None = None,
) -> bands.Search:
    """All distances needed for the pairs (keys, scenario, vid_o, vid_d[, upper]), settled band by band (``bands.search``).

    ``keys`` are equal on pairs and arcs; ``scenario`` columns belong to the pairs only and meet the arcs' ``carry``
    columns in the condition ``usable``.
    """
    return bands.search(pairs, _Arcs.with_shortcuts(arcs, keys, carry, doublings), keys, scenario, usable, cutoff, width)


def routable_pairs(od: DataFrame, nodes: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Trips summed per vertex pair, for pairs in one component of the (variant's) network."""
    shared = [k for k in keys if k in od.columns]
    pairs = cut(od.groupBy(*shared, "vid_o", "vid_d").agg(F.sum("n_ods").alias("n_ods")))
    return pair_components(pairs, nodes, keys).filter("cid_o = cid_d").select(*keys, "vid_o", "vid_d", "n_ods")


def pair_distances(
    pairs: DataFrame, edges: DataFrame, keys: Sequence[str] = (), cutoff: int | None = None
) -> DataFrame:
    """The pairs with ``d``, their shortest length; pairs without a route drop."""
    result = distances(pairs.select(*keys, "vid_o", "vid_d").distinct(), arc_table(edges, keys), keys, cutoff=cutoff)
    return _with_distance(pairs, bands.found(result), keys)


def _with_distance(pairs: DataFrame, state: DataFrame, who: Sequence[str]) -> DataFrame:
    d = state.select(*who, F.col("o").alias("vid_o"), F.col("v").alias("vid_d"), F.col("dist").alias("d"))
    return pairs.join(d, [*who, "vid_o", "vid_d"])


class Routes:
    """Shortest-path trees of the origins: one predecessor link per (origin, node).

    Of several links that lie on a shortest path to a node the least id is taken, so the
    trees are the same on every run.
    """

    def __init__(self, pairs: DataFrame, edges: DataFrame, keys: Sequence[str] = (), cutoff: int | None = None):
        arcs = arc_table(edges, keys)
        result = distances(pairs.select(*keys, "vid_o", "vid_d").distinct(), arcs, keys, cutoff=cutoff)
        state = cut(bands.within_reach(result))
        result.discard()
        self._set(pairs, keys, state, cut(_links_into(state, state, _Arcs(arcs, keys), [*keys, "o"])))

    def _set(self, pairs: DataFrame, keys: Sequence[str], state: DataFrame, tree: DataFrame) -> None:
        self.keys, self.who = list(keys), [*keys, "o"]
        self.pairs = pairs
        self.state = state  # (keys, o, v, dist)
        self.tree = tree  # (keys, o, v, edge_id, p): the link into v and the node it comes from
        self._ladder: list[DataFrame] | None = None

    @classmethod
    def of(cls, pairs: DataFrame, keys: Sequence[str], state: DataFrame, tree: DataFrame) -> Routes:
        out = cls.__new__(cls)
        out._set(pairs, keys, state, tree)
        return out

    def ladder(self) -> list[DataFrame]:
        """Ancestors 1, 2, 4, ... links up each tree, until no node is that deep."""
        if self._ladder is None:
            rung, n = self.tree.select(*self.who, "v", F.col("p").alias("a")).filter("a <> o"), 1
            rungs = []
            while n:
                rung, seen = counted_cut(rung)
                n = seen["n"]
                if n:
                    rungs.append(rung)
                    up = rung.select(*self.who, F.col("v").alias("a"), F.col("a").alias("b"))
                    rung = rung.join(up, [*self.who, "a"]).select(*self.who, "v", F.col("b").alias("a"))
            self._ladder = rungs
        return self._ladder

    def lengths(self) -> DataFrame:
        """(keys, vid_o, vid_d, n_ods..., d)"""
        return _with_distance(self.pairs, self.state, self.keys)

    def paths(self) -> DataFrame:
        """(keys, vid_o, vid_d, edge_id, hop) with hop 0 at the destination's end.

        The nodes of all paths are listed by doubling: from the destinations, every rung of
        the ladder (highest first) adds the nodes that many links further up, so the number
        of rounds is the logarithm of the longest path.
        """
        ends = self.pairs.select(*self.keys, F.col("vid_o").alias("o"), F.col("vid_d")).filter("o <> vid_d").distinct()
        nodes = ends.withColumns({"v": F.col("vid_d"), "hop": F.lit(0)})
        rungs = self.ladder()
        for k in range(len(rungs) - 1, -1, -1):
            higher = nodes.join(rungs[k], [*self.who, "v"]).select(
                *self.who, "vid_d", F.col("a").alias("v"), (F.col("hop") + (1 << k)).alias("hop")
            )
            nodes = nodes.unionByName(higher)
            nodes = cut(nodes)
        out = nodes.join(self.tree.select(*self.who, "v", "edge_id"), [*self.who, "v"])
        return out.select(*self.keys, F.col("o").alias("vid_o"), "vid_d", "edge_id", "hop")

    def edge_trips(self) -> DataFrame:
        """(keys, id, n_trips): trips over each used link, without listing any path.

        The trips that end at or below a node are summed by doubling up the trees.
        """
        flow = (
            self.pairs.filter("vid_o <> vid_d")
            .select(*self.keys, F.col("vid_o").alias("o"), F.col("vid_d").alias("v"), "n_ods")
            .groupBy(*self.who, "v")
            .agg(F.sum("n_ods").alias("n"))
        )
        for rung in self.ladder():
            lifted = flow.join(rung, [*self.who, "v"]).select(*self.who, F.col("a").alias("v"), "n")
            flow = cut(flow.unionByName(lifted).groupBy(*self.who, "v").agg(F.sum("n").alias("n")))
        used = flow.join(self.tree.select(*self.who, "v", "edge_id"), [*self.who, "v"])
        return used.groupBy(*self.keys, F.col("edge_id").alias("id")).agg(F.sum("n").alias("n_trips"))


def edge_trips(pairs: DataFrame, edges: DataFrame, keys: Sequence[str] = (), nodes: DataFrame | None = None) -> DataFrame:
    """The links with ``n_trips``; links no trip uses are kept with 0.

    With ``nodes``, the component labels (keys, vid, cid) of the edges, only links of components that hold a pair are laid out and searched.
    """
    some = edges
    if nodes is not None:
        held = skew_join(pairs.select(*keys, F.col("vid_o").alias("vid")).distinct(), nodes, [*keys, "vid"], rows=known_rows(pairs))
        held = held.select(*keys, "cid").distinct()
        some = cut(edge_components(edges, nodes, keys).join(held, [*keys, "cid"], "left_semi").select(*edges.columns))
    trips = Routes(pairs, some, keys).edge_trips()
    return edges.join(trips, [*keys, "id"], "left").fillna({"n_trips": 0})


def _sweep(order: Sequence[int], base, relation: dict[int, str], schema, who: Sequence[str], block: int = MOVES) -> dict[int, list[str]]:
    """Amounts handed on along the rows of ``relation``, band by band in the given order.

    ``base(k)`` has the amounts (who, v, s) that start in band k, ``relation`` a folder of rows (who, v, to, weight, here, there)
    for each band ``here`` of v.  Whatever reaches a node is handed on with the weight; amounts for a band not yet
    open wait in its folder.  A band is left when nothing moves inside it; several moves run per job, because on short hops the jobs
    cost more than the joins.  Gives the folders of all amounts that were handed on, by the band of their node.
    """
    flows: dict[int, list[str]] = {}
    who = list(who)
    for k in order:
        level = base(k)
        spark = level.sparkSession
        if k in flows:
            level = level.unionByName(bands.read(spark, schema, flows[k]).select(*who, "v", "s"))
        level = level.groupBy(*who, "v").agg(F.sum("s").alias("s"))
        while k in relation:
            rows, made = bands.read(spark, relation[k].schema, [relation[k].path]), None
            for i in range(block):
                moved = level.join(rows, [*who, "v"])
                moved = moved.groupBy(*who, F.col("to").alias("v"), "here", "there").agg(F.sum(F.col("s") * F.col("weight")).alias("s"))
                level = moved.filter("here = there").select(*who, "v", "s")
                tagged = moved.withColumn("move", F.lit(i))
                made = tagged if made is None else made.unionByName(tagged)
            inside = F.col("here") == F.col("there")
            path, seen = stored(
                made.withColumn("at", F.col("there")), ["at", "move"], last=F.count_if(inside & (F.col("move") == block - 1)),
                bands=F.bit_or(F.expr("shiftleft(1L, cast(abs(there - here) as int))")),
            )
            step = 1 if len(order) < 2 or order[0] < order[-1] else -1
            for b in bands.bits(seen["bands"]):
                flows.setdefault(k + step * b, []).append(f"{path}/at={k + step * b}")
            if not seen["last"]:
                break
            level = bands.read(spark, schema, [f"{path}/at={k}/move={block - 1}"]).select(*who, "v", "s")
    return flows


def edge_betweenness(
    edges: DataFrame, keys: Sequence[str] = (), sources: DataFrame | None = None, batches: int | None = None
) -> DataFrame:
    """The links with ``bwness``: shortest paths over each link, ties split evenly.

    Undirected, weighted by ``len``, not normalised, each unordered pair once.  ``sources``
    (keys, vid) limits the origins; the result is then the sum over those origins only
    (Brandes & Pich 2007 scale it up to an estimate), halved likewise.

    Where there are many links, dead ends are folded first (``_fold``): every path between what hangs on a link and the rest of its
    component takes that link, so its sum is a product of two counts, and only what is left, each node standing for all that
    was folded into it, goes on.  Of parallel links the shortest are searched as one that counts as often.

    Of that, components of at most ``SMALL`` nodes are worked out in one task each (``_small_sums``), as their search would be all rounds and no rows.

    The other origins are treated in ``batches`` (by default as many as keep the arcs that the origins of one can reach below
    ``BATCH_ROWS``, counted component by component where the arcs of the whole network would not fit); of each only the sums per link stay.  With exact distances, the arcs on shortest paths are those with
    dist(w) = dist(u) + len.  Path counts are handed on along them from the nearest band outwards, dependencies from the farthest
    band inwards, so every join reads the arcs of one band only and no plan grows with the number of hops.
    """
    keys = list(keys)
    spark = edges.sparkSession
    once = arc_table(edges, keys).filter("u < w")
    same = once.repartition(*keys, "u", "w").groupBy(*keys, "u", "w", "len").agg(F.count(F.lit(1)).alias("ways"))
    links, seen = counted_cut(same.groupBy(*keys, "u", "w").agg(F.min(F.struct("len", "ways")).alias("_l")).select(*keys, "u", "w", "_l.*").dropna(subset=keys))
    n_links = seen["n"]
    ends = F.array(F.struct(F.col("u").alias("v"), F.col("w").alias("near")), F.struct(F.col("w").alias("v"), F.col("u").alias("near")))
    many = n_links > FOLD_LINKS
    whole = many and dict(links.dtypes)["u"] in ("tinyint", "smallint", "int", "bigint")
    near = F.bit_xor("near") if whole else F.min("near")
    one = F.lit(1).cast("bigint")
    nodes = links.select(*keys, F.inline(ends)).groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("deg"), near.alias("near")).withColumn("n", one)
    if sources is None:
        nodes = nodes.withColumn("s", one)
    else:
        some = sources.select(*keys, F.col("vid").alias("v")).distinct().withColumn("s", one)
        nodes = nodes.join(some, [*keys, "v"], "left").fillna(0, ["s"])
    busiest = {"most": F.max("deg"), "origins": F.count_if(F.col("s") > 0)}
    nodes, seen = counted_cut(nodes, **busiest)
    most = seen["most"] or 0
    fold = _fold(nodes, keys) if whole else None
    if fold is not None:
        nodes, seen = counted_cut(fold.core, **busiest)
        inner = skew_join(links, nodes.select(*keys, F.col("v").alias("u")), [*keys, "u"], "left_semi", rows=most)
        inner, found = counted_cut(skew_join(inner, nodes.select(*keys, F.col("v").alias("w")), [*keys, "w"], "left_semi", rows=most))
        n_links = found["n"]
    else:
        inner = links
    totals, largest, far, pair_sums = None, seen["n"], nodes, []  # ``far``: the nodes that are searched
    if n_links and (many or (batches is None and seen["origins"] * 2 * n_links > BATCH_ROWS)):
        parts = connected_components(inner.withColumnsRenamed({"u": "src_vid", "w": "trg_vid"}), keys).withColumnRenamed("vid", "v")
        member = cut(nodes.join(parts, [*keys, "v"]))
        count = F.count_if(F.col("s") > 0).cast("double") * F.sum("deg")  # rows (origin, arc): each meets the arcs of its component
        size = F.count(F.lit(1))
        steps = size.cast("double") * size * (size + F.sum("deg"))  # of ``_small_sums``
        sums = member.groupBy(*keys, "cid").agg(F.sum("n").alias("all"), F.sum("s").alias("asked"), count.alias("rows"), size.alias("size"), steps.alias("steps"))
        small = (F.col("size") <= (SMALL if many else 0)) & (F.col("steps") <= SMALL_STEPS)
        sums, found = counted_cut(sums, rows=F.sum(F.when(~small, F.col("rows"))), largest=F.max("size"), steps=F.sum(F.when(small, F.col("steps"))))
        largest = found["largest"]
        totals = cut(skew_join(member, sums.drop("rows"), [*keys, "cid"], rows=largest))
        discard(member)
        if found["steps"]:
            far = totals.filter(~small)
            pair_sums.append(_small_sums(totals.filter(small), inner, keys, -(-int(found["steps"]) // SMALL_STEPS), most))
            inner, left = counted_cut(skew_join(inner, far.select(*keys, F.col("v").alias("u")), [*keys, "u"], "left_semi", rows=most))
            n_links = left["n"]
        if batches is None:
            batches = int(-(-(found["rows"] or 0) // BATCH_ROWS))
    batches = max(1, batches or 1)
    if fold is not None:
        pair_sums.append(fold.sums(None if totals is None else totals.select(*keys, "v", "all", "asked")))
    if n_links:
        arcs = cut(symmetric(inner.withColumnsRenamed({"u": "src_vid", "w": "trg_vid"}), keys, ["len", "ways"]))
        net, plain = _Arcs.with_shortcuts(arcs.drop("ways"), keys), _Arcs(arcs, keys)
        width = (MOVES - 1) * plain.mean or None  # so that one job usually ends a band
        stands = None if fold is None else far.select(*keys, "v", "n", "s")
        for batch in range(batches):
            own = far.filter("s > 0")
            own = own.filter(F.pmod(F.xxhash64("v"), F.lit(batches)) == batch) if batches > 1 else own
            pairs = own.select(*keys, F.col("v").alias("vid_o"), F.lit(None).cast(dict(own.dtypes)["v"]).alias("vid_d"))
            path, schema = _link_sums(bands.search(pairs, net, keys, width=width), plain, keys, stands, largest)
            pair_sums.append(bands.read(spark, schema, [path]))
    for_pair = [*keys, "u", "w"]
    told = links.select(*for_pair, "len", "ways", F.lit(0.0).alias("part"))
    for part in pair_sums:
        told = told.unionByName(part, allowMissingColumns=True)
    told = told.groupBy(*for_pair).agg(F.max("len").alias("_len"), (F.sum("part") / F.max("ways")).alias("part"))
    passed = once.join(told, for_pair).filter("len = _len").groupBy(*keys, "id").agg((F.sum("part") / 2).alias("bwness"))
    return edges.join(passed, [*keys, "id"], "left").fillna({"bwness": 0.0})


def _small_sums(nodes: DataFrame, links: DataFrame, keys: Sequence[str], tasks: int, most: int) -> DataFrame:
    """(keys, u, w, part) of the ``links`` within small components; ``nodes`` has (keys, cid, v, n, s) of these only.

    A component is a row: lengths and numbers of all shortest paths between its nodes in one array, cell o * size + d, node after node
    let in between (Floyd & Warshall).  A link of length l from i to j takes of the paths from o to d, where
    dist(o, i) + l + dist(j, d) = dist(o, d), as many as lead to i times as many as lead on from j.
    """
    by = [*keys, "cid"]
    of = skew_join(links, nodes.select(*by, F.col("v").alias("u")), [*keys, "u"], rows=most)
    node = nodes.select(*by, F.struct("v", F.col("n").cast("double").alias("n"), F.col("s").cast("double").alias("s")).alias("node"))
    rows = node.unionByName(of.select(*by, F.struct("u", "w", "len", "ways").alias("link")), allowMissingColumns=True)
    # by number: adaptive execution would put the few bytes, and with them the work, in a few tasks
    rows = rows.repartition(tasks, *by).groupBy(*by).agg(F.array_sort(F.collect_list("node")).alias("nodes"), F.collect_list("link").alias("links"))
    let = lambda value, body: F.transform(F.array(value), body)[0]  # noqa: E731  # names a value, so that it is worked out once
    cell = lambda d, p: F.struct(d.alias("d"), p.alias("p"))
    nodes_at = lambda i: F.col("nodes")[i]
    upto = lambda size: F.sequence(F.lit(0), size - 1)

    def placed(vids):  # the links with the places of their ends
        place = lambda v: (F.array_position(vids, v) - 1).cast("int")
        return F.transform("links", lambda e: F.struct(place(e.u).alias("i"), place(e.w).alias("j"), e.len.alias("len"), e.ways.cast("double").alias("ways"), e.u.alias("u"), e.w.alias("w")))

    def start(found, size):
        turned = lambda e, i, j: F.struct((i * size + j).alias("key"), cell(e.len.cast("bigint"), e.ways).alias("value"))
        there = F.map_from_entries(F.flatten(F.transform(found, lambda e: F.array(turned(e, e.i, e.j), turned(e, e.j, e.i)))))
        none, own = cell(F.lit(bands.FAR).cast("bigint"), F.lit(0.0)), cell(F.lit(0).cast("bigint"), F.lit(1.0))
        return let(there, lambda m: F.transform(upto(size * size), lambda c: F.when(c % (size + 1) == 0, own).otherwise(F.coalesce(F.try_element_at(m, c), none))))

    def let_in(cells, k, size):
        def better(x, c):
            a, b = cells[c - c % size + k], cells[k * size + c % size]
            far, ends = a.d + b.d > x.d, (c % size == k) | (c - c % size == k * size)
            return F.when(far | ends, x).when(a.d + b.d == x.d, cell(x.d, x.p + a.p * b.p)).otherwise(cell(a.d + b.d, a.p * b.p))

        return F.transform(cells, better)

    def share(cells, e, size):
        def passing(o, i, j):  # from o to every node, over the link from i to j
            def more(sum_, d):
                whole = cells[o * size + d]
                return sum_ + F.when(cells[o * size + i].d + e.len + cells[j * size + d].d == whole.d, cells[j * size + d].p / whole.p * nodes_at(d).n).otherwise(0.0)

            return cells[o * size + i].p * F.aggregate(upto(size), F.lit(0.0), more)

        def origin(sum_, o):
            i, j = cells[o * size + e.i].d, cells[o * size + e.j].d
            over = F.when(i + e.len == j, passing(o, e.i, e.j)).when(j + e.len == i, passing(o, e.j, e.i)).otherwise(0.0)
            return sum_ + F.when(nodes_at(o).s == 0, 0.0).otherwise(nodes_at(o).s * over)

        return F.aggregate(upto(size), F.lit(0.0), origin) * e.ways

    done = let(F.size("nodes"), lambda size: let(placed(F.transform("nodes", lambda x: x.v)), lambda found: let(
        F.aggregate(upto(size), start(found, size), lambda cells, k: let_in(cells, k, size)),
        lambda cells: F.transform(found, lambda e: F.struct(e.u.alias("u"), e.w.alias("w"), share(cells, e, size).alias("part"))),
    )))
    return cut(rows.select(*keys, F.inline(done)))


@dataclass
class _Fold:
    """A network whose dead ends were folded into the nodes they hang on."""

    keys: list[str]
    core: DataFrame  # (keys, v, deg, near, n, s): the nodes left that have links left, with the nodes and the origins each stands for
    tree: DataFrame  # (keys, v, up, n, s): the folded nodes, the node they hang on, what hangs on the link between, with v
    roots: DataFrame  # (keys, v, n, s): of components folded up whole, the last node
    rounds: int
    most: int  # nodes that one node stands for, at most

    def sums(self, totals: DataFrame | None) -> DataFrame:
        """(keys, u, w, part) of the folded links: origins on one side times nodes on the other, both ways.

        ``totals`` (keys, v, all, asked) are nodes and origins of the components of the core's nodes.  Each folded node finds the root or core node
        at its top by doubling.
        """
        keys = self.keys
        tree = cut(self.tree.withColumn("top", F.col("up")))
        for _ in range((self.rounds - 1).bit_length()):
            hop = tree.select(*keys, F.col("v").alias("top"), F.col("top").alias("_far"))
            before = tree
            tree = cut(skew_join(tree, hop, [*keys, "top"], "left", rows=self.most).withColumn("top", F.coalesce("_far", "top")).drop("_far"))
            discard(before)
        tops = self.roots.select(*keys, "v", F.col("n").alias("all"), F.col("s").alias("asked"))
        tops = tops if totals is None else tops.unionByName(totals)
        both = skew_join(tree, tops.withColumnRenamed("v", "top"), [*keys, "top"], rows=self.most)
        out = F.col("s").cast("double") * (F.col("all") - F.col("n")) + (F.col("asked") - F.col("s")).cast("double") * F.col("n")
        return both.select(*keys, F.least("v", "up").alias("u"), F.greatest("v", "up").alias("w"), out.alias("part"))


def _fold(nodes: DataFrame, keys: Sequence[str]) -> _Fold:
    """Takes off nodes with one neighbour, round by round, for as long as a job takes off a worthwhile share of them.

    ``nodes`` has (keys, v, deg, near, n, s): the neighbours of v by number and as the exclusive or of their ids, which for a
    leaf is its neighbour, so a round moves one message a leaf and no link.  Of two leaves that are left alone with each other the
    lesser stays.  Wherever it stops, what is left is a network of its own.
    """
    keys, tables, rounds, most = list(keys), [], 0, 1
    left, before = nodes._rows, None
    kind, leaf = dict(nodes.dtypes)["v"], F.col("up").isNull() & (F.col("deg") == 1)
    none = F.lit(None).cast(kind)
    core = nodes
    while left and (before is None or left * FOLD_WORTH <= before * (FOLD_WORTH - 1)):
        table = core.withColumn("up", none)
        for _ in range(FOLDS):
            own = F.struct("v", "deg", "near", "n", "s", "up", F.lit(False).alias("told"))
            gone = F.struct(F.col("near").alias("v"), "deg", F.col("v").alias("near"), "n", "s", "up", F.lit(True).alias("told"))
            mine = lambda c: F.max(F.when(~F.col("told"), F.col(c))).alias(c)
            table = table.select(*keys, F.inline(F.when(leaf, F.array(own, gone)).otherwise(F.array(own)))).groupBy(*keys, "v").agg(
                *[mine(c) for c in ("deg", "near", "n", "s", "up")], F.count_if("told").alias("_deg"),
                F.bit_xor(F.when(F.col("told"), F.col("near"))).alias("_near"),
                *[F.coalesce(F.sum(F.when(F.col("told"), F.col(c))), F.lit(0)).alias(f"_{c}") for c in ("n", "s")],
            )
            off = leaf & ((F.col("_deg") == 0) | (F.col("v") > F.col("near")))
            stays = lambda c, more: F.when(off, F.col(c)).otherwise(F.col(c) + F.col(more)).alias(c)
            table = table.select(
                *keys, "v", (F.col("deg") - F.col("_deg")).alias("deg"), F.when(off, F.col("near")).otherwise(F.col("near").bitwiseXOR(F.coalesce("_near", F.lit(0).cast(kind)))).alias("near"),
                stays("n", "_n"), stays("s", "_s"), F.when(off, F.col("near")).otherwise(F.col("up")).alias("up"),
            )
        table, seen = counted_cut(table, left=F.count_if(F.col("up").isNull() & (F.col("deg") > 0)), most=F.max("n"))
        tables.append(table)
        rounds, most = rounds + FOLDS, max(most, seen["most"])
        before, left = left, seen["left"]
        core = table.filter("up is null and deg > 0").drop("up")
    both = lambda where, *c: functools.reduce(DataFrame.unionByName, [t.filter(where).select(*keys, *c) for t in tables])
    return _Fold(keys, core, both("up is not null", "v", "up", "n", "s"), both("up is null and deg = 0", "v", "n", "s"), rounds, most)


def _link_sums(result: bands.Search, plain: _Arcs, keys: Sequence[str], stands: DataFrame | None, largest: int) -> tuple[str, object]:
    """Folder and schema of (keys, u, w, part): what the origins of one search add to each pair of neighbours; everything else is dropped again.

    ``stands`` (keys, v, n, s) are the nodes and origins each node counts for (1 without), ``largest`` the most nodes of a component.
    """
    who, width, spark = result.who, result.width, result.spark
    numbers = [k for k, _, _ in result.bands]
    at = lambda d: F.call_function("div", F.col(d), F.lit(width).cast("bigint"))
    state = result.settled()
    dag = (
        plain.follow(state)
        .select(*who, "u", "w", "ways", F.col("dist").alias("near"), (F.col("dist") + F.col("len")).alias("dist"))
        .join(state.withColumnRenamed("v", "w"), [*who, "w", "dist"])
        .select(*who, "u", "w", F.col("ways").cast("double").alias("ways"), at("near").alias("bu"), at("dist").alias("bw"))
    )
    dag, seen = counted_cut(dag)
    pair = [F.least("u", "w").alias("u"), F.greatest("u", "w").alias("w")]
    if not seen["n"]:
        none = dag.select(*keys, *pair, F.lit(0.0).alias("part"))
        result.discard()
        return stored(none)[0], none.schema
    forward = dag.select(*who, F.col("u").alias("v"), F.col("w").alias("to"), F.col("ways").alias("weight"), F.col("bu").alias("here"), F.col("bw").alias("there"))
    ahead = bands.by_band(forward, "here")
    one = result.settled(0, 0).filter("dist = 0").select(*who, "v", F.lit(1.0).alias("s"))
    flow_schema = one.schema
    counts = _sweep(numbers, lambda k: one if k == 0 else one.limit(0), ahead, flow_schema, who)
    total = lambda flows, base: (
        base.unionByName(bands.read(spark, flow_schema, [f for some in flows.values() for f in some]).select(*who, "v", "s"))
        .groupBy(*who, "v").agg(F.sum("s").alias("s"))
    )
    paths = cut(total(counts, one))
    shares = cut(
        dag.join(paths.select(*who, F.col("v").alias("u"), F.col("s").alias("su")), [*who, "u"])
        .join(paths.select(*who, F.col("v").alias("w"), F.col("s").alias("sw")), [*who, "w"])
        .select(*who, F.col("w").alias("v"), F.col("u").alias("to"), (F.col("su") * F.col("ways") / F.col("sw")).alias("weight"), F.col("bw").alias("here"), F.col("bu").alias("there"))
    )
    behind = bands.by_band(shares, "here")
    stood = {}
    if stands is None:
        ends = lambda first=0, last=None: result.settled(first, last).filter("v <> o").select(*who, "v", F.lit(1.0).alias("s"))
    else:
        counted = skew_join(state.filter("v <> o"), stands.select(*keys, "v", "n"), [*keys, "v"], rows=largest)
        counted = skew_join(counted, stands.select(*keys, F.col("v").alias("o"), F.col("s").alias("_s")), [*keys, "o"], rows=largest)
        stood = bands.by_band(counted.select(*who, "v", (F.col("n").cast("double") * F.col("_s")).alias("s"), at("dist").alias("_at")), "_at")

        def ends(first: int = 0, last: int | None = None) -> DataFrame:
            return bands.read(spark, flow_schema, [part.path for k, part in stood.items() if k >= first and (last is None or k <= last)]).select(*who, "v", "s")

    gains = _sweep(numbers[::-1], lambda k: ends(k, k), behind, flow_schema, who)
    parts = total(gains, ends()).join(shares, [*who, "v"]).select(*keys, F.least("v", "to").alias("u"), F.greatest("v", "to").alias("w"), (F.col("s") * F.col("weight")).alias("part"))
    parts = parts.groupBy(*keys, "u", "w").agg(F.sum("part").alias("part"))
    path, _ = stored(parts)
    for table in (dag, paths, shares):
        discard(table)
    for folder in {f.rsplit("/at=", 1)[0] for flows in (counts, gains) for some in flows.values() for f in some}:
        remove(spark, folder)
    for bandwise in (ahead, behind, stood):
        for part in bandwise.values():
            remove(spark, part.path)
    result.discard()
    return path, parts.schema


@dataclass
class Repair:
    """Routes after links were removed."""

    routes: Routes
    hit: DataFrame  # (keys, vid_o, vid_d) of the pairs that were routed anew
    touched: dict[str, int]  # rows taken out of the trees, put in again, and written while searching


def repair(routes: Routes, edges_left: DataFrame, removed: DataFrame) -> Repair:
    """The routes without the ``removed`` links (keys, id), mended where they were broken.

    The nodes below a removed link in a tree are found by doubling up the tree.  They lose their distances; all others keep
    theirs, as their own path is whole and nothing gets shorter.  Where a destination of the origin is among the lost nodes, the
    search starts again from the links that lead out of what is left, and spreads over what has no distance.
    A kept node keeps its link: it was the least of those that lie on shortest paths, and no new ones come up.
    """
    keys, who = routes.keys, routes.who
    gone = removed.select(*[k for k in keys if k in removed.columns], F.col("id").alias("edge_id"))
    lost = cut(routes.tree.join(gone, gone.columns, "left_semi").select(*who, "v"))
    for rung in routes.ladder():  # after rung k: all that lie less than 2^(k + 1) links below
        lower = rung.join(lost.withColumnRenamed("v", "a"), [*who, "a"], "left_semi").select(*who, "v")
        before, lost = lost, cut(lost.unionByName(lower).distinct())
        discard(before)
    ends = routes.pairs.select(*keys, F.col("vid_o").alias("o"), F.col("vid_d").alias("v")).distinct()
    hit = cut(ends.join(lost, [*who, "v"], "left_semi").select(*keys, F.col("o").alias("vid_o"), F.col("v").alias("vid_d")))
    origins = hit.select(*keys, F.col("vid_o").alias("o")).distinct()
    whole = cut(routes.state.join(lost, [*who, "v"], "left_anti"))
    kept = cut(whole.join(origins, who, "left_semi"))
    arcs = arc_table(edges_left, keys)
    plain = _Arcs(arcs, keys)
    out = plain.follow(kept).select(*who, F.col("w").alias("v"), (F.col("dist") + F.col("len")).alias("dist"))
    seeds = cut(out.join(kept.select(*who, "v"), [*who, "v"], "left_anti").groupBy(*who, "v").agg(F.min("dist").alias("dist")))
    result = bands.search(hit, _Arcs.with_shortcuts(arcs, keys), keys, seeds=seeds, known=kept)
    mended = cut(bands.within_reach(result))
    result.discard()
    around = kept.unionByName(mended)
    tree = cut(routes.tree.join(lost, [*who, "v"], "left_anti").unionByName(_links_into(mended, around, plain, who)))
    touched = {"lost": lost._rows, "mended": mended._rows, "written": sum(n for _, n, _ in result.rounds)}
    return Repair(Routes.of(routes.pairs, keys, whole.unionByName(mended), tree), hit, touched)


def reroute(routes: Routes, edges_left: DataFrame, removed: DataFrame, paths: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Lengths and paths after the ``removed`` links are gone.

    The first are the pairs with their length ``d`` after, and ``changed`` for those that were routed anew (pairs without a route drop);
    the second (keys, vid_o, vid_d, edge_id, hop) carries on the ``paths`` before of all others.
    """
    done = repair(routes, edges_left, removed)
    on = [*routes.keys, "vid_o", "vid_d"]
    anew = done.hit.withColumn("_anew", F.lit(True))
    lengths = done.routes.lengths().join(anew, on, "left").withColumn("changed", F.coalesce("_anew", F.lit(False))).drop("_anew")
    before = routes.paths() if paths is None else paths
    kept = before.join(done.hit, on, "left_anti")
    some = done.hit.select(*routes.keys, F.col("vid_o").alias("o")).distinct()
    mended = Routes.of(done.hit, routes.keys, done.routes.state, cut(done.routes.tree.join(some, routes.who, "left_semi")))
    return lengths, kept.unionByName(mended.paths())


def _links_into(nodes: DataFrame, around: DataFrame, plain: _Arcs, who: Sequence[str]) -> DataFrame:
    """(keys, o, v, edge_id, p): of the links over which ``around`` reaches each of the nodes at its distance, that of the least id."""
    who = list(who)
    came = plain.follow(around.select(*who, "v", "dist")).select(
        *who, F.col("w").alias("v"), (F.col("dist") + F.col("len")).alias("dist"), F.struct("id", "u").alias("via")
    )
    best = came.join(nodes.select(*who, "v", "dist"), [*who, "v", "dist"]).groupBy(*who, "v").agg(F.min("via").alias("via"))
    return best.select(*who, "v", F.col("via.id").alias("edge_id"), F.col("via.u").alias("p")).filter("v <> o")
