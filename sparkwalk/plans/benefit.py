"""What batches of new links buy: trips that become possible, mean trips that get shorter."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sparkwalk.functions.scalar import METRES_PER_MILE
from sparkwalk.operators.bands import found
from sparkwalk.operators.forest import bottlenecks
from sparkwalk.operators.ranking import batches, interpolate_gaps, running
from sparkwalk.operators.routing import arc_table, distances
from sparkwalk.session import counted_cut, cut


def new_links(edges_max: DataFrame, edges_min: DataFrame) -> DataFrame:
    """Links of the larger network that the smaller one lacks."""
    return edges_max.join(edges_min.select("id"), "id", "left_anti")


def first_connected_step(pairs: DataFrame, edges: DataFrame, last: int) -> DataFrame:
    """For each pair the least step at which its ends are connected.

    ``edges`` (src_vid, trg_vid, step) join the network at their step (0 = already there,
    at most ``last``); ``pairs`` (vid_o, vid_d, n_ods).  Pairs that never connect drop.
    A vertex counts only once it has a link, also where both ends are the same vertex.

    One spanning forest over the steps answers all pairs (``forest.bottlenecks``), however many steps there are.
    """
    ends = edges.select("step", F.explode(F.array("src_vid", "trg_vid")).alias("vid_o"))
    own = ends.groupBy("vid_o").agg(F.min("step").alias("step"))
    loops = pairs.filter("vid_o = vid_d").join(own, "vid_o").select("vid_o", "vid_d", "n_ods", "step")
    met = bottlenecks(pairs.select("vid_o", "vid_d", "n_ods"), edges, "step")
    return loops.unionByName(met).filter(F.col("step") <= last)


def links_vs_trips(od: DataFrame, edges_min: DataFrame, edges_max: DataFrame, interval: int = 1) -> DataFrame:
    """Best-scored new links first, in steps of ``interval``: what share of the new trips do they make possible?

    Rows (n_links, pct_links, pct_new_trips, length, n_trips), the first one all zero.  A
    last, unfinished batch gets no row, but still counts towards the maximum.
    """
    pairs = od.groupBy("vid_o", "vid_d").agg(F.sum("n_ods").alias("n_ods"))
    ranked, seen = counted_cut(
        batches(new_links(edges_max, edges_min), interval, [F.desc("pedscore"), F.asc("id")]).select(
            "id", "src_vid", "trg_vid", "len", (F.col("step") + 1).alias("step")
        )
    )
    n_links = seen["n"]
    last = -(-n_links // interval)
    timed = edges_min.select("src_vid", "trg_vid", F.lit(0).alias("step")).unionByName(ranked.select("src_vid", "trg_vid", "step"))
    gained = first_connected_step(pairs, timed, last).groupBy("step").agg(F.sum("n_ods").alias("trips"))
    added = ranked.groupBy("step").agg(F.sum("len").alias("added"))
    per_step = gained.join(added, "step", "full").fillna(0, ["trips", "added"])
    curve = cut(running(per_step, ["step"], {"n_trips": "trips", "length": "added"}))
    low_high = curve.agg(
        F.coalesce(F.max(F.when(F.col("step") == 0, F.col("n_trips"))), F.lit(0)).alias("_low"),
        F.coalesce(F.max("n_trips"), F.lit(0)).alias("_high"),
    )
    curve = curve.join(F.broadcast(low_high), F.lit(True))  # a single row
    n = F.col("step") * interval
    steps = curve.filter((F.col("step") > 0) & (n <= n_links)).select(
        n.cast("int").alias("n_links"),
        (100.0 * n / n_links).alias("pct_links"),
        F.try_divide(100.0 * (F.col("n_trips") - F.col("_low")), F.col("_high") - F.col("_low")).alias("pct_new_trips"),
        "length",
        "n_trips",
    )
    first = low_high.select(
        F.lit(0).alias("n_links"), F.lit(0.0).alias("pct_links"), F.lit(0.0).alias("pct_new_trips"),
        F.lit(0).cast("bigint").alias("length"), F.col("_low").alias("n_trips"),
    )
    return first.unionByName(steps)


def removal_steps(edges_min: DataFrame, edges_max: DataFrame, interval: int) -> tuple[DataFrame, int, int]:
    """Edges with ``gone_at``, the step at which they are removed: worst-scored new links first.

    Also returns the number of steps and of removed links.  Links of the smaller network stay
    to the end.
    """
    treated, seen = counted_cut(
        batches(new_links(edges_max, edges_min), interval, [F.asc("pedscore"), F.asc("id")]).select(
            "id", "src_vid", "trg_vid", "len", (F.col("step") + 1).alias("gone_at")
        )
    )
    last = -(-seen["n"] // interval)
    kept = edges_max.join(treated.select("id"), "id", "left_anti")
    kept = kept.select("id", "src_vid", "trg_vid", "len", F.lit(last + 1).alias("gone_at"))
    return cut(kept.unionByName(treated)), last, seen["n"]


def distance_profile(pairs: DataFrame, edges: DataFrame, last: int) -> DataFrame:
    """How the distance of each pair grows while links are removed: (vid_o, vid_d, step, d), changes only.

    Step 0 is the whole network; at step k the links with ``gone_at`` <= k are gone.  Every
    pair has a row for step 0 and one for each step at which its distance rises.  ``pairs``
    must be connected at the last step.

    Distances only grow, so where two steps agree all steps between them do too.  The steps
    are halved for the pairs that differ, and all pairs and steps of one level are routed
    together; pairs that no removed link touches are routed twice in all.
    """
    arcs = cut(arc_table(edges, carry=["gone_at"]))

    def route(asked: DataFrame) -> DataFrame:
        result = distances(asked, arcs, scenario=["step"], usable="gone_at > step", carry=["gone_at"])
        out = cut(found(result).select("step", F.col("o").alias("vid_o"), F.col("v").alias("vid_d"), F.col("dist").alias("d")))
        result.discard()
        return out

    ends = pairs.select("vid_o", "vid_d").distinct()
    known = route(ends.withColumn("step", F.explode(F.array_distinct(F.array(F.lit(0), F.lit(last))))))
    at = lambda k, name: known.filter(F.col("step") == k).select("vid_o", "vid_d", F.col("d").alias(name))
    spans = at(0, "d_lo").join(at(last, "d_hi"), ["vid_o", "vid_d"]).withColumns({"lo": F.lit(0), "hi": F.lit(last)})
    undecided = "d_lo < d_hi and hi - lo > 1"
    spans, seen = counted_cut(spans.filter(undecided))
    while seen["n"]:
        spans = spans.withColumn("step", F.floor((F.col("lo") + F.col("hi")) / 2).cast("int"))
        mid = route(spans.select("step", "vid_o", "vid_d", F.col("d_hi").alias("upper")))
        known = known.unionByName(mid)
        split = spans.join(mid, ["vid_o", "vid_d", "step"]).select(
            "vid_o", "vid_d",
            F.explode(
                F.array(
                    F.struct(F.col("lo").alias("lo"), F.col("step").alias("hi"), F.col("d_lo").alias("d_lo"), F.col("d").alias("d_hi")),
                    F.struct(F.col("step").alias("lo"), F.col("hi").alias("hi"), F.col("d").alias("d_lo"), F.col("d_hi").alias("d_hi")),
                )
            ).alias("s"),
        ).select("vid_o", "vid_d", "s.*")
        spans, seen = counted_cut(split.filter(undecided))
    # the step at which each distance first occurs
    return known.groupBy("vid_o", "vid_d", "d").agg(F.min("step").alias("step")).select("vid_o", "vid_d", "step", "d")


def distance_snapshots(pairs: DataFrame, profile: DataFrame, last: int) -> DataFrame:
    """The whole table of every step: (step, vid_o, vid_d, n_ods, d, changed)."""
    spans = profile.groupBy("vid_o", "vid_d").agg(F.array_sort(F.collect_list(F.struct("step", "d"))).alias("at"))
    upto = F.expr(f"transform(at, (x, i) -> coalesce(get(at, i + 1).step, {last + 1}) - 1)")
    runs = spans.select("vid_o", "vid_d", F.inline(F.arrays_zip(F.col("at").alias("at"), upto.alias("upto"))))
    rows = runs.select("vid_o", "vid_d", F.col("at.d").alias("d"), F.col("at.step").alias("since"), F.explode(F.sequence("at.step", "upto")).alias("step"))
    changed = (F.col("step") == F.col("since")) & (F.col("step") > 0)
    return rows.join(pairs.select("vid_o", "vid_d", "n_ods"), ["vid_o", "vid_d"]).select(
        "step", "vid_o", "vid_d", "n_ods", "d", changed.alias("changed")
    )


def mean_distance(profile: DataFrame, last: int, interval: int, n_links: int) -> DataFrame:
    """Mean distance over the pairs (unweighted) at every step.

    Rows (step, n_links, n_left, d_mean, delta_mean): ``n_links`` is the reversed step label,
    ``n_left`` the real number of new links still there, ``delta_mean`` the share of the
    largest decrease.  Summed from the changes, so pairs x steps is never built.
    """
    firsts = profile.groupBy("vid_o", "vid_d").agg(F.array_sort(F.collect_list(F.struct("step", "d"))).alias("at"))
    rises = F.expr("transform(at, (x, i) -> named_struct('step', x.step, 'rise', x.d - coalesce(get(at, i - 1).d, 0)))")
    per_step = (
        firsts.select(F.inline(rises)).groupBy("step").agg(F.sum("rise").alias("rise"), F.count(F.lit(1)).alias("n"))
    )
    steps = profile.sparkSession.range(0, last + 1).select(F.col("id").cast("int").alias("step"))
    sums = running(steps.join(per_step, "step", "left").fillna(0), ["step"], {"total": "rise"})
    n_pairs = per_step.filter("step = 0").select(F.col("n").alias("_pairs"))
    out = sums.join(F.broadcast(n_pairs), F.lit(True)).select(  # a single row
        "step",
        ((last - F.col("step")) * interval).cast("int").alias("n_links"),
        F.greatest(F.lit(n_links) - F.col("step") * interval, F.lit(0)).cast("int").alias("n_left"),
        (F.col("total") / F.col("_pairs")).alias("d_mean"),
    )
    out = cut(out)
    ends = out.agg(F.min("d_mean").alias("_min"), F.max("d_mean").alias("_max"))
    share = F.try_divide(F.col("d_mean") - F.col("_min"), F.col("_max") - F.col("_min"))
    return out.join(F.broadcast(ends), F.lit(True)).select(*out.columns, ((1 - share) * 100).alias("delta_mean"))  # a single row


def distance_change(od_pairs: DataFrame, edges_min: DataFrame, edges_max: DataFrame, interval: int) -> tuple[DataFrame, DataFrame]:
    """(profile, mean distance per step) of the pairs connected in the smaller network."""
    edges, last, n_links = removal_steps(edges_min, edges_max, interval)
    profile = cut(distance_profile(od_pairs, edges, last))
    return profile, mean_distance(profile, last, interval, n_links)


def benefit_cost(trips: DataFrame, dist: DataFrame, unit: float = 1.0) -> DataFrame:
    """Both curves on one axis of added links, gaps filled linearly by row.

    ``trips`` from ``links_vs_trips``, ``dist`` from ``mean_distance``; ``unit`` is the length
    unit in metres.  Adds the length in percent of its maximum and in miles.
    """
    cols = ["pct_links", "pct_new_trips", "length", "d_mean", "delta_mean"]
    both = trips.select("n_links", "pct_links", "pct_new_trips", "length").join(
        dist.select("n_links", "d_mean", "delta_mean"), "n_links", "full"
    )
    filled = cut(interpolate_gaps(both, "n_links", cols))
    longest = filled.agg(F.max("length").alias("_max"))
    return filled.join(F.broadcast(longest), F.lit(True)).select(  # a single row
        *filled.columns,
        F.try_divide(100.0 * F.col("length"), F.col("_max")).alias("pct_length"),
        (F.col("length") * unit / METRES_PER_MILE).alias("length_mi"),
    )
