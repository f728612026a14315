"""Shortest distances by distance bands.

Distances are settled band by band (delta-stepping; Meyer & Sanders, 2003).  A node whose distance lies in a closed band never
changes again: its row goes to an append-only table, one folder a band.  Only the rows of the open band are merged and
written again, and what is found beyond it waits in the folder of its own band, so what a round writes follows the frontier.

A proposal for a settled node is told by the bands just below only: links lead both ways, so a neighbour of a node at
distance d is no nearer than d less the longest arc.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkwalk.operators.skew import skew_join
from sparkwalk.session import counted_cut, cut, discard, remove, stored

FAR = 1 << 60  # longer than any route
#: Bands that one arc may cross: their numbers share a 64-bit mask.
REACH = 32


@dataclass
class Search:
    """What a search has settled."""

    spark: SparkSession
    who: list[str]
    schema: object  # of the band tables
    width: int
    bands: list[tuple[int, str, int]] = field(default_factory=list)  # number, folder, rows
    rounds: list[tuple[int, int, int]] = field(default_factory=list)  # band, rows written, rows of the band among them
    targets: DataFrame | None = None  # (keys, scenario, o, v) that were asked for

    def settled(self, first: int = 0, last: int | None = None) -> DataFrame:
        """(keys, scenario, o, v, dist) of the bands from ``first`` to ``last``."""
        folders = [path for k, path, _ in self.bands if k >= first and (last is None or k <= last)]
        return read(self.spark, self.schema, folders).select(*self.who, "v", "dist")

    def discard(self) -> None:
        for _, path, _ in self.bands:
            remove(self.spark, path)


def read(spark: SparkSession, schema, folders: Sequence[str]) -> DataFrame:
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.option("recursiveFileLookup", "true").schema(schema).parquet(*folders)  # folder names are no columns here


def bits(mask: int | None) -> list[int]:
    return [i for i in range((mask or 0).bit_length()) if mask >> i & 1]


@dataclass
class Part:
    """The rows of one band of a stored table."""

    path: str
    schema: object
    rows: int


def by_band(df: DataFrame, band: str) -> dict[int, Part]:
    """``df`` stored once, a folder for each value of the column ``band`` (which the rows keep)."""
    path, seen = stored(df.withColumn("_band", F.col(band)), ["_band"])
    if not seen["n"]:
        return {}
    numbers = df.sparkSession.read.parquet(path).groupBy("_band").count().collect()  # as many rows as there are bands
    return {r[0]: Part(f"{path}/_band={r[0]}", df.schema, r[1]) for r in numbers}


def search(
    pairs: DataFrame,
    net,
    keys: Sequence[str] = (),
    scenario: Sequence[str] = (),
    usable: str | None = None,
    cutoff: int | None = None,
    width: int | None = None,
    seeds: DataFrame | None = None,
    known: DataFrame | None = None,
) -> Search:
    """Distances from every origin, band by band, until its destinations are settled.

    ``pairs`` has (keys, scenario, vid_o, vid_d[, upper]); a null ``vid_d`` means "to every node", and ``upper`` is a
    length already known to be reachable.  ``net`` is a laid-out arc table (``routing.Arcs``) whose arcs lead
    both ways.  ``scenario`` columns belong to the pairs only and meet the arcs' carried columns in the condition
    ``usable``.  An origin is given up at the end of the band in which the last of its destinations was settled.

    A search may go on from an earlier one: ``seeds`` (keys, scenario, o, v, dist) are proposals to start from in place of the
    origins, ``known`` (the same columns) final distances, which are neither searched nor given again.
    """
    keys, scenario = list(keys), list(scenario)
    who = [*keys, *scenario, "o"]
    spark = pairs.sparkSession
    long = lambda v: F.lit(v).cast("bigint")
    width = width or max(net.in_a_band * net.mean, -(-net.longest // REACH), 1)
    back = -(-net.longest // width)  # bands below an open one in which its neighbours may be settled

    asked = pairs.select(
        *keys, *scenario, F.col("vid_o").alias("o"), F.col("vid_d").alias("v"), (F.coalesce("upper", long(FAR)) if "upper" in pairs.columns else long(FAR)).alias("upper")
    )
    targets = cut(asked.filter("v is not null").select(*who, "v").distinct())
    # one row an origin: destinations left, whether it goes on to the end, how far it needs to look
    live, seen = counted_cut(
        asked.groupBy(*who).agg(
            F.count_distinct("v").alias("left"), F.max(F.col("v").isNull()).alias("open"), F.max(F.when(F.col("v").isNull(), long(FAR)).otherwise(F.col("upper"))).alias("reach")
        )
    )
    # numbers of bands are columns, not literals, so every round runs the same compiled code
    band = F.call_function("div", F.col("dist"), long(width))
    first = live.select(*who, F.col("o").alias("v"), long(0).alias("dist")) if seeds is None else seeds.select(*who, "v", "dist")
    first = first.withColumns({"reach": long(0), "fresh": F.lit(True)})
    schema, n_origins = first.schema, seen["n"]
    if seeds is None:
        start = {0: Part(stored(first)[0], schema, n_origins)} if n_origins else {}
    else:
        start = by_band(first.withColumn("_at", band), "_at")
    out = Search(spark, who, schema, width, targets=targets)
    waiting: dict[int, list[str]] = {k: [part.path] for k, part in start.items()}
    most = {k: part.rows for k, part in start.items()}  # rows that wait for a band, at most
    final = {} if known is None else by_band(known.select(*who, "v", "dist").withColumn("_at", band), "_at")

    def merged(rows: DataFrame, ahead: DataFrame | None, below: DataFrame) -> DataFrame:
        """The least distance of each node with ``old``, the one before (null: none), and the open band ``at``; without settled nodes."""
        parts = rows.select(*who, "v", "dist", "reach", F.col("dist").alias("old"), band.alias("at"))
        if ahead is not None:
            parts = parts.unionByName(ahead.withColumn("old", F.lit(None).cast("bigint")))
        parts = parts.unionByName(below.select(*who, "v", "dist", long(0).alias("reach"), long(-1).alias("old"), long(-1).alias("at")))
        best = parts.groupBy(*who, "v").agg(
            F.min("dist").alias("dist"), F.max("reach").alias("reach"), F.min("old").alias("old"), F.max("at").alias("at")
        )
        return best.filter("old is null or old >= 0")

    while waiting:
        k = min(waiting)
        used = waiting.pop(k)
        below = out.settled(k - back)
        for b in range(k - back, k + 1):
            if b in final:
                below = below.unionByName(read(spark, final[b].schema, [final[b].path]).select(*who, "v", "dist"))
        waits = read(spark, schema, used).drop("reach")
        opened = skew_join(waits, live.select(*who, "reach"), who, rows=most.pop(k)).filter("dist <= reach")
        rows = merged(opened, None, below).withColumn("fresh", F.lit(True))
        while True:
            ahead = net.follow(rows.filter("fresh").select(*who, "v", "dist", "reach", band.alias("at")))
            if usable is not None:
                ahead = ahead.filter(usable)
            ahead = ahead.select(*who, F.col("w").alias("v"), (F.col("dist") + F.col("len")).alias("dist"), "reach", "at").filter("dist <= reach")
            if cutoff is not None:
                ahead = ahead.filter(F.col("dist") <= int(cutoff))
            fresh = (band == F.col("at")) & (F.col("old").isNull() | (F.col("dist") < F.col("old")))
            table = merged(rows, ahead, below).withColumns({"fresh": fresh, "band": band})
            path, seen = stored(
                table.select(*who, "v", "dist", "reach", "fresh", "band", "at"), ["band", "at"], fresh=F.count_if("fresh"),
                own=F.count_if(F.expr("band = at")), beyond=F.bit_or(F.expr("shiftleft(1L, cast(band - at as int))")),
            )
            out.rounds.append((k, seen["n"], seen["own"]))
            for folder in used:
                remove(spark, folder)
            for b in bits(seen["beyond"]):
                if b:
                    waiting.setdefault(k + b, []).append(f"{path}/band={k + b}/at={k}")
                    most[k + b] = most.get(k + b, 0) + seen["n"] - seen["own"]
            used = [f"{path}/band={k}/at={k}"]
            if not seen["fresh"]:
                break
            rows = read(spark, schema, used)
        if not seen["own"]:
            continue
        out.bands.append((k, used[0], seen["own"]))
        if not waiting or not targets._rows:
            continue
        # destinations settled in this band; origins with none left stop here
        hits = read(spark, schema, used).select(*who, "v").join(targets, [*who, "v"]).groupBy(*who).agg(F.count(F.lit(1)).alias("hits"))
        before = live
        live, seen = counted_cut(
            live.join(hits, who, "left").withColumn("left", F.col("left") - F.coalesce("hits", F.lit(0))).filter("open or left > 0").drop("hits")
        )
        discard(before)
        if not seen["n"]:
            break
    for part in final.values():
        remove(spark, part.path)
    for folders in waiting.values():
        for folder in folders:
            remove(spark, folder)
    discard(live)
    return out


def found(result: Search) -> DataFrame:
    """(keys, scenario, o, v, dist) of the destinations that were asked for and reached."""
    return result.settled().join(result.targets, [*result.who, "v"])


def within_reach(result: Search) -> DataFrame:
    """The settled nodes no farther than the farthest reached destination of their origin (all, for origins to every node)."""
    far = found(result).groupBy(*result.who).agg(F.max("dist").alias("_reach"))
    return skew_join(result.settled(), far, result.who).filter("dist <= _reach").drop("_reach")
