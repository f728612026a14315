"""Source divergence audit: how far the word use of each source lies from that of the others in its language.

Tasks count the terms of their documents by (language, source) before anything is shuffled.  A language keeps the terms that
enough of its documents hold, dealt to slices of bounded size.  Each group (language, source) becomes sorted arrays
(term id, count), one a slice.  The groups of a language form blocks; every unordered pair of blocks is one
task a slice, in which the arrays of each pair of groups are merged: the shorter gallops through the longer, and terms
in both, in one only and in neither are priced with the smoothed shares of both.  The partial sums of the slices add up.

With count c of a term, N counted terms of the group and V terms kept by the language the share is
p = 1 + floor(scale * (c + smooth) / (N + smooth * V)); all arithmetic is on whole numbers.

Defined results: null text, language and source count as ''; a group without kept terms is compared like any other (all its
counts are 0); in a language that keeps no term every pair has value 0; a language of one source has no pairs; equal
values rank by ascending item (UTF-8); repeated documents count as often as they occur; an empty table gives an empty result;
columns other than the three are never read.  Counts of one term are exact to 9 * 10^15.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from sparkwalk.llm.terms import LETTERS, count_terms, raw
from sparkwalk.operators.skew import skew_join
from sparkwalk.session import counted_cut, cut

#: Entries a task holds before it hands on what it has counted; terms of a slice; groups of a block.
HELD, SLICE, BLOCK = 200_000, 65_536, 16
#: A needle run of the galloping merge.
RUN = 1024


def group_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs), pre-aggregated within tasks: occurrences and documents that hold the term."""
    schema = pa.schema(
        [("lang", pa.string()), ("source", pa.string()), ("term", pa.binary()), ("n", pa.int64()), ("docs", pa.int64())]
    )

    def flushed(counts, holds):
        rows = [(lang, source, t, n, holds[lang, source][t]) for (lang, source), c in counts.items() for t, n in c.items()]
        columns = list(zip(*rows)) or [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    def run(batches):
        counts, holds, size = defaultdict(Counter), defaultdict(Counter), 0
        for batch in batches:
            for lang, source, data in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), raw(batch, "text")):
                own = count_terms(data, LETTERS)
                total = counts[lang, source]
                size -= len(total)
                total.update(own)
                holds[lang, source].update(own.keys())
                size += len(total)
                if size > HELD:
                    yield flushed(counts, holds)
                    counts, holds, size = defaultdict(Counter), defaultdict(Counter), 0
        yield flushed(counts, holds)

    return docs.mapInArrow(run, "lang string, source string, term binary, n long, docs long")


def share(count: Column, total: Column, smooth: int, scale: int) -> Column:
    """1 + floor(scale * (count + smooth) / total) without leaving 64 bits: the quotient a factor of 1,000 at a time."""
    rest, digits = count + smooth, F.lit(0).cast("long")
    for step in _steps(scale):
        digits = digits * step + F.call_function("div", rest * step, total)
        rest = F.pmod(rest * step, total)
    return digits + 1


def _steps(scale: int) -> list[int]:
    steps = []
    while scale > 1000 and scale % 1000 == 0:
        steps.append(1000)
        scale //= 1000
    return [*steps, scale]


def shares(count: np.ndarray, total: int, smooth: int, scale: int) -> np.ndarray:
    """``share`` over an array."""
    rest, digits = count.astype(np.int64) + smooth, np.zeros(len(count), dtype=np.int64)
    for step in _steps(scale):
        digits = digits * step + rest * step // total
        rest = rest * step % total
    return digits + 1


def gallop(short: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in both of the ids that both hold (sorted, distinct): runs of the shorter leap through the longer."""
    at, start = np.zeros(len(short), dtype=np.int64), 0
    for i in range(0, len(short), RUN):
        run = short[i : i + RUN]
        step, stop = RUN, start
        while stop < len(long) and long[stop] <= run[-1]:
            stop, step = min(stop + step, len(long)), 2 * step
        at[i : i + RUN] = start + np.searchsorted(long[start:stop], run)
        start = int(at[min(i + RUN, len(short)) - 1])
    found = at < len(long)
    found[found] = long[at[found]] == short[found]
    where = np.flatnonzero(found)
    return where, at[where]


def price(a: tuple, b: tuple, kept: int) -> int:
    """Sum over the ``kept`` terms of |p of a - p of b|; each side is (ids, their p, p of an absent term)."""
    if len(a[0]) > len(b[0]):
        a, b = b, a
    (ids_a, p_a, none_a), (ids_b, p_b, none_b) = a, b
    i, j = gallop(ids_a, ids_b)
    both = np.abs(p_a[i] - p_b[j]).sum()
    only_a = np.abs(p_a - none_b).sum() - np.abs(p_a[i] - none_b).sum()
    only_b = np.abs(p_b - none_a).sum() - np.abs(p_b[j] - none_a).sum()
    neither = (kept - len(ids_a) - len(ids_b) + len(i)) * abs(none_a - none_b)
    return int(both + only_a + only_b) + neither


def pair_sums(arrays: DataFrame, smooth: int, scale: int) -> DataFrame:
    """(lang, source, item, value) of every unordered pair of groups, summed over the slices.

    ``arrays`` has lang, slice, kept (terms of the slice), total (N + smooth * V), source, place and blocks
    (of the group among those of its language), ids and ns.
    """

    def prices(pdf_a: pd.DataFrame, pdf_b: pd.DataFrame) -> pd.DataFrame:
        def told(pdf):
            out = []
            for place, source, total, kept, ids, ns in zip(*(pdf[c] for c in ("place", "source", "total", "kept", "ids", "ns"))):
                if not total:  # nothing kept in the language
                    out.append((place, source, kept, (np.zeros(0, np.int64), np.zeros(0, np.int64), 0)))
                    continue
                p = shares(np.asarray(ns, dtype=np.int64), int(total), smooth, scale)
                none = int(shares(np.zeros(1, np.int64), int(total), smooth, scale)[0])
                out.append((place, source, kept, (np.asarray(ids, dtype=np.int64), p, none)))
            return out

        rows, right = [], told(pdf_b)
        lang = pdf_a["lang"].iloc[0] if len(pdf_a) else ""
        for place, source, kept, a in told(pdf_a):
            rows += [(lang, source, other, price(a, b, int(kept))) for beyond, other, _, b in right if place < beyond]
        return pd.DataFrame(rows, columns=["lang", "source", "item", "value"])

    block = F.floor(F.col("place") / BLOCK).cast("int")
    left = arrays.withColumn("a", block).withColumn("b", F.explode(F.sequence("a", F.col("blocks") - 1)))
    right = arrays.toDF(*arrays.columns).withColumn("b", block).withColumn("a", F.explode(F.sequence(F.lit(0), "b")))
    task = ["lang", "slice", "a", "b"]
    parts = left.groupBy(*task).cogroup(right.groupBy(*task)).applyInPandas(prices, "lang string, source string, item string, value long")
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit(
    docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least: int = 30, smooth: int = 5, scale: int = 10**9, top: int = 50
) -> DataFrame:
    """(lang, source, part, item, value, rank): ``pair`` rows to every other source, ``term`` rows of the ``top`` terms used most beyond the language."""
    empty = F.lit("")
    named = docs.select(
        F.coalesce(F.col(lang).cast("string"), empty).alias("lang"), F.coalesce(F.col(source).cast("string"), empty).alias("source"), F.col(text).alias("text")
    )
    counts = cut(group_counts(named).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    kept = (
        counts.groupBy("lang", "term").agg(F.sum("n").alias("q_n"), F.sum("docs").alias("docs")).filter(F.col("docs") >= least)
        .select("lang", "term", "q_n", F.monotonically_increasing_id().alias("id"))
    )
    kept, _ = counted_cut(kept)
    groups = named.select("lang", "source").distinct()
    totals = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("q_n").alias("q_total"))
    langs = groups.select("lang").distinct().join(totals, "lang", "left").fillna({"v": 0, "q_total": 0})
    langs = cut(langs.withColumn("slices", F.greatest(F.ceil(F.col("v") / SLICE), F.lit(1)).cast("int")))
    dealt = kept.join(langs.select("lang", "slices"), "lang").withColumn("slice", F.pmod(F.xxhash64("id"), "slices").cast("int")).drop("slices")
    dealt = cut(dealt)
    used = cut(counts.join(dealt, ["lang", "term"]).select("lang", "source", "term", "n", "q_n", "id", "slice"))

    place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    of = groups.join(used.groupBy("lang", "source").agg(F.sum("n").alias("n")), ["lang", "source"], "left").join(langs, "lang")
    last = F.max("place").over(Window.partitionBy("lang"))
    of = of.select("lang", "source", F.coalesce("n", F.lit(0)).alias("n_total"), "v", "q_total", "slices", place.alias("place"))
    of = cut(of.withColumn("blocks", (F.floor(last / BLOCK) + 1).cast("int")))

    # part term: terms of the group that stand above their language
    mine = of.select("lang", "source", (F.col("n_total") + smooth * F.col("v")).alias("_t"), (F.col("q_total") + smooth * F.col("v")).alias("_q"))
    ahead = skew_join(used, mine, ["lang", "source"])
    above = share(F.col("n"), F.col("_t"), smooth, scale) - share(F.col("q_n"), F.col("_q"), smooth, scale)
    term_rows = ahead.select("lang", "source", F.lit("term").alias("part"), F.decode("term", "utf-8").alias("item"), above.alias("value")).filter("value > 0")

    # part pair: sorted arrays of each group and slice, empty ones too
    pair = F.sort_array(F.collect_list(F.struct("id", "n")))
    lists = used.groupBy("lang", "source", "slice").agg(pair.alias("x"))
    kept_in = dealt.groupBy("lang", "slice").agg(F.count(F.lit(1)).alias("kept"))
    base = of.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    arrays = (
        base.join(kept_in, ["lang", "slice"], "left").join(lists, ["lang", "source", "slice"], "left")
        .select(
            "lang", "slice", "source", "place", "blocks", F.coalesce("kept", F.lit(0)).alias("kept"), (F.col("n_total") + smooth * F.col("v")).alias("total"),
            F.coalesce(F.col("x.id"), F.array().cast("array<long>")).alias("ids"), F.coalesce(F.col("x.n"), F.array().cast("array<long>")).alias("ns"),
        )
    )
    sums = cut(pair_sums(cut(arrays), smooth, scale))
    both = F.inline(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))))
    pair_rows = sums.select("lang", "value", both).select("lang", "source", F.lit("pair").alias("part"), "item", "value")

    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    best = term_rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return pair_rows.withColumn("rank", F.row_number().over(order)).unionByName(best)
