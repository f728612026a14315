"""Removal of repeated byte strings by merged Burrows-Wheeler transforms.

A byte goes if a string of ``length`` bytes that covers it starts earlier too (in a smaller document, or before
in the same one); strings never cross documents and are judged on the input.

1. Anchors.  Every string of ``length`` bytes has a rarest ``GRAM``-byte string, by hash; strings with the same
   one next to each other make a segment.  Equal strings have equal anchors, so they meet under one key.
   Segments under a key that comes once, and without repeats of its own, are done with.
2. Equal segments are one: the first stays, in all later ones every string has an earlier copy.
3. Where different segments share an anchor, their first copies are dealt by anchor to buckets.  In a bucket, shards of
   segments get a Burrows-Wheeler transform each; the transforms are merged by refining the interleave of their
   rows, a few symbols a round: each round sends the rows, in their present order, to the order of the symbols
   before them.  Where neighbouring rows part, the round tells the length of their common prefix; rows
   that have not parted after ``length`` symbols are an interval of equal strings, and all but the
   earliest of it are marked.  No suffix of the merged text is sorted again.
4. The marked strings of each document are united and cut out.

An anchor shared by more than ``CROWD`` different segments (a common line in unlike surroundings) would crowd its
bucket: its strings are told apart one by one by joins instead, which need no bucket.  Anchors, segments and those
strings are compared by 64-bit hashes, segments by two.

Defined results: a null text is empty; texts shorter than ``length`` lose nothing; of documents with one key those with
other texts count as later, in the order of their text's hash, and rows equal in both are one document,
returned as often as they come; a null key comes first; an empty table gives an empty result.
"""

from __future__ import annotations

import gc

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from sparkwalk.llm.common import map_batches, texts
from sparkwalk.operators.ranking import dense_ids
from sparkwalk.session import counted_cut, cut

LENGTH, GRAM = 100, 32
#: Windows in a segment (no more than 128, and than LENGTH - GRAM + 1 at least), windows looked at in one go, bytes in a bucket and in a shard of it, segments of a crowded anchor.
RUN, STRETCH, BUCKET, SHARD, CROWD = 128, 1 << 18, 1 << 17, 1 << 14, 8_192


# ---- anchors and segments ------------------------------------------------------------------


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of every string of ``gram`` bytes; polynomial, doubled up, then mixed."""
    with np.errstate(over="ignore"):
        value = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        size, base = 1, 0xD1342543DE82EF95
        while size < gram:
            step = min(size, gram - size)  # the second half may overlap the first
            value = value[:-step] * np.uint64(base) + value[step:]
            base = pow(base, 2, 1 << 64) | 1
            size += step
        value ^= value >> np.uint64(31)
        value *= np.uint64(0xBF58476D1CE4E5B9)
        value ^= value >> np.uint64(29)
        value *= np.uint64(0x94D049BB133111EB)
        return value ^ (value >> np.uint64(32))


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    out, size = values, 1
    while size < width:
        step = min(size, width - size)
        out = np.minimum(out[:-step], out[step:])
        size += step
    return out


def segments(data: bytes, length: int = LENGTH, gram: int = GRAM):
    """Anchor hash, first window, number of windows and whether the anchor comes twice, of each segment."""
    whole = np.frombuffer(data, dtype=np.uint8)
    found = []
    for at in range(0, len(data) - length + 1, STRETCH):
        grams = gram_hashes(whole[at : at + STRETCH + length - 1], gram)
        least = sliding_least(grams, length - gram + 1)
        starts = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
        ends = np.concatenate((starts[1:], [len(least)]))
        parts = -(-(ends - starts) // RUN)  # runs of one anchor, as in a repeated word, are cut
        which = np.repeat(np.arange(len(starts)), parts)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(parts) - parts, parts)
        lo = starts[which] + nth * RUN
        n = np.minimum(ends[which], lo + RUN) - lo
        anchors = least[lo]
        ordered = np.sort(grams)
        again = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        twice = np.isin(anchors, again)  # comes twice in the text, and perhaps in its segment
        for i in np.flatnonzero(twice).tolist():
            twice[i] = np.count_nonzero(grams[lo[i] : lo[i] + n[i] + length - gram] == anchors[i]) > 1
        found.append((anchors, lo + at, n, twice))
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, int), np.zeros(0, int), np.zeros(0, bool)
    return tuple(np.concatenate(x) for x in zip(*found))


def occurrences(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(anchor, class, d, place, more) of every segment; place packs first window, windows - 1 and twice.

    Segments equal within a batch of documents come as one row, the earliest, with the others in ``more``.
    """

    def run(batch):
        cols: list[list[np.ndarray]] = [[], [], [], []]
        for d, text in zip(batch.column("d").to_pylist(), batch.column("text").to_pylist()):
            data = text.encode("utf-8", "surrogatepass")
            if len(data) < length:
                continue
            anchors, lo, n, twice = segments(data, length, gram)
            kinds = [xxhash.xxh64_intdigest(data[a : a + k + length - 1]) for a, k in zip(lo.tolist(), n.tolist())]
            place = lo.astype(np.int64) << 8 | (n.astype(np.int64) - 1) << 1 | twice
            for c, v in zip(cols, (anchors.view(np.int64), np.array(kinds, dtype=np.uint64).view(np.int64), np.full(len(lo), d, np.int64), place)):
                c.append(v)
        if not cols[0]:
            return {c: [] for c in ("anchor", "class", "d", "place", "more")}
        anchor, kind, d, place = map(np.concatenate, cols)
        order = np.lexsort((place, d, kind, anchor))
        anchor, kind, d, place = anchor[order], kind[order], d[order], place[order]
        same = np.concatenate(([False], (anchor[1:] == anchor[:-1]) & (kind[1:] == kind[:-1])))
        first = np.flatnonzero(~same)
        more: list[list[int] | None] = [None] * len(first)
        owner = np.cumsum(~same) - 1
        for i in np.flatnonzero(same).tolist():
            own = more[owner[i]]
            if own is None:
                own = more[owner[i]] = []
            own += [int(d[i]), int(place[i])]
        return {"anchor": anchor[first], "class": kind[first], "d": d[first], "place": place[first], "more": more}

    kinds = {"anchor": "long", "class": "long", "d": "long", "place": "long", "more": "array<long>"}
    return map_batches(docs.select("d", "text"), run, kinds, rows=2048)


# ---- Burrows-Wheeler transforms ------------------------------------------------------------


def ranks(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    ordered = keys[order]
    rank = np.empty(len(keys), dtype=np.int64)
    rank[order] = np.cumsum(np.concatenate(([0], ordered[1:] != ordered[:-1])))
    return rank, order


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Rows of a shard: its rotations in the order of their first ``depth`` symbols, at least (doubling)."""
    wide = text.astype(np.int64)
    rank, order = ranks(((wide << 9 | np.roll(wide, -1)) << 9 | np.roll(wide, -2)) << 9 | np.roll(wide, -3))
    size = 4
    while size < depth:
        rank, order = ranks(rank * len(text) + np.roll(rank, -size))
        size *= 2
    return np.argsort(rank, kind="stable")


def before(text: np.ndarray, q: int) -> np.ndarray:
    """The ``q`` symbols before each place of a shard, as one number."""
    code = np.zeros(len(text), dtype=np.int64)
    for k in range(q, 0, -1):
        code = code * 257 + np.roll(text, k)
    return code


def rows_of(interleave: np.ndarray, shards: int) -> np.ndarray:
    """Where the rows of each shard stand, shard by shard."""
    return np.concatenate([np.flatnonzero(interleave == s) for s in range(shards)])


def merge(shards: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in the joined text by the order of their first ``depth`` symbols, their block, and common prefixes.

    Places of one block agree in all ``depth`` symbols; the common prefix of a row with the row before is given
    to within the symbols of a round, -1 within a block.
    """
    rows = [suffix_order(t, depth) for t in shards]  # the transform of a shard is the symbols before its rows
    for q in range(6, 1, -1):  # as many symbols a round as have numbers of 16 bits
        tables = {}
        for size in {q, depth % q} - {0}:
            codes = np.concatenate([before(t, size)[r] for t, r in zip(shards, rows)])
            distinct, tables[size] = np.unique(codes, return_inverse=True)
        if len(distinct) <= 1 << 16 and max(t.max(initial=0) for t in tables.values()) < 1 << 16:
            break
    tables = {size: t.astype(np.uint16) for size, t in tables.items()}
    start = np.cumsum([0, *map(len, shards)])
    interleave = np.repeat(np.arange(len(shards), dtype=np.uint8), [len(t) for t in shards])
    block = np.zeros(len(interleave), dtype=np.int32)
    common = np.full(len(interleave), -1, dtype=np.int16)
    done = 0
    while done < depth:
        size = min(q, depth - done)
        symbols = np.empty(len(interleave), dtype=np.uint16)
        symbols[rows_of(interleave, len(shards))] = tables[size]  # the j-th row of a shard here is its j-th row
        order = np.argsort(symbols, kind="stable")
        interleave, block, symbols = interleave[order], block[order], symbols[order]
        parted = np.concatenate(([True], (symbols[1:] != symbols[:-1]) | (block[1:] != block[:-1])))
        common[parted & (common < 0)] = done
        block = np.cumsum(parted, dtype=np.int32)
        done += size
    places = np.empty(len(interleave), dtype=np.int64)
    places[rows_of(interleave, len(shards))] = np.concatenate([r + s for r, s in zip(rows, start)])
    return places, block, common


def repeated_windows(parts: list[bytes], d: np.ndarray, lo: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(segment, offset) of the windows of these segments that also start earlier; segments in order of (d, lo)."""
    if not parts:
        return np.zeros(0, int), np.zeros(0, int)
    joined = np.frombuffer(b"".join(t + b"\0" for t in parts), dtype=np.uint8).astype(np.uint16) + 1
    sizes = np.array([len(t) + 1 for t in parts])
    ends = np.cumsum(sizes)
    joined[ends - 1] = 0  # a mark that is no byte closes each segment
    owner = np.repeat(np.arange(len(parts)), sizes)
    offset = np.arange(len(joined)) - np.repeat(ends - sizes, sizes)
    shard_of = np.minimum((ends - sizes) // max(SHARD, -(-len(joined) // 200)), 254)  # by the segment's start
    cuts = np.flatnonzero(np.concatenate(([True], shard_of[1:] != shard_of[:-1])))
    bounds = [*(ends - sizes)[cuts].tolist(), len(joined)]
    places, block, _ = merge([joined[a:b] for a, b in zip(bounds, bounds[1:])], length)
    whole = offset[places] <= sizes[owner[places]] - 1 - length
    places, block = places[whole], block[whole]
    if not len(places):
        return np.zeros(0, int), np.zeros(0, int)
    seg = owner[places]
    order = np.lexsort((lo[seg] + offset[places], d[seg]))
    age = np.empty(len(places), dtype=np.int64)
    age[order] = np.arange(len(places))
    edges = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
    eldest = np.repeat(np.minimum.reduceat(age, edges), np.diff([*edges, len(places)]))
    later = age > eldest
    return seg[later], offset[places][later]


def spans_of(d: np.ndarray, start: np.ndarray, length: int) -> pd.DataFrame:
    """(d, a, b): marked windows, those that follow one another in one span."""
    order = np.lexsort((start, d))
    d, start = d[order], start[order]
    edges = np.flatnonzero(np.concatenate(([True], (d[1:] != d[:-1]) | (start[1:] != start[:-1] + 1)))) if len(d) else np.zeros(0, int)
    last = np.concatenate((edges[1:], [len(d)]))[: len(edges)] - 1
    return pd.DataFrame({"d": d[edges], "a": start[edges], "b": start[last] + length})


# ---- the job -------------------------------------------------------------------------------


def settle(spark) -> None:
    """Lets Spark's cleaner drop the shuffle files of steps that are stored and no longer named."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def marks(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(d, a, b): byte spans that go, each a union of windows of ``docs`` (d, text) that also start earlier."""
    windows, first_window = (F.shiftright("place", 1).bitwiseAND(F.lit(127)) + 1), F.shiftright("place", 8)
    by_anchor, by_class = Window.partitionBy("anchor"), Window.partitionBy("anchor", "class").orderBy("d", "place")
    seen = (
        occurrences(docs, length, gram)
        .withColumns(
            {
                "n": F.count(F.lit(1)).over(by_anchor),
                "mixed": F.min("class").over(by_anchor) != F.max("class").over(by_anchor),
                "own": F.max(F.col("place").bitwiseAND(F.lit(1))).over(by_anchor) == 1,
            }
        )
        .filter((F.col("n") > 1) | F.col("own") | F.col("more").isNotNull())
        .withColumn("nth", F.row_number().over(by_class))
    )
    compared = (F.col("nth") == 1) & (F.col("mixed") | F.col("own"))
    known, sums = counted_cut(
        seen.select("anchor", "d", "place", "more", "nth", "n", compared.alias("compared")),
        bytes=F.sum(F.when(F.col("compared"), windows + length - 1)),
    )
    del seen
    settle(docs.sparkSession)
    pairs = F.expr("transform(sequence(0, size(more) - 1, 2), i -> named_struct('d', more[i], 'place', more[i + 1]))")
    itself = F.when(F.col("nth") > 1, F.array(F.struct("d", "place"))).otherwise(F.array().cast("array<struct<d:bigint,place:bigint>>"))
    later = known.select(F.inline(F.concat(itself, F.when(F.col("more").isNotNull(), pairs).otherwise(F.array().cast("array<struct<d:bigint,place:bigint>>")))))
    copies = later.select("d", first_window.alias("a"), (first_window + windows + length - 1).alias("b"))

    asked = known.filter("compared").groupBy("d").agg(F.collect_list(F.struct("anchor", "place", (F.col("n") > CROWD).alias("crowd"))).alias("asked"))
    told = docs.join(asked, "d")  # a document's own segments; both readers below share the exchange of texts
    kinds = {"anchor": "long", "d": "long", "lo": "long", "segment": "binary"}

    def cut_out(batch, crowded: bool):
        out: dict[str, list] = {c: [] for c in kinds}
        for d, text, rows in zip(*(batch.column(c).to_pylist() for c in ("d", "text", "asked"))):
            data = text.encode("utf-8", "surrogatepass")
            for r in rows:
                if r["crowd"] == crowded:
                    lo, n = r["place"] >> 8, (r["place"] >> 1 & 127) + 1
                    steps = range(lo, lo + n) if crowded else (lo,)
                    for a in steps:
                        piece = data[a : a + length] if crowded else data[a : a + n + length - 1]
                        key = xxhash.xxh64_intdigest(piece) - (1 << 63) if crowded else r["anchor"]
                        for c, v in zip(kinds, (key, d, a, b"" if crowded else piece)):
                            out[c].append(v)
        return out

    buckets = max(1, -(-int(sums["bytes"] or 0) // BUCKET))
    dealt = map_batches(told, lambda b: cut_out(b, False), kinds, rows=64).withColumn(
        "_bucket", F.pmod(F.xxhash64("anchor"), F.lit(buckets)).cast("int")
    )

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["d", "lo"], kind="stable").reset_index(drop=True)
        d, lo = pdf["d"].to_numpy(), pdf["lo"].to_numpy()
        seg, offset = repeated_windows(pdf["segment"].tolist(), d, lo, length)
        return spans_of(d[seg], lo[seg] + offset, length)

    merged = dealt.groupBy("_bucket").applyInPandas(compare, "d long, a long, b long")

    crowd = told.filter(F.exists("asked", lambda r: r["crowd"]))
    single = map_batches(crowd, lambda b: cut_out(b, True), kinds, rows=64).select(F.col("anchor").alias("window"), "d", "lo")
    eldest = single.groupBy("window").agg(F.min(F.struct("d", "lo")).alias("first"))
    apart = single.join(eldest, "window").filter(F.struct("d", "lo") > F.col("first")).select("d", F.col("lo").alias("a"), (F.col("lo") + length).alias("b"))
    return cut(copies.unionByName(merged).unionByName(apart))


def numbered(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """``docs`` with ``_d``, a number in the order of documents, and its documents (d, text), each once.

    Where all rows have keys of their own, these are the numbers.
    """
    told = F.coalesce(F.col(text), F.lit("")).alias("text")
    keys = docs.groupBy(F.col(key).cast("long").alias("_key")).agg(F.count(F.lit(1)).alias("_n"))
    if not keys.filter((F.col("_n") > 1) | F.col("_key").isNull()).limit(1).count():
        rows = docs.withColumn("_d", F.col(key).cast("long"))
        return rows, rows.select(F.col("_d").alias("d"), told)
    marked = docs.withColumns({"_key": F.col(key).cast("long"), "_h": F.xxhash64(F.coalesce(F.col(text), F.lit("")))})
    order = dense_ids(marked.select("_key", "_h").distinct(), "_d", ["_key", "_h"]).withColumnsRenamed({"_key": "_k", "_h": "_g"})
    same = F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_h") == F.col("_g"))
    rows = marked.join(order, same).select(*docs.columns, "_d")
    return rows, rows.select(F.col("_d").alias("d"), told).dropDuplicates(["d"])


def united(spans: list[dict]) -> list[tuple[int, int]]:
    """Spans in order, those that overlap or touch as one."""
    out: list[list[int]] = []
    for s in sorted((s["a"], s["b"]) for s in spans):
        if out and s[0] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s[1])
        else:
            out.append(list(s))
    return [tuple(s) for s in out]


def with_spans(docs: DataFrame, key: str, text: str, length: int, gram: int) -> DataFrame:
    """``docs`` with ``_spans``, the spans that go from each (a, b; not yet united)."""
    rows, once_each = numbered(docs, key, text)
    spans = marks(once_each, length, gram)
    settle(docs.sparkSession)
    per = spans.groupBy(F.col("d").alias("_d")).agg(F.collect_set(F.struct("a", "b")).alias("_spans"))  # of one document
    return rows.join(per, "_d", "left")


def cut_from(data: bytes, gone: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for s in gone for x in s), len(data)]
    return b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))


def remove(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept) of every document; ``kept`` holds the bytes that stay."""

    def run(batch):
        out = {"key": batch.column("_key"), "n_bytes": [], "n_removed": [], "n_spans": [], "kept": []}
        for t, found in zip(texts(batch, "_text"), batch.column("_spans").to_pylist()):
            data, gone = t.encode("utf-8", "surrogatepass"), united(found or [])
            out["n_bytes"].append(len(data))
            out["n_removed"].append(sum(b - a for a, b in gone))
            out["n_spans"].append(len(gone))
            out["kept"].append(cut_from(data, gone))
        return out

    kinds = {"key": "long", "n_bytes": "long", "n_removed": "long", "n_spans": "long", "kept": "binary"}
    given = with_spans(docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")), "_key", "_text", length, gram)
    return map_batches(given.select(F.col("_key").cast("long").alias("_key"), "_text", "_spans"), run, kinds).withColumnRenamed("key", key)


def clean(docs: DataFrame, key: str = "doc_id", text: str = "text", count: str = "n_chars", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``docs``, all columns, with the repeated bytes cut from the text; ``count``, where there is such a column, counts anew.

    Of a letter of which some bytes went the others go too.  A null text stays null.  Columns may have any names: inside they go by number.
    """
    at = {n: i for i, n in enumerate(docs.columns)}
    plain = docs.toDF(*[f"c{i}" for i in at.values()])
    body, counted = at[text], at.get(count)

    def run(batches):
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, max(batch.num_rows, 1), 256)):
                arrays = list(part.columns)
                kept = [
                    None if t is None else cut_from(t.encode("utf-8", "surrogatepass"), united(found or [])).decode("utf-8", "ignore")
                    for t, found in zip(arrays[body].to_pylist(), arrays.pop().to_pylist())
                ]
                arrays[body] = pa.array(kept, arrays[body].type)
                if counted is not None:
                    arrays[counted] = pa.array([None if t is None else len(t) for t in kept], arrays[counted].type)
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    names = plain.columns
    spans = with_spans(plain, f"c{at[key]}", f"c{body}", length, gram)
    return spans.select(*names, "_spans").mapInArrow(run, plain.schema).toDF(*docs.columns)
