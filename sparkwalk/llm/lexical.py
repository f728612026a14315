"""Ranked lexical search: tiles of queries times tiles of documents as dense matrix products.

The terms of a block of items are a vocabulary of bounded size.  One pass over the documents keeps of each its
length and the vocabulary terms in it; from these come the corpus statistics.  A tile of items holds the
weights of its own terms only (a compact vocabulary), a tile of documents the whole-number impacts of the same
terms, both in float64, and their product gives the scores.  A tile takes only as many terms as keep every
partial sum below 2^53, so BLAS sums are exact in any order; the parts of wider tiles are added as 64-bit integers.
Each task keeps the ``top`` best of every item, equal scores by ascending key; what the tasks keep is ranked
by salted windows until no item has more rows than one task should take.

Statistics cover all documents: N those with a term, L all their terms, n the terms of one, df the documents that hold a term, tf
its occurrences.  w = floor(1000 * ln((2N + 2) / (2df + 1))), m = 50 + 50nN div L, and a score is the sum of
w * (10^9 tf div (1000 tf + 20 m)) over the terms of the item.

Defined results: null and empty texts, and texts without a term, count nowhere and match nothing; an item without a term
has no rows; rows of one item id (null is one id) are one item with all their terms; repeated documents rank
one by one; documents with a null key come after others of equal score; empty tables give an empty result; columns other than key
and text are never read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from sparkwalk.llm.common import map_batches
from sparkwalk.llm.terms import WORDS, count_terms, raw
from sparkwalk.session import counted_cut, cut, discard

#: Bytes of items and terms that one pass may ship to the tasks; more items take more passes.
VOCABULARY = 64 << 20
#: Items, documents and terms of one tile.
ITEMS, DOCUMENTS, COLUMNS = 32, 1024, 4096
#: No impact is larger: 10^9 tf div (1000 tf + 20 m) is below 10^6.
IMPACT = 10**6
EXACT = 1 << 53
#: Rows of one item that one task should rank.
RANKED = 65_536


def item_terms(queries: DataFrame, key: str, text: str) -> DataFrame:
    """(item, term): the terms of each item, once each."""

    def run(batch):
        found = [(k, t) for k, x in zip(batch.column("item").to_pylist(), raw(batch, "text")) for t in count_terms(x, WORDS)]
        return {"item": [k for k, _ in found], "term": [t for _, t in found]}

    asked = queries.select(F.col(key).cast("long").alias("item"), F.col(text).alias("text"))
    return map_batches(asked, run, {"item": "long", "term": "binary"}).distinct()


def blocks(pairs: DataFrame) -> tuple[DataFrame, int]:
    """(block, item, term) and the number of blocks: each is one item, or fits ``VOCABULARY``."""
    stored, seen = counted_cut(pairs, size=F.sum(F.octet_length("term") + 32))
    count = max(1, -(-(seen["size"] or 0) // VOCABULARY))
    while True:
        dealt = stored.withColumn("block", F.pmod(F.xxhash64(F.lit(count), "item"), F.lit(count)).cast("int"))
        per = dealt.groupBy("block").agg(F.sum(F.octet_length("term") + 32).alias("size"), F.countDistinct("item").alias("items"))
        if count == 1 or not per.filter((F.col("size") > VOCABULARY) & (F.col("items") > 1)).limit(1).count():
            return dealt, count
        count *= 2


def found_terms(docs: DataFrame, vocabulary: dict[bytes, int], key: str, text: str) -> DataFrame:
    """(key, n, ids, tfs): the terms of each document that has any, counted, and those of the vocabulary."""

    def run(batch):
        out = {"key": [], "n": [], "ids": [], "tfs": []}
        for k, data in zip(batch.column("key").to_pylist(), raw(batch, "text")):
            counts = count_terms(data, WORDS)
            if not counts:
                continue
            hits = [(vocabulary[t], c) for t, c in counts.items() if t in vocabulary]
            out["key"].append(k)
            out["n"].append(counts.total())
            out["ids"].append([i for i, _ in hits])
            out["tfs"].append([c for _, c in hits])
        return out

    keyed = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    return map_batches(keyed, run, {"key": "long", "n": "long", "ids": "array<int>", "tfs": "array<long>"})


def item_tiles(wanted: list[list[int]], weights: np.ndarray) -> list[tuple[int, list[tuple[np.ndarray, np.ndarray]]]]:
    """(first item, parts) of each tile; a part is (term ids, weights of its items x these terms).

    The terms of a part are few enough for every sum over them to stay below 2^53.
    """
    tiles = []
    for first in range(0, len(wanted), ITEMS):
        lists = wanted[first : first + ITEMS]
        ids = np.unique(np.concatenate([np.asarray(x, dtype=np.int64) for x in lists]))
        room = np.cumsum(weights[ids] * IMPACT)
        cuts, start = [0], 0
        while start < len(ids):
            base = room[start - 1] if start else 0
            stop = min(int(np.searchsorted(room, base + EXACT, side="left")), start + COLUMNS)
            start = max(stop, start + 1)
            cuts.append(start)
        parts = []
        for a, b in zip(cuts, cuts[1:]):
            part = np.zeros((len(lists), b - a))
            for row, x in enumerate(lists):
                at = np.searchsorted(ids[a:b], x)
                inside = (at < b - a) & (ids[a:b][np.minimum(at, b - a - 1)] == x)
                part[row, at[inside]] = weights[np.asarray(x)[inside]]
            parts.append((ids[a:b], part))
        tiles.append((first, parts))
    return tiles


class Best:
    """The ``top`` best rows of each item so far: highest score first, then keys ascending, null keys last."""

    def __init__(self, items: int, top: int):
        self.top, self.items = top, items
        self.floor = np.ones(items, dtype=np.int64)  # a row below it cannot be among the best
        self.kept: list[tuple[np.ndarray, ...]] = []
        self.waiting = 0

    def offer(self, first: int, scores: np.ndarray, keys: np.ndarray, missing: np.ndarray) -> None:
        rows, item = np.nonzero(scores >= self.floor[first : first + scores.shape[1]])
        if len(rows):
            self.kept.append((item + first, scores[rows, item], missing[rows], keys[rows]))
            self.waiting += len(rows)
            if self.waiting > 4 * self.top * self.items + 65_536:
                self.prune()

    def prune(self) -> None:
        if not self.kept:
            return
        item, score, missing, key = (np.concatenate(c) for c in zip(*self.kept))
        order = np.lexsort((key, missing, -score, item))
        item = item[order]
        nth = np.arange(len(item)) - np.searchsorted(item, item)
        order, last = order[nth < self.top], order[nth == self.top - 1]
        self.kept = [tuple(c[order] for c in (np.concatenate(c) for c in zip(*self.kept)))]
        self.waiting = len(order)
        whole = tuple(np.concatenate(c) for c in zip(*self.kept))
        full = np.bincount(whole[0], minlength=self.items) >= self.top
        if len(last):
            worst = np.full(self.items, np.iinfo(np.int64).max)
            np.minimum.at(worst, whole[0], whole[1])
            self.floor = np.where(full, np.maximum(worst, 1), self.floor)

    def rows(self) -> tuple[np.ndarray, ...]:
        self.prune()
        empty = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))
        return self.kept[0] if self.kept else empty


def best_rows(found: DataFrame, tiles: list, items: int, terms: int, n_docs: int, n_terms: int, top: int) -> DataFrame:
    """(item number, key, score): the ``top`` best documents of each item in each task."""
    schema = pa.schema([("item", pa.int64()), ("key", pa.int64()), ("score", pa.int64())])

    def scores(parts, ids, row, impact, column):
        """(rows with a term of the tile, their scores)."""
        used = [np.flatnonzero(np.isin(ids, part_ids)) for part_ids, _ in parts]
        hit = np.unique(row[np.concatenate(used)])
        if not len(hit):
            return hit, None
        total = np.zeros((len(hit), parts[0][1].shape[0]), dtype=np.int64)
        for at, (part_ids, weights) in zip(used, parts):
            column[part_ids] = np.arange(len(part_ids))
            dense = np.zeros((len(hit), len(part_ids)))
            dense[np.searchsorted(hit, row[at]), column[ids[at]]] = impact[at]
            total += (dense @ weights.T).astype(np.int64)
        return hit, total

    def run(batches):
        best, column = Best(items, top), np.zeros(terms, dtype=np.int64)
        for batch in (b.slice(i, DOCUMENTS) for b in batches for i in range(0, b.num_rows, DOCUMENTS)):
            lists = batch.column("ids")
            ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            tf = batch.column("tfs").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(batch.num_rows), pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False))
            n = batch.column("n").to_numpy(zero_copy_only=False).astype(np.int64)
            m = 50 + 50 * n * n_docs // n_terms
            impact = 10**9 * tf // (1000 * tf + 20 * m[row])
            missing = batch.column("key").is_null().to_numpy(zero_copy_only=False)
            keys = batch.column("key").fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for first, parts in tiles:
                hit, total = scores(parts, ids, row, impact, column)
                if len(hit):
                    best.offer(first, total, keys[hit], missing[hit])
        item, score, missing, key = best.rows()
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(key, mask=missing), pa.array(score)], schema=schema)

    return found.select("key", "n", "ids", "tfs").filter(F.size("ids") > 0).mapInArrow(run, "item long, key long, score long")


def ranked(rows: DataFrame, top: int) -> DataFrame:
    """(item, key, score, rank) of the ``top`` rows of each item, no task taking a whole crowded item at once."""
    order = [F.col("score").desc(), F.col("key").asc_nulls_last()]
    while True:
        rows, _ = counted_cut(rows)
        most = rows.groupBy("item").count().agg(F.max("count")).first()[0] or 0
        if most <= max(RANKED, 2 * top):
            break
        salts = -(-most // max(RANKED, 2 * top))
        salt = F.pmod(F.xxhash64("key", "score"), F.lit(salts))
        window = Window.partitionBy("item", "_salt").orderBy(*order)
        rows = rows.withColumn("_salt", salt).withColumn("_nth", F.row_number().over(window)).filter(F.col("_nth") <= top).drop("_salt", "_nth")
    window = Window.partitionBy("item").orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= top)


def search(
    docs: DataFrame, queries: DataFrame, key: str = "doc_id", text: str = "text", query_key: str = "item_id", query_text: str = "text", top: int = 50
) -> DataFrame:
    """(query_key, rank, key, score): the ``top`` documents of each query with a score above 0."""
    pairs, count = blocks(item_terms(queries, query_key, query_text))
    spark, out = docs.sparkSession, None
    for block in range(count):
        # bounded by VOCABULARY bytes, or one item
        asked = pairs.filter(F.col("block") == block).select("item", "term").collect()
        names = sorted({r.item for r in asked}, key=lambda k: (k is None, k or 0))
        terms = {t: i for i, t in enumerate(sorted({bytes(r.term) for r in asked}))}
        wanted: dict = {k: [] for k in names}
        for r in asked:
            wanted[r.item].append(terms[bytes(r.term)])
        found, seen = counted_cut(found_terms(docs, terms, key, text), length=F.sum("n"))
        n_docs, n_terms = seen["n"], seen["length"] or 0
        held = np.zeros(len(terms), dtype=np.int64)
        for r in found.select(F.explode("ids").alias("id")).groupBy("id").count().collect():  # one row a term of the block
            held[r["id"]] = r["count"]
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in held], dtype=np.int64)
        tiles = item_tiles([sorted(wanted[k]) for k in names], weights) if names else []
        rows = cut(best_rows(found, tiles, len(names), len(terms), n_docs, max(n_terms, 1), top))
        discard(found)
        ids = spark.createDataFrame(list(enumerate(names)), "item long, name long")
        part = ranked(rows, top).join(ids, "item").select(F.col("name").alias(query_key), "rank", F.col("key").alias(key), "score")
        out = part if out is None else out.unionByName(part)
    return out
