"""SimHash near-duplicates by vantage-point trees over Hamming distance.

A fingerprint is the majority vote of the 64-bit hashes of a text's word shingles.  Equal
fingerprints are one point.  A tree of vantage points, fitted on a bounded sample, splits the
points into shards: inside or outside a ball around each vantage point.  By the triangle
inequality a point within ``radius`` of a ball's surface may have neighbours on both sides, so it
also visits the shard across; within a shard a second tree, down to small leaves, is searched by the
same bounds.  A shard reports a spanning forest of the links it finds, never the pairs themselves, and
the components of all forests are found by contraction.

Defined results: a null or wordless text has fingerprint zero and links like any other; a text of
fewer words than a shingle is one shingle; rows repeated with the same key come out as often as they
went in; an empty table gives an empty result; columns other than key and text are ignored.  A row with
a null key joins the component of its fingerprint if a keyed row has the same one, else its component is null.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from sparkwalk.llm.common import map_batches, texts
from sparkwalk.operators.components import connected_components
from sparkwalk.session import counted_cut, cut

SEED = 42
#: Points at the vantage-point tree's fitting, the aim for a shard, and the size of a leaf in it.
SAMPLE, SHARD, LEAF = 20_000, 8_192, 64


def fingerprint(text: str, words_per_shingle: int = 3) -> int:
    """64-bit SimHash of the lower-cased text's shingles; a bit is set if in over half of the hashes."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - words_per_shingle + 1)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    stops = ends[min(words_per_shingle, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops)], dtype="<u8")
    votes = np.zeros(64, dtype=np.int64)
    for i in range(0, n, 4096):  # blocks, so a very long text needs no more memory than a short one
        block = hashes[i : i + 4096]
        votes += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words_per_shingle: int = 3) -> DataFrame:
    """(key, fp): the fingerprint as a signed long."""

    def run(batch):
        fps = np.array([fingerprint(t, words_per_shingle) for t in texts(batch, "text")], dtype=np.uint64)
        return {"key": batch.column("key"), "fp": fps.view(np.int64)}

    keyed = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    return map_batches(keyed, run, {"key": "long", "fp": "long"}).withColumnRenamed("key", key)


# ---- vantage-point trees -------------------------------------------------------------------


def distance(points: np.ndarray, vantage) -> np.ndarray:
    return np.bitwise_count(points ^ vantage).astype(np.int16)


def split(points: np.ndarray, rng: random.Random) -> tuple | None:
    """A vantage point and a radius that leave points on both sides, as evenly as a few tries find."""
    best = None
    for _ in range(8):
        vantage = points[rng.randrange(len(points))]
        d = np.sort(distance(points, vantage))
        r = int(d[(len(d) - 1) // 2])
        for radius in (r, r - 1):  # the median may be the largest distance
            inside = int(np.searchsorted(d, radius, side="right"))
            if 0 < inside < len(d) and (best is None or abs(2 * inside - len(d)) < best[0]):
                best = (abs(2 * inside - len(d)), vantage, radius)
    return best and best[1:]


def shard_tree(sample: np.ndarray, leaves: int, seed: int = SEED):
    """A tree of at most about ``leaves`` shards: (vantage, radius, inside, outside) or a shard number."""
    rng, count = random.Random(seed), 0

    def grow(points: np.ndarray, want: int):
        nonlocal count
        cutting = split(points, rng) if want > 1 and len(points) > 1 else None
        if cutting is None:
            count += 1
            return count - 1
        vantage, radius = cutting
        near = distance(points, vantage) <= radius
        return vantage, radius, grow(points[near], (want + 1) // 2), grow(points[~near], want // 2)

    return grow(sample, leaves), count


def visits(tree, points: np.ndarray, slack: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shard, home): each point's own shard, and those in which a point within ``slack`` may lie."""
    out: list[tuple[np.ndarray, int, np.ndarray]] = []

    def go(node, rows: np.ndarray, home: np.ndarray) -> None:
        if not len(rows):
            return
        if isinstance(node, int):
            out.append((rows, node, home))
            return
        vantage, radius, inside, outside = node
        d = distance(points[rows], vantage)
        near = d <= radius
        a, b = d <= radius + slack, d > radius - slack
        go(inside, rows[a], home[a] & near[a])
        go(outside, rows[b], home[b] & ~near[b])

    go(tree, np.arange(len(points)), np.ones(len(points), dtype=bool))
    if not out:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0, bool)
    return (
        np.concatenate([r for r, _, _ in out]),
        np.concatenate([np.full(len(r), s) for r, s, _ in out]),
        np.concatenate([h for _, _, h in out]),
    )


def unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Make the ends of all pairs share the least label (hook roots, then flatten, until nothing changes)."""
    while True:
        x, y = label[a], label[b]
        differ = x != y
        if not differ.any():
            return
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            flat = label[label]
            if np.array_equal(flat, label):
                break
            label[:] = flat


def forest(points: np.ndarray, home: np.ndarray, slack: int, seed: int = SEED) -> np.ndarray:
    """For each point the least index linked to it through links with at least one end at home."""
    label, rng = np.arange(len(points)), random.Random(seed)

    def leaf(members: np.ndarray, queries: np.ndarray) -> None:
        for i in range(0, len(queries), 4096):
            q = queries[i : i + 4096]
            close = np.bitwise_count(points[q][:, None] ^ points[members][None, :]) <= slack
            x, y = np.nonzero(close)
            unite(label, q[x], members[y])

    def search(members: np.ndarray, queries: np.ndarray) -> None:
        if not len(members) or not len(queries):
            return
        cutting = split(points[members], rng) if len(members) > LEAF else None
        if cutting is None:
            for i in range(0, len(members), LEAF):
                leaf(members[i : i + LEAF], queries)
            return
        vantage, radius = cutting
        near, d = distance(points[members], vantage) <= radius, distance(points[queries], vantage)
        search(members[near], queries[d <= radius + slack])
        search(members[~near], queries[d > radius - slack])

    search(np.flatnonzero(home), np.arange(len(points)))
    return label


# ---- the join ------------------------------------------------------------------------------


def links(points: DataFrame, n: int, slack: int) -> DataFrame:
    """(src_vid, trg_vid): a spanning forest of the links between the points (rep, fp), shard by shard."""
    share = min(1.0, SAMPLE / max(n, 1))
    sample = points.filter(F.pmod(F.xxhash64(F.lit(SEED), "fp"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    picked = sample.select("fp").orderBy("fp").limit(2 * SAMPLE).collect()  # fits the tree only; every point is searched
    fitted = np.array([r[0] for r in picked], dtype=np.int64).view(np.uint64)
    tree, shards = shard_tree(fitted, -(-n // SHARD)) if len(fitted) else (0, 1)

    def deal(batch):
        fp = batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64)
        rep = batch.column("rep").to_numpy(zero_copy_only=False)
        rows, shard, home = visits(tree, fp.view(np.uint64), slack)
        return {"shard": shard, "rep": rep[rows], "fp": fp[rows], "home": home}

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rep", kind="stable")
        rep = pdf["rep"].to_numpy()
        label = forest(pdf["fp"].to_numpy().astype(np.int64).view(np.uint64), pdf["home"].to_numpy(), slack)
        other = label != np.arange(len(label))
        return pd.DataFrame({"src_vid": rep[other], "trg_vid": rep[label[other]]})

    dealt = map_batches(points.select("rep", "fp"), deal, {"shard": "int", "rep": "long", "fp": "long", "home": "boolean"})
    return dealt.groupBy("shard").applyInPandas(search, "src_vid long, trg_vid long")


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", words_per_shingle: int = 3, max_bits: int = 2
) -> DataFrame:
    """(key, fp, component): the component is the least key reachable over links of ``max_bits`` bits at most."""
    prints = cut(fingerprints(docs, key, text, words_per_shingle).withColumnRenamed(key, "_key"))
    points, seen = counted_cut(prints.groupBy("fp").agg(F.min("_key").alias("rep")))
    named = points.filter(F.col("rep").isNotNull())
    unnamed = points.filter(F.col("rep").isNull()).select("fp", F.lit(None).cast("long").alias("component"))
    parts = connected_components(cut(links(named, seen["n"], max_bits)))
    classes = (
        named.join(parts.withColumnRenamed("vid", "rep"), "rep", "left")
        .select("fp", F.coalesce("cid", "rep").alias("component"))
        .unionByName(unnamed)
    )
    return prints.join(cut(classes), "fp").select(F.col("_key").alias(key), "fp", "component")
