"""Near-duplicate vectors by a subspace pigeonhole join.

Unit vectors are rotated by a fixed random rotation and their coordinates, as whole numbers, cut into low-dimensional
blocks.  If two vectors lie within a squared distance, then in at least one block they lie within the share of it that is
proportional to the block's dimensions.  So every block is joined by range in its own subspace: a tree of median splits
deals the points to leaves, a point near a split also visits the leaves on the other side, and pairs found within a leaf
are the candidates.  Each candidate is verified once, in the first block and the lowest leaf that hold it, by the cosine of
the given vectors in double precision.  Block distances are sums of whole numbers below 2^53, exact in any order, so all tasks
agree on which block is the first.

Equal vectors of one label are one point with a count.  Tasks report per point the number of links and the least point
linked to it within the task, never the pairs; a spanning forest of all links gives the components.  A leaf with more points than a
tile (such as one large group of near copies) is cut into tiles, and each pair of tiles is a task of its own.

The trees are fitted on at most ``2 * SAMPLE`` vectors, by hash; every vector is dealt, so no link depends on the sample.  A label goes down
its tree only as far as its own number of points needs.

Defined results: vectors that are null, empty, zero, or hold a null or a number that is not finite link with nothing, and so do rows without a
label, and vectors of different lengths with each other; repeated rows link with each other; null keys are never a
component's name unless all its keys are null (then it is null, and all its rows count as kept); an empty table gives an empty
result; columns other than key, vector and label are never read.
"""

from __future__ import annotations

import functools
import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sparkwalk.llm.simhash import unite
from sparkwalk.operators.components import connected_components
from sparkwalk.operators.skew import skew_join
from sparkwalk.session import cut, discard

SEED = 42
#: Dimensions of a block; vectors the trees are fitted on; points of a tile, and the aim for a leaf; rows compared at once.
DIMENSIONS, SAMPLE, TILE, STRIP = 8, 20_000, 4_096, 256
#: Rotated coordinates are multiples of 2^-14.
UNIT = 1 << 14


@functools.cache
def rotation(size: int) -> np.ndarray:
    """A random rotation (or reflection) of that many dimensions, the same in every process."""
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def block_slices(size: int) -> list[tuple[int, int]]:
    return [(a, min(a + DIMENSIONS, size)) for a in range(0, size, DIMENSIONS)]


def reach(size: int, block: int, cosine: float) -> int:
    """The distance in a block, in units, within which a pair at the cosine must lie in at least one block.

    The squared distance of unit vectors is 2 - 2 cos; a block gets its dimensions' share.  Rounding moves a
    coordinate by at most half a unit, a block distance by at most the root of its dimensions; one unit more covers doubles.
    """
    a, b = block_slices(size)[block]
    radius = math.sqrt(max(0.0, 2 - 2 * cosine) * (b - a) / size)
    return math.ceil(radius * UNIT + math.sqrt(b - a) + 1)


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; first by their largest entry, so that no square overflows."""
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def rotated(vectors: np.ndarray) -> np.ndarray:
    """Whole-number coordinates of the rotated unit vectors."""
    return np.rint(unit_rows(vectors) @ rotation(vectors.shape[1]) * UNIT).astype(np.int16)


# ---- points ----------------------------------------------------------------------------------


def signed(rows: DataFrame, kind: str) -> DataFrame:
    """Rows (key, vector, label) with ``size`` and ``digest`` of the vector (null where it links with nothing) and its rotated ``coords``."""
    schema = pa.schema([
        ("key", pa.int64()), ("label", pa.string()), ("size", pa.int32()), ("digest", pa.binary()), ("vector", pa.list_(pa.float64() if kind == "double" else pa.float32())),
        ("coords", pa.list_(pa.int16())),
    ])

    def run(batches):
        for batch in batches:
            keys, labels, given = (batch.column(c) for c in ("key", "label", "vector"))
            digests, sizes, coords, vectors = [], [], [None] * len(given), []
            by_size: dict[int, list[tuple[int, np.ndarray]]] = {}
            for i, (vector, label) in enumerate(zip(given, labels)):
                x = vector.values
                sound = x is not None and len(x) and not x.null_count and label.is_valid
                if sound:
                    x = x.to_numpy(zero_copy_only=False) + 0.0  # no negative zeros: equal vectors have equal bytes
                    sound = np.isfinite(x).all() and x.any()
                digests.append(hashlib.sha256(x.tobytes()).digest()[:16] if sound else None)
                sizes.append(len(x) if sound else None)
                vectors.append(x if sound else None)
                if sound:
                    by_size.setdefault(len(x), []).append((i, x))
            for some in by_size.values():
                for (i, _), row in zip(some, rotated(np.stack([x for _, x in some]).astype(np.float64))):
                    coords[i] = row
            columns = [keys, labels, sizes, digests, vectors, coords]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return rows.mapInArrow(run, f"key long, label string, size int, digest binary, vector array<{kind}>, coords array<short>")


# ---- trees -----------------------------------------------------------------------------------


def fit(sample: np.ndarray, depth: int) -> dict[int, tuple[int, int]]:
    """Median splits of the widest coordinate: node -> (coordinate, largest value of the lower side); children of k are 2k and 2k + 1."""
    tree: dict[int, tuple[int, int]] = {}

    def grow(node: int, points: np.ndarray, left: int) -> None:
        if not left or len(points) < 2:
            return
        spread = np.percentile(points, 90, axis=0) - np.percentile(points, 10, axis=0)
        at = int(spread.argmax())
        values = np.sort(points[:, at])
        if values[0] == values[-1]:
            return
        cut_at = int(values[(len(values) - 1) // 2])
        if cut_at == values[-1]:
            cut_at = int(values[values < cut_at][-1])
        tree[node] = (at, cut_at)
        low = points[:, at] <= cut_at
        grow(2 * node, points[low], left - 1)
        grow(2 * node + 1, points[~low], left - 1)

    grow(1, sample, depth)
    return tree


def deal(tree: dict, points: np.ndarray, depth: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, leaf, home): each point's own leaf, and the lower ones in which a point within ``radius`` may lie.

    Pairs across leaves are found in the lower one only, so no point visits a higher one.
    """
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def go(node: int, level: int, rows: np.ndarray, home: np.ndarray) -> None:
        if not len(rows):
            return
        done = depth[rows] <= level
        if node not in tree:
            done = np.ones(len(rows), dtype=bool)
        if done.any():
            out.append((rows[done], np.full(done.sum(), node), home[done]))
            rows, home = rows[~done], home[~done]
        if not len(rows):
            return
        at, cut_at = tree[node]
        x = points[rows, at].astype(np.int64)
        low = x <= cut_at
        visits_low = np.where(home, low, x <= cut_at + radius)  # a visitor looks everywhere within reach
        visits_high = np.where(home, ~low, x > cut_at - radius)
        across = home & ~low & (x <= cut_at + radius)
        go(2 * node, level + 1, np.concatenate([rows[visits_low], rows[across]]), np.concatenate([home[visits_low], np.zeros(across.sum(), bool)]))
        go(2 * node + 1, level + 1, rows[visits_high], home[visits_high])

    go(1, 0, np.arange(len(points)), np.ones(len(points), dtype=bool))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0, bool))


def leaves(points: DataFrame, cosine: float) -> DataFrame:
    """(label, size, block, leaf, home, point, copies, vector, coords) of all points; ``points`` has a ``depth`` as well."""
    total = points.count()
    share = min(1.0, SAMPLE / max(total, 1))
    picked = points.filter(F.pmod(F.xxhash64(F.lit(SEED), "point"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    picked = picked.select("size", "coords").limit(2 * SAMPLE).collect()  # fits the trees only; every point is dealt
    deepest = points.agg(F.max("depth")).first()[0] or 0
    trees: dict[int, list[dict]] = {}
    for size in {r["size"] for r in picked}:
        sample = np.array([r["coords"] for r in picked if r["size"] == size], dtype=np.int64)
        trees[size] = [fit(sample[:, a:b], deepest) for a, b in block_slices(size)]

    def run(batches):
        for batch in batches:
            sizes = batch.column("size").to_numpy(zero_copy_only=False)
            depth = batch.column("depth").to_numpy(zero_copy_only=False)
            for size in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == size)
                coords = np.stack([c.values.to_numpy(zero_copy_only=False) for c in batch.column("coords").take(pa.array(rows))])
                for block, (a, b) in enumerate(block_slices(size)):
                    tree = trees[size][block] if size in trees else {}
                    row, leaf, home = deal(tree, coords[:, a:b], depth[rows], reach(size, block, cosine))
                    for i in range(0, len(row), 2048):
                        part = slice(i, i + 2048)
                        taken = batch.select(["label", "size", "point", "copies", "vector", "coords"]).take(pa.array(rows[row[part]]))
                        named = {"block": pa.array(np.full(taken.num_rows, block, np.int32)), "leaf": pa.array(leaf[part].astype(np.int64)), "home": pa.array(home[part])}
                        yield pa.RecordBatch.from_arrays([*taken.columns, *named.values()], names=[*taken.schema.names, *named])

    kind = dict(points.dtypes)["vector"]
    return points.select("label", "size", "depth", "point", "copies", "vector", "coords").mapInArrow(
        run, f"label string, size int, point long, copies long, vector {kind}, coords array<short>, block int, leaf long, home boolean"
    )


# ---- pairs -----------------------------------------------------------------------------------


def task_links(pdf: pd.DataFrame, cosine: float) -> pd.DataFrame:
    """(point, links, other): links found in one pair of tiles of a leaf, counted, and the least point reached by them.

    Rows of ``side`` 0 are the first tile's homes, those of side 1 all of the second tile; where both are one tile, side 1 are its visitors.
    """
    pdf = pdf.sort_values("point", kind="stable")
    size, block, same = int(pdf["size"].iloc[0]), int(pdf["block"].iloc[0]), bool((pdf["s"] == pdf["t"]).iloc[0])
    side = pdf["side"].to_numpy()
    points, copies = pdf["point"].to_numpy(), pdf["copies"].to_numpy()
    q = np.stack(pdf["coords"].to_numpy()).astype(np.float64)
    units = unit_rows(np.stack(pdf["vector"].to_numpy()).astype(np.float64))
    spans = block_slices(size)
    limits = [reach(size, k, cosine) ** 2 for k in range(len(spans))]
    a, b = spans[block]
    own = q[:, a:b]
    squares = (own * own).sum(axis=1)
    order = np.argsort(own[:, 0], kind="stable")  # a band along the first coordinate
    homes = order[side[order] == 0]
    radius = reach(size, block, cosine)
    links, label = np.zeros(len(points), dtype=np.int64), np.arange(len(points))
    others = order if same else order[side[order] == 1]
    x = own[others, 0]
    for i in range(0, len(homes), STRIP):
        strip = homes[i : i + STRIP]
        first = np.searchsorted(x, own[strip[0], 0] - radius)
        last = np.searchsorted(x, own[strip[-1], 0] + radius, side="right")
        band = others[first:last]
        if not len(band):
            continue
        near = squares[strip][:, None] + squares[band][None, :] - 2 * (own[strip] @ own[band].T) <= limits[block]
        if same:  # each pair of homes once, and homes with visitors
            near &= (side[band] == 1)[None, :] | (strip[:, None] < band[None, :])
        u, v = np.nonzero(near)
        u, v = strip[u], band[v]
        for k in range(0, len(u), 32_768):
            c, d = u[k : k + 32_768], v[k : k + 32_768]
            for e in range(block):  # pairs of an earlier block are verified there
                diff = q[c, spans[e][0] : spans[e][1]] - q[d, spans[e][0] : spans[e][1]]
                later = (diff * diff).sum(axis=1) > limits[e]
                c, d = c[later], d[later]
            alike = (units[c] * units[d]).sum(axis=1) >= cosine
            c, d = c[alike], d[alike]
            np.add.at(links, c, copies[d])
            np.add.at(links, d, copies[c])
            unite(label, c, d)
    told = links > 0
    return pd.DataFrame({"point": points[told], "links": links[told], "other": points[label[told]]})


def found_links(dealt: DataFrame, cosine: float) -> DataFrame:
    """(point, links, other) over all leaves; crowded leaves are cut into tiles and each pair of tiles is a task."""
    leaf = ["label", "size", "block", "leaf"]
    crowd = dealt.groupBy(*leaf).agg(F.count(F.lit(1)).alias("n"), F.count_if("home").alias("homes")).filter("homes > 0 and n > 1")
    crowd = cut(crowd.select(*leaf, F.ceil(F.col("n") / TILE).cast("int").alias("tiles")))
    tiled = dealt.join(crowd, leaf)  # a leaf without homes, or of one row, holds no pair
    tile = F.pmod(F.xxhash64(F.lit(SEED), "point"), "tiles").cast("int")
    tiled = tiled.withColumn("tile", tile)
    # a home of tile k: side 0 of (k, t) for all t, and side 1 of (s, k) for s below k; a visitor: side 1 of (s, k) for all s
    pairs = lambda s, t, side: F.struct(s.cast("int").alias("s"), t.cast("int").alias("t"), F.lit(side).alias("side"))
    k, every = F.col("tile"), F.sequence(F.lit(0), F.col("tiles") - 1)
    as_first = F.transform(every, lambda t: pairs(k, t, 0))
    below = F.filter(every, lambda s: s < k)
    visits = F.when(F.col("home"), F.concat(as_first, F.transform(below, lambda s: pairs(s, k, 1)))).otherwise(F.transform(every, lambda s: pairs(s, k, 1)))
    tasks = tiled.select(*leaf, "point", "copies", "vector", "coords", F.inline(visits))
    return tasks.groupBy(*leaf, "s", "t").applyInPandas(lambda pdf: task_links(pdf, cosine), "point long, links long, other long")


def near_duplicates(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = 0.98
) -> DataFrame:
    """(key, n_links, component_id, kept) of every row: its links of at least that cosine within its label, and the least key it reaches."""
    if not 0 < cosine <= 1:
        raise ValueError("cosine must lie in (0, 1]")
    given = vectors.select(F.col(key).cast("long").alias("key"), F.col(vector).alias("vector"), F.col(label).cast("string").alias("label"))
    kind = "float" if dict(given.dtypes)["vector"] == "array<float>" else "double"
    rows = signed(given.withColumn("vector", F.col("vector").cast(f"array<{kind}>")), kind)
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()))
    same = ["label", "size", "digest"]
    points = rows.filter("digest is not null").groupBy(*same).agg(
        F.min("key").alias("least"), F.count(F.lit(1)).alias("copies"), F.min("row").alias("point"), F.first("vector").alias("vector"), F.first("coords").alias("coords")
    )
    points = cut(points)
    counts = points.groupBy("label", "size").agg(F.count(F.lit(1)).alias("n"))
    deep = F.ceil(F.log2(F.greatest(2 * F.col("n") / TILE, F.lit(1.0)))).cast("int")  # homes and visitors of a leaf about fill a tile
    dealt = cut(leaves(cut(skew_join(points, counts.select("label", "size", deep.alias("depth")), ["label", "size"])), cosine))
    found = cut(found_links(dealt, cosine))
    discard(dealt)
    forest = found.filter("point <> other").select(F.col("point").alias("src_vid"), F.col("other").alias("trg_vid"))
    parts = connected_components(forest.distinct()).withColumnRenamed("vid", "point")
    more = found.groupBy("point").agg(F.sum("links").alias("links"))
    of = points.select(*same, "point", "least", "copies").join(more, "point", "left").join(parts, "point", "left")
    of = cut(of.withColumn("cid", F.coalesce("cid", "point")))
    names = of.groupBy("cid").agg(F.min("least").alias("component"))
    told = skew_join(of, names, ["cid"]).select(*same, (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component")
    linked = skew_join(rows.filter("digest is not null").select("key", *same), told, same)
    alone = rows.filter("digest is null").select("key", F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component"))
    out = linked.select("key", "n_links", "component").unionByName(alone)
    return out.select(F.col("key").alias(key), "n_links", F.col("component").alias("component_id"), F.col("key").eqNullSafe(F.col("component")).alias("kept"))
