"""Near-duplicate vectors against all pairs by brute force."""

import math

import numpy as np
import pytest
from llm.sql import same

from sparkwalk.llm import embeddings, queries

FOLDER = "/root/testdata/sf0.01"


def plain(rows, cosine=0.98):
    """(key, links, least key reached, kept) of each row, all pairs of each label compared."""
    sound = []
    for _, x, label in rows:
        ok = label is not None and x and all(v is not None and math.isfinite(v) for v in x) and any(x)
        sound.append(np.array(x, dtype=np.float64) if ok else None)
    near = [[] for _ in rows]
    for i, a in enumerate(sound):
        for j in range(i):
            b = sound[j]
            if a is None or b is None or rows[i][2] != rows[j][2] or len(a) != len(b):
                continue
            if a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= cosine:
                near[i].append(j)
                near[j].append(i)
    group = [None] * len(rows)
    for i in range(len(rows)):
        if group[i] is None:
            group[i], todo = i, [i]
            while todo:
                for j in near[todo.pop()]:
                    if group[j] is None:
                        group[j] = i
                        todo.append(j)
    least = {}
    for i, g in enumerate(group):
        if rows[i][0] is not None:
            least[g] = min(least.get(g, rows[i][0]), rows[i][0])
    return [(rows[i][0], len(near[i]), least.get(g), rows[i][0] == least.get(g)) for i, g in enumerate(group)]


def check(spark, rows, kind="float"):
    df = spark.createDataFrame([(k, x, label, 1, None) for k, x, label in rows], f"vec_id long, embedding array<{kind}>, label int, point long, leaf string")
    got = [tuple(r) for r in embeddings.near_duplicates(df.repartition(4)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, plain(rows)))
    return df


def clouds(rng, size, groups, noise):
    """Groups of near copies, chains among them, whose cosines lie around the bound."""
    rows = []
    for _ in range(groups):
        centre = rng.standard_normal(size)
        for _ in range(int(rng.integers(1, 30))):
            x = centre + noise * rng.standard_normal(size)
            rows.append((len(rows), (x * rng.uniform(0.1, 9)).astype(np.float32).tolist(), int(rng.integers(0, 2))))
    return rows


def test_query_equals_sql(spark):
    assert same(queries.op13_embeddings, queries.OP13_SQL, spark, FOLDER) == 500


@pytest.mark.parametrize("size, tile", [(64, 4096), (64, 24), (11, 24), (3, 16), (1, 8)])
def test_no_link_is_lost(monkeypatch, spark, size, tile):
    """Leaves far smaller than the groups: many tiles, visitors on both sides."""
    for name, value in {"TILE": tile, "STRIP": 5, "SAMPLE": 300}.items():
        monkeypatch.setattr(embeddings, name, value)
    rng = np.random.default_rng(size)
    rows = clouds(rng, size, 30, 0.14)
    assert sum(n for _, n, _, _ in plain(rows)) > len(rows)
    check(spark, rows)


def test_odd_rows(monkeypatch, spark):
    monkeypatch.setattr(embeddings, "TILE", 4)
    nan, inf = float("nan"), float("inf")
    one, two = [1.0, 0.5, -0.0], [1.0, 0.5, 0.0]
    rows = [
        (1, one, 1), (9, two, 1), (9, two, 1), (4, one, 2), (5, one, None), (6, None, 1), (7, [], 1), (8, [0.0, 0.0, 0.0], 1), (10, [1.0, None, 2.0], 1),
        (11, [nan, 1.0, 0.0], 1), (12, [inf, 1.0, 0.0], 1), (13, [2.0, 1.0, 0.0], 1), (14, [1.0, 0.5], 1), (None, [0.0, 0.0, 1.0], 3),
        (None, [0.0, 0.0, 2.0], 3), (None, [1.0, 0.5, 0.01], 1), (2, [-1.0, -0.5, 0.0], 1), (15, [1e30, 5e29, 0.0], 1), (16, [1e-30, 5e-31, 0.0], 1),
    ] + [(100 + i, [0.1, 0.2, 0.3], 4) for i in range(40)]
    df = check(spark, rows, "double")
    check(spark, rows, "float")
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_blocks_hold_every_pair():
    """Pigeonhole: of two vectors within the bound, some block holds the pair within its share."""
    rng = np.random.default_rng(0)
    for size in (5, 8, 64, 100):
        x = rng.standard_normal((4000, size))
        y = x + 0.2 * rng.standard_normal((4000, size)) * rng.uniform(0, 1.2, (4000, 1))
        cos = (embeddings.unit_rows(x) * embeddings.unit_rows(y)).sum(axis=1)
        p, q = (embeddings.rotated(v).astype(np.int64) for v in (x, y))
        found = np.zeros(4000, bool)
        for k, (a, b) in enumerate(embeddings.block_slices(size)):
            found |= ((p[:, a:b] - q[:, a:b]) ** 2).sum(axis=1) <= embeddings.reach(size, k, 0.98) ** 2
        assert (cos >= 0.98).sum() > 100 and found[cos >= 0.98].all()
