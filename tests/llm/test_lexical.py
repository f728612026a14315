"""Ranked lexical search against SQL on the tables and a plain program on odd rows and small tiles."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from llm.sql import same

from sparkwalk.llm import lexical, queries, terms

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, score long, term string"


def plain(docs, items, top):
    """Rows (item, rank, key, score) by the definition, one document and one item at a time."""
    split = lambda t: re.findall("[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    counted = [(k, Counter(split(t))) for k, t in docs]
    counted = [(k, c) for k, c in counted if c]
    big_n, big_l = len(counted), sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    wanted = {}
    for k, t in items:
        wanted.setdefault(k, set()).update(split(t))
    out = []
    for item, ts in wanted.items():
        rows = []
        for k, c in counted:
            m = 50 + 50 * c.total() * big_n // big_l
            score = sum(
                math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in ts if t in c
            )
            if score > 0:
                rows.append((-score, k is None, k or 0))
        out += [(item, i + 1, None if none else k, -s) for i, (s, none, k) in enumerate(sorted(rows)[:top])]
    return out


def test_query_equals_sql(spark):
    assert same(queries.op11_lexical, queries.OP11_SQL, spark, FOLDER) > 1000


def odd():
    rng = np.random.default_rng(5)
    word = lambda: "w%d" % min(rng.zipf(1.4), 300)
    docs = [(i, " ".join(word() for _ in range(int(rng.integers(0, 60))))) for i in range(300)]
    docs += [(i, "Tied tied Ünïcode-x") for i in (900, 903, 901, 902, None, None)]  # ties and null keys
    docs += [(1, docs[1][1]), (1, docs[1][1]), (None, None), (7, ""), (8, " \t.,"), (2000, "w1 w2 long " * 9_000)]
    items = [(0, "w1 W2 w2 w299 tied"), (1, "ünïcode Ünïcode x"), (2, None), (3, ""), (4, "unknown words"), (None, "w3"), (None, "w4 w5"), (5, "w6"), (5, "w7")]
    return docs, items


@pytest.mark.parametrize("small", [False, True])
def test_odd_rows(monkeypatch, spark, small):
    docs, items = odd()
    if small:  # tiles of one or two terms, a block an item, heaps pruned all the time, rank windows salted, texts in pieces
        for name, value in {"VOCABULARY": 250, "ITEMS": 2, "DOCUMENTS": 7, "COLUMNS": 2, "EXACT": 20_000 * 10**6, "RANKED": 30}.items():
            monkeypatch.setattr(lexical, name, value)
        monkeypatch.setattr(terms, "PIECE", 100)
    df = spark.createDataFrame([(k, t, 1, "x") for k, t in docs], SCHEMA).repartition(5)
    asked = spark.createDataFrame([(k, t, 2) for k, t in items], "item_id long, text string, doc_id long")
    got = [tuple(r) for r in lexical.search(df, asked, top=12).collect()]
    want = plain(docs, items, 12)
    text = lambda rows: sorted(map(repr, rows))
    assert text(got) == text(want)
    assert lexical.search(df.limit(0), asked).count() == 0 and lexical.search(df, asked.limit(0)).count() == 0


def test_partial_sums_stay_exact():
    weights = np.array([45_000] * 500_000)
    tiles = lexical.item_tiles([list(range(500_000))], weights)
    parts = tiles[0][1]
    assert sum(len(ids) for ids, _ in parts) == 500_000
    assert all(int(weights[ids].sum()) * lexical.IMPACT < lexical.EXACT and len(ids) <= lexical.COLUMNS for ids, _ in parts)


def test_best_keeps_ties_by_key():
    rng, best = np.random.default_rng(1), lexical.Best(3, 5)
    scores, keys = rng.integers(0, 4, (4000, 3)), rng.permutation(4000)
    for i in range(0, 4000, 100):
        best.offer(0, scores[i : i + 100], keys[i : i + 100], np.zeros(100, bool))
        if i % 700 == 0:
            best.prune()
    item, score, _, key = best.rows()
    for j in range(3):
        want = sorted((-s, k) for s, k in zip(scores[:, j].tolist(), keys.tolist()) if s)[:5]
        assert sorted(zip((-score[item == j]).tolist(), key[item == j].tolist())) == want
