"""Source divergence against SQL on the tables and a plain program on odd rows, small slices and blocks."""

import re
from collections import Counter

import numpy as np
import pytest
from llm.sql import same

from sparkwalk.llm import divergence, queries, terms

FOLDER = "/root/testdata/sf0.001"


def plain(rows, least, top):
    """Rows (lang, source, part, item, value, rank) by the definition, every term of every pair."""
    split = lambda t: re.findall("[a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    rows = [(lang or "", source or "", split(t)) for lang, source, t in rows]
    out = []
    for lang in {r[0] for r in rows}:
        holds, groups = Counter(), {}
        for one, source, ts in rows:
            if one == lang:
                holds.update(set(ts))
                groups.setdefault(source, Counter()).update(ts)
        kept = [t for t, n in holds.items() if n >= least]
        whole = sum(groups.values(), Counter())

        def share(c):
            total = sum(c[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 10**9 * (c[t] + 5) // total for t in kept}

        p, q = {s: share(c) for s, c in groups.items()}, share(whole)
        for s in groups:
            found = {
                "pair": [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in groups if o != s],
                "term": [(q[t] - p[s][t], t) for t in kept if groups[s][t] and p[s][t] > q[t]],
            }
            for part, values in found.items():
                values = sorted(values, key=lambda v: (v[0], v[1].encode()))
                out += [(lang, s, part, o, -v, i + 1) for i, (v, o) in enumerate(values) if part == "pair" or i < top]
    return out


def test_query_equals_sql(spark):
    assert same(queries.op12_divergence, queries.OP12_SQL, spark, FOLDER) > 1000


def odd():
    rng = np.random.default_rng(3)
    rows = []
    for i in range(400):
        n = int(rng.integers(0, 40))
        words = [f"{'abcdefgh'[rng.integers(8)] * int(min(rng.zipf(1.5), 9))}é" if rng.random() < 0.3 else "Xy"[: rng.integers(1, 3)] for _ in range(n)]
        rows.append(("en" if i % 3 else "de", "hot" if i % 2 else f"s{i % 23}", " ".join(words) + " 12 ab1c"))
    rows += [(None, None, "a b c"), (None, "s1", None), ("", "", ""), ("fr", "only", "lone words"), ("de", "s1", "xy " * 5_000), ("en", "nothing", "123 456")]
    return rows + rows[:5]


@pytest.mark.parametrize("small", [False, True])
def test_odd_rows(monkeypatch, spark, small):
    if small:
        for name, value in {"HELD": 20, "SLICE": 5, "BLOCK": 3, "RUN": 2}.items():
            monkeypatch.setattr(divergence, name, value)
        monkeypatch.setattr(terms, "PIECE", 50)
    rows = odd()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "lang string, source string, text string, value long, term string").repartition(4)
    got = [tuple(r) for r in divergence.audit(df, least=6, top=7).collect()]
    assert sorted(got) == sorted(plain(rows, 6, 7))
    assert divergence.audit(df.limit(0)).count() == 0


def test_gallop_finds_what_both_hold(monkeypatch):
    rng = np.random.default_rng(2)
    for run in (1, 3, 1024):
        monkeypatch.setattr(divergence, "RUN", run)
        for a, b in ((0, 9), (1, 1), (5, 2000), (300, 400), (1500, 1500)):
            x, y = np.unique(rng.integers(0, 3000, a)), np.unique(rng.integers(0, 3000, b))
            i, j = divergence.gallop(x, y)
            assert x[i].tolist() == y[j].tolist() == np.intersect1d(x, y).tolist()


def test_shares_beyond_64_bits():
    counts = np.array([0, 3, 10**15, 9 * 10**15])
    total = 9_300_000_000_000_077
    assert divergence.shares(counts, total, 5, 10**9).tolist() == [1 + 10**9 * (int(c) + 5) // total for c in counts]
