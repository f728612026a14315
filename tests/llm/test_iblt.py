"""Sketch differences and likeness against plain sets."""

import hashlib
import random
import re

import pytest
from llm.sql import connect
from pyspark.sql import functions as F

from sparkwalk.llm import iblt, queries


def paragraphs(text):
    return {p for line in (text or "").split("\n") for p in re.findall(".{1,256}", line, re.S) if re.search(r"[^ \t\n\v\f\r]", p)}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def expected(docs):
    docs = sorted(docs)
    out = {}
    for i, (k, t) in enumerate(docs):
        t, after = t or "", docs[(i + 1) % len(docs)][1] or ""
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        own = paragraphs(t)
        out[k] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), jaccard(own, paragraphs(edited)), jaccard(own, paragraphs(after)))
    return out


def test_query_equals_sets(spark):
    folder = "/root/testdata/sf0.01"
    docs = connect(folder).sql("select doc_id, text from documents").fetchall()
    want, rows = expected(docs), queries.op8_iblt(spark, folder).collect()
    assert len(rows) == len(docs)
    for r in rows:
        n, sha, edited, after = want[r.doc_id]
        assert (r.n_chars, r.edited_sha256) == (n, sha)
        assert (r.near_edited, r.near_next) == pytest.approx((edited, after), abs=1e-12)
    prints, texts = {r.doc_id: r.fingerprint for r in rows}, dict(docs)
    for a in texts:
        for b in texts:
            assert (prints[a] == prints[b]) == (paragraphs(texts[a]) == paragraphs(texts[b]))


def test_peeling_recovers_the_difference(spark, monkeypatch):
    rng, rows = random.Random(8), []
    for i in range(60):
        both, left, right = ([rng.getrandbits(63) - (1 << 62) for _ in range(rng.randrange(0, n))] for n in (200, 1 + i, 1 + i // 2))
        rows.append((i, both + left, both + right))
    rows += [(60, [], []), (61, [1], []), (62, [rng.getrandbits(63) for _ in range(3000)], [5])]
    frame = spark.createDataFrame(rows, "i int, a array<long>, b array<long>")
    for i, a, b, d in frame.withColumn("d", iblt.differing(F.col("a"), F.col("b"), F.lit(0))).collect():
        assert {x.k: x.c for x in d} == {k: 1 if k in a else -1 for k in set(a) ^ set(b)} and len(d) == len(set(a) ^ set(b))
    small = frame.limit(40)
    monkeypatch.setattr(iblt, "SIZES", (12, 24))  # sizes that often fail: other salts come in, or the row is known to be stuck
    stuck = {r.i for r in small.filter(F.size(iblt.differing(F.col("a"), F.col("b"), F.lit(0))).isNull()).collect()}
    monkeypatch.setattr(iblt, "SHARE", 6)
    got = {r.i: r.d for r in iblt.compare(small, "a", "b", "d").collect()}
    assert got == {i: len(set(a) ^ set(b)) for i, a, b in rows[:40]} and stuck


def test_odd_rows(spark):
    docs = [(5, None), (3, ""), (None, "first\nlines"), (7, "w\n" * 5000 + "x" * 70_000), (8, "\n \n\t"), (9, "é🙂" * 600), (9, "other"), (4, "a\nb\nc\nd")]
    frame = spark.createDataFrame([(*d, 1, "c") for d in docs + docs[-1:]], "doc_id long, text string, n_chars int, own string")
    rows = {(r.doc_id, r.n_chars): r for r in iblt.fingerprints(frame).collect()}
    assert len(rows) == len(docs)
    assert rows[3, 0].near_edited == 1.0 and rows[3, 0].fingerprint == rows[5, 0].fingerprint == rows[3, 0].edited_fingerprint
    chain = expected([(-1, "first\nlines"), (3, ""), (4, "a\nb\nc\nd"), (5, None)])
    assert rows[4, 7].near_edited == chain[4][2] and rows[4, 7].edited_sha256 == chain[4][1]
    one = iblt.fingerprints(frame.filter("doc_id = 4")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert iblt.fingerprints(frame.limit(0)).count() == 0
