"""Removal of repeated strings against a set of all windows in order."""

import hashlib
import random

import numpy as np
import pytest
from llm.sql import connect, same

from sparkwalk.llm import queries, suffix


def plain(docs, length=100):
    """docs in order: {key: (n_bytes, n_removed, n_spans, kept)}"""
    seen, out = set(), {}
    for k, t in docs:
        data = (t or "").encode()
        gone = np.zeros(len(data) + 1, dtype=bool)
        for i in range(len(data) - length + 1):
            w = data[i : i + length]
            if w in seen:
                gone[i : i + length] = True
            seen.add(w)
        kept = bytes(np.frombuffer(data, np.uint8)[~gone[:-1]])
        out[k] = (len(data), int(gone.sum()), int((gone[:-1] & ~np.concatenate(([False], gone[:-2]))).sum()) if data else 0, kept)
    return out


def test_query_equals_plain(spark):
    folder = "/root/testdata/sf0.001"
    want = plain(connect(folder).sql("select doc_id, text from documents order by doc_id").fetchall())
    got = queries.op6_suffix(spark, folder).collect()
    assert sorted(map(tuple, got)) == sorted((k, n, r, s, hashlib.sha256(b).hexdigest()) for k, (n, r, s, b) in want.items())
    assert any(r.n_removed for r in got)


def test_query_equals_sql(spark):
    assert same(queries.op6_suffix, queries.ORACLE["op6_suffix"], spark, "/root/testdata/sf0.01")


def made(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abé🙂 \n", k=rng.randrange(1, 9)))
    shared = [" ".join(word() for _ in range(rng.randrange(5, 80))) for _ in range(6)]
    texts = []
    for _ in range(60):
        parts = [rng.choice(shared) if rng.random() < 0.5 else " ".join(word() for _ in range(20)) for _ in range(rng.randrange(1, 6))]
        texts.append("".join(parts))
    texts += ["ab" * 300, "xyz " * 100, "ab" * 290 + "c" + "ab" * 90, "", "q" * 99, "q" * 100, "q" * 101, "q" * 350, texts[3], texts[3] + "!", None, "\0" * 130 + "z" + "\0" * 130]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed, sizes", [(1, {}), (2, {"RUN": 7, "STRETCH": 150, "SHARD": 300, "BUCKET": 4000}), (3, {"CROWD": 2}), (4, {"CROWD": 0, "RUN": 3})])
def test_made_texts(spark, monkeypatch, seed, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(suffix, name, value)
    docs = list(enumerate(made(seed)))
    frame = spark.createDataFrame([(k, t, b"x", 1) for k, t in docs], "doc_id long, text string, kept binary, d int").repartition(5)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix.remove(frame).collect()}
    assert got == plain(docs)


def test_repeated_and_null_keys(spark):
    a, b, c = "alpha " * 40, "beta and more " * 20, "gamma, once only, " + " ".join(map(str, range(60)))
    rows = [(7, a), (7, a), (None, c), (3, c), (9, a + b), (9, c)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed) for r in suffix.remove(frame).collect()), key=str)
    own = {k: v[:2] for k, v in plain([("n", c), ("3", c), ("7", a), ("9c", c), ("9ab", a + b)]).items()}
    want = [(None, *own["n"]), (3, *own["3"]), (7, *own["7"]), (7, *own["7"]), (9, *own["9c"]), (9, *own["9ab"])]
    assert got == sorted(want, key=str)
    assert suffix.remove(frame.limit(0)).count() == 0


def test_merged_transforms_equal_a_sorted_text():
    rng = np.random.default_rng(5)
    shards = [np.concatenate([rng.integers(1, 4, n), [0]]).astype(np.uint16) for n in (40, 1, 90, 63)]
    places, block, common = suffix.merge(shards, 10)
    start = np.cumsum([0, *map(len, shards)])

    def prefix(p):
        s = int(np.searchsorted(start, p, side="right")) - 1
        return tuple(np.roll(shards[s], -(p - start[s]))[np.arange(10) % len(shards[s])].tolist())

    told = [prefix(int(p)) for p in places]
    assert told == sorted(told) and sorted(places.tolist()) == list(range(start[-1]))
    assert [x == y for x, y in zip(told, told[1:])] == (block[1:] == block[:-1]).tolist()
    for x, y, n in zip(told, told[1:], common[1:].tolist()):
        real = next((i for i in range(10) if x[i] != y[i]), None)
        assert n == -1 if real is None else n <= real < n + 6
