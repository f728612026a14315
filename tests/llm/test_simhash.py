"""SimHash near-duplicates against all pairs by brute force."""

import random

import numpy as np
import pytest
import xxhash

from sparkwalk.llm import queries, simhash

FOLDER = "/root/testdata/sf0.001"


def slow_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in low + " ":
        if c in " \t\n\v\f\r":
            words, word = words + [word] * bool(word), ""
        else:
            word += c
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(rows, bits=2):
    """rows: (key, fingerprint); the least key reachable, by breadth-first search over all pairs."""
    out, keys = {}, sorted(rows)
    for key, _ in keys:
        if key in out:
            continue
        out[key], todo = key, [key]
        fp = dict(rows)
        while todo:
            a = todo.pop()
            for b, f in keys:
                if b not in out and (f ^ fp[a]).bit_count() <= bits:
                    out[b] = key
                    todo.append(b)
    return out


def test_query_equals_brute_force(spark):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    prints = [(r.doc_id, slow_fingerprint(r.text)) for r in rows]
    want = slow_components(prints)
    got = queries.op1_simhash(spark, FOLDER).collect()
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == sorted(
        (k, f"{f:016x}", want[k]) for k, f in prints
    )


def test_odd_rows(spark):
    docs = spark.createDataFrame(
        [(5, None, 1), (7, "", 2), (9, " \t\n", 3), (3, "One two", 4), (3, "one TWO", 5), (None, "one two", 6), (None, "lone row", 7), (11, "é " * 30_000, 8)],
        "doc_id long, text string, component int",
    )
    got = {(r.doc_id, r.fp, r.component) for r in simhash.near_duplicates(docs).collect()}
    two = int(np.uint64(slow_fingerprint("one two")).astype(np.int64))
    assert {(5, 0, 5), (7, 0, 5), (9, 0, 5), (3, two, 3), (None, two, 3)} <= got
    assert any(k is None and c is None for k, _, c in got) and any(k == 11 and c == 11 for k, _, c in got)
    assert simhash.near_duplicates(docs).count() == 8
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("shard, leaf", [(40, 8), (400, 3)])
def test_trees_lose_no_link(monkeypatch, spark, shard, leaf):
    """Chains of points two bits apart, cut into many small shards."""
    monkeypatch.setattr(simhash, "SHARD", shard)
    monkeypatch.setattr(simhash, "LEAF", leaf)
    rng, rows = random.Random(1), []
    for _ in range(60):
        fp = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 12)):
            rows.append((len(rows), fp))
            fp ^= 1 << rng.randrange(64) | 1 << rng.randrange(64)
    rng.shuffle(rows)
    rows = list({f: (k, f) for k, f in rows}.values())
    points = spark.createDataFrame([(k, int(np.uint64(f).astype(np.int64))) for k, f in rows], "rep long, fp long")
    found = [(r[0], r[1]) for r in simhash.links(points, len(rows), 2).collect()]
    label = {k: k for k, _ in rows}
    fp = dict(rows)
    assert all((fp[a] ^ fp[b]).bit_count() for a, b in found)
    for _ in rows:
        for a, b in found:
            label[a] = label[b] = min(label[a], label[b])
    assert label == slow_components(rows)
    assert len(found) < 3 * len(rows)
