"""Packing: every id once and in place, ids as the tokenizer gives them, few sequences."""

import random
import zlib

import numpy as np
import public_tokenizers as P
from llm.sql import connect
from tokenizers import Tokenizer

from sparkwalk.llm import packing, queries

PATH = P.path("byte_bpe_50k.json")


def check_places(rows, length):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= length
    return len(by)


def test_query_equals_tokenizer(spark):
    folder, whole, want = "/root/testdata/sf0.001", Tokenizer.from_file(PATH), []
    for k, t in connect(folder).sql("select doc_id, text from documents").fetchall():
        ids = np.array(whole.encode(t, add_special_tokens=False).ids + [2], dtype="<u4")
        first = len(ids) if len(ids) <= 1024 else len(ids) % 1024 or 1024
        for i, s in enumerate([0, *range(first, len(ids), 1024)]):
            part = ids[s : first if s == 0 else s + 1024]
            want.append((k, i, s, len(part), zlib.crc32(part.tobytes())))
    rows = queries.op9_packing(spark, folder).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    used, least = check_places(rows, 1024), -(-sum(w[3] for w in want) // 1024)
    assert least <= used <= least * 1.01 + 1


def test_ranks_give_the_tokenizers_ids():
    both, slow = packing.encoder(PATH, P.path("byte_bpe_50k.tiktoken"), P.PATTERN), packing.encoder(PATH, None, None)
    rng = random.Random(3)
    signs = [chr(c) for c in range(0x250)] + [" ", "\n", "'s", "<|endoftext|>", "漢", "🙂", "\u2028"]
    for c in signs:
        for t in (c, f"a{c}b", f" {c} {c}", f"1{c}\n{c}{c} x"):
            assert list(both(t)) == list(slow(t)), repr(t)
    for _ in range(2000):
        t = "".join(rng.choices(signs[:0x250] if rng.random() < 0.7 else signs, k=30))
        assert list(both(t)) == list(slow(t)), repr(t)
    for folder in ("sf0.01",):
        for (t,) in connect(f"/root/testdata/{folder}").sql("select text from documents").fetchall():
            assert list(both(t)) == list(slow(t))


def test_exchange_fills_a_gap():
    """60 + 30 leaves 10; 30 goes for 25 + 15."""
    lengths = [60, 30, 25, 15]
    assert sorted(sorted(lengths[i] for i in b) for b in packing.best_two_fit(lengths, 100)) == [[15, 25, 60], [30]]
    rng = random.Random(9)
    for _ in range(200):
        lengths = [rng.randrange(1, 101) for _ in range(rng.randrange(0, 60))]
        bins = packing.best_two_fit(lengths, 100)
        assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
        assert all(sum(lengths[i] for i in b) <= 100 for b in bins)


def test_odd_rows(spark):
    docs = spark.createDataFrame(
        [(1, None, 1), (1, None, 1), (2, "", 2), (None, "no key", 3), (4, "long " * 5000, 4)], "doc_id long, text string, piece int"
    )
    parts = packing.pieces(docs, PATH, length=64, keep_ids=True)
    packed = packing.pack(parts, length=64, shard=20)
    rows = packed.collect()
    check_places(rows, 64)
    assert [(r.doc_id, r.length, list(r.ids)) for r in rows if r.doc_id in (1, 2)] .count((1, 1, [2])) == 2
    assert sum(r.length for r in rows if r.doc_id == 4) == len(Tokenizer.from_file(PATH).encode("long " * 5000).ids) + 1
    ids = {r.sequence_id: list(r.ids) for r in packing.sequences(packed).collect()}
    for r in rows:
        assert ids[r.sequence_id][r.offset : r.offset + r.length] == list(r.ids)
    assert packing.pack(packing.pieces(docs.limit(0), PATH)).count() == 0
