"""Chunked BPE against the encoder over whole texts."""

import hashlib
import random

import public_tokenizers as P
from llm.sql import connect

from sparkwalk.llm import bpe, queries

PATH = P.path("byte_bpe_50k.tiktoken")


def test_query_equals_whole_texts(spark):
    encoder = bpe.load(PATH, P.PATTERN)[0]
    folder = "/root/testdata/sf0.001"
    want = []
    for k, t in connect(folder).sql("select doc_id, text from documents").fetchall():
        ids = encoder.encode_ordinary(t)
        want.append((k, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    assert sorted(map(tuple, queries.op7_bpe(spark, folder).collect())) == sorted(want)


def test_small_chunks_and_odd_texts(spark):
    rng = random.Random(7)
    alphabet = ["a", "B", "é", "9", " ", " ", "\n", "  ", "'s", "'", "—", "漢", "\u00a0", "🙂", "<|endoftext|>", "word ", "\r\n"]
    texts = ["".join(rng.choices(alphabet, k=rng.randrange(1, 400))) for _ in range(80)]
    texts += [None, "", "x" * 1000, " " * 1000, "\n" * 500 + "a", "ab " * 300 + "y" * 200 + " cd" * 300, "é" * 41]
    docs = spark.createDataFrame([(i // 2, t, "c") for i, t in enumerate(texts)] + [(None, "null key " * 40, "c")], "doc_id long, text string, ids string")
    encoder = bpe.load(PATH, P.PATTERN)[0]
    coded = bpe.encode(docs, PATH, P.PATTERN, chunk=64, overlap=16)
    want = sorted(repr((k, encoder.encode_ordinary(t or ""))) for k, t, _ in docs.collect())
    assert sorted(repr((k, list(ids))) for k, ids in coded.collect()) == want
    back = sorted(repr((k, bytes(b))) for k, b in bpe.decode(coded, PATH, P.PATTERN).collect())
    assert back == sorted(repr((k, (t or "").encode())) for k, t, _ in docs.collect())
    assert bpe.encode(docs.limit(0), PATH, P.PATTERN).count() == 0
