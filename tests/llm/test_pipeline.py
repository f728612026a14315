"""The pipeline against plain programs of its stages, and each stage's columns and odd rows."""

import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers as P
import pytest
from llm.sql import connect
from llm.test_packing import check_places
from llm.test_quality import verdicts
from llm.test_simhash import slow_components, slow_fingerprint
from llm.test_suffix import plain
from tokenizers import Tokenizer

FOLDER = "/root/testdata/sf0.001"


def test_run_equals_plain_programs(spark):
    con = connect(FOLDER)
    docs = con.sql("select doc_id, lang, text from documents order by doc_id").fetchall()
    judged, _ = verdicts(docs, con.sql("select doc_id, quality from labels").fetchall())
    good = {j[0] for j in judged if j[-1]}
    docs = [(k, t) for k, _, t in docs if k in good]
    groups = slow_components([(k, slow_fingerprint(t)) for k, t in docs])
    docs = [(k, t) for k, t in docs if groups[k] == k]
    kept = {k: b.decode("utf-8", "ignore") for k, (_, _, _, b) in plain(docs).items()}
    whole, want = Tokenizer.from_file(P.path("byte_bpe_50k.json")), []
    for k, t in kept.items():
        ids = np.array([*whole.encode(t, add_special_tokens=False).ids, 2], dtype="<u4")
        first = len(ids) if len(ids) <= 1024 else len(ids) % 1024 or 1024
        for i, s in enumerate([0, *range(first, len(ids), 1024)]):
            part = ids[s : first if s == 0 else s + 1024]
            want.append((k, i, s, len(part), zlib.crc32(part.tobytes())))
    rows = corpus_pipeline.run(spark, FOLDER).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    check_places(rows, 1024)


@pytest.fixture(scope="module")
def odd(spark):
    long = "one of a kind, " + " ".join(f"w{i}" for i in range(300))
    rows = [
        (1, long, "en", "s", 9), (1, long, "en", "s", 9), (2, long + " more", None, None, None), (None, long, "en", "s", 1), (3, None, None, "s", 0), (4, "", "en", "s", 0),
        (5, "word " * 400, "de", "s", 1), (6, " ".join(f"é{i}" for i in range(200)), "fr", "s", 1),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


@pytest.mark.parametrize("stage", range(3))
def test_stages_return_documents(spark, odd, stage):
    name, fn = corpus_pipeline.STAGES[stage]
    out = fn(spark, odd, FOLDER)
    assert out.columns == odd.columns and [f.dataType for f in out.schema] == [f.dataType for f in odd.schema]
    rows = out.collect()
    if name == "quality":
        assert sorted(r.doc_id for r in rows if r.doc_id) == [1, 1, 2, 6] and sum(r.doc_id is None for r in rows) == 1
    elif name == "near_dedup":
        assert sorted((r.doc_id for r in rows if r.doc_id)) in ([1, 3, 5, 6], [1, 2, 3, 5, 6])
    else:
        assert sorted(str(r.doc_id) for r in rows) == sorted(str(r.doc_id) for r in odd.collect())
        assert all(r.n_chars == len(r.text) for r in rows if r.text is not None)
    assert fn(spark, odd.limit(0), FOLDER).count() == 0


def test_last_stage(spark, odd):
    assert {r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, odd, FOLDER).collect()} == {1, 2, 3, 4, 5, 6, None}
