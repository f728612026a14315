"""Stages of the pipeline judge rows: null and repeated keys neither take other rows along nor stay behind."""

import corpus_pipeline

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(tag, n=120):
    return " ".join(f"{tag}{i}" for i in range(n))


def test_quality_by_row(spark):
    rows = [(None, prose("a")), (None, "junk " * 90), (None, prose("b")), (9, prose("c")), (9, "too short"), (None, None), (9, prose("c"))]
    docs = spark.createDataFrame([(k, t, lang, "s", i) for i, (k, t) in enumerate(rows) for lang in ("en", None)], SCHEMA)
    kept = corpus_pipeline.keep_good(spark, docs, FOLDER)
    assert sorted((r.n_chars, str(r.lang)) for r in kept.collect()) == [(i, lang) for i in (0, 2, 3, 6) for lang in ("None", "en")]


def test_one_row_of_each_group(spark):
    a, b, c, d = (prose(t) for t in "abcd")
    rows = [
        (5, a), (7, a), (5, b), (3, b.upper()), (None, a), (None, c), (None, c.title()), (None, c), (8, d), (8, d), (2, None), (None, ""), (1, prose("e")),
    ]
    docs = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in rows], SCHEMA)
    kept = [(r.doc_id, (r.text or "")[:1].lower()) for r in corpus_pipeline.one_of_each(spark, docs, FOLDER).collect()]
    assert sorted(kept, key=str) == sorted([(5, "a"), (3, "b"), (None, "c"), (8, "d"), (2, ""), (1, "e")], key=str)


def test_clashing_columns_stay(spark):
    """Columns named as names used inside come back as they were."""
    names = ["row", "fp", "component", "_key", "_hash", "key", "hash", "language", "_d", "_spans", "c0", "c1", "w", "_shard", "ROW_"]
    rows = [(i, prose(t), "en", "s", 0, *[f"{n}{i}" for n in names]) for i, t in enumerate("aab")]
    docs = spark.createDataFrame(rows, SCHEMA + "".join(f", `{n}` string" for n in names))
    for (_, stage), keys in zip(corpus_pipeline.STAGES[:3], ([0, 1, 2], [0, 2], [0, 1, 2])):
        out = stage(spark, docs, FOLDER)
        assert out.columns == docs.columns
        assert sorted(r.doc_id for r in out.collect()) == keys
        assert all(r[n] == f"{n}{r.doc_id}" for r in out.collect() for n in names)
    assert {r.doc_id for r in corpus_pipeline.STAGES[3][1](spark, docs, FOLDER).collect()} == {0, 1, 2}
