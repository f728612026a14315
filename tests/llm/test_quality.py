"""Quality rules against a plain re-count and exact binomial sums."""

import math
import re
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from llm.sql import connect, same

from sparkwalk.llm import quality, queries

FOLDER = "/root/testdata/sf0.01"


def counts(text):
    text = text or ""
    words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    windows = defaultdict(list)
    for i in range(len(words) - 2):
        windows[tuple(words[i : i + 3])].append(i)
    inside = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(3)}
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(text.count(c) for c in "#*$%&|<>"),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(inside),
        "n_capitals": sum(w == w.upper() != w.lower() for w in words), "n_exclamations": text.count("!"), "n_lines": len(lines),
    }


def rejected(c, level):
    return any(c[a] / max(c[b], 1) > grid[level] for (a, b), grid in quality.RULES.values())


def tail(k, n, p):
    p = Fraction(p).limit_denominator(1000)
    return float(sum(math.comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1)))


def verdicts(docs, labels, alpha=quality.ALPHA, limit=quality.LIMIT):
    """docs: (key, stratum, text)"""
    told, good = [(k, s or "", counts(t)) for k, s, t in docs], defaultdict(list)
    for k, q in labels:
        if k is not None and q is not None:
            good[k].append(q)
    good = {k for k, q in good.items() if min(q) == 1}
    held = defaultdict(list)
    for k, s, c in told:
        if k in good:
            held[s].append(c)
    level = {}
    for s, own in held.items():
        for j in range(quality.LEVELS):
            if tail(sum(rejected(c, j) for c in own), len(own), limit) > alpha / len(held):
                break
            level[s] = j
    out = []
    for k, s, c in told:
        base = c["n_words"] < 50 or 100 * c["n_repeat_words"] > 50 * c["n_words"]
        out.append((k, *c.values(), base, not base and not (s in level and rejected(c, level[s]))))
    return out, level


@pytest.mark.parametrize("limit", [quality.LIMIT, 0.1])
def test_equals_plain_count(spark, monkeypatch, limit):
    con = connect(FOLDER)
    want, level = verdicts(
        con.sql("select doc_id, lang, text from documents").fetchall(), con.sql("select doc_id, quality from labels").fetchall(), limit=limit
    )
    assert level or limit < 0.1
    monkeypatch.setattr(quality.certified, "__defaults__", ("doc_id", quality.ALPHA, limit))
    got = quality.judge(*(spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels")))
    assert sorted(map(tuple, got.collect())) == sorted(want)
    if limit == quality.LIMIT:
        few = queries.op5_quality(spark, FOLDER)
        assert sorted(map(tuple, few.collect())) == sorted((*w[:6], *w[9:]) for w in want)


def test_query_equals_sql(spark):
    assert same(queries.op5_quality, queries.ORACLE["op5_quality"], spark, FOLDER)


def test_tail_is_exact(spark):
    from pyspark.sql import functions as F

    cases = [(k, n) for n in (1, 7, 100, 3000) for k in {0, 1, 2, n // 50, n // 34} if k <= n]
    frame = spark.createDataFrame(cases, "k long, n long")
    for k, n, t in frame.select("k", "n", quality.binomial_tail(F.col("k"), F.col("n"), 0.03)).collect():
        assert t == pytest.approx(tail(k, n, 0.03) if k < n * 0.03 else 1.0, rel=1e-9)


def test_odd_rows(spark):
    texts = [None, "", " \t\v\f\r\n", "a b c a b c", "x " * 70, "é b " * 60, "A!! B!! " * 40 + "\n" * 3, "l1 w\nl1 w\n\n \nl1 w\nother", "a b c d a b c d a b", "word" * 50_000, " ".join(map(str, range(30_000)))]
    docs = [(i // 2, None if i % 3 == 0 else f"s{i % 2}", t) for i, t in enumerate(texts)] + [(None, "s1", "no key " * 60)] * 2
    labels = [(0, 1), (0, 0), (1, None), (None, 1), (99, 1), (3, 1), (3, 1)]
    frame = spark.createDataFrame([(*d, True, 5) for d in docs], "doc_id long, lang string, text string, kept boolean, n_words int")
    told = spark.createDataFrame([(*x, "z") for x in labels], "doc_id long, quality int, text string")
    want, _ = verdicts(docs, labels)
    got = quality.judge(frame, told)
    assert Counter(map(tuple, got.collect())) == Counter(want)
    assert quality.judge(frame.limit(0), told).count() == 0
    assert Counter(map(tuple, quality.judge(frame, told.limit(0)).collect())) == Counter(verdicts(docs, [])[0])
