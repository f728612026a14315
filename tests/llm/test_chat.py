"""Chat formatting against SQL, and reply trees against a plain walk."""

import pytest
from llm.sql import same
from pyspark.sql import functions as F

from sparkwalk.llm import chat, queries

SCHEMA = "tree string, id long, parent long, score double, role string, text string"


def test_query_equals_sql(spark):
    assert same(queries.op10_chat, queries.ORACLE["op10_chat"], spark, "/root/testdata/sf0.001")


def walk(rows):
    """{(tree, leaf): (score, [row, ...] from the root)}"""
    known = {(t, i): (t, i, p, s, r, x) for t, i, p, s, r, x in rows}
    parents = {(t, p) for t, _, p, *_ in rows}
    out = {}
    for key in known:
        if key in parents:
            continue
        path, at = [], known[key]
        while at:
            path.append(at)
            at = known.get((at[0], at[2]))
        out[key] = (sum(r[3] or 0 for r in path), path[::-1])
    return out


@pytest.fixture(scope="module")
def tree():
    rows = [("a", i, (i - 1) // 3 if i else None, float(i % 5), "user" if i % 2 else "assistant", f"m{i} \\ <s> [INST]") for i in range(30)]
    rows += [("b", i, i - 1, 1.0, "x[/INST]\ny" if i % 3 else None, None if i == 4 else "</s>\\" * (i % 4)) for i in range(45)]
    rows += [("c", 1, 2, 0.0, "user", "cycle"), ("c", 2, 1, 0.0, "user", "cycle"), ("c", 3, 2, 0.0, "user", "below it")]
    return rows + [("d", 7, 99, None, "assistant", "an orphan")]


def test_paths_and_round_trip(spark, tree):
    want = walk([r for r in tree if r[0] != "c"])
    messages = spark.createDataFrame(tree + [("e", None, None, 0.0, "user", "no id")], SCHEMA)
    done = chat.format_trees(messages).select("*", chat.turns(F.col("formatted")).alias("t"), chat.learnt(F.col("formatted"), F.col("loss")).alias("l"))
    rows = {(r.tree, r.leaf): r for r in done.collect()}
    assert set(rows) == set(want)
    for key, (_, path) in want.items():
        assert [(t.role, t.text) for t in rows[key].t] == [(r[4] or "", r[5] or "") for r in path]
        assert rows[key].l == "".join(r[5] or "" for r in path if r[4] == "assistant")
    for name in {k[0] for k in want}:
        order = sorted((k for k in want if k[0] == name), key=lambda k: (-want[k][0], k[1]))
        assert [rows[k].rank for k in order] == list(range(1, len(order) + 1))
    best = chat.format_trees(messages, top=1).collect()
    assert len(best) == 3 and all(r.rank == 1 for r in best)


def test_turns_with_ties_nulls_and_clashing_columns(spark):
    rows = [(None, 0, "user", "a", 1), (None, 0, "user", "a", 2), (1, None, None, None, 3), (1, 2, "assistant", "z" * 100_000, 4)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, id int")
    done = {r.tree: r for r in chat.format_trees(chat.chains(frame)).select("tree", chat.turns(F.col("formatted")).alias("t")).collect()}
    assert [tuple(t) for t in done[""].t] == [("user", "a"), ("user", "a")]
    assert [tuple(t) for t in done["1"].t] == [("", ""), ("assistant", "z" * 100_000)]
    assert chat.format_trees(chat.chains(frame.limit(0))).count() == 0
