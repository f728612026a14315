"""Chat formatting of reply trees.

Messages name the message they answer.  Root-to-leaf paths come from iterated self-joins: each round doubles how
far a message's ancestor pointer reaches, so a chain of n replies takes log2(n) rounds; then the leaves' paths
are unrolled from the pointers, longest first, again doubling.  The paths of a tree are ranked by the sum of
their scores (ties: least leaf), and each chosen path becomes one conversation.

Format: every turn is ``<s>[INST]role[/INST]text</s>``.  In roles and texts a backslash is doubled and every control string gets
a backslash behind its first character, so no control string stands in the output but the marks themselves,
and one pass that drops escaping backslashes gives the text back.  ``loss`` holds for each turn (start,
length) within that turn, length 0 unless its role is learnt from.

All of it is DataFrame work.  Defined results: null text and role are empty; a message whose parent is null or not
there starts a tree; messages in a cycle have no root and are left out; messages without id are left out;
of messages repeated with one id all are formatted, below the least parent told; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from sparkwalk.session import counted_cut, cut, discard

OPEN, ROLE_END, CLOSE = "<s>[INST]", "[/INST]", "</s>"
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")


def escape(text: Column) -> Column:
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    for c in CONTROLS:
        out = F.replace(out, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def chains(rows: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Conversations told as numbered turns, as messages: (tree, id, parent, score, role, text).

    Turns of one number follow each other by role and text; ``tree`` is the conversation's key as a string, "" for null.
    """
    order = Window.partitionBy("tree").orderBy("_turn", "role", "text")
    return (
        rows.select(F.coalesce(F.col(conv).cast("string"), F.lit("")).alias("tree"), F.col(turn).alias("_turn"), "role", "text")
        .withColumn("id", F.row_number().over(order).cast("long"))
        .select("tree", "id", F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"), F.lit(0.0).alias("score"), "role", "text")
    )


def paths(messages: DataFrame) -> DataFrame:
    """(tree, leaf, id, depth): every message on every root-to-leaf path, depth 0 at the root."""
    links = messages.groupBy("tree", "id").agg(F.min("parent").alias("parent"))
    known = links.select("tree", F.col("id").alias("parent"), F.lit(True).alias("_there"))
    # up: the ancestor 2^k steps above, null once the root is passed; depth: how many steps were taken
    first, seen = counted_cut(
        links.join(known, ["tree", "parent"], "left").select(
            "tree", "id", F.when(F.col("_there"), F.col("parent")).alias("up"), F.when(F.col("_there"), 1).otherwise(0).cast("long").alias("depth")
        ),
        climbing=F.count("up"),
    )
    levels, climbing = [first], seen["climbing"]
    arrived = first.filter("up is null")
    while climbing and 1 << len(levels) < 2 * seen["n"]:  # beyond that only cycles still climb
        below = levels[-1].filter("up is not null")
        higher = arrived.unionByName(below).select("tree", F.col("id").alias("up"), F.col("up").alias("_up"), F.col("depth").alias("_more"))
        level, now = counted_cut(  # only messages that still climb are joined
            below.join(higher, ["tree", "up"]).select("tree", "id", F.col("_up").alias("up"), (F.col("depth") + F.col("_more")).alias("depth")),
            climbing=F.count("up"),
        )
        climbing = now["climbing"]
        levels.append(level)
        arrived = arrived.unionByName(level.filter("up is null"))
    parents = first.filter("up is not null").select("tree", F.col("up").alias("id")).distinct()
    leaves = arrived.join(parents, ["tree", "id"], "left_anti").select("tree", F.col("id").alias("leaf"), "id", "depth")
    found = cut(leaves)
    for k in range(len(levels) - 1, -1, -1):  # each pass adds, to every message found, the one 2^k steps above it
        jump = levels[k].filter("up is not null").select("tree", "id", "up")
        added = found.join(jump, ["tree", "id"]).select("tree", "leaf", F.col("up").alias("id"), (F.col("depth") - (1 << k)).alias("depth"))
        before, found = found, cut(found.unionByName(added))
        discard(before)
    for level in levels:
        discard(level)
    return found


def ranked(messages: DataFrame, found: DataFrame, top: int | None = None) -> DataFrame:
    """(tree, leaf, score, rank): the paths of each tree, best first; ``top`` keeps that many of each tree."""
    scores = messages.groupBy("tree", "id").agg(F.max("score").alias("score"))
    total = found.join(scores, ["tree", "id"]).groupBy("tree", "leaf").agg(F.sum(F.coalesce("score", F.lit(0.0))).alias("score"))
    best = Window.partitionBy("tree").orderBy(F.desc("score"), "leaf")
    out = total.withColumn("rank", F.row_number().over(best))
    return out if top is None else out.filter(F.col("rank") <= top)


def render(messages: DataFrame, found: DataFrame, chosen: DataFrame, learn: Sequence[str] = ("assistant",)) -> DataFrame:
    """(tree, leaf, rank, formatted, loss): one conversation a path."""
    role, text = escape(F.col("role")), escape(F.col("text"))
    head = F.concat(F.lit(OPEN), role, F.lit(ROLE_END))
    taught = F.coalesce(F.col("role").isin(*learn), F.lit(False))
    turns = messages.select(
        "tree",
        "id",
        F.concat(head, text, F.lit(CLOSE)).alias("piece"),
        F.struct(
            F.length(head).cast("long").alias("start"), F.when(taught, F.length(text)).otherwise(0).cast("long").alias("length")
        ).alias("mask"),
    )
    placed = found.join(chosen.select("tree", "leaf", "rank"), ["tree", "leaf"]).join(turns, ["tree", "id"])
    own = F.array_sort(F.collect_list(F.struct("depth", "id", "piece", "mask")))  # one conversation, which is one row of the result
    return (
        placed.groupBy("tree", "leaf", "rank")
        .agg(own.alias("_t"))
        .select("tree", "leaf", "rank", F.array_join(F.col("_t.piece"), "").alias("formatted"), F.col("_t.mask").alias("loss"))
    )


def format_trees(messages: DataFrame, top: int | None = None, learn: Sequence[str] = ("assistant",)) -> DataFrame:
    """The ``top`` best paths of each tree (all of them by default) as conversations."""
    found = paths(messages)
    return render(messages, found, ranked(messages, found, top), learn)


def turns(formatted: Column) -> Column:
    """Array of (role, text) read back from a formatted conversation."""
    pieces = F.filter(F.split(formatted, CLOSE, -1), lambda p: p.startswith(OPEN))
    role = lambda p: F.substring_index(F.substring(p, F.lit(len(OPEN) + 1), F.length(p)), ROLE_END, 1)
    text = lambda p: F.substring(p, F.length(role(p)) + (len(OPEN) + len(ROLE_END) + 1), F.length(p))
    return F.transform(pieces, lambda p: F.struct(unescape(role(p)).alias("role"), unescape(text(p)).alias("text")))


def learnt(formatted: Column, loss: Column) -> Column:
    """The texts under the loss mask, unescaped, one after another."""
    pieces = F.split(formatted, CLOSE, -1)
    cut_out = lambda p, i: F.substring(p, (F.get(loss, i)["start"] + 1).cast("int"), F.get(loss, i)["length"].cast("int"))
    return F.array_join(F.transform(pieces, lambda p, i: unescape(F.coalesce(cut_out(p, i), F.lit("")))), "")
