"""Document fingerprints as invertible Bloom lookup sketches of paragraph digests.

A paragraph is a line; a line of more than ``PARAGRAPH`` code points counts as several, cut from its start; lines
of white space alone are none.  A text is the set of its paragraphs' 64-bit digests.  A sketch has three tables of
cells, each digest goes to one cell of each table, and a cell keeps count, xor of digests and xor of check sums.  Cells
of two versions subtract: what both hold cancels, and the digests that differ are recovered by peeling
cells that hold just one.  Where peeling gets stuck a sketch of twice the cells is tried, and in the end another
salt.  So that no sketch grows with the text, the digests of long texts are first dealt to shards of some
``SHARE`` by their own bits, and shard is subtracted from shard.

The fingerprint written out is the smallest sketch of the whole text (count, digests, checks in hex) behind the number
of digests: equal texts, and texts with the same paragraphs, have equal fingerprints.  The likeness is the
Jaccard index of the two sets, which follows from their sizes and the number of digests recovered.

All of it is array expressions within a row, and joins.  Defined results: a null text is empty, an empty text has
no paragraphs, two such texts are alike (1.0); a paragraph repeated in a text counts once; rows equal in key and
text are one document and come out once; rows of one key with different texts are documents in the order of
their text hash; a null key comes first; a single document is its own successor; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sparkwalk.llm.common import bind
from sparkwalk.session import counted_cut, cut

PARAGRAPH, SHARE = 256, 16
SIZES = (12, 24, 48, 96, 192, 384)
FOUND = "array<struct<k:bigint,c:int>>"


def digests(text: Column) -> Column:
    """The distinct 64-bit digests of a text's paragraphs."""
    lines = F.filter(F.regexp_extract_all(text, F.lit(rf"[^\n]{{1,{PARAGRAPH}}}"), 0), lambda p: p.rlike(r"\S"))
    return F.array_distinct(F.transform(lines, lambda p: F.xxhash64(p)))


def check(digest: Column) -> Column:
    return F.xxhash64(F.lit("check"), digest).bitwiseAND(F.lit(0xFFFFFFFF))


def placed(digest: Column, sign: Column, cells: Column, salt: Column) -> Column:
    """A digest with its cells, one in each of the three tables."""
    third = (cells / 3).cast("int")
    at = lambda t: (F.pmod(F.xxhash64(F.lit(t), cells, salt, digest), third) + t * third).cast("int")
    return F.struct(
        sign.cast("int").alias("c"), digest.alias("k"), check(digest).alias("h"), *[at(t).alias(f"i{t}") for t in range(3)]
    )


def added(cell: Column, items: Column, j: Column, sign: int) -> Column:
    """A cell with those of the placed items that belong to it added or taken away."""
    own = F.filter(items, lambda p: (p["i0"] == j) | (p["i1"] == j) | (p["i2"] == j))
    put = lambda a, p: F.struct(
        (a["c"] + sign * p["c"]).alias("c"), a["k"].bitwiseXOR(p["k"]).alias("k"), a["h"].bitwiseXOR(p["h"]).alias("h")
    )
    return F.aggregate(own, cell, put)


def sketch(items: Column, cells: Column, salt: Column) -> Column:
    """The cells of a set of digests."""
    zero = F.struct(F.lit(0).alias("c"), F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("h"))
    spots = F.transform(items, lambda d: placed(d, F.lit(1), cells, salt))
    return bind(spots, lambda s: F.transform(F.sequence(F.lit(0), cells - 1), lambda j: added(zero, s, j, 1)))


def subtract(a: Column, b: Column) -> Column:
    minus = lambda x, y: F.struct(
        (x["c"] - y["c"]).alias("c"), x["k"].bitwiseXOR(y["k"]).alias("k"), x["h"].bitwiseXOR(y["h"]).alias("h")
    )
    return F.zip_with(a, b, minus)


def peel(cells: Column, size: Column, salt: Column) -> Column:
    """The digests left in subtracted cells, with sign (1 only left, -1 only right); null if peeling gets stuck."""
    none = F.array().cast(FOUND)
    first = F.struct(cells.alias("cells"), none.alias("found"), F.lit(True).alias("live"))

    def step(acc: Column, _: Column) -> Column:
        single = lambda x: (F.abs(x["c"]) == 1) & (x["h"] == check(x["k"]))
        pure = F.array_distinct(F.transform(F.filter(acc["cells"], single), lambda x: F.struct(x["k"].alias("k"), x["c"].alias("c"))))

        def take(p: Column) -> Column:
            spots = F.transform(p, lambda x: placed(x["k"], x["c"], size, salt))
            rest = bind(spots, lambda s: F.transform(acc["cells"], lambda x, j: added(x, s, j, -1)))
            return F.struct(rest.alias("cells"), F.concat(acc["found"], p).alias("found"), F.lit(True).alias("live"))

        stop = F.struct(acc["cells"].alias("cells"), acc["found"].alias("found"), F.lit(False).alias("live"))
        return F.when(acc["live"], bind(pure, lambda p: F.when(F.size(p) > 0, take(p)).otherwise(stop))).otherwise(acc)

    empty = lambda x: (x["c"] == 0) & (x["k"] == 0) & (x["h"] == 0)
    return F.aggregate(
        F.sequence(F.lit(1), size), first, step, lambda acc: F.when(F.forall(acc["cells"], empty), acc["found"])
    )


def difference(a: Column, b: Column, salt: Column) -> Column:
    """The digests in which two small sets differ, from their sketches; null if none of ``SIZES`` will do."""
    attempt = lambda m: peel(subtract(sketch(a, m, salt), sketch(b, m, salt)), m, salt)
    larger = lambda found, m: F.when(found.isNotNull(), found).otherwise(attempt(m))
    return F.aggregate(F.lit(list(SIZES)), F.lit(None).cast(FOUND), larger)  # a larger one only if those before got stuck


def deal(items: Column, shards: Column, shift: int) -> Column:
    """Array of ``shards`` sets, by bits of the digests."""
    part = lambda d: F.pmod(F.shiftright(d, shift), shards)
    return F.transform(F.sequence(F.lit(0).cast("long"), shards - 1), lambda g: F.filter(items, lambda d: part(d) == g))


def differing(a: Column, b: Column, salt: Column) -> Column:
    """The digests in which two sets of any size differ; null if a shard could not be peeled.

    Sets are dealt twice, first to parts of some 64 shards, so dealing does not go over a long text once a shard.
    """
    parts = lambda n, size: F.greatest(F.lit(1), F.ceil(n / size)).cast("long")
    most = F.greatest(F.size(a), F.size(b))

    def within(x: Column, y: Column) -> Column:
        shards = parts(F.greatest(F.size(x), F.size(y)), SHARE)
        pairs = lambda n: F.arrays_zip(deal(x, n, 0).alias("a"), deal(y, n, 0).alias("b"))
        return bind(shards, lambda n: F.transform(pairs(n), lambda p: difference(p["a"], p["b"], salt)))

    outer = bind(
        parts(most, 64 * SHARE),
        lambda n: F.flatten(F.transform(F.arrays_zip(deal(a, n, 40).alias("a"), deal(b, n, 40).alias("b")), lambda p: within(p["a"], p["b"]))),
    )
    return bind(outer, lambda o: F.when(F.forall(o, lambda x: x.isNotNull()), F.flatten(o)))


def likeness(a: Column, b: Column, differ: Column) -> Column:
    """Jaccard index of two sets from their sizes and the number of digests that only one of them has."""
    total = F.size(a) + F.size(b)
    return F.when(total == 0, 1.0).otherwise((total - differ) / (total + differ))


def fingerprint(items: Column) -> Column:
    """The smallest sketch, written out."""
    hexed = lambda x, n: F.lpad(F.hex(x), n, "0")
    cells = F.transform(
        sketch(items, F.lit(SIZES[0]), F.lit(0)), lambda x: F.concat(hexed(x["c"], 4), hexed(x["k"], 16), hexed(x["h"], 8))
    )
    return F.lower(F.concat(F.hex(F.size(items)), F.lit(":"), F.array_join(cells, "")))


def compare(pairs: DataFrame, left: str, right: str, out: str) -> DataFrame:
    """``pairs`` with ``out``: the number of digests in which the arrays ``left`` and ``right`` differ."""
    salt, done, todo = 0, None, pairs
    while True:
        asked = todo.withColumn(out, F.size(differing(F.col(left), F.col(right), F.lit(salt))).cast("long"))
        tried, seen = counted_cut(asked, stuck=F.count(F.when(F.col(out) < 0, 1)), unknown=F.count(F.when(F.col(out).isNull(), 1)))
        good = tried.filter(F.col(out) >= 0)
        done = good if done is None else done.unionByName(good)
        if not seen["stuck"] + seen["unknown"]:
            return done
        todo, salt = tried.filter(F.coalesce(F.col(out) < 0, F.lit(True))).drop(out), salt + 1


def range_of(key: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds lie below the key, by binary search; 0 for null."""
    if not bounds:
        return F.lit(0)
    table = F.lit(bounds)

    def halve(acc: Column, _: Column) -> Column:
        middle = F.shiftright(acc["lo"] + acc["hi"], 1)
        below, open_ = F.get(table, middle) < key, acc["lo"] < acc["hi"]
        return F.struct(
            F.when(open_ & below, middle + 1).otherwise(acc["lo"]).alias("lo"), F.when(open_ & ~below, middle).otherwise(acc["hi"]).alias("hi")
        )

    steps = F.sequence(F.lit(1), F.lit(len(bounds).bit_length()))
    return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi")), halve, lambda acc: acc["lo"])


def versions(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_chars, own, next, edited: digests; edited_sha256) of every document.

    The edited text is the document with the last half of its code points replaced by as many (or all) of
    the first of the next document.  Documents are dealt by ranges of the key, so the texts travel once and a
    document meets the next one in its range; the first of each range also visits the range before.
    """
    spark = docs.sparkSession
    given = docs.select(F.col(key).cast("long").alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / ranges for i in range(1, ranges)] or [0.5]
    cuts = given.agg(F.percentile_approx("_key", shares, 10_000)).first()[0] or []  # one key a range
    bounds = sorted(set(cuts))
    rows = given.withColumns({"_hash": F.xxhash64("_text"), "_range": range_of(F.col("_key"), bounds)})
    firsts = sorted(tuple(r) for r in rows.groupBy("_range").agg(F.min(F.struct("_key", "_hash")).alias("f")).select("_range", "f._key", "f._hash").collect())
    host = [(firsts[i - 1][0], *f[1:]) for i, f in enumerate(firsts)]  # one row a range; the first of all visits the last
    visits = F.broadcast(spark.createDataFrame(host, "_host int, _k long, _h long"))
    visitors = rows.join(visits, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_hash") == F.col("_h"))).select(
        "_key", "_text", "_hash", F.col("_host").alias("_range"), F.lit(1).alias("_visits")
    )
    order = Window.partitionBy("_range").orderBy("_visits", F.asc_nulls_first("_key"), "_hash")
    here = F.struct("_visits", "_key", "_hash")
    met = (
        rows.withColumn("_visits", F.lit(0))
        .unionByName(visitors)
        .withColumn("_same", F.lag(here).over(order).eqNullSafe(here))
        .filter("not _same")  # rows equal in key and text
        .withColumn("_next", F.lead("_text").over(order))
        .filter("_visits = 0")
    )
    half = F.floor(F.length("_text") / 2).cast("int")
    kept, head = F.substring(F.col("_text"), F.lit(1), F.length("_text") - half), F.substring(F.col("_next"), F.lit(1), half)
    edited = met.withColumn("_edited", F.concat(kept, head))
    return edited.select(
        F.col("_key").alias(key), F.length("_text").cast("long").alias("n_chars"), digests(F.col("_text")).alias("own"),
        digests(F.col("_next")).alias("next"), digests(F.col("_edited")).alias("edited"), F.sha2("_edited", 256).alias("edited_sha256"),
    )


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every document."""
    told = cut(versions(docs, key, text))  # digests and digests' digests, no texts
    near = compare(compare(told, "own", "edited", "_edited"), "own", "next", "_next")
    return near.select(
        key, "n_chars", "edited_sha256", fingerprint(F.col("own")).alias("fingerprint"), fingerprint(F.col("edited")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("edited"), F.col("_edited")).alias("near_edited"),
        likeness(F.col("own"), F.col("next"), F.col("_next")).alias("near_next"),
    )
