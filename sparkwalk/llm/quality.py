"""Quality rules whose cutoffs are certified against false rejection.

Each rule rejects a text whose ratio (symbols per word, and so on) lies above a cutoff.  A level names one
cutoff for every rule, and the levels of the fixed grid run from lenient to strict.  For every stratum they are tried
in that order on labelled holdout texts of good quality: with k of n rejected by any rule, a level is
certified if the exact binomial tail P(Bin(n, limit) <= k) is at most alpha / strata, i.e. if the
Clopper-Pearson upper bound of the false-rejection rate is within ``limit``.  Testing stops at the first
level that fails (fixed sequence), so only the strata need the Bonferroni correction; the last level
certified is used, and a stratum without one has no rules.  With probability 1 - alpha, then, no stratum
loses more than ``limit`` of its good texts to the rules.  The grid is fixed beforehand: it has not seen the holdout.

All of it is DataFrame work: the counts of a text are array expressions over its own words, the
calibration is one aggregate per stratum.  Defined results: a null text has no words; a null stratum is a
stratum of its own, named ""; labels that are null, or of unknown keys, count for nothing; of several labels
of one key the worst counts; a row repeated in the table is judged each time; no labels, no certified
level: then only the base rule rejects; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from sparkwalk.llm.common import bind
from sparkwalk.session import cut

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
ALPHA, LIMIT = 0.05, 0.03
#: rule -> (counts that make its ratio, its cutoff at each level)
RULES = {
    "symbols": (("n_symbols", "n_words"), [2.0, 1.0, 0.7, 0.5, 0.35, 0.25, 0.15, 0.1]),
    "capitals": (("n_capitals", "n_words"), [0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3]),
    "exclamations": (("n_exclamations", "n_words"), [2.0, 1.5, 1.0, 0.75, 0.5, 0.4, 0.3, 0.2]),
    "repeats": (("n_repeat_words", "n_words"), [0.9, 0.8, 0.75, 0.7, 0.65, 0.6, 0.55, 0.5]),
    "lines": (("n_dup_lines", "n_lines"), [0.9, 0.8, 0.75, 0.7, 0.65, 0.6, 0.55, 0.5]),
}
LEVELS = 8
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_capitals", "n_exclamations", "n_lines"]


def removed(text: Column, characters: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("long")


def repeated(words: Column, tagged: Column) -> Column:
    """Sorted starts of the three-word windows that occur more than once.

    ``tagged`` is the sorted list of window hashes with the window's position in the low 31 bits.  Windows whose
    upper hash bits have a like neighbour are then compared by their words, so hashes decide nothing.
    """
    upper = lambda i: F.shiftright(F.get(tagged, i), 31)
    twice = lambda x, i: (F.shiftright(x, 31) == upper(i - 1)) | (F.shiftright(x, 31) == upper(i + 1))
    maybe = F.filter(tagged, lambda x, i: F.coalesce(twice(x, i), F.lit(False)))
    at = lambda x: x.bitwiseAND(F.lit((1 << 31) - 1)).cast("int")
    spelled = F.array_sort(
        F.transform(
            maybe,
            lambda x: bind(
                at(x), lambda p: F.struct(F.concat_ws(" ", F.get(words, p), F.get(words, p + 1), F.get(words, p + 2)).alias("s"), p.alias("p"))
            ),
        )
    )
    same = lambda s, x, i: F.coalesce(F.get(s, i).s == x.s, F.lit(False))
    return bind(
        spelled,
        lambda s: F.array_sort(F.transform(F.filter(s, lambda x, i: same(s, x, i - 1) | same(s, x, i + 1)), lambda x: x.p)),
    )


def covered(starts: Column) -> Column:
    """How many words the three-word windows at the sorted ``starts`` cover together."""
    step = lambda total, i: total + F.least(F.lit(3), F.coalesce(F.get(starts, i + 1) - F.get(starts, i), F.lit(3)))
    return F.when(F.size(starts) == 0, 0).otherwise(
        F.aggregate(F.sequence(F.lit(0), F.size(starts) - 1), F.lit(0), step)
    ).cast("long")


def features(
    docs: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang", extra: Sequence[str] = ()
) -> DataFrame:
    """(key, _stratum, counts, extra) of every text."""
    base = docs.select(
        F.col(key).cast("long").alias("_key"),
        F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("_stratum"),
        F.coalesce(F.col(text), F.lit("")).alias("_text"),
        *extra,
    )
    split = base.select(
        "*",
        F.array_remove(F.split("_text", SPACE, -1), "").alias("_words"),
        F.filter(F.split("_text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"),
    )
    window = lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2))
    tag = lambda i: window(i).bitwiseAND(F.lit(-1 << 31)).bitwiseOR(i.cast("long"))
    tagged = split.withColumn(
        "_tagged",
        F.when(
            F.size("_words") >= 3, F.sort_array(F.transform(F.sequence(F.lit(0), F.size("_words") - 3), tag))
        ).otherwise(F.array().cast("array<bigint>")),
    )
    starts = tagged.withColumn("_starts", repeated(F.col("_words"), F.col("_tagged")))
    shouted = lambda w: (w == F.upper(w)) & (w != F.lower(w))
    return starts.select(
        F.col("_key").alias(key),
        "_stratum",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        removed(F.col("_text"), SYMBOLS).alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        covered(F.col("_starts")).alias("n_repeat_words"),
        F.size(F.filter("_words", shouted)).cast("long").alias("n_capitals"),
        removed(F.col("_text"), "!").alias("n_exclamations"),
        F.size("_lines").cast("long").alias("n_lines"),
        *extra,
    )


def ratio(rule: str) -> Column:
    above, below = RULES[rule][0]
    return F.col(above) / F.greatest(F.col(below), F.lit(1))


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), exact up to rounding; 1 where k is not below the mean, which certifies nothing.

    Below the mean the terms rise with k, so each new one is the largest and the sum is kept in units of it.
    """
    from math import log

    first = F.struct((n * log(1 - p)).alias("m"), F.lit(1.0).alias("s"))

    def add(acc: Column, j: Column) -> Column:
        m = acc.m + F.log((n - j + 1) / j) + log(p / (1 - p))
        return bind(m, lambda m: F.struct(m.alias("m"), (acc.s * F.exp(acc.m - m) + 1.0).alias("s")))

    steps = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    total = F.aggregate(steps, first, add, lambda acc: acc.s * F.exp(acc.m))
    return F.when(k >= n * p, 1.0).otherwise(total)


def rejected(level: Column | int) -> Column:
    """Whether any rule rejects at a level; nothing is rejected where the level is null."""
    cutoff = lambda grid: F.lit(grid[level]) if isinstance(level, int) else F.get(F.array(*map(F.lit, grid)), level)
    out = F.lit(False)
    for rule, (_, grid) in RULES.items():
        out = out | F.coalesce(ratio(rule) > cutoff(grid), F.lit(False))
    return out


def certified(feats: DataFrame, labels: DataFrame, key: str = "doc_id", alpha: float = ALPHA, limit: float = LIMIT) -> DataFrame:
    """(_stratum, _level): the strictest certified level of the strata that have one."""
    good = labels.groupBy(F.col(key).cast("long").alias(key)).agg(F.min("quality").alias("_q")).filter("_q = 1").select(key)
    held = feats.join(good, key, "left_semi")
    counts = [F.count(F.when(rejected(j), 1)).alias(f"k_{j}") for j in range(LEVELS)]
    per = held.groupBy("_stratum").agg(F.count(F.lit(1)).alias("n"), *counts)
    tests = F.array(*[F.struct(F.lit(j).alias("_level"), F.col(f"k_{j}").alias("k")) for j in range(LEVELS)])
    rows = per.select("_stratum", "n", F.inline(tests))  # strata x levels, whatever the corpus
    strata = F.count(F.lit(1)).over(Window.partitionBy("_level"))
    tested = rows.withColumn("_ok", binomial_tail(F.col("k"), F.col("n"), limit) <= alpha / strata)
    so_far = Window.partitionBy("_stratum").orderBy("_level")
    passed = tested.withColumn("_ok", F.min("_ok").over(so_far)).filter("_ok")
    return passed.groupBy("_stratum").agg(F.max("_level").alias("_level"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judge(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    stratum: str = "lang",
    extra: Sequence[str] = (),
) -> DataFrame:
    """(key, counts, base_failed, kept, extra) of every row."""
    feats = cut(features(docs, key, text, stratum, extra))  # a few numbers per text, counted once
    levels = cut(certified(feats, labels, key))
    return feats.join(levels, "_stratum", "left").select(
        key, *COUNTS, base_failed().alias("base_failed"), (~base_failed() & ~rejected(F.col("_level"))).alias("kept"), *extra
    )
