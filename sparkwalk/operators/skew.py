"""Equi-joins whose big side may pile up on a few keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from sparkwalk.session import counted_cut, cut, known_rows

# A key is hot once it holds more rows than one task should take.
HOT_ROWS = 1_000_000
# Rows whose key is null match nothing; they are dealt to this many salts.
NULL_SALTS = 4_096


def hot_keys(df: DataFrame, on: Sequence[str], hot_rows: int = HOT_ROWS) -> tuple[DataFrame, int]:
    """All keys with more than ``hot_rows`` rows and their number of salts, stored once, and how many there are.

    No more than rows / hot_rows keys can be hot.  The table is stored, so that both sides of a join, and
    every repeated task, see the same salts.
    """
    hot, seen = counted_cut(
        df.groupBy(*on)
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") > hot_rows)
        .select(*on, F.ceil(F.col("_n") / hot_rows).cast("int").alias("_salts"))
    )
    return hot, seen["n"]


def skew_join(
    big: DataFrame,
    small: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    where: Column | None = None,
    hot_rows: int = HOT_ROWS,
    rows: int | None = None,
) -> DataFrame:
    """``big`` joined to ``small`` with the rows of hot keys spread over salts.

    Each row of ``big`` gets one salt, each matching row of ``small`` one copy per
    salt, so the result equals the plain join for ``inner``, ``left``, ``left_semi`` and
    ``left_anti``.  ``where`` is an extra condition over the columns of both sides,
    which share no names other than ``on``.  ``rows`` is the row count of ``big``, or of its
    fullest key, where the caller knows it (stored tables know theirs by themselves): no key of a table that small can be hot,
    so the measuring is skipped.  Where there are hot keys ``big`` is stored with a number for each row, and the
    salt comes from that number: equal rows spread too, and a repeated task deals them as the lost one did.
    """
    on = list(on)
    rows = known_rows(big) if rows is None else rows
    hot, count = (None, 0) if rows is not None and rows <= hot_rows else hot_keys(big, on, hot_rows)
    if not count:
        left, right, keys = big, small, on
    else:
        stored = cut(big.withColumn("_row", F.monotonically_increasing_id()))
        salts = F.coalesce(F.col("_salts"), F.lit(1))
        unkeyed = F.lit(False)
        for k in on:
            unkeyed = unkeyed | F.col(k).isNull()
        salt = F.pmod(F.xxhash64("_row"), F.when(unkeyed, NULL_SALTS).otherwise(salts)).cast("int")
        left = stored.join(hot, on, "left").withColumn("_salt", salt).drop("_salts", "_row")
        right = small.join(hot, on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
        keys = [*on, "_salt"]
    if where is None:
        return left.join(right, keys, how).drop("_salt")
    right = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    cond = where
    for k in keys:
        cond = (F.col(k) == F.col(f"_r_{k}")) & cond
    return left.join(right, cond, how).drop("_salt", *[f"_r_{k}" for k in keys])
