"""Ranks, running sums and batches over a whole table without a one-task window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from sparkwalk.session import cut


def _ranged(df: DataFrame, order_by: Sequence[Column | str]) -> DataFrame:
    """``df`` split into key ranges.

    The split is stored, because the range bounds are sampled and every later pass
    must see the same ones.  ``order_by`` should end in a unique column, so that equal
    values do not all fall into one range.
    """
    return cut(df.repartitionByRange(*order_by).withColumn("_range", F.spark_partition_id()))


def running(
    df: DataFrame,
    order_by: Sequence[Column | str],
    sums: dict[str, Column | str] | None = None,
    rank: str | None = None,
    keep_range: bool = False,
) -> DataFrame:
    """Add running totals (``sums``: new name -> expression) and a 1-based ``rank``.

    Each range is summed by itself; the totals of the ranges before it (one row per
    range, so no more rows than partitions) are then added.
    """
    exprs: dict[str, Column] = {k: F.col(v) if isinstance(v, str) else v for k, v in (sums or {}).items()}
    if rank is not None:
        exprs[rank] = F.lit(1).cast("bigint")
    parts = _ranged(df, order_by)
    totals = parts.groupBy("_range").agg(*[F.sum(e).alias(f"_t_{n}") for n, e in exprs.items()])
    before = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_range", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in exprs]
    )
    inside = Window.partitionBy("_range").orderBy(*order_by).rowsBetween(Window.unboundedPreceding, 0)
    out = parts
    for n, e in exprs.items():
        out = out.withColumn(f"_i_{n}", F.sum(e).over(inside))
    out = out.join(F.broadcast(offsets), "_range")  # one row per partition of `parts`
    kept = [*df.columns, "_range"] if keep_range else df.columns
    return out.select(*kept, *[(F.col(f"_i_{n}") + F.col(f"_o_{n}")).alias(n) for n in exprs])


def with_start(df: DataFrame, order_by: Sequence[Column | str], total: str, start: str) -> DataFrame:
    """``df``, from ``running`` with its ``_range``, with ``start``: the very ``total`` of the row before, 0 in the first.

    Taken over, not computed, so that the rows' intervals meet without gap or overlap whatever the rounding.
    """
    ends = df.groupBy("_range").agg(F.max(total).alias("_end"))
    before = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("_range", F.max("_end").over(before).alias("_before"))  # one row per partition
    inside = Window.partitionBy("_range").orderBy(*order_by)
    out = df.withColumn("_prior", F.lag(total).over(inside)).join(F.broadcast(ends), "_range")
    return out.withColumn(start, F.coalesce("_prior", "_before", F.lit(0.0))).drop("_prior", "_before", "_range")


def dense_ids(df: DataFrame, name: str, order_by: Sequence[Column | str], start: int = 0) -> DataFrame:
    """Surrogate ids ``start, start + 1, ...`` in the order of a unique key, repeatable."""
    out = running(df, order_by, rank="_rank")
    return out.select((F.col("_rank") - 1 + start).alias(name), *df.columns)


def batches(
    df: DataFrame, interval: int, order_by: Sequence[Column | str], name: str = "step", rank: str = "rank"
) -> DataFrame:
    """Number the rows best-first and cut them into batches of ``interval`` (0, 1, ...)."""
    return running(df, order_by, rank=rank).withColumn(name, F.floor((F.col(rank) - 1) / interval).cast("int"))


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each group in ``order`` (ascending).

    An aggregate with map-side combine, not a window: a group never has to sit in one task.
    """
    rest = [c for c in df.columns if c not in group and c not in order]
    row = F.min(F.struct(*order, *rest)).alias("_row")
    return df.groupBy(*group).agg(row).select(*group, "_row.*").select(*df.columns)


def interpolate_gaps(df: DataFrame, order: str, cols: Sequence[str]) -> DataFrame:
    """Fill nulls linearly by row position; leading gaps stay null, trailing gaps repeat the last value.

    Every range finds the known neighbours of its rows by itself; the last known row before
    it and the first one after it come from a table with one row per range.
    """
    rows = running(df, [order], rank="_pos", keep_range=True)
    point = {c: F.when(F.col(c).isNotNull(), F.struct(F.col("_pos").alias("p"), F.col(c).cast("double").alias("y"))) for c in cols}
    ends = rows.groupBy("_range").agg(
        *[F.max(point[c]).alias(f"_l_{c}") for c in cols], *[F.min(point[c]).alias(f"_f_{c}") for c in cols]
    )
    whole = Window.partitionBy(F.lit(0)).orderBy("_range")
    before, after = whole.rowsBetween(Window.unboundedPreceding, -1), whole.rowsBetween(1, Window.unboundedFollowing)
    carried = ends.select(
        "_range",
        *[F.last(f"_l_{c}", ignorenulls=True).over(before).alias(f"_b_{c}") for c in cols],
        *[F.first(f"_f_{c}", ignorenulls=True).over(after).alias(f"_a_{c}") for c in cols],
    )
    inside = Window.partitionBy("_range").orderBy("_pos")
    up_to, onward = inside.rowsBetween(Window.unboundedPreceding, 0), inside.rowsBetween(0, Window.unboundedFollowing)
    out = rows.join(F.broadcast(carried), "_range")  # one row per partition
    for c in cols:
        out = out.withColumn(f"_b_{c}", F.coalesce(F.last(point[c], ignorenulls=True).over(up_to), f"_b_{c}"))
        out = out.withColumn(f"_a_{c}", F.coalesce(F.first(point[c], ignorenulls=True).over(onward), f"_a_{c}"))
    filled = {}
    for c in cols:
        b, a = F.col(f"_b_{c}"), F.col(f"_a_{c}")
        slope = (a.y - b.y) / (a.p - b.p)
        filled[c] = F.when(a.isNull() | (a.p == b.p), b.y).otherwise(b.y + slope * (F.col("_pos") - b.p))
    return out.select(*[filled[c].alias(c) if c in filled else F.col(c) for c in df.columns])
