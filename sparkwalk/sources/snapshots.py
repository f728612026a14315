"""Step snapshots by city and kind, stored as changes and read as of any step."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkwalk.session import exists
from sparkwalk.sources.layers import city_label

_LOG = "city string, kind string, run string, last int, saved_at timestamp, seq bigint"


def _log(spark: SparkSession, root: str) -> list:
    """All finished runs: a row per save, so a small table."""
    return spark.read.schema(_LOG).parquet(f"{root}/runs").collect() if exists(spark, f"{root}/runs") else []


def save_snapshots(profile: DataFrame, pairs: DataFrame, root: str, city: str, kind: str, last: int) -> str:
    """Store all steps 0 .. ``last`` of one city and kind; the name of the run.

    ``profile`` (vid_o, vid_d, step, d) as ``benefit.distance_profile`` gives it: a row for each change.  Each row is written
    with the step before which it ends, in a folder of its step, so the store grows with the changes, not with
    pairs x steps.  The rows go to a folder of their own, and one row in ``runs`` then makes them the current snapshots: a
    reader sees the run before or this one, whole, and a job that dies leaves nothing that is read.
    """
    run, label = uuid.uuid4().hex, city_label(city)
    spans = profile.groupBy("vid_o", "vid_d").agg(F.array_sort(F.collect_list(F.struct("step", "d"))).alias("at"))
    upto = F.expr(f"transform(at, (x, i) -> coalesce(get(at, i + 1).step, {last + 1}))")  # at most a row per step and pair
    rows = spans.select("vid_o", "vid_d", F.inline(F.arrays_zip(F.col("at").alias("at"), upto.alias("until"))))
    rows = rows.select("vid_o", "vid_d", F.col("at.d").alias("d"), F.col("at.step").alias("step"), "until")
    rows = rows.join(pairs.select("vid_o", "vid_d", "n_ods"), ["vid_o", "vid_d"])
    rows.write.partitionBy("step").parquet(f"{root}/changes/run={run}")
    spark = profile.sparkSession
    seq = 1 + max((r.seq for r in _log(spark, root) if (r.city, r.kind) == (label, kind)), default=0)
    entry = spark.range(1).select(
        F.lit(label).alias("city"), F.lit(kind).alias("kind"), F.lit(run).alias("run"), F.lit(last).alias("last"),
        F.current_timestamp().alias("saved_at"), F.lit(seq).cast("bigint").alias("seq"),
    )
    entry.write.mode("append").parquet(f"{root}/runs")
    return run


def load_snapshots(spark: SparkSession, root: str, city: str, kinds: Sequence[str], steps: Sequence[int]) -> DataFrame:
    """(kind, step, vid_o, vid_d, n_ods, d, changed) of the asked kinds and steps; ``changed``: risen at this very step.

    Folders of later steps are not read, rows that ended before the first one asked are left out at the scan.  A kind that was never
    saved, or a step it does not have, is an error.
    """
    current: dict[str, tuple] = {}
    for r in sorted(_log(spark, root), key=lambda r: (r.seq, r.saved_at)):
        if r.city == city_label(city):
            current[r.kind] = (r.run, r.last)
    out, asked = None, sorted(set(steps))
    for kind in kinds:
        if kind not in current:
            raise ValueError(f"no snapshots of kind {kind!r}")
        run, last = current[kind]
        if not asked or asked[0] < 0 or asked[-1] > last:
            raise ValueError(f"steps of {kind!r} run from 0 to {last}")
        rows = spark.read.schema("vid_o int, vid_d int, d bigint, until int, n_ods bigint, step int").parquet(f"{root}/changes/run={run}")
        rows = rows.filter((F.col("step") <= asked[-1]) & (F.col("until") > asked[0]))
        held = F.filter(F.array(*map(F.lit, asked)), lambda s: (s >= F.col("step")) & (s < F.col("until")))
        part = rows.withColumn("_at", F.explode(held)).select(
            F.lit(kind).alias("kind"), F.col("_at").alias("step"), "vid_o", "vid_d", "n_ods", "d",
            ((F.col("_at") == F.col("step")) & (F.col("_at") > 0)).alias("changed"),
        )
        out = part if out is None else out.unionByName(part)
    return out
