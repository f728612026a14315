"""Session settings and the one way this package cuts lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

# Recommended settings of a session that runs these jobs.  The master, memory and
# shuffle-partition count belong to the cluster, so they are not set here.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: int | str = 8, app: str = "sparkwalk", memory: str = "12g") -> SparkSession:
    """A local session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
    )
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder: on a cluster a
    machine-local folder would be lost together with the executor.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="sparkwalk-checkpoint-")
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext.getCheckpointDir()
    return folder


def counted_cut(df: DataFrame, **metrics: Column) -> tuple[DataFrame, dict]:
    """Compute ``df`` once, store it in the shared folder and forget its lineage.

    A written table, not an RDD checkpoint: it is columnar and compressed, later reads
    take only the columns they need, and the planner sees its true size.  Also returns the
    row count ``n`` and the given aggregates, taken while the rows are written.
    """
    path, seen = stored(df, **metrics)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    out._rows = seen["n"]
    return out, seen


def stored(df: DataFrame, by: Sequence[str] = (), **metrics: Column) -> tuple[str, dict]:
    """Write ``df`` to a new folder, a subfolder for each value of ``by``; its path, row count ``n`` and the given aggregates."""
    path = f"{checkpoint_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    seen = Observation()
    aggs = {"n": F.count(F.lit(1))} | metrics
    out = df.observe(seen, *[e.alias(n) for n, e in aggs.items()]).write
    (out.partitionBy(*by) if by else out).parquet(path)
    return path, seen.get


def cut(df: DataFrame) -> DataFrame:
    return counted_cut(df)[0]


def bucketed(df: DataFrame, by: Sequence[str], **metrics: Column) -> tuple[DataFrame, dict]:
    """As ``counted_cut``, in buckets by the columns: joins and groups on these columns, in this order, do not shuffle the table.

    Spark knows buckets of named tables only, so it is one of the session's catalog; its files lie in the shared folder.
    """
    spark = df.sparkSession
    name, n = f"bucketed_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    path, seen = f"{checkpoint_dir(spark)}/{name}", Observation()
    aggs = {"n": F.count(F.lit(1))} | metrics
    rows = df.observe(seen, *[e.alias(m) for m, e in aggs.items()]).repartition(n, *by)
    rows.write.bucketBy(n, *by).sortBy(*by).option("path", path).format("parquet").saveAsTable(name)
    out = spark.table(name)
    out._stored_at, out._rows = path, seen.get["n"]
    return out, seen.get


def known_rows(df: DataFrame) -> int | None:
    """The row count of a stored table, as far as this very DataFrame knows it."""
    return getattr(df, "_rows", None)


def discard(df: DataFrame) -> None:
    """Delete the stored table of an earlier round, once nothing reads it any more."""
    path = getattr(df, "_stored_at", None)
    if path is not None:
        remove(df.sparkSession, path)


def exists(spark: SparkSession, path: str) -> bool:
    sc = spark.sparkContext
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(sc._jsc.hadoopConfiguration()).exists(where)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that ``stored`` wrote, or a part of it."""
    sc = spark.sparkContext
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)
