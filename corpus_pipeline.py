"""The corpus pipeline: quality rules, near-duplicates, repeated passages, packing.

Each stage takes (spark, documents, folder of the tables); all but the last return the columns of documents, further ones too,
whatever their names.  Null texts count as empty and pass each stage by its own rule (the quality rules reject them); texts of any
length are read whole; ties go to the least key, then to the first row; empty tables stay empty.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkwalk.llm import packing, quality, simhash, suffix
from sparkwalk.llm.common import fresh
from sparkwalk.session import checkpoint_dir, cut


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality rules keep; each goes by its own text and language, also if its key is null or repeated."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    own = docs.select("doc_id", "text", "lang", F.xxhash64("text").alias("_hash"), F.col("lang").alias("_lang"))
    judged = quality.judge(own, labels, extra=["_hash", "_lang"])
    key, told, lang = (fresh(n, docs.columns) for n in ("key", "hash", "language"))
    gone = judged.filter("not kept").select(F.col("doc_id").alias(key), F.col("_hash").alias(told), F.col("_lang").alias(lang))
    same = F.col("doc_id").eqNullSafe(F.col(key)) & (F.xxhash64("text") == F.col(told))
    return docs.join(gone, same & F.col("lang").eqNullSafe(F.col(lang)), "left_anti")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates, those of the SimHash operator with its own shingles and bits: the least key, null keys last.

    Rows go by a number of their own, so null and repeated keys neither lose a group nor keep one twice.
    """
    row = fresh("row", [*docs.columns, "fp", "component"])
    numbered = cut(docs.withColumn(row, F.monotonically_increasing_id()))
    groups = simhash.near_duplicates(numbered, key=row)
    rank = F.struct(F.col("d.doc_id").isNull().alias("none"), F.col("d.doc_id").alias("key"), F.col(f"d.{row}").alias("row"))
    of = numbered.select("doc_id", row).alias("d").join(groups.select(row, "component").alias("g"), F.col(f"d.{row}") == F.col(f"g.{row}"))
    best = of.groupBy("component").agg(F.min(rank).alias("w")).select(F.col("w.row").alias(row))
    return numbered.join(best, row, "left_semi").select(*docs.columns)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes that repeat earlier ones; of a letter cut in part the rest goes too."""
    return suffix.clean(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the packed sequences."""
    parts = packing.pieces(
        docs, public_tokenizers.path("byte_bpe_50k.json"), ranks=public_tokenizers.path("byte_bpe_50k.tiktoken"),
        pattern=public_tokenizers.PATTERN,
    )
    return packing.pack(parts)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_good),
    ("near_dedup", one_of_each),
    ("suffix_dedup", without_repeats),
    ("packing", packed),
]
#: Near-duplicates need reachability and the cuts need all windows in order: compared with a plain program in the tests.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
