"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

ARROW = {
    "long": pa.int64(),
    "int": pa.int32(),
    "string": pa.string(),
    "binary": pa.binary(),
    "boolean": pa.bool_(),
    "double": pa.float64(),
    "array<int>": pa.list_(pa.int32()),
    "array<long>": pa.list_(pa.int64()),
}


SLICE = 256


def once(name: str, make: Callable):
    """``make()``, kept for the life of a worker process (tokenizers and other costly objects)."""
    store = sys.modules.setdefault("_llm_worker_store", types.ModuleType("_llm_worker_store")).__dict__
    if name not in store:
        store[name] = make()
    return store[name]


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], dict], columns: dict[str, str], rows: int = 0) -> DataFrame:
    """``fn`` over Arrow batches of the partitions of ``df``; it gives one list or array per column.

    Batches are handed on in slices of at most ``rows`` (``SLICE``) rows, so what ``fn`` makes of them stays small.
    """
    schema = pa.schema([(name, ARROW[kind]) for name, kind in columns.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = rows or SLICE
        for batch in (b.slice(i, size) for b in batches for i in range(0, max(b.num_rows, 1), size)):
            out = fn(batch)
            arrays = [v if isinstance(v := out[f.name], pa.Array) else pa.array(v, f.type) for f in schema]
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return df.mapInArrow(run, ", ".join(f"`{n}` {k}" for n, k in columns.items()))


def texts(batch: pa.RecordBatch, name: str) -> list[str]:
    """A text column as Python strings, null as empty."""
    return [x or "" for x in batch.column(name).to_pylist()]


def fresh(name: str, taken: Iterable[str]) -> str:
    """``name``, with underscores added until no column of ``taken`` has it (Spark compares without case)."""
    known = {t.lower() for t in taken}
    while name.lower() in known:
        name += "_"
    return name


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` applied to ``value``, which is computed once however often the body names it."""
    return F.transform(F.array(value), body)[0]


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
