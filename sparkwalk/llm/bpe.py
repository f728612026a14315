"""Byte-level BPE over whole texts: overlapping chunks, stitched where their pre-tokens agree.

A text of at most ``chunk`` code points is encoded where it lies.  A longer one is dealt out as
chunks that overlap their successors; each chunk is pre-tokenised by itself, from its own first
character, which may lie inside a pre-token.  A pre-token depends on the text from its start to one
character past its end only, so once a boundary of the successor meets a settled boundary of the chunk
before it, both agree from there on: that is where the pieces are cut.  The pieces are encoded in
parallel and their ids joined in order.  Where two chunks do not meet within the overlap (one run of
letters longer than that), the rest of that text stays one piece.  Decoding joins the bytes of the ids.

Defined results: null is the empty text, which has no ids; repeated rows come out as often as they went in;
an empty table gives an empty one; ids outside the vocabulary raise ValueError on decoding.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, functions as F

from sparkwalk.llm.common import map_batches, once, texts

CHUNK, OVERLAP = 65_536, 1_024


def load(path: str, pattern: str) -> tuple[tiktoken.Encoding, list]:
    """The encoder of a rank file (one ``base64 rank`` a line), and the bytes of each id."""

    def make():
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        table: list[bytes | None] = [None] * (max(ranks.values()) + 1)
        for piece, rank in ranks.items():
            table[rank] = piece
        return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), table

    return once(f"bpe:{path}:{pattern}", make)


def boundaries(text: str, pattern: str) -> list[int]:
    """Ends of the pre-tokens of ``text`` that what follows cannot change, but for those at white space:
    the encoder, given a piece that ends in white space, could join it otherwise than within the whole text.
    """
    ends = [m.end() for m in once(f"pattern:{pattern}", lambda: regex.compile(pattern)).finditer(text)]
    return [e for e in ends if e < len(text) and not text[e - 1].isspace()]


def cuts(docs: DataFrame, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """(_row, cuts): the positions at which each long text (_row, text, n) may be cut."""
    parts = docs.select(
        "_row",
        F.explode(F.expr(f"sequence(0L, (n - 1) div {chunk})")).alias("i"),
        "text",
    ).select("_row", "i", F.expr(f"substring(text, int(i * {chunk} + 1), {chunk + overlap})").alias("text"))

    def pretokenise(batch):
        head, tail = [], []
        for i, t in zip(batch.column("i").to_pylist(), batch.column("text").to_pylist()):
            start = i * chunk
            settled = boundaries(t, pattern)
            head.append([start + p for p in settled if p <= overlap])
            tail.append([start + p for p in settled if p >= chunk])
        return {"_row": batch.column("_row"), "i": batch.column("i"), "head": head, "tail": tail}

    spread = parts.repartition("_row", "i")  # the chunks of one text go to many tasks
    found = map_batches(spread, pretokenise, {"_row": "long", "i": "long", "head": "array<long>", "tail": "array<long>"})

    def stitch(rows):
        rows = rows.sort_values("i")
        out: list[int] = []
        for tail, head in zip(rows["tail"][:-1], rows["head"][1:]):
            settled = set(tail.tolist())
            at = next((p for p in head.tolist() if p in settled), None)
            if at is None:
                break  # what follows is not known to be settled
            out.append(at)
        rows = rows[:1].assign(cuts=[out])
        return rows[["_row", "cuts"]]

    # one row for each chunk, with boundaries within the overlaps only
    return found.groupBy("_row").applyInPandas(stitch, "_row long, cuts array<long>")


def encode(
    docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text",
    chunk: int = CHUNK, overlap: int = OVERLAP,
) -> DataFrame:
    """(key, ids): the ids of the whole text, as the encoder of the rank file gives them without special tokens."""

    def run(batch):
        encoder, _ = load(path, pattern)
        ids = [np.array(encoder.encode_ordinary(t), dtype=np.int32) for t in texts(batch, "text")]
        offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
        flat = np.concatenate([*ids, np.zeros(0, np.int32)])
        out = {c: batch.column(c) for c in batch.schema.names if c != "text"}
        return out | {"ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))}

    all_docs = docs.select(F.col(key).cast("long").alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    short = map_batches(all_docs.filter(F.length("text") <= chunk), run, {"_key": "long", "ids": "array<int>"})
    long = (
        all_docs.withColumn("n", F.length("text").cast("long"))
        .filter(F.col("n") > chunk)
        .withColumn("_row", F.monotonically_increasing_id())
    )
    ends = F.concat(F.array(F.lit(0).cast("long")), F.coalesce("cuts", F.array().cast("array<long>")), F.array("n"))
    pieces = (
        long.join(cuts(long, pattern, chunk, overlap), "_row", "left")
        .withColumn("ends", ends)
        .select("_key", "_row", "text", F.posexplode(F.expr("transform(slice(ends, 2, size(ends) - 1), (b, i) -> named_struct('a', ends[i], 'b', b))")).alias("i", "p"))
        .select("_key", "_row", "i", F.expr("substring(text, int(p.a + 1), int(p.b - p.a))").alias("text"))
        .repartition("_row", "i")
    )
    done = map_batches(pieces, run, {"_key": "long", "_row": "long", "i": "int", "ids": "array<int>"})
    whole = done.groupBy("_row", "_key").agg(F.array_sort(F.collect_list(F.struct("i", "ids"))).alias("p"))
    return (
        short.unionByName(whole.select("_key", F.flatten(F.col("p.ids")).alias("ids"))).withColumnRenamed("_key", key)
    )


def decode_ids(rows: list[list[int] | None], vocabulary: list[bytes]) -> list[bytes]:
    out = []
    for ids in rows:
        if ids and not (0 <= min(ids) and max(ids) < len(vocabulary)):
            raise ValueError("an id outside the vocabulary")
        out.append(b"".join(map(vocabulary.__getitem__, ids or [])))
    return out


def decode(coded: DataFrame, path: str, pattern: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, bytes): the bytes of the ids, one after another; null ids are none."""

    def run(batch):
        return {"key": batch.column("key"), "bytes": decode_ids(batch.column("ids").to_pylist(), load(path, pattern)[1])}

    keyed = coded.select(F.col(key).cast("long").alias("key"), F.col(ids).alias("ids"))
    return map_batches(keyed, run, {"key": "long", "bytes": "binary"}).withColumnRenamed("key", key)
