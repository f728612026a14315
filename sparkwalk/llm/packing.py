"""Best-two-fit packing of tokenised documents into sequences of bounded length.

Documents become runs of token ids that end in an end mark; only a run longer than a sequence is
cut, into full pieces behind a first one that takes the remainder.  Pieces are dealt to shards by a hash,
each shard large enough for fits to be found and small enough for one task.  In a shard a bin
starts with the longest piece left and is filled greedily with the longest that fits; then its smallest
piece is exchanged for two unpacked ones wherever they fill the widened gap more tightly.

Defined results: null is the empty text, a run of the end mark alone; pieces of equal length are taken in
the order of key and piece; repeated rows are packed as often as they occur; an empty table packs into nothing.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from sparkwalk.llm.bpe import load
from sparkwalk.llm.common import fresh, map_batches, once, texts
from sparkwalk.session import counted_cut

LENGTH, END, SHARD = 1024, 2, 16_384
#: A character past U+024F; those before have had their classes since Unicode 5.0.
ODD = re.compile("[^\\x00-\u024f]").search


def encoder(path: str, ranks: str | None, pattern: str | None):
    """text -> ids as the library ``tokenizers`` gives them for the file at ``path``, without added special tokens.

    With ``ranks`` (the same vocabulary as a rank file) texts in plain letters go through the faster ranks, which
    give the same ids; texts with a later character, or "<|" (a special token may follow), go through ``tokenizers`` itself.
    """
    whole = once(f"tokenizer:{path}", lambda: Tokenizer.from_file(path))
    if ranks is None:
        return lambda t: whole.encode(t, add_special_tokens=False).ids
    fast, _ = load(ranks, pattern)
    return lambda t: fast.encode_ordinary(t) if "<|" not in t and not ODD(t) else whole.encode(t, add_special_tokens=False).ids


def spans(n: int, length: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a run of ``n`` ids."""
    first = n if n <= length else n % length or length
    return [(0, first)] + [(s, length) for s in range(first, n, length)]


def pieces(
    docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", length: int = LENGTH, end: int = END,
    ranks: str | None = None, pattern: str | None = None, keep_ids: bool = False,
) -> DataFrame:
    """(key, piece, start, length, ids_crc32[, ids]) of every document."""
    kinds = {"key": "long", "piece": "int", "start": "long", "length": "long", "ids_crc32": "long"}
    if keep_ids:
        kinds["ids"] = "array<int>"

    def run(batch):
        encode = encoder(path, ranks, pattern)
        out: dict[str, list] = {c: [] for c in kinds}
        for k, t in zip(batch.column("key").to_pylist(), texts(batch, "text")):
            ids = np.array([*encode(t), end], dtype="<u4")
            for i, (start, n) in enumerate(spans(len(ids), length)):
                part = ids[start : start + n]
                for c, v in zip(kinds, (k, i, start, n, zlib.crc32(part.tobytes()), part.tolist() if keep_ids else None)):
                    out[c].append(v)
        return out

    keyed = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    return map_batches(keyed, run, kinds).withColumnRenamed("key", key)


def best_two_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of indices into ``lengths``; no bin holds more than ``capacity``."""
    by_length: dict[int, list[int]] = {}
    for i in range(len(lengths) - 1, -1, -1):  # so that the first of equals is taken first
        by_length.setdefault(lengths[i], []).append(i)
    there = 0  # bit n: some piece of length n is unpacked
    for n in by_length:
        there |= 1 << n

    def longest(room: int) -> int:
        """Length of the longest unpacked piece of at most ``room``; 0 if there is none."""
        return max(0, (there & ((1 << room + 1) - 1)).bit_length() - 1)

    def take(n: int) -> int:
        nonlocal there
        i = by_length[n].pop()
        if not by_length[n]:
            there ^= 1 << n
        return i

    def put(i: int) -> None:
        nonlocal there
        by_length[lengths[i]].append(i)
        there |= 1 << lengths[i]

    def two(room: int, over: int) -> tuple[int, int] | None:
        """Two unpacked pieces of together more than ``over`` and at most ``room``, as much as can be."""
        best, a = None, longest(room - 1)
        while a and 2 * a > over:
            b = longest(min(room - a, a))
            if b == a and len(by_length[a]) < 2:
                b = longest(a - 1)
            if b and a + b > over:
                best, over = (a, b), a + b
                if over == room:
                    break
            a = longest(a - 1)
        return best

    bins = []
    while there:
        own = [take(longest(capacity))]
        gap = capacity - lengths[own[0]]
        while gap and (n := longest(gap)):
            own.append(take(n))
            gap -= n
        if gap and there:
            least = lengths[own[-1]]  # pieces were taken in falling length
            if pair := two(gap + least, least):
                put(own.pop())
                own += [take(n) for n in pair]
        bins.append(own)
    return bins


def pack(parts: DataFrame, key: str = "doc_id", length: int = LENGTH, shard: int = SHARD) -> DataFrame:
    """``parts`` (key, piece, length and other columns) with sequence_id and offset."""
    parts, seen = counted_cut(parts)
    shards = max(1, round(seen["n"] / shard))
    own_shard = fresh("_shard", parts.columns)
    dealt = parts.withColumn(own_shard, F.pmod(F.xxhash64("piece", key), F.lit(shards)).cast("int"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([key, "piece"], kind="stable").reset_index(drop=True)
        lengths = pdf["length"].tolist()
        order, number, offset = [], [], []
        for s, own in enumerate(best_two_fit(lengths, length)):
            at = 0
            for i in own:
                order.append(i)
                number.append(s)
                offset.append(at)
                at += lengths[i]
        out = pdf.iloc[order].copy()
        out["sequence_id"] = np.array(number, dtype=np.int64) + (out[own_shard].to_numpy().astype(np.int64) << 40)
        out["offset"] = np.array(offset, dtype=np.int64)
        return out[columns]

    columns = [*parts.columns, "sequence_id", "offset"]
    schema = ", ".join(f"`{n}` {t}" for n, t in parts.dtypes) + ", sequence_id bigint, offset bigint"
    return dealt.groupBy(own_shard).applyInPandas(run, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the packed sequences themselves, from pieces that kept their ids."""
    own = F.array_sort(F.collect_list(F.struct("offset", "ids")))  # at most one sequence's worth of ids
    return packed.groupBy("sequence_id").agg(own.alias("_p")).select("sequence_id", F.flatten(F.col("_p.ids")).alias("ids"))
