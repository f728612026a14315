"""URL rules as a sort-merge range join.

The labels of a host, reversed and each closed by a dot (``example.org`` -> ``org.example.``), turn "this host
and all subdomains" into an interval of keys, and the intervals of rules nest.  Urls and rules are dealt by
ranges of that key; urls of one host are told apart by a hash, so a hot host spreads over several ranges, and a
rule goes to each range its interval overlaps.  Each range is read once in key order, with a stack of the
rules whose interval is open; each stack entry holds the path prefixes of one rule host.

A rule fits if its host is the url's or a parent of it, and the url's path starts with the rule's.  The longest
(host plus path) wins, at equal length the longer host, between equal rules block.  Defined results: a null
url, or one without ``://``, has an empty host and path, which no rule fits; rules with a null or empty host or an
unknown action are ignored, a null path is empty; a url without a rule gets the default verdict; repeated
rows come out as often as they went in; empty tables give the default, or nothing.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from sparkwalk.session import counted_cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Keys that are looked at for each range, to place its bounds.
KEYS_PER_RANGE = 64
LAST = "\U0010ffff"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null and where there is no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def reversed_host(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, "[.]", -1)), "."), F.lit("."))


class Stack:
    """The rules whose intervals hold the current key, outermost first."""

    def __init__(self) -> None:
        self.open: list[tuple[str, dict[str, tuple[str, str]]]] = []  # (interval, path -> (rule, action))

    def close(self, key: str) -> None:
        while self.open and not key.startswith(self.open[-1][0]):
            self.open.pop()

    def add(self, key: str, path: str, rule: str, action: str) -> None:
        self.close(key)
        if not self.open or self.open[-1][0] != key:
            self.open.append((key, {}))
        paths = self.open[-1][1]
        if paths.get(path, ("", ""))[1] != "block":
            paths[path] = (rule, action)

    def find(self, key: str, path: str) -> tuple[str, str] | None:
        self.close(key)
        best, size = None, -1
        for _, paths in self.open:
            for n in sorted({len(p) for p in paths}, reverse=True):
                if n <= len(path) and (hit := paths.get(path[:n])):
                    if len(hit[0]) >= size:  # at equal length the later entry, whose host is longer
                        best, size = hit, len(hit[0])
                    break
        return best


def sweep(frames: Iterator[pd.DataFrame], default: str) -> Iterator[pd.DataFrame]:
    """Rows in order of (part, key, rules first) -> the urls among them with rule and verdict."""
    stack, part = Stack(), None
    for frame in frames:
        rows = []
        for p, key, page, host, path, action in frame[["part", "key", "page", "host", "path", "action"]].itertuples(index=False):
            if p != part:
                stack, part = Stack(), p
            if action:
                stack.add(key, path, host + path, action)
            else:
                rule, verdict = stack.find(key, path) or (None, default)
                rows.append((page, host, path, rule, verdict))
        yield pd.DataFrame(rows, columns=["page", "host", "path", "rule", "verdict"]).astype({"page": "Int64"})


def judge(
    urls: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow"
) -> DataFrame:
    """(key, host, path, rule, verdict) of every row; ``rules`` has action, host, path."""
    host, path = host_and_path(F.col(url))
    known, seen = counted_cut(
        urls.select(F.col(key).cast("long").alias("page"), host.alias("host"), path.alias("path")).withColumn(
            "key", F.concat(reversed_host(F.col("host")), F.lit("\x00"), F.lpad(F.hex(F.xxhash64("page", "path")), 16, "0"))
        )
    )
    spark = urls.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    share = min(1.0, KEYS_PER_RANGE * ranges / max(seen["n"], 1))
    looked = known.filter(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).select("key")
    keys = sorted(r[0] for r in looked.orderBy("key").limit(2 * KEYS_PER_RANGE * ranges).collect())  # places bounds only
    bounds = sorted({keys[i * len(keys) // ranges] for i in range(1, ranges)}) if keys else []

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(part=[bisect.bisect_right(bounds, k) for k in f["key"]])

    def spread(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            parts = [range(bisect.bisect_right(bounds, k), bisect.bisect_right(bounds, k + LAST) + 1) for k in f["key"]]
            yield f.assign(part=[list(p) for p in parts]).explode("part").astype({"part": "int32"})

    fields = "key string, page long, host string, path string, action string, part int"
    asked = known.select("key", "page", "host", "path", F.lit(None).cast("string").alias("action"))
    given = (
        rules.select(
            F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), F.col("action").alias("action")
        )
        .filter(F.col("host").isNotNull() & (F.col("host") != "") & F.col("action").isin("allow", "block"))
        .select(reversed_host(F.col("host")).alias("key"), F.lit(None).cast("long").alias("page"), "host", "path", "action")
    )
    both = asked.mapInPandas(place, fields).unionByName(given.mapInPandas(spread, fields))
    ordered = both.repartition(ranges, "part").sortWithinPartitions("part", "key", F.col("action").isNull())
    return ordered.mapInPandas(
        lambda frames: sweep(frames, default), "page long, host string, path string, rule string, verdict string"
    ).withColumnRenamed("page", key)
