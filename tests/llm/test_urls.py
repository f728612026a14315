"""URL rules against SQL and against a plain loop over all rules."""

import itertools
import random

import pytest
from llm.sql import same

from sparkwalk.llm import queries, urls


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_query_equals_sql(spark, sf):
    assert same(queries.op3_urls, queries.ORACLE["op3_urls"], spark, f"/root/testdata/sf{sf}")


def plain(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0] if rest[cut:].startswith("/") else ""
    fits = [
        (len(h + p), len(h), a == "block", h + p, a)
        for a, h, p in rules
        if h and (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else default


def test_nested_rules_over_many_ranges(spark):
    rng = random.Random(4)
    hosts = [".".join(p) for n in (1, 2, 3) for p in itertools.product(["a", "b-c", "bc", "b"], repeat=n)]
    paths = ["", "/", "/x", "/x/", "/x/y", "/xyz"]
    rules = [(rng.choice(["allow", "block"]), rng.choice(hosts), rng.choice(paths)) for _ in range(150)]
    pages = [(i, f"http://{rng.choice(['', 'Z.', 'q.'])}{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', '?a=/x', '#/x'])}") for i in range(600)]
    pages += [(900 + i, "ftp://hot.a.b/x/y") for i in range(300)] + [(1, "http://a/x")] * 2
    pages += [(2000, None), (2001, ""), (2002, "no scheme.a/x"), (2003, "http://"), (2004, "http:///x"), (2005, "x://a." + "b." * 5000 + "a/x"), (None, "http://a/")]
    frame = spark.createDataFrame([(k, u, "h") for k, u in pages], "page_id long, url string, host string")
    given = spark.createDataFrame(rules + [("allow", None, "/"), ("block", "", "/"), ("maybe", "a", "/"), (None, "a", "/")], "action string, host string, path string")
    got = sorted(map(repr, map(tuple, urls.judge(frame, given).collect())))
    assert got == sorted(repr((k, *plain(u, rules))) for k, u in pages)


def test_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://a/")], "page_id long, url string")
    none = spark.createDataFrame([], "action string, host string, path string")
    assert [tuple(r) for r in urls.judge(pages, none, default="block").collect()] == [(1, "a", "/", None, "block")]
    assert urls.judge(pages.limit(0), none).count() == 0
