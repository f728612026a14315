"""Graph operators against plain Python on a small random multigraph with ties and loops."""

import heapq
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sparkwalk.operators import bands, components, forest, routing, skew
from sparkwalk.operators.components import connected_components
from sparkwalk.operators.contract import contract_chains
from sparkwalk.plans import benefit

EDGE = "id int, src_vid int, trg_vid int, len bigint"


def graph(n=30, m=42, seed=5):
    rnd = random.Random(seed)
    edges = [(i, rnd.randrange(n), rnd.randrange(n), rnd.choice([1, 2, 2, 3])) for i in range(m)]
    edges += [(m, 3, 3, 2), (m + 1, *edges[0][1:3], edges[0][3])]  # a loop and a parallel link
    return edges


def neighbours(edges):
    out = defaultdict(list)
    for i, a, b, w in edges:
        out[a].append((b, w, i))
        if a != b:
            out[b].append((a, w, i))
    return out


def dijkstra(edges, s):
    adj, dist, heap = neighbours(edges), {s: 0}, [(0, s)]
    while heap:
        d, u = heapq.heappop(heap)
        for v, w, _ in adj[u] if d == dist[u] else ():
            if d + w < dist.get(v, 1 << 60):
                dist[v] = d + w
                heapq.heappush(heap, (d + w, v))
    return dist


def labels(edges):
    parent = {}
    find = lambda v: v if parent.setdefault(v, v) == v else find(parent[v])
    for _, a, b, _ in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {v: find(v) for v in parent}


def test_components(spark):
    edges = graph(m=22)
    got = connected_components(spark.createDataFrame(edges, EDGE)).collect()
    assert {r.vid: r.cid for r in got} == labels(edges)


@pytest.fixture(scope="module")
def routed(spark):
    edges = graph()
    full = {s: dijkstra(edges, s) for s in labels(edges)}
    pairs = [(o, d, 1 + (o * d) % 3) for o in full for d in full[o] if (o + 2 * d) % 5 < 2]
    df = spark.createDataFrame(edges, EDGE)
    return edges, full, pairs, df, routing.Routes(spark.createDataFrame(pairs, "vid_o int, vid_d int, n_ods bigint"), df)


def test_distances_and_paths(routed):
    edges, full, pairs, _, routes = routed
    assert {(r.vid_o, r.vid_d): r.d for r in routes.lengths().collect()} == {(o, d): full[o][d] for o, d, _ in pairs}
    by_id = {e[0]: e for e in edges}
    total = defaultdict(int)
    for r in routes.paths().collect():
        total[r.vid_o, r.vid_d] += by_id[r.edge_id][3]
    assert dict(total) == {(o, d): full[o][d] for o, d, _ in pairs if o != d}


def test_trips_times_length(routed):
    edges, full, pairs, _, routes = routed
    by_id = {e[0]: e for e in edges}
    assert sum(r.n_trips * by_id[r.id][3] for r in routes.edge_trips().collect()) == sum(n * full[o][d] for o, d, n in pairs)


@pytest.mark.parametrize("width", [2, 7, 1000])
def test_bands_of_any_width(spark, width):
    """Few rows are written twice, and never those of a closed band."""
    edges = [(2 * i, i, i + 1, 1 + i % 4) for i in range(200) if i % 20 < 19] + [(2 * i + 1, i, i + 20, 1 + i % 3) for i in range(180)] + [(999, 300, 301, 1)]
    want = {s: dijkstra(edges, s) for s in (0, 17, 100)}
    arcs = routing.arc_table(spark.createDataFrame(edges, EDGE))
    half = sorted(want[0], key=want[0].get)[len(want[0]) // 2]
    some = [(0, half), (17, max(want[17])), (17, 17), (17, 4000)]
    result = routing.distances(spark.createDataFrame([(100, None), *some], "vid_o int, vid_d int"), arcs, width=width)
    got = {(r.o, r.v): r.dist for r in result.settled().collect()}
    assert all(want[o][v] == d for (o, v), d in got.items())
    assert {v: d for (o, v), d in got.items() if o == 100} == want[100] and {v: d for (o, v), d in got.items() if o == 17} == want[17]
    assert {(r.o, r.v) for r in bands.found(result).collect()} == set(some[:3])
    near = {(o, v) for o, v in got if o == 0}
    assert len(near) == len([v for v, d in want[0].items() if d // width <= want[0][half] // width])  # given up after that band
    assert sum(n for _, _, n in result.bands) == len(got)
    final = {k: n for k, _, n in result.bands}
    assert all(own <= final.get(k, 0) for k, _, own in result.rounds)  # of settled nodes a round writes those of its band only
    if width < 1000:
        assert sum(n for _, n, _ in result.rounds) < len(result.rounds) * len(got) / 3


def test_routes_are_mended(spark):
    """As if routed anew: lengths, paths and usage, one removal after another."""
    edges, left = graph(n=60, m=110, seed=8), None
    pairs = [(o, d, 1 + o % 3) for o in labels(edges) for d in labels(edges) if (o + 3 * d) % 7 == 0]
    df = spark.createDataFrame(pairs, "vid_o int, vid_d int, n_ods bigint")
    routes, paths = routing.Routes(df, spark.createDataFrame(edges, EDGE)), None
    for gone in ({3, 40, 77}, {5, 6, 61, 80, 99}):
        left = [e for e in left or edges if e[0] not in gone]
        links = spark.createDataFrame(left, EDGE)
        removed = spark.createDataFrame([(i,) for i in gone], "id int")
        done = routing.repair(routes, links, removed)
        lengths, paths = routing.reroute(routes, links, removed, paths)
        paths = paths.cache()
        anew = routing.Routes(df, links)
        rows = lambda f, *c: sorted(map(tuple, f.select(*c).collect()))
        assert rows(lengths, "vid_o", "vid_d", "n_ods", "d") == rows(anew.lengths(), "vid_o", "vid_d", "n_ods", "d")
        assert rows(paths, "vid_o", "vid_d", "edge_id", "hop") == rows(anew.paths(), "vid_o", "vid_d", "edge_id", "hop")
        assert rows(done.routes.edge_trips(), "id", "n_trips") == rows(anew.edge_trips(), "id", "n_trips")
        assert {r[:2] for r in rows(lengths.filter("changed"), "vid_o", "vid_d")} <= set(rows(done.hit, "vid_o", "vid_d"))
        assert done.touched["mended"] <= done.touched["lost"] < routes.state.count() / 2
        routes = done.routes


def test_removals_that_touch_no_path(spark):
    edges = [(0, 1, 2, 5), (1, 2, 3, 5), (2, 1, 3, 50)]
    routes = routing.Routes(spark.createDataFrame([(1, 3, 2)], "vid_o int, vid_d int, n_ods bigint"), spark.createDataFrame(edges, EDGE))
    lengths, paths = routing.reroute(routes, spark.createDataFrame(edges[:2], EDGE), spark.createDataFrame([(2,)], "id int"))
    assert [tuple(r) for r in lengths.select("vid_o", "vid_d", "d", "changed").collect()] == [(1, 3, 10, False)]
    assert sorted((r.edge_id, r.hop) for r in paths.collect()) == [(0, 1), (1, 0)]


def test_hubs_spread_over_salts(routed):
    _, _, _, df, _ = routed
    arcs = routing.arc_table(df)
    front = arcs.select(F.col("u").alias("v")).distinct()
    rows = lambda a: sorted((r.u, r.w, r.id) for r in a.follow(front).collect())
    assert rows(routing._Arcs(arcs, [], hot_rows=3)) == rows(routing._Arcs(arcs, []))


def test_betweenness(spark):
    edges = [e for e in graph(m=30) if e[1] != e[2]]
    want = defaultdict(float)
    adj = neighbours(edges)
    for s in labels(edges):
        dist = dijkstra(edges, s)
        order = sorted(dist, key=dist.get)
        paths, gain = defaultdict(float, {s: 1.0}), defaultdict(float)
        back = {v: [(u, i) for u, w, i in adj[v] if u in dist and dist[u] + w == dist[v]] for v in order}
        for v in order:
            paths[v] += sum(paths[u] for u, _ in back[v])
        for v in reversed(order):
            for u, i in back[v]:
                part = paths[u] / paths[v] * (1 + gain[v])
                gain[u] += part
                want[i] += part / 2
    for batches in (1, 7):
        got = {r.id: r.bwness for r in routing.edge_betweenness(spark.createDataFrame(edges, EDGE), batches=batches).collect()}
        assert got == pytest.approx({e[0]: want[e[0]] for e in edges})


def test_first_connected_step(spark):
    edges = [(a, b, i % 6) for i, a, b, _ in graph(m=26)]
    pairs = [(o, d, 1) for o in range(30) for d in range(0, 30, 4)]
    want = {}
    for step in reversed(range(6)):
        lab = labels([(0, a, b, 1) for a, b, s in edges if s <= step])
        want |= {(o, d): step for o, d, _ in pairs if o in lab and d in lab and lab[o] == lab[d]}
    got = benefit.first_connected_step(
        spark.createDataFrame(pairs, "vid_o int, vid_d int, n_ods bigint"), spark.createDataFrame(edges, "src_vid int, trg_vid int, step int"), 5
    )
    assert {(r.vid_o, r.vid_d): r.step for r in got.collect()} == want


def test_distance_profile(spark):
    edges = [(*e, (e[0] % 5) + 1 if e[0] % 2 else 6) for e in graph(m=60)]
    base = [e[:4] for e in edges if e[4] == 6]
    pairs = [(o, d, 1) for o in labels(base) for d in dijkstra(base, o)]
    df = spark.createDataFrame(pairs, "vid_o int, vid_d int, n_ods bigint")
    profile = benefit.distance_profile(df, spark.createDataFrame(edges, EDGE + ", gone_at int"), 5).cache()
    got = {(r.step, r.vid_o, r.vid_d): r.d for r in benefit.distance_snapshots(df, profile, 5).collect()}
    want = {}
    for k in range(6):
        left = [e[:4] for e in edges if e[4] > k]
        for o in {p[0] for p in pairs}:
            dist = dijkstra(left, o)
            want |= {(k, a, b): dist[b] for a, b, _ in pairs if a == o}
    assert got == want
    mean = {r.step: r.d_mean for r in benefit.mean_distance(profile, 5, 6, 30).collect()}
    assert mean == pytest.approx({k: sum(v for (s, *_), v in want.items() if s == k) / len(pairs) for k in range(6)})


def test_chain_becomes_one_edge(spark):
    rows = [(i, i, i + 1, 10 + i, True, False) for i in range(6)] + [(6, 0, 10, 1, True, True), (7, 0, 11, 1, True, False), (8, 6, 12, 1, True, False), (9, 6, 13, 1, False, False)]
    edges = spark.createDataFrame(rows, EDGE + ", `exists` boolean, is_xwalk boolean")
    out = contract_chains(edges, spark.createDataFrame([(99,)], "vid int")).collect()
    assert [(list(r.eids), r.src_vid, r.trg_vid, r.len) for r in out if r.orig_id == -1] == [([1, 2, 3, 4], 1, 5, 50)]
    assert len(out) == 7


def test_variant_without_a_connected_trip_counts_zero(spark):
    edges = spark.createDataFrame([("a", 1, 2), ("b", 1, 3), ("c", 8, 9)], "variant string, src_vid int, trg_vid int")
    pairs = spark.createDataFrame([(1, 2, 5), (2, 3, 7)], "vid_o int, vid_d int, n_ods bigint")
    nodes = connected_components(edges, ["variant"])
    assert sorted(map(tuple, components.connected_trips(pairs, nodes, ["variant"]).collect())) == [("a", 5), ("b", 0), ("c", 0)]


def test_lengths_are_positive_whole_numbers(spark):
    with pytest.raises(ValueError):
        routing.arc_table(spark.createDataFrame([(1, 1, 2, 0.5)], "id int, src_vid int, trg_vid int, len double"))
    with pytest.raises(Exception, match="positive length"):
        routing.arc_table(spark.createDataFrame([(1, 1, 2, 0)], EDGE)).collect()


def test_weakest_links_and_spanning_forest(spark):
    """Against Kruskal, per key: total weight and number of links, and the weight at which each pair meets."""
    rnd, rows, want, least = random.Random(4), [], {}, {}
    pairs = [(k, o, d, o * 100 + d) for k in "ab" for o in range(0, 80, 3) for d in range(0, 80, 7)]
    for k, m in (("a", 70), ("b", 200)):
        own = [(k, i, rnd.randrange(70), rnd.randrange(70), rnd.choice([0, 0, 1, 2, 5, i])) for i in range(m)]
        own += [(k, m, 4, 4, -1), (k, m + 1, *own[0][2:])] + [(k, m + 2 + i, 70 + i, 71 + i, i) for i in range(9)]  # a loop, a copy, a rising chain
        group, total = {}, [0, 0]
        find = lambda v: v if group.setdefault(v, v) == v else find(group[v])
        for _, _, a, b, w in sorted(own, key=lambda e: e[4]):
            a, b = find(a), find(b)
            if a != b:
                group[a] = b
                total = [total[0] + 1, total[1] + w]
                for p in pairs:
                    if p[0] == k and p[1] != p[2] and p not in want and find(p[1]) == find(p[2]):
                        want[p] = w
        rows, least[k] = rows + own, total
    edges = spark.createDataFrame(rows, "k string, id int, src_vid int, trg_vid int, cost int")
    got = forest.bottlenecks(spark.createDataFrame(pairs, "k string, vid_o int, vid_d int, note int"), edges, "cost", ["k"])
    assert {(r.k, r.vid_o, r.vid_d, r.note): r.cost for r in got.collect()} == want
    chosen = forest.spanning_forest(edges, "cost", keys=["k"]).join(edges, ["k", "id"]).groupBy("k").agg(F.count("id"), F.sum("cost"))
    assert {r[0]: [r[1], r[2]] for r in chosen.collect()} == least


def test_forest_of_nothing(spark):
    edges = spark.createDataFrame([(1, 2, 2, 0)], "id int, src_vid int, trg_vid int, step int")  # a loop alone
    pairs = spark.createDataFrame([(2, 2, 1), (2, 3, 1), (None, 2, 1)], "vid_o int, vid_d int, n_ods bigint")
    assert forest.spanning_forest(edges, "step").count() == 0
    assert forest.bottlenecks(pairs, edges, "step").count() == 0
    assert [tuple(r) for r in benefit.first_connected_step(pairs, edges, 3).collect()] == [(2, 2, 1, 0)]


def test_betweenness_of_many_parts_takes_few_batches(spark, monkeypatch):
    """An origin reaches its own part only, so batches follow the parts, not the whole network squared."""
    searches = []
    search = routing.bands.search
    monkeypatch.setattr(routing.bands, "search", lambda *a, **k: searches.append(1) or search(*a, **k))
    monkeypatch.setattr(routing, "BATCH_ROWS", 400)
    edges = [(i, 2 * i, 2 * i + 1, 5) for i in range(100)]
    edges += [(100, 1000, 1001, 5), (101, 1001, 1002, 5), (102, 2000, 2000, 5)]
    got = {r.id: r.bwness for r in routing.edge_betweenness(spark.createDataFrame(edges, EDGE)).collect()}
    assert got == {**{i: 1.0 for i in range(100)}, 100: 2.0, 101: 2.0, 102: 0.0}
    assert len(searches) == 2  # 100 parts of 2 origins x 2 arcs, one of 3 x 4: 412 rows; 204 x 204 over all


def test_component_rounds_measure_no_join_for_hot_keys(spark, monkeypatch):
    """The arcs at the busiest node are counted with the choices, so no round joins its arcs twice to look for hubs."""
    measured, join, hot_keys = [], components.skew_join, skew.hot_keys
    monkeypatch.setattr(components, "skew_join", lambda *a, **k: join(*a, **k, hot_rows=10))
    monkeypatch.setattr(skew, "hot_keys", lambda df, on, *a: measured.append(on[-1]) or hot_keys(df, on, *a))
    got = lambda edges: {r.vid: r.cid for r in components.connected_components(spark.createDataFrame(edges, EDGE)).collect()}
    assert got([(i, i, i + 1, 1) for i in range(60)]) == {i: 0 for i in range(61)}
    assert not {"u", "w"} & set(measured)
    star = [(i, 7, 100 + i, 1) for i in range(40)] + [(50, 200, 201, 1), (51, 300, 300, 1)]
    assert got(star) == {7: 7, **{100 + i: 7 for i in range(40)}, 200: 200, 201: 200, 300: 300}
    assert {"u", "w"} <= set(measured)  # a hub is still spread


def test_many_arcs_stay_where_they_are(spark, monkeypatch):
    """Where there are many arcs, short cuts that cost more than their rounds are left out, and no round shuffles the arcs; the routes are the same."""
    edges = graph()
    df, nodes = spark.createDataFrame(edges, EDGE), sorted(labels(edges))
    full = {s: dijkstra(edges, s) for s in nodes}
    pairs = spark.createDataFrame([(o, d, 1) for o in nodes for d in full[o]], "vid_o int, vid_d int, n_ods bigint")
    arcs = routing.arc_table(df)
    plain, both = arcs.groupBy("u", "w").agg(F.min("len").alias("len")), routing.shortcuts(arcs)
    for most, left in ((0, 2), (sum(r["count"] ** 2 for r in plain.groupBy("u").count().collect()), 1)):
        monkeypatch.setattr(routing, "BUCKET_ARCS", 10)
        monkeypatch.setattr(routing, "SHORTCUT_PAIRS", most)
        some, out = routing.shortcuts(arcs)
        assert out == left and some.count() < both[0].count()
        assert left == 1 or sorted(map(tuple, some.select("u", "w", "len").collect())) == sorted(map(tuple, plain.collect()))
        net = routing._Arcs.with_shortcuts(arcs, [])
        assert net.in_a_band == 4 << left
        monkeypatch.setattr(routing, "SHORTCUT_PAIRS", 0)
        front = spark.createDataFrame([(v, i) for i, v in enumerate(nodes)], "v int, o int").hint("merge")
        plan = net.follow(front)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1  # the front alone
        got = routing.pair_distances(pairs, df).collect()
        assert {(r.vid_o, r.vid_d): r.d for r in got} == {(o, d): full[o][d] for o in nodes for d in full[o]}


def test_betweenness_with_dead_ends_folded(spark, monkeypatch):
    """Folded trees, parallel links, pairs alone with each other and limited origins count as if every pair were walked, searched or, in small parts, worked out in a task."""
    searches, search = [], routing.bands.search
    monkeypatch.setattr(routing.bands, "search", lambda *a, **k: searches.append(a[0].count()) or search(*a, **k))
    monkeypatch.setattr(routing, "FOLD_LINKS", 0)
    monkeypatch.setattr(routing, "FOLDS", 2)
    rnd, rows, want = random.Random(3), [], {}
    for k, m in (("a", 0), ("b", 12)):
        own = [(i, i, (i + 1) % 8, 1 + i % 2) for i in range(8)] + [(8 + i, 0, 4, 5 + i % 2) for i in range(3)]  # a ring, chords of two lengths
        own += [(100 + i, i, rnd.randrange(i), rnd.choice([1, 2, 3])) for i in range(8, 40)]  # trees on it
        own += [(200 + i, 50 + i, 51 + i, 2) for i in range(9) if i != 3] + [(300, 50, 51, 2), (301, 50, 51, 9), (302, 70, 70, 1), (303, 80, 81, 1)]
        own += [(400 + i, rnd.randrange(90, 99), rnd.randrange(90, 99), 1) for i in range(m)]
        rows += [(k, *e) for e in own]
        adj = neighbours([e for e in own if e[1] != e[2]])
        for s in adj:
            dist = dijkstra(own, s)
            order, paths, gain = sorted(dist, key=dist.get), defaultdict(float, {s: 1.0}), defaultdict(float)
            back = {v: [(u, i) for u, w, i in adj[v] if u in dist and dist[u] + w == dist[v]] for v in order}
            for v in order:
                paths[v] += sum(paths[u] for u, _ in back[v])
            for v in reversed(order):
                for u, i in back[v]:
                    part = paths[u] / paths[v] * (1 + gain[v])
                    gain[u] += part
                    want.setdefault((k, i), []).append((s, part / 2))
    edges = spark.createDataFrame(rows, "k string, " + EDGE)
    for some, batches, small in ((None, None, 0), ({1, 12, 20, 39, 50, 92}, 3, 0), (None, None, 8), ({1, 12, 20, 39, 50, 92}, None, 100)):
        monkeypatch.setattr(routing, "SMALL", small)
        sources = None if some is None else spark.createDataFrame([(k, v) for k in "ab" for v in some], "k string, vid int")
        got = {(r.k, r.id): r.bwness for r in routing.edge_betweenness(edges, ["k"], sources, batches).collect()}
        assert got == pytest.approx({(k, e): sum(x for s, x in want.get((k, e), ()) if some is None or s in some) for k, e, *_ in rows})
    assert searches[0] < 30 and len(searches) <= 1 + 3 + 1  # origins: two rings of 8 nodes and at most 9 more, of 121 nodes


def test_trips_are_searched_in_components_that_hold_a_pair(spark, monkeypatch):
    """Links elsewhere are kept with no trips, but not laid out."""
    laid, shortcuts = [], routing.shortcuts
    monkeypatch.setattr(routing, "shortcuts", lambda arcs, *a, **k: laid.append(arcs.count()) or shortcuts(arcs, *a, **k))
    edges = spark.createDataFrame([(i, i, i + 1, 5) for i in range(40) if i % 4 < 3] + [(90, 8, 9, 7), (91, 60, 60, 1)], EDGE)
    pairs = spark.createDataFrame([(8, 11, 3), (10, 10, 2), (21, 20, 1)], "vid_o int, vid_d int, n_ods bigint")
    got = lambda **k: sorted(map(tuple, routing.edge_trips(pairs, edges, **k).select("id", "n_trips").collect()))
    want = {8: 3, 9: 3, 10: 3, 20: 1}
    assert got(nodes=connected_components(edges)) == got() == sorted((i, want.get(i, 0)) for i in [*(i for i in range(40) if i % 4 < 3), 90, 91])
    assert laid == [2 * 7, 2 * 31]
