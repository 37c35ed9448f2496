"""Methods, errors and streams that the queries over the test tables do not reach, on small graphs and by simulation."""

import heapq
import itertools
import math
import random
import time
import struct
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.operators.graph import Graph, KeyIndex
from loomgraph.operators.log import effects, first_touches, lifetimes, replay
from loomgraph.operators.prefixes import MEASURES, TOTALS, prefix_node_metrics, prefix_totals
from loomgraph.operators.window import SlidingWindow, add_flags, check_edges, expired_counts, window_calls
from loomgraph.plans.order import carried, even_buckets
from loomgraph.sources.interop import from_frames, from_networkx, index_keys, to_frames


def graph(spark, edges, **kw):
    return Graph.empty(spark, **kw).add_edges(edges)


def values(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_reserved_ids_do_not_outlive_clear(spark):
    g = Graph.empty(spark, 3).reserve_nodes(500)
    assert g.n_ids() == 500 and g.n_nodes() == 0 and g.clear().n_ids() == 3
    assert graph(spark, [(1, 700)]).reserve_nodes(500).n_ids() == 701
    copied = graph(spark, [(1, 9)], n_nodes=4).copy()
    assert copied.n_ids() == 10 and copied.clear().n_ids() == 10 and not copied.clear().directed
    with pytest.raises(IndexError):
        g.reserve_nodes(-1)
    with pytest.raises(ValueError):
        g.reserve_edges(-1)


def test_new_nodes_are_counted(spark):
    g = graph(spark, [(2, 5)])
    more, added = g.count_new_nodes(1, 6)
    assert added == 4 and more.n_nodes() == 6 and g.count_new_nodes(4, 0)[1] == 0
    asked = spark.createDataFrame([(2,), (3,), (3,)], "id long")
    assert values(g.add_node_flags(asked), "id", "added") == [(2, False), (3, True)]


def test_dense_histogram_and_empty_graph(spark):
    assert values(Graph.empty(spark).degree_histogram(dense=True), "degree", "nodes") == [(0, 0)]
    star = graph(spark, [(0, k) for k in range(1, 5)]).add_nodes(9, 1)
    assert values(star.degree_histogram(dense=True), "degree", "nodes") == [(0, 1), (1, 4), (2, 0), (3, 0), (4, 1)]
    none = Graph.empty(spark, 7)
    assert none.n_components() == 0 and none.triangle_count() == 0 and none.avg_clustering() == 0 and none.density() == 0
    assert none.pagerank().count() == 0 and none.betweenness_approx().count() == 0 and none.all_local_triangles().count() == 7


def test_lazy_validation_fails_when_it_runs(spark):
    shape = "u long, v long, w double"
    good = spark.createDataFrame([(0, 1, 2.0), (1, 0, 9.0), (3, 3, 1.0)], shape)
    assert values(Graph.from_edges(good, weighted=True, lazy=True).edges, "u", "v") == [(0, 1)]
    for row in ((-1, 2, 1.0), (None, 2, 1.0), (2**32, 2, 1.0), (5, 5, -1.0), (1, 2, float("nan")), (1, 2, 0.0)):
        bad = spark.createDataFrame([(0, 1, 2.0), row], shape)
        with pytest.raises((IndexError, ValueError)):
            Graph.from_edges(bad, weighted=True)
        with pytest.raises(Exception, match="out of range|finite and positive"):
            Graph.from_edges(bad, weighted=True, lazy=True).n_edges()


def test_directed_lookups(spark):
    g = graph(spark, [(0, 2), (1, 2), (2, 3)], directed=True)
    assert g.degree(2) == 1 and g.in_degree(2) == 2 and g.in_degree(99) == 0
    assert [r.id for r in g.in_neighbours(2).collect()] == [0, 1] and g.in_neighbours(77).count() == 0
    asked = spark.createDataFrame([(0, 2), (2, 0), (2, 2)], "u long, v long")
    assert values(g.has_edges(asked), "u", "v", "present") == [(0, 2, True), (2, 0, False), (2, 2, False)]
    assert {(r.u, r.v): r.w for r in g.edge_weights(asked).collect()} == {(0, 2): 1.0, (2, 0): None, (2, 2): None}


def test_directed_betweenness(spark):
    chain = graph(spark, [(0, 1), (1, 2)], directed=True)
    assert values(chain.betweenness_approx(k=10**6), "id", "betweenness") == [(0, 0), (1, 1), (2, 0)]
    meeting = graph(spark, [(0, 1), (2, 1)], directed=True)
    assert all(b == 0 for _, b in values(meeting.betweenness_approx(k=10**6), "id", "betweenness"))


@pytest.mark.parametrize(("directed", "weighted"), [(False, False), (True, False), (False, True), (True, True)])
@pytest.mark.parametrize("k", [25, 10**6])
def test_betweenness_by_joins_equals_the_kernel(spark, directed, weighted, k):
    from loomgraph.operators.centrality import betweenness

    rng = random.Random(2)
    edges = [(*rng.sample((u, v), 2), rng.choice([0.5, 1.0, 1.5])) for u, v in itertools.combinations(range(9), 2) if rng.random() < 0.4] + [(20, 21, 1.0)]
    g = graph(spark, edges, directed=directed, weighted=weighted).add_nodes(30, 1)
    one = dict(values(betweenness(g.edges, g.touched, directed, weighted, k, 3, False), "id", "betweenness"))
    two = dict(values(betweenness(g.edges, g.touched, directed, weighted, k, 3, False, broadcast_arcs=-1), "id", "betweenness"))
    assert one.keys() == two.keys() and all(abs(one[i] - two[i]) < 1e-9 for i in one) and (k == 25 or any(one.values()))


def lengths(arcs, s):
    best, heap = {}, [(0.0, s)]
    while heap:
        d, x = heapq.heappop(heap)
        if x not in best:
            best[x] = d
            for u, v, w in arcs:
                if u == x:
                    heapq.heappush(heap, (d + w, v))
    return best


@pytest.mark.parametrize("delta", [None, 0.7, 1e9])
def test_distances_settle_by_buckets(spark, delta):
    from loomgraph.operators.paths import distances

    rng = random.Random(5)
    arcs = [(u, v, rng.choice([1e-6, 0.25, 1.0, rng.random(), 40.0])) for u, v in itertools.permutations(range(12), 2) if rng.random() < 0.25] + [(20, 21, 3.0)]
    got = distances(spark.createDataFrame(arcs, "u long, v long, w double"), spark.createDataFrame([(0,), (3,), (7,), (20,)], "s long"), delta)
    want = {(s, v): d for s in (0, 3, 7, 20) for v, d in lengths(arcs, s).items()}
    assert {(r.s, r.v): r.d for r in got.collect()} == want


def test_distances_without_arcs_and_of_bad_width(spark):
    from loomgraph.operators.paths import distances

    none, one = spark.createDataFrame([], "u long, v long, w double"), spark.createDataFrame([(4,)], "s long")
    assert values(distances(none, one), "s", "v", "d") == [(4, 4, 0.0)] and distances(none, one.limit(0)).count() == 0
    for bad in (0.0, -1.0, float("inf"), float("nan")):
        with pytest.raises(ValueError):
            distances(none, one, bad)


def test_betweenness_by_joins_along_a_long_path(spark):
    """More levels than one plan keeps tables of."""
    from loomgraph.operators.centrality import dependencies_by_joins

    arcs = spark.createDataFrame([(x, x + 1, 1.0) for x in range(20)], "u long, v long, w double")
    told = spark.createDataFrame([(0, 20, 2.0), (0, 99, 1.0), (99, 0, 1.0)], "s long, v long, own double")
    got = dependencies_by_joins(arcs, False, False, told).groupBy("id").agg(F.sum("b").alias("b")).filter("b > 0")
    assert values(got, "id", "b") == [(x, 2.0) for x in range(1, 20)]


def test_drawn_pairs_do_not_depend_on_partitions(spark):
    from loomgraph.operators.centrality import drawn_pairs

    nodes = spark.range(0, 300, 3, 7)
    one, two = (values(drawn_pairs(x, 100, 5000, 9), "s", "v", "own") for x in (nodes, nodes.repartition(3)))
    assert one == two and sum(x for _, _, x in one) == 5000 and all(a != b and a % 3 == b % 3 == 0 for a, b, _ in one)
    assert {a for a, _, _ in one} == {b for _, b, _ in one} == set(range(0, 300, 3))
    assert one != values(drawn_pairs(nodes, 100, 5000, 10), "s", "v", "own")


@pytest.mark.parametrize("arcs", list(itertools.permutations([(0, 1), (1, 2), (2, 0)]))[::2])
def test_directed_triangles_in_any_order(spark, arcs):
    assert graph(spark, list(arcs), directed=True).triangle_count() == 1


def test_complete_graph(spark):
    k10 = graph(spark, list(itertools.combinations(range(10), 2)))
    assert k10.triangle_count() == 120 and {t for _, t in values(k10.local_triangles(), "id", "triangles")} == {36}


#: The friendships of Zachary's karate club (1977), members numbered from 0, each with the later ones it knows.
KARATE = {0: (1, 2, 3, 4, 5, 6, 7, 8, 10, 11, 12, 13, 17, 19, 21, 31), 1: (2, 3, 7, 13, 17, 19, 21, 30), 2: (3, 7, 8, 9, 13, 27, 28, 32), 3: (7, 12, 13), 4: (6, 10), 5: (6, 10, 16), 6: (16,), 8: (30, 32, 33), 9: (33,), 13: (33,), 14: (32, 33), 15: (32, 33), 18: (32, 33), 19: (33,), 20: (32, 33), 22: (32, 33), 23: (25, 27, 29, 32, 33), 24: (25, 27, 31), 25: (31,), 26: (29, 33), 27: (33,), 28: (31, 33), 29: (32, 33), 30: (32, 33), 31: (32, 33), 32: (33,)}


def test_karate_club(spark):
    g = graph(spark, [(a, b) for a, row in KARATE.items() for b in row])
    assert g.n_nodes() == 34 and g.n_edges() == 78 and g.triangle_count() == 45 and g.n_components() == 1
    rank = dict(values(g.pagerank(), "id", "rank"))
    assert abs(sum(rank.values()) - 1) < 1e-9 and max(rank, key=rank.get) == 33


def test_component_labels_belong_to_a_version(spark):
    g = graph(spark, [(0, 1), (2, 3)])
    first = g._labels
    assert g.n_components() == 2 and g.same_component(2, 3) and g._labels is first
    h, _ = g.add_edge(1, 2)
    assert h.n_components() == 1 and g.n_components() == 2


def test_keys_keep_their_type(spark):
    numbers = spark.createDataFrame([(7, 1), (3, 2), (7, 3)], "k long, seq long")
    index = KeyIndex.of(numbers, "k", "seq")
    assert index.id(7) == 0 and index.key(1) == 3 and 3 in index and 4 not in index
    told = index.contains(spark.createDataFrame([(7,), (8,)], "k long"), "k", "known")
    assert values(told, "k", "known") == [(7, True), (8, False)]
    assert [r.key for r in index.keys().collect()] == [7, 3] and [r.id for r in index.ids().collect()] == [0, 1]
    assert index_keys(["a", "b"]) == ["a", "b"] and index_keys([2, 1]) == [2, 1] and len(set(index_keys([1, "1", 1.5]))) == 3


class Other:
    """What from_networkx needs of a graph."""

    def __init__(self, names, edges):
        self.names, self.links = names, edges

    def nodes(self):
        return self.names

    def is_directed(self):
        return True

    def edges(self, data):
        return self.links


def test_from_networkx_keeps_apart_what_prints_alike(spark):
    g, index = from_networkx(spark, Other([1, "1", (2,)], [(1, "1", {}), ("1", (2,), {"weight": 4.0})]))
    assert g.directed and g.weighted and g.n_nodes() == 3 and len(index) == 3 and index.table.select("key").distinct().count() == 3
    assert values(g.edges, "u", "v", "w") == [(0, 1, 1.0), (1, 2, 4.0)]
    plain, numbers = from_networkx(spark, Other([5, 3], [(5, 3, {})]))
    assert not plain.weighted and numbers.id(5) == 0 and numbers.id(3) == 1


def test_frames_both_ways(spark):
    g = graph(spark, [(4, 9, 2.5)], weighted=True).add_nodes(20, 1)
    vertices, edges = to_frames(g)
    back = from_frames(vertices, edges)
    assert back.weighted and values(back.edges, "u", "v", "w") == [(4, 9, 2.5)] and values(back.nodes(), "id") == [(4,), (9,), (20,)]
    named = from_frames(spark.createDataFrame([("a",), ("b",), ("c",)], "name string"), spark.createDataFrame([(1, 3)], "src long, dst long"))
    assert values(named.edges, "u", "v") == [(0, 2)] and named.n_nodes() == 3
    for ids in ([1, 1], [None, 1], [-1, 1]):
        with pytest.raises(ValueError):
            from_frames(spark.createDataFrame([(i,) for i in ids], "id long"), spark.createDataFrame([(1, 1)], "src long, dst long"))


def edgs(flags=0, ids=10, nodes=(0, 1, 2), edges=((0, 1), (1, 2)), magic=b"EDGS", version=3, weights=None, tail=b""):
    body = magic + struct.pack("<HBQQQ", version, flags, ids, len(nodes), len(edges)) + b"".join(struct.pack("<I", i) for i in nodes)
    for k, (u, v) in enumerate(edges):
        body += struct.pack("<II", u, v) + (struct.pack("<d", weights[k]) if weights else b"")
    return body + tail


@pytest.mark.parametrize(
    "data",
    [
        edgs(nodes=(1, 0, 2)),
        edgs(nodes=(0, 0, 1)),
        edgs(nodes=(0, 1, 12)),
        edgs(edges=((0, 1), (1, 0))),
        edgs(edges=((1, 1),)),
        edgs(edges=((0, 3),)),
        edgs(edges=((0, 11),)),
        edgs(magic=b"EDGX"),
        edgs(version=4),
        edgs(flags=4),
        edgs(ids=2),
        edgs(tail=b"x"),
        edgs()[:-1],
        edgs()[:9],
        b"ED",
        edgs(flags=2, weights=(1.0, -1.0)),
        edgs(flags=2, weights=(float("nan"), 1.0)),
        edgs(flags=2, weights=(float("inf"), 1.0)),
    ],
)
def test_invalid_files_are_refused(spark, tmp_path, data):
    (tmp_path / "x.esg").write_bytes(data)
    with pytest.raises(RuntimeError):
        Graph.load(spark, f"{tmp_path}/x.esg")


def test_files_round_trip_across_parts(spark, tmp_path, monkeypatch):
    from loomgraph.sources import edgs as module

    monkeypatch.setattr(module, "BLOCK", 3)
    g = graph(spark, [(k, k + 1) for k in range(20)])
    g.save(f"{tmp_path}/a.esg")
    assert values(Graph.load(spark, f"{tmp_path}/a.esg").edges, "u", "v") == [(k, k + 1) for k in range(20)]
    with pytest.raises(RuntimeError):
        Graph.load(spark, f"{tmp_path}/missing.esg")


def test_carried_looks_back_over_buckets(spark):
    rng = random.Random(3)
    rows = [(i, rng.randrange(0, 500), rng.choice([None, None, rng.randrange(9)])) for i in range(200)]
    df = spark.createDataFrame(rows, "i long, at long, x long")
    want, last = {}, None
    for i, _, x in sorted(rows, key=lambda r: (r[1], r[0])):
        want[i] = last
        last = x if x is not None else last
    for parts in (1, 7, 1000):
        got = carried(df, even_buckets(df, "at", parts), ["at", "i"], df["x"], "before")
        assert {r.i: r.before for r in got.collect()} == want
    empty = df.limit(0)
    assert carried(empty, even_buckets(empty, "at", 3), ["at"], empty["x"], "before").count() == 0


def window_by_hand(calls, width, directed=False):
    live, out = {}, []
    for seq, op, u, v, ts in sorted(calls):
        gone = [e for e, t in live.items() if t < ts - width]
        for e in gone:
            del live[e]
        added = None
        if op == "add":
            e = (u, v) if directed else (min(u, v), max(u, v))
            added = u != v and e not in live
            if u != v:
                live[e] = ts
        out.append((seq, op, added, len(gone)))
    return out


@pytest.mark.parametrize("directed", [False, True])
def test_window_calls_by_simulation(spark, directed):
    rng = random.Random(8)
    clock, calls = 0.0, []
    for seq in range(250):
        clock += rng.choice([0, 0, 1, 2, 5])
        calls.append((seq, rng.choice(["add", "add", "add", "advance"]), rng.randrange(5), rng.randrange(5), clock))
    df = spark.createDataFrame([(*c, 1.0) for c in calls], "seq long, op string, u long, v long, ts double, w double")
    got = [(r.seq, r.op, r.added, r.expired) for r in window_calls(df, 6, directed).orderBy("seq").collect()]
    assert got == window_by_hand(calls, 6, directed)
    adds = [c for c in calls if c[1] == "add"]
    flags = {r.seq: r.added for r in add_flags(df.filter("op = 'add'"), 6, directed).collect()}
    assert flags == {s: a for s, _, a, _ in window_by_hand(adds, 6, directed) if a is not None and s in flags}
    ticks = spark.createDataFrame([(0.0,), (50.0,), (50.0,), (1e6,)], "at double")
    assert sum(r.expired for r in expired_counts(df.filter("op = 'add'"), 6, ticks, directed).collect()) == sum(flags.values())


def test_window_clock_is_checked(spark):
    shape = "seq long, op string, u long, v long, ts double, w double"
    falling = spark.createDataFrame([(1, "add", 0, 1, 5.0, 1.0), (2, "add", 1, 2, 4.0, 1.0)], shape)
    for df in (falling, spark.createDataFrame([(1, "add", 0, 1, math.nan, 1.0)], shape), spark.createDataFrame([(1, "add", 0, 1, math.inf, 1.0)], shape), spark.createDataFrame([(1, "add", 0, 1, None, 1.0)], shape)):
        with pytest.raises(ValueError):
            window_calls(df, 10)
    with pytest.raises(ValueError):
        SlidingWindow(falling, 10)
    w = SlidingWindow(falling.filter("seq = 1"), 10)
    for a, b in ((math.nan, math.nan), (1.0, math.nan), (math.nan, 1.0), (2.0, 1.0), (0.0, math.inf)):
        with pytest.raises(ValueError):
            w.advance(a, b)
    for bad in (math.nan, math.inf):
        with pytest.raises(ValueError):
            w.at(bad)
    assert w.n_edges() == 1 and w.snapshot().n_edges() == 1 and w.advance(5, 16) == 1
    with pytest.raises(AttributeError):
        w.add_edges
    assert SlidingWindow(falling.limit(0), 10).n_edges() == 0


def measured(edges, nodes, directed):
    """{id: (degree, in_degree, strength, triangles, clustering, component)} by hand; edges {(u, v): w}."""
    out, back, near = {n: [] for n in nodes}, {n: 0 for n in nodes}, {n: set() for n in nodes}
    for (u, v), w in edges.items():
        out[u].append(w)
        back[v] += 1
        if not directed:
            out[v].append(w)
            back[u] += 1
        near[u].add(v)
        near[v].add(u)
    got = {}
    for n in nodes:
        seen, todo = {n}, [n]
        while todo:
            for x in near[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        tri = sum(b in near[a] for a, b in itertools.combinations(near[n], 2))
        d = len(near[n])
        got[n] = (len(out[n]), back[n] if directed else len(out[n]), sum(out[n]), tri, 2 * tri / (d * (d - 1)) if d > 1 else 0, min(seen))
    return got


def simulated(rows, points, directed):
    """Per checkpoint what measured gives for each node, and the totals, by carrying out the calls one by one."""
    want, totals = {}, {}
    for at in points:
        live, touched = {}, set()
        for i, op, u, v, w in rows:
            if i > at:
                break
            if op == "clear":
                live, touched = {}, set()
                continue
            e = (u, v) if directed else (min(u, v), max(u, v))
            if op == "node":
                touched.add(u)
            elif u != v and op == "add" and e not in live:
                live[e] = w
                touched |= {u, v}
            elif e in live and op == "remove":
                del live[e]
            elif e in live and op == "update":
                live[e] = w
        got = measured(live, touched, directed)
        want |= {(at, n): x for n, x in got.items()}
        n, m, each = len(touched), len(live), 1 if directed else 2
        rates = sum(x[4] for x in got.values()) / n if n else 0
        totals[at] = (n, m, sum(live.values()), max([x[0] for x in got.values()], default=0), each * m / n if n else 0, each * m / (n * (n - 1)) if n > 1 else 0, sum(x[3] for x in got.values()) // 3, rates, len({x[5] for x in got.values()}))
    return want, totals


OPS = ["add"] * 9 + ["remove"] * 3 + ["update"] * 3 + ["node"] * 2


@pytest.mark.parametrize(("directed", "clears", "points"), [(True, 3, [20, 75, 159, 400]), (False, 4, range(-1, 165, 11))])
def test_metrics_after_prefixes_by_simulation(spark, directed, clears, points):
    rng = random.Random(6 + clears)
    rows = [(i, rng.choice(OPS + ["clear"] * (clears > 3)), rng.randrange(7), rng.randrange(7), float(rng.randrange(1, 9))) for i in range(160)]
    for i in rng.sample(range(10, 150), clears):
        rows[i] = (i, "clear", None, None, None)
    want, totals = simulated(rows, points, directed)
    log = spark.createDataFrame(rows, "seq long, op string, u long, v long, w double")
    at = spark.createDataFrame([(p,) for p in [*points, *points]], "at long")
    found = {(r.at, r.id): (r.degree, r.in_degree, r.strength, r.triangles, r.clustering, r.component_id) for r in prefix_node_metrics(log, at, directed, True).collect()}
    assert found.keys() == want.keys() and all(all(abs(a - b) < 1e-9 for a, b in zip(found[k], want[k], strict=True)) for k in want)
    sums = {r.at: tuple(r)[1:] for r in prefix_totals(log, at, directed, True).collect()}
    assert sums.keys() == totals.keys() and all(all(abs(a - b) < 1e-9 for a, b in zip(sums[k], totals[k], strict=True)) for k in totals)


def test_chosen_measures_and_empty_logs(spark):
    rows = [(1, "add", 1, 2, 2.0), (2, "add", 2, 3, 4.0), (3, "clear", None, None, None), (4, "add", 7, 8, 1.0)]
    log = spark.createDataFrame(rows, "seq long, op string, u long, v long, w double")
    at = spark.createDataFrame([(2,), (3,), (4,)], "at long")
    want, totals = simulated(rows, [2, 3, 4], False)
    for chosen in (["in_degree"], ["component_id", "triangles"]):
        got = {(r["at"], r["id"]): tuple(r)[2:] for r in prefix_node_metrics(log, at, weighted=True, measures=chosen).collect()}
        assert got == {key: tuple(x[MEASURES.index(m)] for m in chosen) for key, x in want.items()}
    for chosen in (["n_components"], ["avg_clustering", "max_degree"]):
        got = {r["at"]: tuple(r)[1:] for r in prefix_totals(log, at, weighted=True, measures=chosen).collect()}
        assert got == {key: tuple(x[TOTALS.index(m)] for m in chosen) for key, x in totals.items()}
    assert [tuple(r)[1:] for r in prefix_totals(log.limit(0), at).collect()] == [(0, 0, 0.0, 0, 0.0, 0.0, 0, 0.0, 0)] * 3
    assert prefix_node_metrics(log.limit(0), at).collect() == prefix_totals(log, at.limit(0)).collect() == []
    with pytest.raises(ValueError):
        prefix_node_metrics(log, at, measures=["rank"])
    # The graph that the log makes is the one since the clear; what calls returned holds for all of them.
    assert [tuple(r) for r in replay(log, weighted=True).edge_list().collect()] == [(7, 8, 1.0)]
    assert sorted(r.id for r in first_touches(log).collect()) == [7, 8]
    assert {r.seq: r.effective for r in effects(log).collect()} == {1: True, 2: True, 4: True}
    assert sorted((r.u, r.born, r.died) for r in lifetimes(log).collect()) == [(1, 1, 3), (2, 2, 3), (7, 4, None)]


@pytest.mark.parametrize("clears", [0, 3])
def test_an_edge_with_most_rows_of_a_log(spark, clears):
    """Its rows lie in several stretches, some of which only update, so what they do hangs on the stretches before."""
    rng = random.Random(clears)
    rows = []
    for seq in range(1500):
        u, v = (1, 2) if rng.random() < 0.8 else rng.sample(range(5), 2)
        quiet = 300 < seq % 750 < 700
        rows.append((seq, "update" if quiet else rng.choice(["add", "remove", "update"]), u, v, rng.choice([None, float(seq)])))
    for at in rng.sample(range(1500), clears):
        rows[at] = (at, "clear", None, None, None)
    live, past, want = {}, Counter(), []
    for seq, op, u, v, w in rows:
        e, w = (min(u or 0, v or 0), max(u or 0, v or 0)), 1.0 if w is None else w
        if op == "clear":
            live, past = {}, Counter()
            continue
        done = (e in live) == (op != "add")
        if done and op == "remove":
            del live[e]
        elif done:
            past[e] += op == "add"
            live[e] = w
        want.append((seq, done, past[e], live.get(e)))
    got = effects(spark.createDataFrame(rows, "seq long, op string, u long, v long, w double"))
    found = {r.seq: (r.effective, r.episode, r.weight) for r in got.collect()}
    assert len(found) == len(want)
    for seq, done, episode, weight in want:
        assert found[seq][:2] == (done, episode) and (weight is None or found[seq][2] == weight)


def test_buckets_hold_as_many_rows_each(spark):
    from loomgraph.plans.order import even_buckets

    far = spark.range(1000).selectExpr("id AS x").union(spark.sql("SELECT 1000000000000L"))
    busy = spark.range(5000).selectExpr("CASE WHEN id < 4000 THEN 3600 * 7 + id / 4000.0 * 3600 ELSE id * 86.4 END AS x")
    for df in (far, busy):
        for parts in (8, 200):
            sizes = df.groupBy(even_buckets(df, "x", parts).alias("b")).count()
            n, top = df.count(), sizes.agg({"count": "max"}).first()[0]
            assert top <= 4 * n / parts + 2 and sizes.count() >= parts // 2
            ordered = df.select("x", even_buckets(df, "x", parts).alias("b")).orderBy("x").collect()
            assert all(a.b <= b.b for a, b in itertools.pairwise(ordered))
    nothing = spark.sql("SELECT cast(NULL AS bigint) AS x")
    assert nothing.select(even_buckets(nothing, "x", 4)).first()[0] is None


def test_expiring_stream(spark, tmp_path):
    from loomgraph.streaming.live import expiring

    shape = "u long, v long, ts timestamp, w double, seq long"
    at = lambda s: f"2024-01-01 00:00:{s:02d}"
    rows = [(0, 1, at(0), 1.0, 1), (0, 1, at(5), 2.0, 2), (0, 1, at(5), 3.0, 3), (2, 3, at(1), 1.0, 4), (4, 4, at(2), 1.0, 5)]
    spark.createDataFrame(rows, shape.replace("ts timestamp", "ts string")).selectExpr("u", "v", "cast(ts AS timestamp) ts", "w", "seq").coalesce(1).write.parquet(f"{tmp_path}/in")

    def run():
        q = expiring(spark.readStream.schema(shape).parquet(f"{tmp_path}/in"), 10).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        q.awaitTermination()

    run()
    late = [(0, 1, at(40), 4.0, 6), (8, 9, "2024-01-01 00:01:30", 1.0, 7)]
    spark.createDataFrame(late, shape.replace("ts timestamp", "ts string")).selectExpr("u", "v", "cast(ts AS timestamp) ts", "w", "seq").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run()
    got = Counter((r.u, r.v, r.event) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got[0, 1, "added"] == 2 and got[0, 1, "refreshed"] == 2 and got[2, 3, "added"] == 1 and got[8, 9, "added"] == 1
    assert got[2, 3, "expired"] == 1 and not any(u == v for u, v, _ in got)


def test_windowed_degrees_count_neighbours_once(spark):
    from loomgraph.streaming.live import windowed_degrees

    rows = [(0, 1, "2024-01-01 00:00:01"), (1, 0, "2024-01-01 00:00:02"), (0, 2, "2024-01-01 00:00:03"), (0, 1, "2024-01-01 00:01:03"), (5, 5, "2024-01-01 00:00:03")]
    df = spark.createDataFrame(rows, "u long, v long, ts string").selectExpr("u", "v", "cast(ts AS timestamp) AS ts")
    got = sorted((str(r.start)[-5:], r.id, r.degree) for r in windowed_degrees(df, "1 minute").collect())
    assert got == [("00:00", 0, 2), ("00:00", 1, 1), ("00:00", 2, 1), ("01:00", 0, 1), ("01:00", 1, 1)]


def test_a_window_answers_every_metric_of_a_graph(spark):
    rows = [(1, 1, 2, 0.0, 1.0), (2, 2, 3, 1.0, 2.0), (3, 1, 3, 2.0, 3.0), (4, 3, 4, 3.0, 4.0), (5, 5, 6, 50.0, 1.0), (6, 1, 2, 52.0, 5.0), (7, 1, 1, 53.0, 1.0)]
    events = spark.createDataFrame(rows, "seq long, u long, v long, ts double, w double")
    w = SlidingWindow(events, 10, weighted=True, n_nodes=9)
    g = w.snapshot()
    assert w.n_nodes() == 6 and w.n_edges() == 2 and w.n_ids() == 9 and not w.directed and w.weighted
    plain = ("n_nodes", "n_edges", "n_ids", "max_degree", "avg_degree", "density", "total_weight", "n_components", "n_strong_components", "triangle_count", "avg_clustering")
    frames = ("nodes", "edge_list", "neighbour_arrays", "in_neighbour_arrays", "degrees", "in_degrees", "degree_histogram", "stats", "strengths", "component_ids", "component_sizes", "strong_component_ids", "triangles", "local_triangles", "all_local_triangles", "clustering", "pagerank", "betweenness_approx")
    of_node = ("degree", "in_degree", "strength", "component_id", "component_size", "clustering_coefficient")
    for name in plain:
        assert getattr(w, name)() is not None, name
    for name in frames:
        assert getattr(w, name)().columns == getattr(g, name)().columns, name
    assert values(w.degrees(), "id", "degree") == [(1, 1), (2, 1), (3, 0), (4, 0), (5, 1), (6, 1)]
    for name in of_node:
        assert getattr(w, name)(1) is not None, name
    assert w.has_edge(2, 1) and w.edge_weight(1, 2) == 5.0 and not w.same_component(1, 3) and w.degree(4) == 0
    assert values(w.neighbours(1), "id") == values(w.component_nodes(1), "id")[1:] == [(2,)]
    for name in ("add_edge", "add_edges", "remove_edge", "update_weights", "clear", "reserve_nodes"):
        with pytest.raises(AttributeError):
            getattr(w, name)


def test_windows_refuse_bad_edges(spark):
    shape = "seq long, op string, u long, v long, ts double, w double"
    for bad, error in (((1, -2), IndexError), ((4294967295, 2), IndexError), ((None, 2), IndexError), ((-1, -1), IndexError)):
        rows = spark.createDataFrame([(1, "add", *bad, 1.0, 1.0)], shape)
        with pytest.raises(error):
            SlidingWindow(rows, 5)
        with pytest.raises(error):
            window_calls(rows, 5)
        with pytest.raises(error):
            check_edges(rows, False)
    for w in (0.0, -1.0, float("inf"), float("nan"), None):
        rows = spark.createDataFrame([(1, "add", 1, 2, 1.0, w)], shape)
        with pytest.raises(ValueError):
            SlidingWindow(rows, 5, weighted=True)
        with pytest.raises(ValueError):
            window_calls(rows, 5, weighted=True)
        assert SlidingWindow(rows, 5).n_edges() == 1
    loop = spark.createDataFrame([(1, "add", 1, 1, 1.0, -1.0), (2, "advance", None, None, 2.0, None)], shape)
    assert [r.added for r in window_calls(loop, 5, weighted=True).collect()].count(False) == 1


@pytest.mark.parametrize("weighted", [False, True])
@pytest.mark.parametrize("directed", [False, True])
def test_shares_of_a_block_equal_those_of_single_sources(directed, weighted):
    """A block of sources takes sums of rows, follows cells, and goes on in another part of the graph, with the same shares."""
    from loomgraph.operators import kernels

    rng = np.random.default_rng(5)
    edges = {tuple(sorted(e)) for e in rng.integers(0, 40, (300, 2)).tolist() if e[0] != e[1]}
    edges |= {(40 + i, 41 + i) for i in range(60)} | {(110, x) for x in range(111, 160)}
    u, v = np.array(sorted(edges)).T
    w = rng.choice([0.5, 1.0, 1.5], len(u)) if weighted else None

    def arcs(a, b, weight):
        order = np.lexsort((b, a))
        return kernels.Arcs(np.searchsorted(a[order], np.arange(161)), b[order].astype(np.int32), None if weight is None else weight[order])

    if directed:
        g = kernels.Adjacency(arcs(u, v, w), arcs(v, u, w))
    else:
        both = arcs(np.r_[u, v], np.r_[v, u], None if w is None else np.r_[w, w])
        g = kernels.Adjacency(both, both)

    def total(sources, targets=None):
        out = np.zeros(160)
        for rows, x in kernels.shares(g, sources, targets):
            out[rows] += x
        return out

    everyone = np.unique(np.r_[u, v])
    want = sum(total(everyone[i : i + 1]) for i in range(len(everyone)))
    assert want[110] == (0 if directed else 49 * 48) and np.allclose(total(everyone), want)
    before = kernels.PUSH, kernels.PULL
    try:
        for kernels.PUSH, kernels.PULL in ((0, 0), (10**9, 10**9), (10**9, 0)):
            assert np.allclose(total(everyone), want)
    finally:
        kernels.PUSH, kernels.PULL = before
    chosen = [{int(t): 2.0 for t in rng.choice(160, 3)} for _ in everyone]
    alone = sum(total(everyone[i : i + 1], chosen[i : i + 1]) for i in range(len(everyone)))
    assert np.allclose(total(everyone, chosen), alone)


def test_shares_take_seconds_where_following_arcs_one_by_one_takes_minutes():
    """All pairs of 4,000 nodes with 80,000 edges: 640 million arcs for all sources."""
    from loomgraph.operators import kernels

    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 4000, (2, 80_000))
    a, b = np.r_[a, b], np.r_[b, a]
    order = np.lexsort((b, a))
    arcs = kernels.Arcs(np.searchsorted(a[order], np.arange(4001)), b[order].astype(np.int32), None)
    start = time.process_time()
    assert sum(x.sum() for _, x in kernels.shares(kernels.Adjacency(arcs, arcs), np.arange(4000), None)) > 0
    assert time.process_time() - start < 60


def test_a_block_of_triangles_takes_few_bytes_an_edge():
    import tracemalloc

    from loomgraph.operators.triangles import _found

    u, v = np.sort(np.random.default_rng(0).integers(0, 20_000, (2, 500_000)), axis=0)
    u, v = u[u != v], v[u != v]
    tracemalloc.start()
    try:
        found = _found(u, v)
        next(found)
        assert sum(len(x) for x, _, _ in found) == 21_112
        assert tracemalloc.get_traced_memory()[1] < 150 * len(u)
    finally:
        tracemalloc.stop()
