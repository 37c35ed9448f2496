import random
import struct

import pytest

from loomgraph.operators.graph import Graph, KeyIndex
from loomgraph.operators.log import effects, prefix_metrics, replay
from loomgraph.operators.window import SlidingWindow, add_flags, assert_monotone, live_edges
from loomgraph.sources.interop import from_arrays, from_frames, from_networkx, to_coordinates


def graph(spark, edges, **kw):
    return Graph.empty(spark, **kw).add_edges(edges)


def values(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_components_and_degrees(spark):
    g = graph(spark, [(0, 1), (2, 3)])
    assert g.n_components() == 2 and not g.same_component(0, 3)
    g, added = g.add_edge(1, 2)
    assert added and g.n_components() == 1 and g.same_component(0, 3) and g.component_id(3) == 0
    assert not g.add_edge(1, 2)[1] and not g.add_edge(2, 1)[1] and not g.add_edge(5, 5)[1]
    assert values(g.degrees(), "id", "degree") == [(0, 1), (1, 2), (2, 2), (3, 1)]
    assert [r.id for r in g.neighbours(1).collect()] == [0, 2]
    with pytest.raises(IndexError):
        g.component_id(9)
    assert g.degree(9) == 0 and g.component_size(9) == 0 and not g.same_component(0, 9)


def test_path_statistics(spark):
    g = graph(spark, [(i, i + 1) for i in range(4)])
    s = g.stats().first()
    assert (s.n_nodes, s.n_edges, s.max_degree) == (5, 4, 2) and abs(s.avg_degree - 1.6) < 1e-9
    raw = dict(values(g.betweenness_approx(k=10**6, normalise=False), "id", "betweenness"))
    assert [raw[i] for i in range(5)] == [0, 3, 4, 3, 0]
    norm = dict(values(g.betweenness_approx(k=10**6), "id", "betweenness"))
    assert [norm[i] for i in range(5)] == [0, 0.75, 1, 0.75, 0]


def test_triangles(spark):
    k4 = graph(spark, [(a, b) for a in range(4) for b in range(a)])
    assert k4.triangle_count() == 4 and dict(values(k4.local_triangles(), "id", "triangles"))[0] == 3
    g = graph(spark, [(0, 1), (1, 2), (0, 2), (0, 3)])
    c = dict(values(g.clustering(), "id", "clustering"))
    assert abs(c[0] - 1 / 3) < 1e-12 and c[1] == 1 and c[3] == 0 and abs(g.avg_clustering() - (1 / 3 + 2) / 4) < 1e-12
    d = graph(spark, [(0, 1), (1, 0), (0, 2), (2, 0), (1, 2), (2, 1)], directed=True)
    assert d.n_edges() == 6 and d.triangle_count() == 1
    d, _ = d.remove_edge(2, 0)
    assert d.triangle_count() == 1
    assert d.remove_edge(0, 2)[0].triangle_count() == 0


def test_weights_and_removal(spark):
    g = graph(spark, [(0, 1, 5.0), (0, 1, 9.0), (1, 2, 2.0)], weighted=True)
    assert g.edge_weight(1, 0) == 5 and g.total_weight() == 7 and g.strength(1) == 7
    g, ok = g.update_edge_weight(1, 0, 8.0)
    assert ok and g.edge_weight(0, 1) == 8 and not g.update_edge_weight(0, 7, 3.0)[1]
    g, ok = g.remove_edge(1, 2)
    assert ok and not g.remove_edge(1, 2)[1] and g.n_nodes() == 3 and g.n_components() == 2
    with pytest.raises(IndexError):
        g.edge_weight(1, 2)
    for w in (float("inf"), float("nan"), 0.0, -1.0):
        with pytest.raises(ValueError):
            g.add_edges([(7, 8, w)])
    with pytest.raises(RuntimeError):
        graph(spark, [(0, 1)]).update_edge_weight(0, 1, 2.0)


def test_nodes_and_ids(spark):
    g = Graph.empty(spark, 100)
    assert g.n_nodes() == 0 and g.n_ids() == 100
    g, new = g.add_node(7)
    assert new and not g.add_node(7)[1]
    g = g.add_nodes(10, 3)
    assert [r.id for r in g.nodes().collect()] == [7, 10, 11, 12] and g.n_components() == 4
    assert values(g.degree_histogram(), "degree", "nodes") == [(0, 4)]
    assert g.clear().n_nodes() == 0 and g.clear().n_ids() == 100 and g.copy().n_nodes() == 4
    with pytest.raises(IndexError):
        g.add_node(4294967295)


def strong_by_hand(arcs, n):
    near = {i: {i} for i in range(n)}
    for u, v in arcs:
        near[u].add(v)
    reach = {}
    for i in near:
        seen, todo = {i}, [i]
        while todo:
            for x in near[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        reach[i] = seen
    return sorted((i, min(x for x in reach[i] if i in reach[x])) for i in near)


def test_strong_components(spark, monkeypatch):
    import random

    from loomgraph.operators import strong

    g = graph(spark, [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 3), (4, 5)], directed=True)
    assert values(g.strong_component_ids(), "id", "component_id") == [(0, 0), (1, 0), (2, 0), (3, 3), (4, 3), (5, 5)] and g.n_strong_components() == 3
    rng = random.Random(4)
    for n, m in ((9, 0), (30, 45), (40, 60)):
        arcs = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(0, 1), (1, 2), (2, 0), (3, 4), (4, 5), (5, 3), (2, 6), (6, 7), (7, 2), (7, 8)]
        got = strong.strong_component_labels(spark.createDataFrame(arcs, "u long, v long"), spark.range(n).toDF("id"))
        assert values(got, "id", "component_id") == strong_by_hand(arcs, n)
    # A path of 5,000 nodes in any order, and a circle: as many rounds as its logarithm, not its length.
    rounds, write = [], strong.written
    monkeypatch.setattr(strong, "written", lambda df: rounds.append(1) or write(df))
    order = list(range(5_000))
    rng.shuffle(order)
    path = spark.createDataFrame(list(zip(order, order[1:])), "u long, v long")
    nodes = spark.range(5_000).toDF("id")
    assert strong.strong_component_labels(path, nodes).filter("id <> component_id").isEmpty() and len(rounds) < 40
    circle = path.union(spark.createDataFrame([(order[-1], order[0])], "u long, v long"))
    assert strong.strong_component_labels(circle, nodes).filter("component_id <> 0").isEmpty()


def ranks_by_hand(arcs, ids, rounds):
    rank = dict.fromkeys(ids, 1 / len(ids))
    out = {i: sum(w for u, _, w in arcs if u == i) for i in ids}
    for _ in range(rounds):
        hung = sum(r for i, r in rank.items() if not out[i])
        rank = {i: (0.15 + 0.85 * hung) / len(ids) + 0.85 * sum(rank[u] * w / out[u] for u, v, w in arcs if v == i) for i in ids}
    return rank


def test_pagerank(spark):
    arcs = [(0, 1, 9.0), (0, 2, 1.0), (2, 0, 1.0)]
    g = graph(spark, arcs, directed=True, weighted=True).add_nodes(5, 1)
    a = dict(values(g.pagerank(), "id", "rank"))
    want = ranks_by_hand(arcs, [0, 1, 2, 5], 200)
    assert abs(sum(a.values()) - 1) < 1e-9 and all(abs(a[i] - want[i]) < 1e-9 for i in want)
    b, want = dict(values(g.pagerank(max_iter=3), "id", "rank")), ranks_by_hand(arcs, [0, 1, 2, 5], 3)
    assert all(abs(b[i] - want[i]) < 1e-12 for i in want)
    assert g.clear().pagerank().collect() == []
    for bad in ({"damping": 1.0}, {"damping": -0.1}, {"tol": 0.0}, {"tol": float("inf")}, {"tol": float("nan")}, {"max_iter": 0}):
        with pytest.raises(ValueError):
            g.pagerank(**bad)


def test_weighted_betweenness_ties(spark):
    a = 1.496915315443057
    g = graph(spark, [(0, 4, a), (2, 3, 0.1), (4, 5, a), (0, 3, a), (0, 1, 0.1), (1, 2, a)], weighted=True)
    got = dict(values(g.betweenness_approx(k=10**6, normalise=False), "id", "betweenness"))
    assert all(abs(got[i] - x) < 1e-6 for i, x in enumerate([6.5, 1.5, 0.5, 1.5, 4, 0]))


def test_edgs_files(spark, tmp_path):
    g = graph(spark, [(5, 7, 2.5)], n_nodes=200, directed=True, weighted=True).add_nodes(99, 1)
    g.save(f"{tmp_path}/a.esg")
    h = Graph.load(spark, f"{tmp_path}/a.esg")
    assert h.directed and h.weighted and h.n_ids() == 200 and [r.id for r in h.nodes().collect()] == [5, 7, 99] and h.edge_weight(5, 7) == 2.5
    assert not (tmp_path / "a.esg.tmp").exists()
    (tmp_path / "b.esg").write_bytes((tmp_path / "a.esg").read_bytes() + b"x")
    with pytest.raises(RuntimeError, match="trailing data"):
        Graph.load(spark, f"{tmp_path}/b.esg")
    (tmp_path / "c.esg").write_bytes(struct.pack("<IHBQQII", 0x45444753, 2, 0, 2, 1, 0, 1))
    assert Graph.load(spark, f"{tmp_path}/c.esg").n_edges() == 1


def test_log_against_simulation(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(["add", "add", "remove", "update"]), rng.randrange(6), rng.randrange(6), float(rng.randrange(1, 9))) for i in range(300)]
    live, flags, touched = {}, {}, set()
    for i, op, u, v, w in rows:
        e = (min(u, v), max(u, v))
        if u != v:
            flags[i] = (e not in live) if op == "add" else e in live
            if flags[i]:
                if op == "remove":
                    del live[e]
                else:
                    live[e] = w
                touched |= set(e)
    log = spark.createDataFrame(rows, "seq long, op string, u long, v long, w double")
    assert {r.seq: r.effective for r in effects(log).collect()} == flags
    g = replay(log, weighted=True)
    assert {(r.u, r.v): r.w for r in g.edges.collect()} == live and {r.id for r in g.touched.collect()} == touched


def test_prefix_metrics(spark):
    rows = [(1, "add", 0, 1, 1.0), (2, "add", 2, 3, 1.0), (3, "add", 1, 2, 1.0), (4, "add", 0, 2, 1.0), (5, "node", 9, None, None)]
    log = spark.createDataFrame(rows, "seq long, op string, u long, v long, w double")
    got = prefix_metrics(log, spark.createDataFrame([(2,), (4,), (5,)], "at long"))
    assert values(got, "at", "n_nodes", "n_edges", "n_triangles", "n_components") == [(2, 4, 2, 0, 2), (4, 4, 4, 1, 1), (5, 5, 4, 1, 2)]


def test_sliding_window(spark):
    e = spark.createDataFrame([(1, 0, 1, 0.0, 2.0), (2, 0, 1, 8.0, 5.0)], "seq long, u long, v long, ts double, w double")
    w = SlidingWindow(e, 10, weighted=True)
    assert [r.added for r in add_flags(e, 10).orderBy("seq").collect()] == [True, False]
    assert w.at(11).edge_weight(0, 1) == 5 and w.at(18).n_edges() == 1 and w.at(19).n_edges() == 0 and w.at(19).n_nodes() == 2
    assert w.advance(8, 11) == 0 and w.advance(11, 19) == 1 and live_edges(e, 10, 18).count() == 1
    assert_monotone(e)
    with pytest.raises(ValueError):
        SlidingWindow(e, 0)
    with pytest.raises(ValueError):
        assert_monotone(e.withColumn("ts", -e["ts"]))


def test_key_index(spark):
    k = spark.createDataFrame([("A", 1), ("B", 2), ("A", 3)], "k string, seq long")
    index = KeyIndex.of(k, "k", "seq")
    assert index.id("A") == 0 and index.id("B") == 1 and index.key(0) == "A" and len(index) == 2 and "C" not in index
    more = index.extended(spark.createDataFrame([("C", 1), ("A", 2)], "k string, seq long"), "k", "seq")
    assert more.id("C") == 2 and more.id("A") == 0
    for bad in (-1, True, 9):
        with pytest.raises(IndexError):
            index.key(bad)
    with pytest.raises(KeyError):
        index.id("Z")


def test_interop(spark):
    import numpy as np

    g = from_arrays(spark, np.array([0, 0, 1, 2], np.uint32), np.array([1, 1, 2, 0], np.uint32))
    assert g.n_edges() == 3 and to_coordinates(g).count() == 6
    with pytest.raises(TypeError):
        from_arrays(spark, np.array([-1]), np.array([1]))

    class Other:
        nodes = staticmethod(lambda: ["x", "y", "z"])
        is_directed = staticmethod(lambda: False)

        def edges(self, data):
            return [("x", "y", {"weight": 2.0})]

    h, index = from_networkx(spark, Other())
    assert h.weighted and h.n_nodes() == 3 and index.key(2) == "z"
    v = spark.createDataFrame([(4,), (9,)], "id long")
    assert from_frames(v, spark.createDataFrame([(4, 9)], "src long, dst long")).n_edges() == 1
    with pytest.raises(ValueError):
        from_frames(v.union(v), spark.createDataFrame([(4, 9)], "src long, dst long"))


def test_stream_maintenance(spark, tmp_path):
    from loomgraph.sources.edgs import load_parquet
    from loomgraph.streaming.live import maintain

    shape = "seq long, op string, u long, v long, w double"
    spark.createDataFrame([(1, "add", 0, 1, 1.0), (2, "add", 1, 2, 1.0)], shape).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(shape).parquet(f"{tmp_path}/in")
    maintain(stream, f"{tmp_path}/g", f"{tmp_path}/c", measures=True).awaitTermination()
    spark.createDataFrame([(3, "remove", 1, 0, None)], shape).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    maintain(stream, f"{tmp_path}/g", f"{tmp_path}/c", measures=True).awaitTermination()
    measured = values(spark.read.parquet(f"{tmp_path}/g/metrics"), "batch", "n_nodes", "n_edges", "max_degree", "n_triangles", "n_components")
    assert measured == [(0, 3, 2, 2, 0, 1), (1, 3, 1, 1, 0, 2)]
    assert load_parquet(spark, f"{tmp_path}/g/0").n_edges() == 2
    g = load_parquet(spark, f"{tmp_path}/g/1")
    assert values(g.edges, "u", "v") == [(1, 2)] and g.n_nodes() == 3


def test_triangles_in_blocks(spark, monkeypatch):
    import random

    from loomgraph.operators import triangles

    rng = random.Random(11)
    edges = {tuple(sorted(rng.sample(range(60), 2))) for _ in range(500)}
    near = {n: {b if a == n else a for a, b in edges if n in (a, b)} for n in range(60)}
    want = sorted((a, b, c) for a, b in edges for c in near[a] & near[b] if b < c)
    df = spark.createDataFrame(sorted(edges), "u long, v long")
    for block, lookups in ((1_000_000, 2_000_000), (40, 7)):  # few large blocks, and many small ones
        monkeypatch.setattr(triangles, "BLOCK_EDGES", block)
        monkeypatch.setattr(triangles, "LOOKUPS", lookups)
        assert values(triangles.listing(df), "a", "b", "c") == want and triangles.count(df) == len(want)
        assert dict(values(triangles.corners(df), "id", "triangles")) == {n: k for n in range(60) if (k := sum(n in t for t in want))}
    assert triangles.listing(df.limit(0)).isEmpty() and triangles.count(df.limit(0)) == 0


def test_triangles_around_a_hub(spark):
    from loomgraph.operators import triangles

    n = 20_000
    spokes = spark.range(1, n + 1).selectExpr("0L AS u", "id AS v")
    rim = spark.range(1, n).selectExpr("id AS u", "id + 1 AS v")
    wheel = spokes.union(rim)
    assert triangles.count(wheel) == n - 1
    assert triangles.corners(wheel).filter("id = 0").first().triangles == n - 1
    assert "Join" not in triangles.listing(wheel)._jdf.queryExecution().toString()  # no pair of spokes is a row
