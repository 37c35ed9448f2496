"""What the findings of the fourth round asked for."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from loomgraph.operators import components, connectivity, strong, triangles
from loomgraph.operators import log as log_module
from loomgraph.operators.graph import Graph
from loomgraph.operators.log import prefix_metrics
from loomgraph.plans.lineage import written


def roots(edges) -> dict:
    up = {}

    def top(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {x: top(x) for x in list(up)}


def test_components_work_out_their_edges_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    edges = spark.createDataFrame([(k, k + 1) for k in range(500)], "u long, v long").mapInArrow(counted, "u long, v long")
    got = Graph.from_edges(edges, lazy=True).add_node_frame(spark.range(400, 600)).component_ids()
    assert {r.id: r.component_id for r in got.collect()} == {k: 0 if k <= 500 else k for k in range(600)}
    assert seen.value == 500


def test_components_of_a_task_in_chunks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    for chunk in (2, 9, 70, 10**6):
        monkeypatch.setattr(components, "CHUNK", chunk)
        u, v = rng.integers(0, 90, (2, 110))
        batches = [pa.record_batch({"u": pa.array(u[k : k + 8]), "v": pa.array(v[k : k + 8])}) for k in range(0, 110, 8)]
        kept = [(a, b) for r in components._with_loops(iter(batches)) for a, b in zip(r.column(0).to_pylist(), r.column(1).to_pylist(), strict=True)]
        assert roots(kept) == roots(zip(u.tolist(), v.tolist(), strict=True))
    edges = list(zip(u.tolist(), v.tolist(), strict=True))
    got = components.component_labels(spark.createDataFrame(edges, "u long, v long").repartition(9, F.rand(1)))  # rounds by joins as well
    assert {r.id: r.component_id for r in got.collect()} == roots(edges)


def test_strong_components_send_no_table_to_the_driver(spark, monkeypatch):
    plans = []

    def told(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df)

    monkeypatch.setattr(strong, "written", told)
    arcs = [(k, (k + 1) % 40) for k in range(40)] + [(k, k + 100) for k in range(40)] + [(7, 3), (100, 101), (101, 100), (200, 201), (201, 202), (202, 200), (201, 200)]
    got = Graph.from_edges(spark.createDataFrame(arcs, "u long, v long"), True, lazy=True).add_node_frame(spark.range(300, 302)).strong_component_ids()
    plans.append(got._jdf.queryExecution().executedPlan().toString())
    assert {r.id: r.component_id for r in got.collect()} == {k: 0 for k in range(40)} | {k: k for k in range(102, 140)} | {100: 100, 101: 100, 200: 200, 201: 200, 202: 200, 300: 300, 301: 301}
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)


def test_triangles_of_lives_are_counted_by_block(spark):
    rng = np.random.default_rng(8)
    lives = []
    for u in range(24):
        for v in range(u + 1, 24):
            cuts = sorted(rng.choice(12, 2 * int(rng.integers(0, 3)), replace=False).tolist())
            lives += [(u, v, *cuts[k : k + 2]) for k in range(0, len(cuts), 2)]
    there = [{(u, v) for u, v, a, b in lives if a <= k < b} for k in range(12)]
    want = {(n, k): sum((a, b) in e and (b, c) in e and (a, c) in e for a in range(24) for b in range(a + 1, 24) for c in range(b + 1, 24) if n in (a, b, c)) for k, e in enumerate(there) for n in range(24)}
    got = triangles.changes(spark.createDataFrame(lives, "u long, v long, k1 long, k2 long"))
    by = {(r.id, r.k): r.by for r in got.collect()}
    assert all(sum(by.get((n, j), 0) for j in range(k + 1)) == t for (n, k), t in want.items())
    assert "Join" not in got._jdf.queryExecution().toString()  # neither a pair of edges nor a triangle is a row


def test_prefix_metrics_shuffle_few_copies_of_an_edge(spark, monkeypatch):
    n = 3_000
    arcs = [(k, (k + s) % n) for k in range(n) for s in (1, 2, 40)]
    log = spark.createDataFrame([(seq, "add", u, v, 1.0) for seq, (u, v) in enumerate(arcs)], "seq long, op string, u long, v long, w double")
    tables = []

    def counted(df):
        out = written(df)
        tables.append(out.count())
        return out

    for module in (log_module, components, connectivity):
        monkeypatch.setattr(module, "written", counted)
    got = prefix_metrics(log, spark.createDataFrame([(-1,), (3 * 10 - 1,), (3 * n - 1,), (9 * n,)], "at long"))
    assert [tuple(r) for r in got.orderBy("at").collect()] == [(-1, 0, 0, 0, 0), (29, 22, 30, 9, 1), (3 * n - 1, n, 3 * n, n, 1), (9 * n, n, 3 * n, n, 1)]
    assert sum(tables) < 12 * len(arcs)  # tables written, in rows
