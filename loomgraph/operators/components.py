"""Weakly connected components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import written

#: Edges that a task looks at together before any are shuffled.
CHUNK = 1_000_000


def _stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (larger, smallest id) that connect what edges (u, v) connect."""
    ids, places = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = places[: len(u)], places[len(u) :]
    label = np.arange(len(ids))
    while len(a):
        a, b = np.maximum(a, b), np.minimum(a, b)
        up = np.arange(len(ids))
        np.minimum.at(up, a, b)
        while not np.array_equal(further := up[up], up):
            up = further
        label, a, b = up[label], up[a], up[b]
        on = a != b
        a, b = a[on], b[on]
    hung = np.flatnonzero(label != np.arange(len(ids)))
    return ids[hung], ids[label[hung]]


def _contracted(batches):
    """Of a task's edges, stars that connect the same; those of a chunk go on to the next one while they are few."""
    parts, held = [], 0

    def sent(u, v):
        return pa.record_batch({"u": pa.array(u), "v": pa.array(v)})

    for b in batches:
        parts.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
        held += b.num_rows
        if held >= CHUNK:
            u, v = _stars(*map(np.concatenate, zip(*parts, strict=True)))
            parts, held = [(u, v)], len(u)
            if held > CHUNK // 2:
                yield sent(u, v)
                parts, held = [], 0
    if held:
        yield sent(*_stars(*map(np.concatenate, zip(*parts, strict=True))))


def _is_star_forest(edges: DataFrame) -> bool:
    """Whether each u has one v and no v is a u: then the larger ends are nodes, the smaller ones their components."""
    ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("out"), F.lit(0).alias("root"))
    ends = ends.union(edges.select(F.col("v").alias("id"), F.lit(0).alias("out"), F.lit(1).alias("root")))
    return ends.groupBy("id").agg(F.sum("out").alias("out"), F.max("root").alias("root")).filter("out > 1 OR (out = 1 AND root = 1)").isEmpty()


def _roots(up: DataFrame) -> DataFrame:
    """(id, c): the root above each id, for a forest up(id, c) that names parents; pointers double their reach."""
    while True:
        above = up.select(F.col("id").alias("c"), F.col("c").alias("further")).hint("merge")
        up = written(up.join(above, "c", "left").select("id", F.coalesce("further", "c").alias("c"), F.col("further").isNotNull().alias("moved")))
        if up.filter("moved").isEmpty():
            return up.select("id", "c")
        up = up.select("id", "c")


def component_labels(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(id, component_id) for every endpoint; component_id is the smallest id of the component.

    Each task first replaces the edges it holds by stars that connect the same, so where nodes are few, or near each other
    in the input, little is shuffled.  What is left is contracted in rounds: each node hangs on its smallest neighbour, if
    that is smaller than itself, by a partially aggregated ``min``, so that only a row per node and task is shuffled and a hub
    is no hot task; pointers double until they name roots; edges are named anew by two joins, and contracted by task again,
    which now hold all edges of a node.  Two rounds at least halve the nodes, whatever the diameter.  Joins are by shuffle,
    so no table of labels passes the driver; AQE splits skewed keys.  Self-loops and repeated edges are harmless.
    """
    pairs = edges.select(F.col(u).cast("long").alias("u"), F.col(v).cast("long").alias("v")).filter("u IS NOT NULL AND v IS NOT NULL")
    kept = written(pairs.mapInArrow(_with_loops, "u long, v long"))
    loops = kept.filter("u = v").select("u").distinct()
    cur = kept.filter("u <> v")
    hung = []
    while not _is_star_forest(cur):
        roots = _roots(written(cur.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("c"))))
        hung.append(roots)
        for end in ("u", "v"):
            named = roots.select(F.col("id").alias(end), "c").hint("merge")
            cur = cur.join(named, end, "left").withColumn(end, F.coalesce("c", end)).drop("c")
        cur = cur.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        cur = written(cur.mapInArrow(_contracted, "u long, v long"))
    stars = cur.select(F.col("u").alias("id"), F.col("v").alias("component_id")).distinct()
    for roots in reversed(hung):  # what a node hangs on may itself have been hung later
        later = stars.select(F.col("id").alias("c"), "component_id").hint("merge")
        stars = roots.join(later, "c", "left").select("id", F.coalesce("component_id", "c").alias("component_id")).union(stars)
    ends = stars.select(F.col("component_id").alias("id"), "component_id").distinct()
    stars = written(stars.union(ends))
    return stars.union(loops.select(F.col("u").alias("id"), F.col("u").alias("component_id")).join(stars.select("id").hint("merge"), "id", "left_anti"))


def _with_loops(batches):
    """_contracted, and the nodes of loops, each once in a batch."""

    def apart():
        for b in batches:
            u, v = b.column(0).to_numpy(), b.column(1).to_numpy()
            loop = u == v
            if loop.any():
                loops.append(np.unique(u[loop]))
            yield b.filter(pa.array(~loop)) if loop.any() else b

    loops: list[np.ndarray] = []
    yield from _contracted(apart())
    if loops:
        x = np.unique(np.concatenate(loops))
        yield pa.record_batch({"u": pa.array(x), "v": pa.array(x)})
