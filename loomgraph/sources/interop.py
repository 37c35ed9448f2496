"""Conversions to and from other graph forms; optional libraries are imported only when used."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.metrics import symmetric
from ..operators.graph import Graph, KeyIndex


def from_arrays(spark: SparkSession, us, vs, ws=None, directed: bool = False, weighted: bool = False) -> Graph:
    """One-dimensional uint32 arrays of equal length; the first of equal edges counts."""
    arrays = [np.asarray(us), np.asarray(vs)]
    for a in arrays:
        if a.dtype != np.uint32:
            raise TypeError("ids must be uint32 arrays")
    if ws is not None:
        arrays.append(np.asarray(ws, np.float64))
    if any(a.ndim != 1 or len(a) != len(arrays[0]) for a in arrays):
        raise ValueError("arrays must be one-dimensional and equally long")
    import pandas as pd

    data = {"pos": np.arange(len(arrays[0])), "u": arrays[0].astype(np.int64), "v": arrays[1].astype(np.int64), "w": arrays[2] if ws is not None else np.ones(len(arrays[0]))}
    return Graph.empty(spark, 0, directed, weighted).add_edges(spark.createDataFrame(pd.DataFrame(data), "pos long, u long, v long, w double"), "pos")


def to_networkx(graph: Graph, index: KeyIndex | None = None):
    import networkx

    out = networkx.DiGraph() if graph.directed else networkx.Graph()
    name = {r.id: r.key for r in index.table.collect()} if index else {}
    out.add_nodes_from(name.get(r.id, r.id) for r in graph.nodes().toLocalIterator())
    out.add_weighted_edges_from((name.get(r.u, r.u), name.get(r.v, r.v), r.w) for r in graph.edge_list().toLocalIterator())
    return out


def index_keys(names: list) -> list:
    """Keys of one Spark type that differ where the names differ: names that are all text or all integers as they are, else type and value as text."""
    for kind in (str, int):
        if all(type(x) is kind for x in names):
            return names
    return [f"{type(x).__name__}:{x!r}" for x in names]


def from_networkx(spark: SparkSession, source) -> tuple[Graph, KeyIndex]:
    """Any object with nodes(), edges(data=True) and is_directed(); ids follow the order of nodes, keys are index_keys of them."""
    names = list(source.nodes())
    place = {x: i for i, x in enumerate(names)}
    edges = list(source.edges(data=True))
    weighted = any("weight" in d for _, _, d in edges)
    graph = Graph.empty(spark, 0, source.is_directed(), weighted).add_nodes(0, len(names)).add_edges([(place[a], place[b], float(d.get("weight", 1.0))) for a, b, d in edges])
    keys = index_keys(names)
    kind = "long" if keys and isinstance(keys[0], int) else "string"
    return graph, KeyIndex(spark.createDataFrame(list(zip(keys, range(len(keys)), strict=True)), f"key {kind}, id long"))


def to_coordinates(graph: Graph) -> DataFrame:
    """(row, col, value) of the adjacency matrix, symmetric if undirected."""
    e = graph.edges if graph.directed else symmetric(graph.edges)
    return e.select(F.col("u").alias("row"), F.col("v").alias("col"), F.col("w").alias("value"))


def to_scipy_sparse(graph: Graph):
    from scipy.sparse import coo_matrix

    t, n = to_coordinates(graph).toPandas(), graph.n_ids()
    return coo_matrix((t["value"], (t["row"], t["col"])), shape=(n, n))


def to_frames(graph: Graph) -> tuple[DataFrame, DataFrame]:
    """Vertices (id) and edges (src, dst[, weight])."""
    cols = [F.col("u").alias("src"), F.col("v").alias("dst"), *([F.col("w").alias("weight")] if graph.weighted else [])]
    return graph.nodes(), graph.edges.select(*cols)


def from_frames(vertices: DataFrame, edges: DataFrame, directed: bool = False, id_col: str = "id") -> Graph:
    """Vertices and edges (src, dst[, weight]).

    With ``id_col`` vertices have unique, not-null, non-negative ids, and edges name them.  Without it vertices are
    numbered from 0, and edges name them by number from 1.
    """
    weighted, shift = "weight" in edges.columns, 0
    if id_col in vertices.columns:
        check = vertices.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(id_col).alias("d"), F.min(id_col).alias("lo")).first()
        if check.n != check.d or (check.lo is not None and check.lo < 0):
            raise ValueError("vertex ids must be unique, not null and not negative")
        graph = Graph.empty(vertices.sparkSession, 0, directed, weighted).add_node_frame(vertices.select(id_col))
    else:  # only how many there are matters
        graph, shift = Graph.empty(vertices.sparkSession, 0, directed, weighted).add_nodes(0, vertices.count()), 1
    e = edges.select((F.col("src") - shift).alias("u"), (F.col("dst") - shift).alias("v"), (F.col("weight").cast("double") if weighted else F.lit(1.0)).alias("w"))
    return graph.add_edges(e)
