"""Graph: an immutable simple graph as two DataFrames and its flags.

edges(u, v, w) holds each edge once: u < v when undirected, every arc when directed; w is 1.0 in unweighted graphs.
extra(id) holds ids that were touched besides the ends of these edges: by add_node, or by an edge removed since.  It may
name ends of edges too.  So a graph that only grew is one table, and its measures one pass over it.
Changing methods return a new Graph; plans stay lazy except for validation, which is one aggregate over a batch, or part
of the plan where the caller asks for that.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import metrics
from ..plans.lineage import cut, written
from . import centrality, triangles
from .components import component_labels
from .strong import strong_component_labels

#: Ids are unsigned 32-bit numbers below this one.
ID_END = 4_294_967_295
EDGES = "u long, v long, w double"


def _id(x) -> int:
    if isinstance(x, bool) or not isinstance(x, int):
        raise TypeError("node ids are integers")
    if not 0 <= x < ID_END:
        raise IndexError(f"node id out of range: {x}")
    return x


def good_weight(w: str = "w") -> str:
    return f"({w} > 0 AND NOT isnan({w}) AND {w} < double('Infinity'))"


@dataclass(frozen=True)
class Graph:
    edges: DataFrame
    extra: DataFrame
    directed: bool = False
    weighted: bool = False
    base_ids: int = 0
    reserved: int = 0

    @classmethod
    def empty(cls, spark: SparkSession, n_nodes: int = 0, directed: bool = False, weighted: bool = False) -> Graph:
        none = spark.range(1).filter("false")  # the optimiser sees that it is empty and drops joins and unions with it
        return cls(none.selectExpr("id AS u", "id AS v", "double(id) AS w"), none, directed, weighted, n_nodes)

    @classmethod
    def from_edges(cls, edges: DataFrame, directed: bool = False, weighted: bool = False, order: str | None = None, lazy: bool = False) -> Graph:
        """Of edges(u, v[, w]); order: the column that says which of several equal edges is first; lazy: see add_edges."""
        return cls.empty(edges.sparkSession, 0, directed, weighted).add_edges(edges, order, lazy)

    def __repr__(self) -> str:
        return f"Graph(directed={self.directed}, weighted={self.weighted})"

    @property
    def spark(self) -> SparkSession:
        return self.edges.sparkSession

    def _frame(self, edges) -> DataFrame:
        if isinstance(edges, DataFrame):
            return edges
        rows = [(i, _id(e[0]), _id(e[1]), float(e[2]) if len(e) > 2 else 1.0) for i, e in enumerate(edges)]
        if self.weighted and any(not 0 < r[3] < float("inf") for r in rows):
            raise ValueError("edge weights must be finite and positive")
        return self.spark.createDataFrame(rows, "pos long, u long, v long, w double")

    def _canonical(self, df: DataFrame) -> DataFrame:
        if self.directed:
            return df
        return df.withColumns({"u": F.least("u", "v"), "v": F.greatest("u", "v")})

    # changes

    def add_edges(self, edges: DataFrame | Iterable[tuple], order: str | None = None, lazy: bool = False) -> Graph:
        """All or nothing; self-loops are validated and dropped, of equal edges the first counts, known edges keep their weight.

        A DataFrame is validated by one aggregate; with ``lazy`` instead in the plan, which then fails when it runs.
        """
        given = isinstance(edges, DataFrame)
        df = self._frame(edges)
        order = order or ("pos" if not given else None)
        w = F.col("w").cast("double") if self.weighted and "w" in df.columns else F.lit(1.0)
        df = df.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"), w.alias("w"), (F.col(order) if order else F.lit(0)).alias("o"))
        bad = F.expr(f"u IS NULL OR v IS NULL OR u < 0 OR v < 0 OR u >= {ID_END} OR v >= {ID_END}")
        wrong = ~F.coalesce(F.expr(good_weight()), F.lit(False))
        if given and not lazy:
            check = df.agg(F.count_if(bad).alias("ids"), F.count_if(wrong).alias("weights")).first()
            if check.ids:
                raise IndexError(f"{check.ids} edges with a node id out of range")
            if check.weights:
                raise ValueError(f"{check.weights} edges with a weight that is not finite and positive")
        best = F.min_by("w", F.struct("o", "w")).alias("w")
        if given and lazy:  # judged above the aggregate, so that no filter of the caller's can be put behind it
            df = self._canonical(df.withColumns({"bad": bad, "wrong": wrong}).filter("u <> v OR bad OR wrong"))
            first = df.groupBy("u", "v").agg(best, F.bool_or("bad").alias("bad"), F.bool_or("wrong").alias("wrong"))
            say = lambda text: F.raise_error(F.lit(text))
            first = first.filter(F.when(F.col("bad"), say("node id out of range")).when(F.col("wrong"), say("edge weight must be finite and positive")).isNull()).select("u", "v", "w")
        else:
            first = self._canonical(df.filter("u <> v")).groupBy("u", "v").agg(best)
        fresh = first.join(self.edges, ["u", "v"], "left_anti")
        return replace(self, edges=self.edges.unionByName(fresh))

    def add_edge(self, u: int, v: int, w: float = 1.0) -> tuple[Graph, bool]:
        if u == v:
            return self, False
        _id(u), _id(v)
        if self.weighted and not (0 < w < float("inf")):
            raise ValueError("edge weight must be finite and positive")
        if self.has_edge(u, v):
            return self, False
        return self.add_edges([(u, v, w)]), True

    def count_new(self, edges: DataFrame | Iterable[tuple], order: str | None = None) -> tuple[Graph, int]:
        """add_edges and the number of edges it added."""
        after = self.add_edges(edges, order)
        return after, after.n_edges() - self.n_edges()

    def remove_edges(self, edges: DataFrame | Iterable[tuple]) -> Graph:
        gone = self._canonical(self._frame(edges).select("u", "v"))
        return replace(self, edges=self.edges.join(gone, ["u", "v"], "left_anti"), extra=self.touched)

    def remove_edge(self, u: int, v: int) -> tuple[Graph, bool]:
        if u == v or not self.has_edge(u, v):
            return self, False
        return self.remove_edges([(u, v)]), True

    def update_weights(self, edges: DataFrame) -> Graph:
        """New weights of present edges (u, v, w); of several for one edge the one with the largest pos, if given, counts."""
        if not self.weighted:
            raise RuntimeError("graph is unweighted")
        if not edges.filter(f"NOT coalesce({good_weight()}, false)").isEmpty():
            raise ValueError("edge weight must be finite and positive")
        pos = F.col("pos") if "pos" in edges.columns else F.lit(0)
        new = self._canonical(edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"), F.col("w").cast("double").alias("x"), pos.alias("pos"))).groupBy("u", "v").agg(F.max_by("x", "pos").alias("x"))
        return replace(self, edges=self.edges.join(new, ["u", "v"], "left").select("u", "v", F.coalesce("x", "w").alias("w")))

    def update_edge_weight(self, u: int, v: int, w: float) -> tuple[Graph, bool]:
        if not self.weighted:
            raise RuntimeError("graph is unweighted")
        if not 0 < w < float("inf"):
            raise ValueError("edge weight must be finite and positive")
        if not self.has_edge(u, v):
            return self, False
        return self.update_weights(self.spark.createDataFrame([(u, v, float(w))], EDGES)), True

    def add_nodes(self, start: int, count: int) -> Graph:
        if start < 0 or count < 0 or start + count > ID_END:
            raise IndexError("node ids out of range")
        return replace(self, extra=self.extra.union(self.spark.range(start, start + count).toDF("id")))

    def count_new_nodes(self, start: int, count: int) -> tuple[Graph, int]:
        """add_nodes and the number of nodes that were new."""
        after = self.add_nodes(start, count)
        known = self.touched.filter((F.col("id") >= start) & (F.col("id") < start + count)).count()
        return after, count - known

    def add_node_flags(self, ids: DataFrame) -> DataFrame:
        """(id, added boolean) of distinct ids: what add_node returns for each."""
        asked = ids.select(F.col(ids.columns[0]).cast("long").alias("id")).distinct()
        known = self.touched.select("id", F.lit(False).alias("added"))
        return asked.join(known, "id", "left").select("id", F.coalesce("added", F.lit(True)).alias("added"))

    def add_node(self, u: int) -> tuple[Graph, bool]:
        fresh = self.touched.filter(F.col("id") == _id(u)).isEmpty()
        return (self.add_nodes(u, 1), True) if fresh else (self, False)

    def add_node_frame(self, ids: DataFrame) -> Graph:
        return replace(self, extra=self.extra.union(ids.select(F.col(ids.columns[0]).cast("long"))))

    def reserve_nodes(self, n: int) -> Graph:
        """Room for ids below n, until the graph is cleared."""
        if n < 0 or n > ID_END:
            raise IndexError("node ids out of range")
        return replace(self, reserved=max(self.reserved, n))

    def reserve_edges(self, m: int) -> Graph:
        """A hint that changes no result."""
        if m < 0:
            raise ValueError("m must not be negative")
        return self

    def clear(self) -> Graph:
        return Graph.empty(self.spark, self.base_ids, self.directed, self.weighted)

    def copy(self) -> Graph:
        """The same values with lineage cut; later clears keep today's id range."""
        return replace(self, edges=cut(self.edges), extra=cut(self.extra.distinct()), base_ids=self.n_ids(), reserved=0)

    # lookups

    @property
    def touched(self) -> DataFrame:
        """(id) of every touched node, once."""
        return self.edges.select(F.explode(F.array("u", "v")).alias("id")).union(self.extra).distinct()

    def nodes(self) -> DataFrame:
        return self.touched.orderBy("id")

    def edge_list(self) -> DataFrame:
        return self.edges.select("u", "v", "w").orderBy("u", "v")

    def _edge(self, u: int, v: int) -> DataFrame:
        a, b = (u, v) if self.directed or u <= v else (v, u)
        return self.edges.filter((F.col("u") == a) & (F.col("v") == b))

    def has_edge(self, u: int, v: int) -> bool:
        return u != v and not self._edge(u, v).isEmpty()

    def has_edges(self, pairs: DataFrame) -> DataFrame:
        """pairs(u, v) with present boolean."""
        key = self._canonical(pairs.select("u", "v").withColumns({"a": F.col("u"), "b": F.col("v")}))
        known = self.edges.select("u", "v", F.lit(True).alias("present"))
        return key.join(known, ["u", "v"], "left").select(F.col("a").alias("u"), F.col("b").alias("v"), F.coalesce("present", F.lit(False)).alias("present"))

    def edge_weight(self, u: int, v: int) -> float:
        row = self._edge(u, v).select("w").first()
        if row is None:
            raise IndexError("edge not found")
        return row.w

    def edge_weights(self, pairs: DataFrame) -> DataFrame:
        """pairs(u, v) with w, null where there is no edge."""
        key = self._canonical(pairs.select("u", "v").withColumns({"a": F.col("u"), "b": F.col("v")}))
        return key.join(self.edges, ["u", "v"], "left").select(F.col("a").alias("u"), F.col("b").alias("v"), "w")

    def _symmetric(self) -> DataFrame:
        return metrics.symmetric(self.edges)

    def _out(self) -> DataFrame:
        return self.edges if self.directed else self._symmetric()

    def _in(self) -> DataFrame:
        return metrics.flipped(self.edges) if self.directed else self._symmetric()

    def neighbours(self, u: int) -> DataFrame:
        return self._out().filter(F.col("u") == u).select(F.col("v").alias("id")).orderBy("id")

    def in_neighbours(self, u: int) -> DataFrame:
        return self._in().filter(F.col("u") == u).select(F.col("v").alias("id")).orderBy("id")

    def neighbour_arrays(self) -> DataFrame:
        """(id, neighbours array<long>) per node that has any."""
        return self._out().groupBy(F.col("u").alias("id")).agg(F.array_sort(F.collect_list("v")).alias("neighbours"))

    def in_neighbour_arrays(self) -> DataFrame:
        """(id, neighbours array<long>) per node that an arc points to."""
        return self._in().groupBy(F.col("u").alias("id")).agg(F.array_sort(F.collect_list("v")).alias("neighbours"))

    def n_nodes(self) -> int:
        return self.touched.count()

    def n_edges(self) -> int:
        return self.edges.count()

    def n_ids(self) -> int:
        top = self.touched.agg(F.max("id")).first()[0]
        return max(self.base_ids, self.reserved, 0 if top is None else top + 1)

    # degrees and totals

    def degrees(self) -> DataFrame:
        return metrics.per_node(self.edges, self.extra, self.directed).select("id", F.col("n").alias("degree"))

    def in_degrees(self) -> DataFrame:
        into = metrics.flipped(self.edges) if self.directed else self.edges
        return metrics.per_node(into, self.extra, self.directed).select("id", F.col("n").alias("degree"))

    def degree(self, u: int) -> int:
        return self._out().filter(F.col("u") == u).count()

    def in_degree(self, u: int) -> int:
        return self._in().filter(F.col("u") == u).count()

    def degree_histogram(self, dense: bool = False) -> DataFrame:
        """(degree, nodes) of the degrees that occur; dense: of all from 0 to the largest, also in an empty graph."""
        found = metrics.histogram(self.degrees())
        if not dense:
            return found
        top = found.agg(F.coalesce(F.max("degree"), F.lit(0)).alias("top")).select(F.explode(F.sequence(F.lit(0).cast("long"), "top")).alias("degree"))
        return top.join(found, "degree", "left").select("degree", F.coalesce("nodes", F.lit(0)).alias("nodes"))

    def stats(self) -> DataFrame:
        return metrics.stats(metrics.per_node(self.edges, self.extra, self.directed), self.directed)

    def max_degree(self) -> int:
        return self.stats().first().max_degree

    def avg_degree(self) -> float:
        return self.stats().first().avg_degree

    def density(self) -> float:
        return self.stats().first().density

    def strengths(self) -> DataFrame:
        return metrics.per_node(self.edges, self.extra, self.directed).select("id", F.col("w").alias("strength"))

    def strength(self, u: int) -> float:
        return self._out().filter(F.col("u") == u).agg(F.coalesce(F.sum("w"), F.lit(0.0))).first()[0]

    def total_weight(self) -> float:
        return self.edges.agg(F.coalesce(F.sum("w"), F.lit(0.0))).first()[0]

    # components

    @cached_property
    def _labels(self) -> DataFrame:
        """Components of this version of the graph, found at the first question about them and kept in the shared folder."""
        return component_labels(self.edges)

    def component_ids(self) -> DataFrame:
        """(id, component_id) per touched node; component_id is the smallest id of the component."""
        found = self._labels  # all ends of edges, so these need not be worked out again
        alone = self.extra.distinct().join(found.select("id").hint("merge"), "id", "left_anti")
        return found.union(alone.select("id", F.col("id").alias("component_id")))

    def component_sizes(self) -> DataFrame:
        return self.component_ids().groupBy("component_id").agg(F.count(F.lit(1)).alias("size"))

    def n_components(self) -> int:
        return self.component_ids().select("component_id").distinct().count()

    def component_id(self, u: int) -> int:
        row = self.component_ids().filter(F.col("id") == u).first()
        if row is None:
            raise IndexError("node not found")
        return row.component_id

    def component_nodes(self, u: int) -> DataFrame:
        labels = self.component_ids()
        return labels.join(labels.filter(F.col("id") == u).select("component_id"), "component_id", "left_semi").select("id").orderBy("id")

    def component_size(self, u: int) -> int:
        return self.component_nodes(u).count()

    def same_component(self, u: int, v: int) -> bool:
        rows = self.component_ids().filter(F.col("id").isin(u, v)).collect()
        return len({r.id for r in rows}) == len({u, v}) and len({r.component_id for r in rows}) == 1

    def strong_component_ids(self) -> DataFrame:
        if not self.directed:
            return self.component_ids()
        arcs = written(self.edges.select("u", "v"))  # gives the nodes as well
        return strong_component_labels(arcs, replace(self, edges=arcs).touched)

    def n_strong_components(self) -> int:
        return self.strong_component_ids().select("component_id").distinct().count()

    # triangles

    def _underlying(self) -> DataFrame:
        return metrics.underlying(self.edges) if self.directed else self.edges.select("u", "v")

    def triangles(self) -> DataFrame:
        """(a, b, c), a < b < c."""
        return triangles.listing(self._underlying())

    def triangle_count(self) -> int:
        return triangles.count(self._underlying())

    def local_triangles(self) -> DataFrame:
        return triangles.local(self._underlying(), self.touched)

    def all_local_triangles(self) -> DataFrame:
        """Dense: one row per id below n_ids."""
        return triangles.local(self._underlying(), self.spark.range(self.n_ids()).toDF("id"))

    def clustering(self) -> DataFrame:
        return triangles.clustering(self._underlying(), self.touched)

    def clustering_coefficient(self, u: int) -> float:
        row = self.clustering().filter(F.col("id") == u).first()
        return row.clustering if row else 0.0

    def avg_clustering(self) -> float:
        return self.clustering().agg(F.coalesce(F.avg("clustering"), F.lit(0.0))).first()[0]

    # centrality

    def _dense(self, df: DataFrame, value: str) -> DataFrame:
        return self.spark.range(self.n_ids()).toDF("id").join(df, "id", "left").select("id", F.coalesce(value, F.lit(0.0)).alias(value))

    def pagerank(self, damping: float = 0.85, tol: float = 1e-10, max_iter: int = 100, dense: bool = False) -> DataFrame:
        out = self._out() if self.weighted else self._out().withColumn("w", F.lit(1.0))
        got = centrality.pagerank(out, self.touched, damping, tol, max_iter)
        return self._dense(got, "rank") if dense else got

    def betweenness_approx(self, k: int = 200, seed: int = 42, normalise: bool = True, dense: bool = False) -> DataFrame:
        got = centrality.betweenness(self.edges, self.touched, self.directed, self.weighted, k, seed, normalise)
        return self._dense(got, "betweenness") if dense else got

    # storage

    def save(self, path: str) -> None:
        from ..sources.edgs import save

        save(self, path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Graph:
        from ..sources.edgs import load

        return load(spark, path)


class KeyIndex:
    """key <-> dense id in first-seen order, as a table (key, id); keys have the type of the column they came from."""

    def __init__(self, table: DataFrame):
        self.table = table

    @classmethod
    def of(cls, keys: DataFrame, key: str, seq: str) -> KeyIndex:
        """Ids 0, 1, … by the first seq of each key."""
        none = keys.select(F.col(key).alias("key"), F.lit(0).cast("long").alias("id")).filter("false")
        return cls(none).extended(keys, key, seq)

    def extended(self, keys: DataFrame, key: str, seq: str) -> KeyIndex:
        """Known keys keep their ids; new ones follow.  Ranks are counted per range partition, with offsets."""
        first = keys.filter(F.col(key).isNotNull()).groupBy(F.col(key).cast(self.table.schema["key"].dataType).alias("key")).agg(F.min(seq).alias("at"))
        fresh = cut(first.join(self.table, "key", "left_anti").repartitionByRange("at", "key").sortWithinPartitions("at", "key").withColumn("part", F.spark_partition_id()).withColumn("m", F.monotonically_increasing_id()))
        per = fresh.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("m").alias("lo"))
        offsets = per.select("part", "lo", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
        start = self.table.agg(F.max("id")).first()[0]
        base = -1 if start is None else start
        return KeyIndex(self.table.union(fresh.join(F.broadcast(offsets), "part").select("key", (F.col("before") + F.col("m") - F.col("lo") + F.lit(base + 1)).alias("id"))))

    def encode(self, df: DataFrame, key: str, to: str) -> DataFrame:
        return df.join(self.table.select(F.col("key").alias(key), F.col("id").alias(to)), key, "left")

    def decode(self, df: DataFrame, ident: str, to: str) -> DataFrame:
        return df.join(self.table.select(F.col("id").alias(ident), F.col("key").alias(to)), ident, "left")

    def contains(self, df: DataFrame, key: str, to: str) -> DataFrame:
        """df with ``to`` boolean: whether the key has an id; none is given out."""
        known = self.table.select(F.col("key").alias(key), F.lit(True).alias(to))
        return df.join(known, key, "left").withColumn(to, F.coalesce(to, F.lit(False)))

    def id(self, key) -> int:
        row = self.table.filter(F.col("key") == key).first()
        if row is None:
            raise KeyError(key)
        return row.id

    def key(self, ident: int):
        if isinstance(ident, bool) or not hasattr(ident, "__index__") or ident < 0:
            raise IndexError("id out of range")
        row = self.table.filter(F.col("id") == int(ident)).first()
        if row is None:
            raise IndexError("id out of range")
        return row.key

    def __contains__(self, key) -> bool:
        return not self.table.filter(F.col("key") == key).isEmpty()

    def __len__(self) -> int:
        return self.table.count()

    n_nodes = __len__

    def keys(self) -> DataFrame:
        return self.table.orderBy("id").select("key")

    def ids(self) -> DataFrame:
        return self.table.orderBy("id").select("id")
