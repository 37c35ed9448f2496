"""Single-pass measures of edge tables (u, v, w) and node tables (id)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def flipped(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "w")


def symmetric(edges: DataFrame) -> DataFrame:
    """Both directions of every edge in one scan."""
    ends = F.array(F.struct(F.col("u").alias("u"), F.col("v").alias("v")), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))
    return edges.select(F.explode(ends).alias("e"), "w").select("e.u", "e.v", "w")


def underlying(arcs: DataFrame) -> DataFrame:
    return arcs.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def degrees(out: DataFrame, nodes: DataFrame) -> DataFrame:
    got = out.groupBy(F.col("u").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
    return nodes.join(got, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))


def strengths(out: DataFrame, nodes: DataFrame) -> DataFrame:
    got = out.groupBy(F.col("u").alias("id")).agg(F.sum("w").alias("strength"))
    return nodes.join(got, "id", "left").select("id", F.coalesce("strength", F.lit(0.0)).alias("strength"))


def histogram(degrees: DataFrame) -> DataFrame:
    """(degree, nodes), only degrees that occur."""
    return degrees.groupBy("degree").agg(F.count(F.lit(1)).alias("nodes"))


def per_node(edges: DataFrame, extra: DataFrame, directed: bool) -> DataFrame:
    """(id, n, w): number and weight of each node's edges, of outgoing arcs if directed; one shuffle over both ends of the edges."""
    far = F.struct(F.col("v").alias("id"), F.lit(0 if directed else 1).cast("long").alias("n"), (F.lit(0.0) if directed else F.col("w")).alias("w"))
    near = F.struct(F.col("u").alias("id"), F.lit(1).cast("long").alias("n"), F.col("w").alias("w"))
    ends = edges.select(F.explode(F.array(near, far)).alias("e")).select("e.id", "e.n", "e.w")
    alone = extra.select("id", F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("w"))
    return ends.union(alone).groupBy("id").agg(F.sum("n").alias("n"), F.sum("w").alias("w"))


def stats(nodes: DataFrame, directed: bool) -> DataFrame:
    """One row of (id, n, w) as per_node gives them: n_nodes, n_edges, total_weight, max_degree, avg_degree, density."""
    each = 1 if directed else 2
    d = nodes.agg(F.count(F.lit(1)).alias("n_nodes"), F.coalesce(F.sum("n"), F.lit(0)).alias("ends"), (F.coalesce(F.sum("w"), F.lit(0.0)) / each).alias("total_weight"), F.coalesce(F.max("n"), F.lit(0)).alias("max_degree"))
    d = d.withColumn("n_edges", F.expr(f"ends div {each}"))
    n, m = F.col("n_nodes"), F.col("n_edges")
    avg = F.when(n > 0, float(each) * m / n).otherwise(F.lit(0.0))
    dense = F.when(n > 1, float(each) * m / (n * (n - 1))).otherwise(F.lit(0.0))
    return d.select("n_nodes", "n_edges", "total_weight", "max_degree", avg.alias("avg_degree"), dense.alias("density"))
