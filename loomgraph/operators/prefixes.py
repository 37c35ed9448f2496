"""Measures at checkpoints of a mutation log, from the lifetimes of what the log makes.

Nothing is repeated for each checkpoint but the rows that are asked for.  Births and deaths are mapped to the first
checkpoint that sees them; what lives between two checkpoints only leaves.  Degrees and strengths are running sums of
changes for each node.  A triangle lives where the lives of its edges meet, so triangles are listed once, and their births
and deaths are changes as well.  Components come from a tree over the checkpoints, see connectivity.

An edge that comes and goes has at most one interval for every two checkpoints left, so lists of them are bounded by what
the caller asks for.  Strengths are running sums of changes of weight and may differ from a sum over the edges in the last
bits; a node without edges has exactly 0.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.lineage import written
from ..plans.order import at_points, numbered
from .connectivity import ancestors, contractions, labels, levels_of, merges, tree_nodes
from .log import effects, touches, with_spans
from .triangles import changes as triangle_changes

MEASURES = ("degree", "in_degree", "strength", "triangles", "clustering", "component_id")


class Timeline:
    """The lives of a log's edges and nodes in numbers of checkpoints: k1 <= k < k2, of ``count`` checkpoints."""

    def __init__(self, log: DataFrame, checkpoints: DataFrame, directed: bool, weighted: bool):
        spark = log.sparkSession
        self.directed, self.weighted = directed, weighted
        self.points = written(numbered(checkpoints))
        self.count = self.points.count()
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        beyond = F.coalesce(F.col("k"), F.lit(self.count)).cast("long")
        seen = at_points(log.select("seq", "op", "u", "v", "w"), self.points, parts).withColumn("k", beyond)
        seen = written(with_spans(seen))
        self.rows = written(effects(seen, directed).filter("effective"))
        until = F.coalesce("until_k", F.lit(self.count).cast("long"))
        gone = F.coalesce(F.max(F.when(F.col("op") == "remove", F.col("k"))), F.first(until))
        last = F.max_by("weight", F.when(F.col("op") != "remove", F.col("seq")))
        lives = self.rows.groupBy("until", "u", "v", "episode").agg(F.min("k").alias("k1"), gone.alias("k2"), last.alias("weight"))
        self.edges = written(lives.select("u", "v", "k1", "k2", "weight").filter("k1 < k2"))
        self.nodes = written(touches(seen, self.rows).select("id", "k1", F.coalesce("k2", F.lit(self.count).cast("long")).alias("k2")).filter("k1 < k2"))

    @cached_property
    def pairs(self) -> DataFrame:
        """(u, v, k1, k2): pairs u < v and each interval in which an edge lies between them; those of a pair lie apart."""
        ends = self.edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), F.struct(F.col("k1").alias("a"), F.col("k2").alias("b")).alias("i"))
        lives = ends.groupBy("u", "v").agg(joined(F.array_sort(F.collect_list("i"))).alias("alive"))
        return written(lives.select("u", "v", F.explode("alive").alias("i")).select("u", "v", F.col("i.a").alias("k1"), F.col("i.b").alias("k2")))

    def weight_changes(self) -> DataFrame:
        """(u, v, k, w): by how much an edge's weight changes at checkpoint k."""
        per = Window.partitionBy("until", "u", "v", "episode").orderBy("seq")
        steps = self.rows.filter("op <> 'remove'").withColumn("w", F.col("weight") - F.coalesce(F.lag("weight").over(per), F.lit(0.0)))
        until = F.coalesce("until_k", F.lit(self.count).cast("long"))
        ends = self.rows.groupBy("until", "u", "v", "episode").agg(F.coalesce(F.max(F.when(F.col("op") == "remove", F.col("k"))), F.first(until)).alias("k"), (-F.max_by("weight", F.when(F.col("op") != "remove", F.col("seq")))).alias("w"))
        return steps.select("u", "v", "k", "w").union(ends.select("u", "v", "k", "w"))


def joined(intervals: Column) -> Column:
    """Sorted intervals (a, b), those that touch or overlap made one."""

    def add(out, i):
        last = F.element_at(out, -1)
        longer = F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.struct(last["a"].alias("a"), F.greatest(last["b"], i["b"]).alias("b"))))
        return F.when((F.size(out) > 0) & (F.get(out, F.size(out) - 1)["b"] >= i["a"]), longer).otherwise(F.concat(out, F.array(i)))

    return F.when(F.size(intervals) <= 1, intervals).otherwise(F.aggregate(F.slice(intervals, 2, F.size(intervals)), F.slice(intervals, 1, 1), add))


def _changes(df: DataFrame, ends: Sequence[tuple[str, str]], name: str, k1: str = "k1", k2: str = "k2") -> DataFrame:
    """(id, k, name, by): +1 at k1 and -1 at k2 for each of the end columns, under their names."""
    told = [F.struct(F.col(end).alias("id"), F.col(k).alias("k"), F.lit(what or name).alias("name"), F.lit(by).cast("double").alias("by")) for end, what in ends for k, by in ((k1, 1), (k2, -1))]
    return df.select(F.explode(F.array(*told)).alias("c")).select("c.*")


def states(line: Timeline, measures: Sequence[str]) -> DataFrame:
    """(id, k, next, present, degree, in_degree, near, strength, triangles): what holds for a node at k <= checkpoint < next.

    One row for each checkpoint at which something about the node changed.
    """
    changes = _changes(line.nodes, [("id", "present")], "present")
    if {"degree", "strength"} & set(measures):
        changes = changes.union(_changes(line.edges, [("u", "degree")] if line.directed else [("u", "degree"), ("v", "degree")], ""))
    if line.directed and "in_degree" in measures:
        changes = changes.union(_changes(line.edges, [("v", "in_degree")], ""))
    elif "in_degree" in measures and "degree" not in measures:
        changes = changes.union(_changes(line.edges, [("u", "degree"), ("v", "degree")], ""))
    if "strength" in measures and line.weighted:
        w = line.weight_changes()
        told = w.select(F.col("u").alias("id"), "k", F.lit("strength").alias("name"), F.col("w").alias("by"))
        changes = changes.union(told if line.directed else told.union(w.select("v", "k", F.lit("strength"), "w")))
    if {"triangles", "clustering"} & set(measures):
        near = line.pairs
        changes = changes.union(triangle_changes(near).select("id", "k", F.lit("triangles").alias("name"), F.col("by").cast("double").alias("by")))
        if "clustering" in measures:
            changes = changes.union(_changes(near, [("u", "near"), ("v", "near")], ""))
    names = ["present", "degree", "in_degree", "near", "strength", "triangles"]
    sums = changes.filter(F.col("k") < line.count).groupBy("id", "k").agg(*[F.coalesce(F.sum(F.when(F.col("name") == n, F.col("by"))), F.lit(0.0)).alias(n) for n in names])
    upto = Window.partitionBy("id").orderBy("k")  # at most one row for each checkpoint
    whole = [F.round(F.sum(n).over(upto)).cast("long").alias(n) for n in names if n != "strength"]
    got = sums.select("id", "k", F.coalesce(F.lead("k").over(upto), F.lit(line.count).cast("long")).alias("next"), *whole, F.sum("strength").over(upto).alias("strength"))
    if not line.directed:
        got = got.withColumn("in_degree", F.col("degree"))
    strength = F.col("strength") if line.weighted else F.col("degree").cast("double")
    got = got.withColumn("strength", F.when(F.col("degree") == 0, F.lit(0.0)).otherwise(strength))
    rate = F.when(F.col("near") >= 2, 2.0 * F.col("triangles") / (F.col("near") * (F.col("near") - 1))).otherwise(F.lit(0.0))
    return got.withColumn("clustering", rate)


def prefix_node_metrics(log: DataFrame, checkpoints: DataFrame, directed: bool = False, weighted: bool = False, measures: Sequence[str] = MEASURES) -> DataFrame:
    """(at, id, *measures) of each node that is touched at each checkpoint (all log rows with seq <= at); any log.

    ``measures``: those of MEASURES that are wanted; only their parts of the work are done.
    """
    if unknown := set(measures) - set(MEASURES):
        raise ValueError(f"no such measures: {sorted(unknown)}")
    line = Timeline(log, checkpoints, directed, weighted)
    plain = [m for m in measures if m != "component_id"]
    out = None
    if plain or not measures:
        held = states(line, measures).filter("present > 0")
        out = held.withColumn("k", F.explode(F.sequence("k", F.col("next") - 1))).select("k", "id", *plain)
    if "component_id" in measures:
        found = labels(line.nodes, contractions(line.pairs, line.count), line.count)
        out = found if out is None else out.join(found, ["k", "id"])
    return out.join(F.broadcast(line.points) if line.count < 1_000_000 else line.points, "k").select("at", "id", *measures)


TOTALS = ("n_nodes", "n_edges", "total_weight", "max_degree", "avg_degree", "density", "n_triangles", "avg_clustering", "n_components")


def prefix_totals(log: DataFrame, checkpoints: DataFrame, directed: bool = False, weighted: bool = False, measures: Sequence[str] = TOTALS) -> DataFrame:
    """(at, *measures) of the whole graph at each checkpoint, of TOTALS; any log.

    Work grows with the changes, not with nodes or edges times checkpoints.
    """
    if unknown := set(measures) - set(TOTALS):
        raise ValueError(f"no such measures: {sorted(unknown)}")
    line = Timeline(log, checkpoints, directed, weighted)
    wanted = set(measures)
    parts = [_counted(line.nodes, "n_nodes"), _counted(line.edges, "n_edges")]
    if "total_weight" in wanted:
        weights = line.weight_changes() if weighted else line.edges.select("k1", F.lit(1.0)).union(line.edges.select("k2", F.lit(-1.0))).toDF("k", "w")
        parts.append(weights.select("k", F.lit("total_weight").alias("name"), F.col("w").alias("by")))
    if {"n_triangles", "avg_clustering", "max_degree"} & wanted:
        need = (["degree"] if "max_degree" in wanted else []) + (["triangles"] if {"n_triangles", "avg_clustering"} & wanted else []) + (["clustering"] if "avg_clustering" in wanted else [])
        held = written(states(line, need))
        per = Window.partitionBy("id").orderBy("k")
        for column, name in (("triangles", "n_triangles"), ("clustering", "avg_clustering")):
            if name in wanted or "avg_clustering" in wanted:
                moved = held.select("k", F.lit(name).alias("name"), (F.col(column) - F.coalesce(F.lag(column).over(per), F.lit(0))).cast("double").alias("by"))
                parts.append(moved)
    changes = parts[0]
    for p in parts[1:]:
        changes = changes.union(p)
    sums = changes.filter(F.col("k") < line.count).groupBy("k").pivot("name", ["n_nodes", "n_edges", "total_weight", "n_triangles", "avg_clustering"]).agg(F.sum("by"))
    upto = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)  # over checkpoints
    got = line.points.join(sums, "k", "left").na.fill(0)
    n, m = F.col("n_nodes"), F.col("n_edges")
    got = got.select("at", "k", *[F.round(F.sum(c).over(upto)).cast("long").alias(c) for c in ("n_nodes", "n_edges")], F.sum("total_weight").over(upto).alias("total_weight"), F.expr("bigint(round(sum(n_triangles) OVER (ORDER BY k)) / 3)").alias("n_triangles"), F.sum("avg_clustering").over(upto).alias("rates"))
    if "max_degree" in wanted:
        levels = levels_of(line.count)
        spread = held.filter("present > 0").select("degree", F.explode(tree_nodes(F.col("k"), F.col("next"), levels)).alias("t"))
        tops = spread.groupBy("t").agg(F.max("degree").alias("d"))
        way = line.points.select("k", F.explode(ancestors(F.col("k"), levels)).alias("t"))
        got = got.join(way.join(tops, "t").groupBy("k").agg(F.max("d").alias("max_degree")), "k", "left")
    if "n_components" in wanted:
        got = got.join(merges(contractions(line.pairs, line.count), line.points, line.count), "k", "left")
    each = 1.0 if directed else 2.0
    out = {
        "total_weight": F.when(m == 0, F.lit(0.0)).otherwise(F.col("total_weight")),
        "max_degree": F.coalesce("max_degree", F.lit(0).cast("long")) if "max_degree" in wanted else None,
        "avg_degree": F.when(n > 0, each * m / n).otherwise(F.lit(0.0)),
        "density": F.when(n > 1, each * m / (n * (n - 1))).otherwise(F.lit(0.0)),
        "avg_clustering": F.when((n > 0) & (F.col("n_triangles") > 0), F.col("rates") / n).otherwise(F.lit(0.0)),
        "n_components": n - F.coalesce("merged", F.lit(0)) if "n_components" in wanted else None,
    }
    return got.select("at", *[out[c].alias(c) if out.get(c) is not None else F.col(c) for c in measures])


def _counted(df: DataFrame, name: str) -> DataFrame:
    """(k, name, by): how the number of what lives changes."""
    ends = F.array(F.struct(F.col("k1").alias("k"), F.lit(1.0).alias("by")), F.struct(F.col("k2").alias("k"), F.lit(-1.0).alias("by")))
    return df.select(F.explode(ends).alias("c")).select("c.k", F.lit(name).alias("name"), "c.by")
