"""Components of a graph whose edges live for intervals of checkpoints, at all checkpoints together.

The checkpoints are the leaves of a binary tree.  An interval is the union of few subtrees (two a level at most), and an
edge is placed at their tops.  Going down, each tree node contracts what its own edges connect, and the edges below meet
the contracted graph only.  All nodes of a level are one graph without edges between them (ids carry the tree node above
32 bits), so a level is one fixpoint of components, and there are as many levels as the logarithm of the checkpoints.  An
edge is there in as many copies as it has subtrees, whatever the number of checkpoints in them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import written
from .components import component_labels

TAG = 2**32


def levels_of(count: int) -> int:
    """Levels below the root of a tree with room for ``count`` leaves."""
    return max(0, (count - 1).bit_length())


def tree_nodes(start: Column, stop: Column, levels: int) -> Column:
    """Tops of the subtrees that make up the leaves start <= k < stop; the root is 1, the children of t are 2t and 2t + 1."""
    leaves = 2**levels
    found = []
    for s in range(levels + 1):
        lo = F.shiftright((start + (leaves + 2**s - 1)).cast("long"), s)
        hi = F.shiftright((stop + leaves).cast("long"), s)
        found.append(F.when((lo < hi) & (lo % 2 == 1), lo))
        found.append(F.when((lo < hi) & (hi % 2 == 1), hi - 1))
    return F.filter(F.array(*found), lambda t: t.isNotNull())


def ancestors(k: Column, levels: int) -> Column:
    """The tree nodes above leaf k, itself included."""
    return F.array(*[F.shiftright((k + 2**levels).cast("long"), s) for s in range(levels + 1)])


def level_of(t: str) -> Column:
    return F.length(F.bin(t)) - 1


def contractions(edges: DataFrame, count: int) -> list[DataFrame | None]:
    """For each level a table (key, label) of what it contracts: key is tree node * 2^32 + id, label an id; None where nothing is.

    edges(u, v, k1, k2) live at the checkpoints k1 <= k < k2 of ``count``; ids are below 2^32.
    """
    levels = levels_of(count)
    placed = edges.select("u", "v", F.explode(tree_nodes(F.col("k1"), F.col("k2"), levels)).alias("t"))
    rest = written(placed.distinct().withColumn("level", level_of("t")))
    there = {r.level for r in rest.select("level").distinct().collect()}  # at most one row a level
    told: list[DataFrame | None] = []
    for level in range(levels + 1):
        if level not in there:
            told.append(None)
            continue
        here = rest.filter(F.col("level") == level)
        found = component_labels(here.select((F.col("t") * TAG + F.col("u")).alias("u"), (F.col("t") * TAG + F.col("v")).alias("v")))
        changed = written(found.filter("id <> component_id").select(F.col("id").alias("key"), F.col("component_id").bitwiseAND(TAG - 1).alias("label")))
        told.append(changed)
        if max(there) == level:
            break
        above = F.expr(f"shiftright(t, level - {level})") * TAG
        rest = rest.filter(F.col("level") > level)
        for end in ("u", "v"):
            rest = rest.withColumn("key", above + F.col(end)).join(changed, "key", "left").withColumn(end, F.coalesce("label", end)).drop("key", "label")
        rest = rest.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "t", "level").distinct()
        rest = written(rest)
        there = {r.level for r in rest.select("level").distinct().collect()} | {level}
        if max(there) == level:
            break
    return told + [None] * (levels + 1 - len(told))


def merges(told: list[DataFrame | None], points: DataFrame, count: int) -> DataFrame:
    """(k, merged): by how many the edges at checkpoint k lower the number of components, for points(k)."""
    per = None
    for t in told:
        if t is not None:
            n = t.groupBy(F.shiftright("key", 32).alias("t")).agg(F.count(F.lit(1)).alias("n"))
            per = n if per is None else per.union(n)
    if per is None:
        return points.select("k", F.lit(0).cast("long").alias("merged"))
    way = points.select("k", F.explode(ancestors(F.col("k"), levels_of(count))).alias("t"))
    return way.join(per, "t", "left").groupBy("k").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("merged"))


def labels(nodes: DataFrame, told: list[DataFrame | None], count: int) -> DataFrame:
    """(id, k, component_id) for nodes(id, k1, k2) at each checkpoint k1 <= k < k2: the smallest id of the component then."""
    levels = levels_of(count)
    now = nodes.select("id", "k1", F.least("k2", F.lit(count)).alias("k2"), F.lit(1).cast("long").alias("t"), F.col("id").alias("label")).filter("k1 < k2")
    for level, changed in enumerate(told):
        if changed is not None:
            now = now.withColumn("key", F.col("t") * TAG + F.col("label")).join(changed.withColumnRenamed("label", "_to"), "key", "left").withColumn("label", F.coalesce("_to", "label")).drop("key", "_to")
        if level < levels:
            size = 2 ** (levels - level - 1)
            first = lambda t: (t - 2 ** (level + 1)) * size  # noqa: B023, E731
            inside = lambda t: (first(t) < F.col("k2")) & (first(t) + size > F.col("k1"))  # noqa: B023, E731
            below = F.filter(F.array(F.col("t") * 2, F.col("t") * 2 + 1), inside)
            now = now.withColumn("t", F.explode(below))
    return now.select("id", (F.col("t") - 2**levels).alias("k"), F.col("label").alias("component_id"))
