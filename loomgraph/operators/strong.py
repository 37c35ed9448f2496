"""Strongly connected components by joins, in rounds that follow the logarithm of the graph, not its diameter.

A phase does four things to what is left of the graph.

1.  Nodes without an arc in or out are components by themselves and go.
2.  Chains (nodes with one arc in and one out) are contracted to one arc between their ends, by pointers that double
    their reach.  A chain lies in a component if its two ends do, which is looked up when all else is known; a chain
    without ends is a cycle, thus a component.
3.  Every node gets the colour of the first node, in a random order, that reaches it, and then of the first one of that
    colour that it reaches: all colours are pivots at once.  A round takes the colours of neighbours and the colour of the
    node that a node's colour names (who reaches that one reaches this one as well), so what is known doubles.
4.  Nodes with the same colour both ways are a component.  Of the others, only arcs within a pair of colours matter.

The order is a hash of the id, so the expected number of phases is logarithmic.  Each round is joins and partially
aggregated minima; no table is collected or held by one task.  Joins are by shuffle: a table sent to all tasks passes the
driver first, and what would be sent in all rounds together grows with the nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import written


def _degrees(arcs: DataFrame) -> DataFrame:
    """(id, n_in, n_out, before, after): for nodes with one arc in or out, the node at its other end."""
    ends = F.array(F.struct(F.col("u").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o"), F.col("v").alias("x")), F.struct(F.col("v").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o"), F.col("u").alias("x")))
    one = arcs.select(F.explode(ends).alias("e")).select("e.*")
    return one.groupBy("id").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"), F.max(F.when(F.col("i") == 1, F.col("x"))).alias("before"), F.max(F.when(F.col("o") == 1, F.col("x"))).alias("after"))


def _chains(inner: DataFrame) -> DataFrame:
    """(id, head, tail, low, ring) for inner(id, before, after): the nodes at both ends of its chain, and whether it is a cycle, with smallest id low."""
    now = written(inner.select("id", F.col("before").alias("head"), F.col("after").alias("tail"), F.col("id").alias("low")))
    left = now.count()
    while left > 0:
        a = now.select(F.col("id").alias("head"), F.col("head").alias("head2"))
        b = now.select(F.col("id").alias("tail"), F.col("tail").alias("tail2"), F.col("low").alias("low2"))
        both = now.join(a.hint("merge"), "head", "left").join(b.hint("merge"), "tail", "left")
        now = written(both.select("id", F.coalesce("head2", "head").alias("head"), F.coalesce("tail2", "tail").alias("tail"), F.least("low", F.coalesce("low2", "low")).alias("low"), (F.col("head2").isNotNull() | F.col("tail2").isNotNull()).alias("moved")))
        if now.filter("moved").isEmpty():
            break
        now, left = now.drop("moved"), left // 2
    inside = now.select(F.col("id").alias("tail"), F.lit(True).alias("ring"))  # a chain with ends has reached them by now
    return now.join(inside.hint("merge"), "tail", "left").select("id", "head", "tail", "low", F.coalesce("ring", F.lit(False)).alias("ring"))


def _first(nodes: DataFrame, arcs: DataFrame) -> DataFrame:
    """(id, c): the first node, by (order, id), among those that reach a node along arcs(u, v); nodes(id) hold both ends."""
    order = lambda c: F.struct(F.xxhash64(c).alias("o"), F.col(c).alias("id"))
    now = written(nodes.select("id", order("id").alias("c")))
    while True:
        told = arcs.join(now.select(F.col("id").alias("u"), "c").hint("merge"), "u").groupBy(F.col("v").alias("id")).agg(F.min("c").alias("t"))
        near = now.join(told.hint("merge"), "id", "left").select("id", F.col("c").alias("old"), F.least("c", F.coalesce("t", "c")).alias("c"))
        named = now.select(F.col("id").alias("at"), F.col("c").alias("further"))
        far = near.withColumn("at", F.col("c.id")).join(named.hint("merge"), "at", "left").select("id", F.least("c", F.coalesce("further", "c")).alias("c"), "old")
        new = written(far.select("id", "c", (F.col("c") < F.col("old")).alias("moved")))
        now = new.select("id", "c")
        if new.filter("moved").isEmpty():
            return now.select("id", F.col("c.id").alias("c"))


def strong_component_labels(arcs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, component_id) per node of a directed graph; component_id is the smallest id of the component."""
    rest = written(arcs.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).filter("u <> v").distinct())
    named, chains = [], []
    while not rest.isEmpty():
        degrees = written(_degrees(rest))
        if not degrees.filter("n_in = 0 OR n_out = 0").isEmpty():
            on = degrees.filter("n_in > 0 AND n_out > 0").select("id")
            rest = written(_within(rest, on))
            if rest.isEmpty():
                break
            degrees = written(_degrees(rest))
        inner = degrees.filter("n_in = 1 AND n_out = 1")
        if not inner.isEmpty():
            found = written(_chains(inner))
            named.append(found.filter("ring").select("id", F.col("low").alias("c")))
            chains.append(found.filter("NOT ring").select("id", "head", "tail"))
            over = rest.join(found.select(F.col("id").alias("v"), "tail").hint("merge"), "v", "left").join(found.select(F.col("id").alias("u")).hint("merge"), "u", "left_anti")
            rest = written(over.select("u", F.coalesce("tail", "v").alias("v")).filter("u <> v").distinct())
            if rest.isEmpty():
                break
            nodes_left = rest.select(F.col("u").alias("id")).union(rest.select("v")).distinct()
        else:
            nodes_left = degrees.select("id")
        ahead = _first(nodes_left, rest)
        tagged = written(rest.join(ahead.select(F.col("id").alias("u"), F.col("c").alias("cu")).hint("merge"), "u").join(ahead.select(F.col("id").alias("v"), F.col("c").alias("cv")).hint("merge"), "v").filter("cu = cv").select("u", "v"))
        back = _first(nodes_left, tagged.select(F.col("v").alias("u"), F.col("u").alias("v")))
        both = written(ahead.join(back.withColumnRenamed("c", "b").hint("merge"), "id"))
        named.append(both.filter("c = b").select("id", "c"))
        open_ = both.filter("c <> b").select("id", F.struct("c", "b").alias("k"))
        ends = tagged.join(open_.select(F.col("id").alias("u"), F.col("k").alias("ku")).hint("merge"), "u").join(open_.select(F.col("id").alias("v"), F.col("k").alias("kv")).hint("merge"), "v")
        rest = written(ends.filter("ku = kv").select("u", "v"))
    known = None
    for part in named:
        known = part if known is None else known.union(part)
    if known is None:
        return nodes.select("id", F.col("id").alias("component_id"))
    known = written(known)
    for found in reversed(chains):  # ends of a chain were named after it was contracted
        ends = found.join(known.select(F.col("id").alias("head"), F.col("c").alias("a")).hint("merge"), "head", "left").join(known.select(F.col("id").alias("tail"), F.col("c").alias("b")).hint("merge"), "tail", "left")
        a, b = F.coalesce("a", "head"), F.coalesce("b", "tail")
        known = written(known.union(ends.filter(a == b).select("id", a.alias("c"))))
    whole = known.union(known.select(F.col("c").alias("id"), "c")).distinct()
    low = whole.groupBy("c").agg(F.min("id").alias("component_id"))
    named_all = whole.join(low.hint("merge"), "c").select("id", "component_id")
    return nodes.join(named_all.hint("merge"), "id", "left").select("id", F.coalesce("component_id", "id").alias("component_id"))


def _within(arcs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Arcs between nodes(id)."""
    return arcs.join(nodes.withColumnRenamed("id", "u").hint("merge"), "u", "left_semi").join(nodes.withColumnRenamed("id", "v").hint("merge"), "v", "left_semi").select("u", "v")
