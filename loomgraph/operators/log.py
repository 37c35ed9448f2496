"""Replay of a mutation log (seq, op, u, v, w), op in add, remove, update, node, clear: results after every prefix.

Everything is a window over the rows of one edge in a stretch of the log, so the log is partitioned by edge and stretch and
never replayed in order.
Running totals at checkpoints are sums of per-interval sums, so no window spans the whole log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.lineage import written
from ..plans.order import at_points, even_buckets, next_point, numbered
from .connectivity import contractions, merges
from .graph import Graph
from .triangles import closed_at


def with_spans(log: DataFrame) -> DataFrame:
    """The log without its clears, with until: the seq of the next one, null behind the last; until_k: its column k, if the log has one."""
    clears = log.filter("op = 'clear'")
    rows = log.filter("op <> 'clear'")
    k = F.col("k") if "k" in log.columns else F.lit(None).cast("long")
    if clears.isEmpty():
        return rows.withColumns({"until": F.lit(None).cast("long"), "until_k": F.lit(None).cast("long")})
    points = clears.select(F.col("seq").alias("at"), F.struct(F.col("seq").cast("long").alias("seq"), k.alias("k")).alias("told"))
    found = next_point(rows, "seq", points, False, int(log.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return found.withColumns({"until": F.col("point.seq"), "until_k": F.col("point.k")}).drop("point")


def _spans(log: DataFrame) -> DataFrame:
    return log if "until" in log.columns else with_spans(log)


def effects(log: DataFrame, directed: bool = False) -> DataFrame:
    """Rows of add, remove and update, before and behind clears, with effective boolean (what the call returns), until (seq of
    the clear that ends what it does, or null), episode, and the weight that holds after it."""
    rows = _spans(log).filter("op IN ('add', 'remove', 'update') AND u <> v")
    if not directed:
        rows = rows.withColumns({"u": F.least("u", "v"), "v": F.greatest("u", "v")})
    return _in_stretches(rows)


def _in_stretches(rows: DataFrame) -> DataFrame:
    """Adds effective, episode and weight by windows over (edge, stretch of the log), so that an edge with most rows is many tasks.

    What a row does depends on what lies before its stretch only by whether the edge is there.  So each stretch is worked
    out for both cases; which one holds is found on a table of one row per edge and stretch.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    span = F.coalesce(F.col("until").cast("long"), F.lit(2**63 - 1))  # joins match no nulls
    keyed = rows.withColumns({"_span": span, "_part": F.coalesce(even_buckets(rows, "seq", parts), F.lit(-1))})
    key = ["_span", "u", "v", "_part"]
    per = Window.partitionBy(*key).orderBy("seq")
    sets = F.when(F.col("op") != "update", F.col("op"))
    inner = keyed.withColumn("_before", F.last(sets, ignorenulls=True).over(per.rowsBetween(Window.unboundedPreceding, -1)))
    for case in ("remove", "add"):
        there = F.coalesce("_before", F.lit(case)) == "add"
        inner = inner.withColumn(f"_does_{case}", F.when(F.col("op") == "add", ~there).otherwise(there))
    upto = per.rowsBetween(Window.unboundedPreceding, 0)
    for case in ("remove", "add"):
        does = F.col(f"_does_{case}")
        weight = F.when(does & (F.col("op") != "remove"), F.coalesce(F.col("w"), F.lit(1.0)))
        inner = inner.withColumns({f"_n_{case}": F.sum(F.when(does & (F.col("op") == "add"), 1).otherwise(0)).over(upto), f"_w_{case}": F.last(weight, ignorenulls=True).over(upto)})
    ends = [F.max(f"_n_{c}").alias(f"_n_{c}") for c in ("remove", "add")] + [F.max_by(f"_w_{c}", "seq").alias(f"_w_{c}") for c in ("remove", "add")]
    whole = inner.groupBy(*key).agg(F.max_by(sets, F.when(sets.isNotNull(), F.col("seq"))).alias("_op"), *ends)
    past = Window.partitionBy(*key[:3]).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per stretch
    pick = lambda what: F.when(F.col("_there"), F.col(f"_{what}_add")).otherwise(F.col(f"_{what}_remove"))
    enters = whole.withColumn("_there", F.coalesce(F.last("_op", ignorenulls=True).over(past) == "add", F.lit(False)))
    enters = enters.select(*key, "_there", F.coalesce(F.sum(pick("n")).over(past), F.lit(0)).alias("_n"), F.last(pick("w"), ignorenulls=True).over(past).alias("_w"))
    return inner.join(enters, key).select(*rows.columns, pick("does").alias("effective"), (F.col("_n") + pick("n")).alias("episode"), F.coalesce(pick("w"), F.col("_w")).alias("weight"))


def lifetimes(log: DataFrame, directed: bool = False) -> DataFrame:
    """(u, v, born, died or null, weight): the spans of seq in which an edge is present, and its last weight in them; a clear ends them."""
    died = F.coalesce(F.max(F.when(F.col("op") == "remove", F.col("seq"))), F.first("until"))
    last = F.max_by("weight", F.when(F.col("op") != "remove", F.col("seq")))
    return effects(log, directed).filter("effective").groupBy("until", "u", "v", "episode").agg(F.min("seq").alias("born"), died.alias("died"), last.alias("weight")).drop("until", "episode")


def touches(log: DataFrame, effective: DataFrame) -> DataFrame:
    """(id, seq, until[, k1, k2]): when each node is first touched, after the start and after each clear, and the clear that ends that.

    ``log`` has what with_spans adds; ``effective`` are its effective rows.
    """
    kept = ["seq", "until", "until_k", *(["k"] if "k" in log.columns else [])]
    added = effective.filter("op = 'add'").select(F.explode(F.array("u", "v")).alias("id"), *kept)
    alone = log.filter("op = 'node'").select(F.col("u").alias("id"), *kept)
    first = [F.min("seq").alias("seq")] + ([F.min("k").alias("k1"), F.first("until_k").alias("k2")] if "k" in kept else [])
    return added.union(alone).groupBy("id", "until").agg(*first)


def first_touches(log: DataFrame, directed: bool = False) -> DataFrame:
    """(id, seq): when each node of the graph that the log makes was first touched, since the last clear."""
    rows = with_spans(log)
    return touches(rows, effects(rows, directed).filter("effective")).filter("until IS NULL").select("id", "seq")


def replay(log: DataFrame, directed: bool = False, weighted: bool = False) -> Graph:
    """The graph after the whole log."""
    live = lifetimes(log, directed).filter("died IS NULL").select("u", "v", (F.col("weight") if weighted else F.lit(1.0)).alias("w"))
    return Graph(live, first_touches(log, directed).select("id"), directed, weighted)


def prefix_metrics(log: DataFrame, checkpoints: DataFrame, directed: bool = False) -> DataFrame:
    """Per checkpoint (seq): n_nodes, n_edges, n_triangles, n_components after all rows up to it; the log has adds and nodes only.

    Rows become the number of the first checkpoint that sees them at once, and the rest is minima of these: an edge is there
    from its first add, a node from its first edge or row, a triangle from the last of its edges.  So no window spans the
    log, and an edge is a row of three numbers.
    """
    parts = int(log.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    points = written(numbered(checkpoints))
    count = points.count()
    seen = at_points(log.select("seq", "op", "u", "v"), points, parts).filter("k IS NOT NULL")
    ends = [F.col("u"), F.col("v")] if directed else [F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")]
    edges = written(seen.filter("op = 'add' AND u <> v").select(*ends, "k").groupBy("u", "v").agg(F.min("k").alias("k")))
    under = edges
    if directed:
        under = written(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "k").groupBy("u", "v").agg(F.min("k").alias("k")))
    alone = seen.filter("op = 'node'").select(F.col("u").alias("id"), "k")
    touched = edges.select(F.explode(F.array("u", "v")).alias("id"), "k").union(alone).groupBy("id").agg(F.min("k").alias("k"))
    per = lambda df, name: df.groupBy("k").agg(F.count(F.lit(1)).alias(name))
    got = points
    for found in (per(touched, "nodes"), per(edges, "links"), closed_at(under).withColumnRenamed("n", "closed")):
        got = got.join(found, "k", "left")
    merged = merges(contractions(under.select("u", "v", F.col("k").alias("k1"), F.lit(count).cast("long").alias("k2")), count), points, count)
    got = got.join(merged, "k", "left").na.fill(0)
    upto = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)  # over checkpoints, which the caller chose
    nodes, links, closed = (F.coalesce(F.sum(c).over(upto), F.lit(0)) for c in ("nodes", "links", "closed"))
    return got.select("at", nodes.alias("n_nodes"), links.alias("n_edges"), closed.alias("n_triangles"), (nodes - F.col("merged")).alias("n_components"))
