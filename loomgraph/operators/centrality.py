"""PageRank and betweenness."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.lineage import cut, filesystem, written
from .kernels import Adjacency, Arcs, shares, without_detours
from .paths import KEPT, distances, levels

#: Edges of a graph that each worker holds for the kernels (8 bytes each, 24 with weights, so 320 MB); larger graphs run as joins.
BROADCAST_ARCS = 40_000_000
#: Sources of a task, and rows that a worker reads at a time.
TASK_SOURCES, READ_ROWS = 256, 500_000


def pagerank(out: DataFrame, nodes: DataFrame, damping: float = 0.85, tol: float = 1e-10, max_iter: int = 100) -> DataFrame:
    """(id, rank) by power iteration over nodes, along arcs out(u, v, w) in proportion to w; a node without arcs spreads evenly.

    Stops after max_iter rounds, or when a round moved less than tol in sum.  Arcs are dealt by source once and stay so:
    a round sends ranks to them, sums what each partition gives to a node, and shuffles those sums.  It is one job, which
    tells on the side what moved and what hangs on nodes without arcs.
    """
    if not 0 <= damping < 1 or not 0 < tol < float("inf") or max_iter <= 0:
        raise ValueError("damping must be in [0, 1), tol finite and positive, max_iter positive")
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    given = cut(out.select("u", "v", "w").repartition(parts, "u"))  # its partitioning is known to the joins that follow
    total = given.groupBy("u").agg(F.sum("w").alias("t"))
    goes = total.select(F.col("u").alias("id"), "t")
    rank = written(nodes.join(goes, "id", "left").select("id", F.col("t")))
    n = rank.count()
    if not n:
        return nodes.select("id", F.lit(0.0).alias("rank"))
    hung = rank.filter("t IS NULL").count() / n
    rank = rank.withColumn("rank", F.lit(1.0 / n))
    for _ in range(max_iter):
        gives = rank.filter("t IS NOT NULL").select(F.col("id").alias("u"), (F.col("rank") / F.col("t")).alias("r"))
        moved = given.join(gives, "u").groupBy(F.col("v").alias("id")).agg(F.sum(F.col("r") * F.col("w")).alias("m"))
        base = (1 - damping) / n + damping * hung / n
        new = rank.join(moved, "id", "left").select("id", "t", (F.lit(base) + damping * F.coalesce("m", F.lit(0.0))).alias("rank"), F.col("rank").alias("old"))
        told = Observation()
        new = new.observe(told, F.sum(F.abs(F.col("rank") - F.col("old"))).alias("gap"), F.sum(F.when(F.col("t").isNull(), F.col("rank"))).alias("hung"))
        rank = written(new.drop("old"))
        got = told.get
        hung = got["hung"] or 0.0
        if got["gap"] < tol:
            break
    return rank.select("id", "rank")


def betweenness(edges: DataFrame, nodes: DataFrame, directed: bool, weighted: bool, k: int = 200, seed: int = 42, normalise: bool = True, broadcast_arcs: int = BROADCAST_ARCS) -> DataFrame:
    """(id, betweenness) per node: k random pairs with replacement, scaled to all pairs; all pairs if there are no more than k.

    A graph of a checked size is read by each worker, and sources run in parallel, one backward pass per source however many of its
    targets were drawn.  A larger one takes part in joins on (source, node), see dependencies_by_joins.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    edges, nodes = written(edges.select("u", "v", "w")), written(nodes.select("id"))  # computed once
    n = nodes.count()
    if n < 2:
        return nodes.select("id", F.lit(0.0).alias("betweenness"))
    pairs = n * (n - 1) if directed else n * (n - 1) // 2
    if k >= pairs:
        drawn, scale = None, 1.0 if directed else 0.5
    else:
        drawn, scale = drawn_pairs(nodes, n, k, seed), pairs / k
    if edges.count() <= broadcast_arcs:
        got = _by_copies(edges, directed, weighted, drawn)
    else:
        got = dependencies_by_joins(edges, directed, weighted, drawn)
    got = got.groupBy("id").agg((F.sum("b") * scale).alias("b"))
    out = nodes.join(got, "id", "left").select("id", F.coalesce("b", F.lit(0.0)).alias("betweenness"))
    if normalise:
        out = written(out)
        top = out.agg(F.max("betweenness")).first()[0]
        out = out.withColumn("betweenness", F.col("betweenness") / top) if top and top > 0 else out
    return out


def drawn_pairs(nodes: DataFrame, n: int, k: int, seed: int) -> DataFrame:
    """(s, v, own): k ordered pairs of two different nodes, drawn with replacement, and how often each was drawn.

    Draw i takes places among the n ascending ids from the first 60 bits of MD5 of "seed:i:s" and "seed:i:t", so that any
    engine draws the same pairs, however the tables are partitioned.
    """
    spark = nodes.sparkSession
    bits = lambda end: F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"), F.lit(f":{end}"))), 1, 15), 16, 10).cast("long")
    a = bits("s") % n
    draws = spark.range(k).select(a.alias("a"), ((a + 1 + bits("t") % (n - 1)) % n).alias("b")).groupBy("a", "b").agg(F.count(F.lit(1)).cast("double").alias("own"))
    place = placed(nodes)
    got = draws.join(place.select(F.col("id").alias("s"), F.col("place").alias("a")), "a").join(place.select(F.col("id").alias("v"), F.col("place").alias("b")), "b")
    return written(got.select("s", "v", "own"))


def placed(ids: DataFrame) -> DataFrame:
    """(id, place): the place of each of different ids among them, ascending."""
    ranked = written(ids.select("id").orderBy("id").withColumn("part", F.spark_partition_id()).withColumn("m", F.monotonically_increasing_id()))
    per = ranked.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("m").alias("lo"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row per partition
    return ranked.join(F.broadcast(per.select("part", "lo", before.alias("before"))), "part").select("id", (F.col("before") + F.col("m") - F.col("lo")).alias("place"))


def _by_copies(edges: DataFrame, directed: bool, weighted: bool, drawn: DataFrame | None) -> DataFrame:
    """(id, b): shares of the paths of all pairs, or of drawn(s, v, own).

    Spark numbers the nodes and writes the arcs, in order, to the shared folder.  Each worker reads its own copy of them, a batch
    at a time into arrays; the driver has the paths only.  Sources run in ranges, a task each, and within a task in blocks.
    Nodes without arcs are on no path, so they are neither read nor sources.
    """
    spark, chosen = edges.sparkSession, drawn is not None
    places = written(placed(edges.select(F.explode(F.array("u", "v")).alias("id")).distinct()))
    n = places.count()
    at = lambda c, name: places.select(F.col("id").alias(c), F.col("place").cast("int").alias(name))
    arcs = edges.join(at("u", "a"), "u").join(at("v", "b"), "v").select("a", "b", "w")
    turned = arcs.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")
    kept = ["a", "b", "w"] if weighted else ["a", "b"]
    in_order = lambda df: sorted(written(df.select(*kept).repartitionByRange("a").sortWithinPartitions("a", "b")).inputFiles(), key=lambda p: p.rpartition("/")[2])
    out = in_order(arcs if directed else arcs.union(turned))
    into = in_order(turned) if directed else None
    if drawn is None:
        sources, count = places.select(F.col("place").alias("s"), F.lit(None).cast("array<struct<v:long,own:double>>").alias("to")), n
    else:
        ends = drawn.join(at("s", "a"), "s").join(at("v", "b"), "v").select(F.col("a").cast("long").alias("s"), F.col("b").cast("long").alias("v"), "own")
        sources = written(ends.groupBy("s").agg(F.collect_list(F.struct("v", "own")).alias("to")))  # no more than the nodes
        count = sources.count()

    def run(batches):
        total = None
        for b in batches:
            if not b.num_rows:
                continue
            g = _copy(n, tuple(out), into and tuple(into))
            if total is None:
                total = np.zeros(n)
            to = [{t["v"]: t["own"] for t in each} for each in b.column(1).to_pylist()] if chosen else None
            for rows, share in shares(g, b.column(0).to_numpy(), to):
                total[rows] += share
        if total is not None:
            some = np.flatnonzero(total)
            for lo in range(0, len(some), 1_000_000):
                part = some[lo : lo + 1_000_000]
                yield pa.record_batch({"place": pa.array(part, pa.int64()), "b": pa.array(total[part])})

    tasks = max(2 * spark.sparkContext.defaultParallelism, count // TASK_SOURCES)
    dealt = sources.repartitionByRange(tasks, "s").sortWithinPartitions("s")
    got = dealt.mapInArrow(run, "place long, b double").groupBy("place").agg(F.sum("b").alias("b"))
    return got.join(places, "place").select("id", "b")


@lru_cache(maxsize=1)
def _copy(n: int, out: tuple[str, ...], into: tuple[str, ...] | None) -> Adjacency:
    """The graph in these files, once for each worker."""
    arcs = _read_arcs(n, out)
    if arcs.weight is not None and not into:
        arcs = without_detours(arcs)
    return Adjacency(arcs, _read_arcs(n, into) if into else arcs)


def _read_arcs(n: int, files: tuple[str, ...]) -> Arcs:
    """Arcs of n places from files in the order of their sources."""
    parts = [pq.ParquetFile(fs.open_input_file(at)) for fs, at in map(filesystem, files)]
    m = sum(p.metadata.num_rows for p in parts)
    to, start = np.empty(m, np.int32), np.zeros(n + 1, np.int64)
    w = np.empty(m) if any("w" in p.schema_arrow.names for p in parts) else None
    k = 0
    for p in parts:
        for b in p.iter_batches(READ_ROWS):
            a = b.column(0).to_numpy()
            to[k : k + len(a)] = b.column(1).to_numpy()
            if w is not None:
                w[k : k + len(a)] = b.column(2).to_numpy()
            ids, sizes = np.unique(a, return_counts=True)
            start[ids + 1] += sizes
            k += len(a)
    return Arcs(np.cumsum(start), to, w)


def dependencies_by_joins(edges: DataFrame, directed: bool, weighted: bool, drawn: DataFrame | None) -> DataFrame:
    """What _by_copies gives, with joins only: distances, by levels or, with weights, by buckets of distance; then the arcs on
    shortest paths, along which path counts go forward and shares go back, a round for each arc of the longest shortest path."""
    w = F.col("w") if weighted else F.lit(1.0)
    arcs = edges.select("u", "v", w.alias("w"))
    arcs = written(arcs if directed else arcs.union(arcs.select("v", "u", "w")))
    ends = arcs.select(F.explode(F.array("u", "v")).alias("s")).distinct()
    sources = written(ends if drawn is None else drawn.select("s").distinct().join(ends, "s", "left_semi"))
    far = distances(arcs, sources) if weighted else levels(arcs, sources)
    near = far.withColumnsRenamed({"v": "u", "d": "du"})
    tie = F.abs(F.col("du") + F.col("w") - F.col("d")) <= 1e-9 * F.greatest(F.lit(1.0), F.abs(F.col("du") + F.col("w")), F.abs(F.col("d")))
    tree = written(near.join(arcs, "u").join(far, ["s", "v"]).filter(tie & (F.col("du") < F.col("d"))).select("s", "u", "v"))
    paths = front = written(sources.select("s", F.col("s").alias("v"), F.lit(1.0).alias("c")))
    rounds = 0
    while not front.isEmpty():
        rounds += 1
        front = written(front.withColumnRenamed("v", "u").join(tree, ["s", "u"]).groupBy("s", "v").agg(F.sum("c").alias("c")))
        paths = paths.union(front)
        if rounds % KEPT == 0:
            paths = written(paths.groupBy("s", "v").agg(F.sum("c").alias("c")))
    paths = written(paths.groupBy("s", "v").agg(F.sum("c").alias("c")))
    share = tree.join(paths.withColumnsRenamed({"v": "u", "c": "cu"}), ["s", "u"]).join(paths, ["s", "v"]).select("s", "u", "v", (F.col("cu") / F.col("c")).alias("r"))
    share = written(share.filter("u <> s"))  # ends of a path take no share
    own = far.filter("s <> v").select("s", "v", F.lit(1.0).alias("own")) if drawn is None else drawn.join(far.select("s", "v"), ["s", "v"], "left_semi")
    front, rounds = own.withColumnRenamed("own", "x"), 0
    total = ends.select(F.col("s").alias("id"), F.lit(0.0).alias("b"))
    while True:
        front = written(front.join(share, ["s", "v"]).groupBy("s", "u").agg(F.sum(F.col("x") * F.col("r")).alias("x")).select("s", F.col("u").alias("v"), "x"))
        if front.isEmpty():
            return total
        rounds += 1
        total = total.union(front.groupBy(F.col("v").alias("id")).agg(F.sum("x").alias("b")))
        if rounds % KEPT == 0:
            total = written(total.groupBy("id").agg(F.sum("b").alias("b")))
