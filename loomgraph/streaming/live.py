"""Graphs over streams.

maintain: a mutation log stream into versioned Parquet snapshots, one per micro-batch (repeating a batch rewrites its
version).  expiring: a timed edge stream into add, refresh and expire events, state kept per edge.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators.graph import Graph
from ..operators.log import first_touches, lifetimes
from ..sources.edgs import load_parquet, save_parquet

EVENTS = "u long, v long, event string, at timestamp, w double"


def maintain(log: DataFrame, path: str, checkpoint: str, directed: bool = False, weighted: bool = False, measures: bool = False, **trigger) -> StreamingQuery:
    """Applies log rows (seq, op, u, v, w) batch by batch; version k of the graph is path/k (Graph via load_parquet).

    With ``measures`` each version's totals are a row of path/metrics, see totals; ``batch`` is the version.
    """

    def step(batch: DataFrame, k: int) -> None:
        spark = batch.sparkSession
        old = load_parquet(spark, f"{path}/{k - 1}") if k else Graph.empty(spark, 0, directed, weighted)
        cleared = not batch.filter("op = 'clear'").isEmpty()
        before = old.clear() if cleared else old
        known = before.edges.select(F.lit(-1).cast("long").alias("seq"), F.lit("add").alias("op"), "u", "v", "w")
        rows = batch.select("seq", "op", "u", "v", "w").unionByName(known) if not cleared else batch.select("seq", "op", "u", "v", "w")
        edges = lifetimes(rows, directed).filter("died IS NULL").select("u", "v", F.col("weight").alias("w"))
        touched = before.touched.union(first_touches(rows, directed).select("id")).distinct()
        save_parquet(Graph(edges, touched, directed, weighted, old.base_ids), f"{path}/{k}")
        if measures:
            totals(load_parquet(spark, f"{path}/{k}")).write.mode("overwrite").parquet(f"{path}/metrics/batch={k}")

    return log.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def totals(graph: Graph) -> DataFrame:
    """One row: what Graph.stats gives, n_triangles, avg_clustering and n_components."""
    one = F.lit(1)
    triangles = graph.triangles().agg(F.count(one).alias("n_triangles"))
    clustering = graph.clustering().agg(F.coalesce(F.avg("clustering"), F.lit(0.0)).alias("avg_clustering"))
    components = graph.component_ids().agg(F.count_if(F.col("id") == F.col("component_id")).alias("n_components"))
    return graph.stats().crossJoin(triangles).crossJoin(clustering).crossJoin(components)  # one row each


def expiring(events: DataFrame, width_s: float, delay: str = "0 seconds") -> DataFrame:
    """Events (u, v, event, at, w) from a stream of (u, v, ts timestamp, w[, seq]): added, refreshed, or expired by the watermark.

    Rows of one edge and time go by seq, or by w where there is none.  Rows behind the watermark are dropped, where a single clock would refuse them.
    """
    width = pd.Timedelta(seconds=width_s)

    def run(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        u, v = key
        out = []
        if state.hasTimedOut:
            last, w = state.get
            out.append((u, v, "expired", pd.Timestamp(last, unit="us") + width, w))
            state.remove()
        else:
            last, w = state.get if state.exists else (None, None)
            rows = pd.concat(list(frames))
            rows = rows.sort_values(["ts", "seq"] if "seq" in rows else ["ts", "w"], kind="stable")
            before = rows["ts"].shift(fill_value=pd.NaT if last is None else pd.Timestamp(last, unit="us"))
            event = np.where(before.isna() | (before < rows["ts"] - width), "added", "refreshed")
            yield pd.DataFrame({"u": u, "v": v, "event": event, "at": rows["ts"], "w": rows["w"].astype(float)})
            last, w = int(rows["ts"].iloc[-1].value // 1000), float(rows["w"].iloc[-1])
            state.update((last, w))
            state.setTimeoutTimestamp(max(int((pd.Timestamp(last, unit="us") + width).value // 1_000_000) + 1, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=["u", "v", "event", "at", "w"])

    timed = events.filter("u <> v").withWatermark("ts", delay)
    return timed.groupBy("u", "v").applyInPandasWithState(run, EVENTS, "last long, w double", "append", GroupStateTimeout.EventTimeTimeout)


def windowed_degrees(events: DataFrame, width: str, slide: str | None = None, delay: str = "0 seconds") -> DataFrame:
    """(start, id, degree): distinct neighbours of each node in a tumbling or sliding window of an undirected edge stream."""
    ends = F.explode(F.array(F.struct(F.col("u").alias("id"), F.col("v").alias("other")), F.struct(F.col("v").alias("id"), F.col("u").alias("other"))))
    rows = events.filter("u <> v").withWatermark("ts", delay).select(ends.alias("e"), "ts").select("e.id", "e.other", "ts")
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return rows.groupBy(w.alias("w"), "id").agg(F.size(F.collect_set("other")).cast("long").alias("degree")).select(F.col("w.start").alias("start"), "id", "degree")
