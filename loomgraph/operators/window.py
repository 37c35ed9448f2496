"""Sliding windows over timed edges (seq, u, v, ts double, w): an edge lives while ts >= clock - width.

The clock moves with every row, self-loops too, and must not go back.  Seeing an edge again restarts its time and
replaces its weight.  An edge seen exactly width ago is still live.

Ids are those of a Graph and must be there, of self-loops too; weights of a weighted window must be finite and positive.
SlidingWindow and window_calls refuse other ids (IndexError) and weights (ValueError); the functions over frames take rows
as check_edges accepts them, and leave calling it to the caller.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.order import next_point
from .graph import ID_END, Graph, good_weight

BAD_IDS = f"u IS NULL OR v IS NULL OR u < 0 OR v < 0 OR u >= {ID_END} OR v >= {ID_END}"


def _checked(width: float) -> float:
    if not 0 < width < float("inf"):
        raise ValueError("window must be finite and positive")
    return float(width)


def check_edges(events: DataFrame, weighted: bool) -> None:
    """Raises IndexError for ids and ValueError for weights that an edge must not have, by one aggregate."""
    wrong = F.expr(f"u <> v AND NOT coalesce({good_weight()}, false)") if weighted else F.lit(False)
    got = events.agg(F.count_if(F.expr(BAD_IDS)).alias("ids"), F.count_if(wrong).alias("weights")).first()
    if got.ids:
        raise IndexError(f"{got.ids} edges with a node id out of range")
    if got.weights:
        raise ValueError(f"{got.weights} edges with a weight that is not finite and positive")


def _canonical(events: DataFrame, directed: bool) -> DataFrame:
    rows = events.filter("u <> v")
    return rows if directed else rows.withColumns({"u": F.least("u", "v"), "v": F.greatest("u", "v")})


def assert_monotone(events: DataFrame) -> None:
    """Raises ValueError if ts ever falls along seq: each range partition is checked, then the borders between them."""
    ranged = events.select("seq", "ts").repartitionByRange("seq").withColumn("part", F.spark_partition_id())
    step = ranged.withColumn("last", F.lag("ts").over(Window.partitionBy("part").orderBy("seq")))
    per = step.groupBy("part").agg(F.count_if(F.col("last") > F.col("ts")).alias("bad"), F.min_by("ts", "seq").alias("lo"), F.max_by("ts", "seq").alias("hi"))
    borders = per.withColumn("before", F.lag("hi").over(Window.orderBy("part")))
    if not borders.filter("bad > 0 OR before > lo").isEmpty():
        raise ValueError("timestamps must not decrease")


def live_edges(events: DataFrame, width: float, at: float, directed: bool = False) -> DataFrame:
    """(u, v, w, ts) live at clock ``at``."""
    _checked(width)
    seen = _canonical(events, directed).filter(F.col("ts") <= at)
    last = seen.groupBy("u", "v").agg(F.max("ts").alias("ts"), F.max_by("w", F.struct("ts", "seq")).alias("w"))
    return last.filter(F.col("ts") >= at - width).select("u", "v", "w", "ts")


def add_flags(events: DataFrame, width: float, directed: bool = False) -> DataFrame:
    """Rows with added boolean: whether adding the edge made it new (False: it was refreshed)."""
    _checked(width)
    last = F.lag("ts").over(Window.partitionBy("u", "v").orderBy("ts", "seq"))
    return _canonical(events, directed).withColumn("last", last).withColumn("added", F.coalesce(F.col("last") < F.col("ts") - width, F.lit(True))).drop("last")


def episodes(events: DataFrame, width: float, directed: bool = False) -> DataFrame:
    """(u, v, first, until, seen): spans of time in which an edge is live; both ends belong to them."""
    flagged = add_flags(events, width, directed)
    n = F.sum(F.col("added").cast("int")).over(Window.partitionBy("u", "v").orderBy("ts", "seq"))
    return flagged.withColumn("episode", n).groupBy("u", "v", "episode").agg(F.min("ts").alias("first"), (F.max("ts") + width).alias("until"), F.count(F.lit(1)).alias("seen")).drop("episode")


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def expired_counts(events: DataFrame, width: float, clocks: DataFrame, directed: bool = False) -> DataFrame:
    """(at, expired): edges each advance of the clock removes, for the given clock values."""
    ends = episodes(events, width, directed).select("until")
    ticks = clocks.select(F.col(clocks.columns[0]).cast("double").alias("at")).distinct()
    got = next_point(ends, "until", ticks, False, _parts(events)).groupBy(F.col("point").alias("at")).agg(F.count(F.lit(1)).alias("expired"))
    return ticks.join(got, "at", "left").select("at", F.coalesce("expired", F.lit(0)).alias("expired"))


def window_calls(calls: DataFrame, width: float, directed: bool = False, weighted: bool = False) -> DataFrame:
    """What each call returns: (seq, op, added boolean, expired long) of calls (seq, op add or advance, u, v, ts, w).

    Every call first moves the clock to its ts, which expires edges; then add adds or refreshes its edge (added false),
    and a self-loop does nothing more (added false).  Raises ValueError if a ts is null, not finite or before the last, and
    what an edge to be added must not have is refused as by Graph.add_edge.
    """
    _checked(width)
    if not calls.filter("ts IS NULL OR isnan(ts) OR abs(ts) = double('Infinity')").isEmpty():
        raise ValueError("timestamps must be finite")
    assert_monotone(calls)
    adds = calls.filter("op = 'add'")
    check_edges(adds, weighted)
    flags = add_flags(adds, width, directed).select("seq", "added")
    ends = episodes(adds, width, directed).select("until")
    # Equal clocks belong to one advance: the first call with that ts makes it.
    gone = next_point(ends, "until", calls.select("ts"), False, _parts(calls)).groupBy(F.col("point").alias("ts")).agg(F.count(F.lit(1)).alias("n"))
    first = calls.groupBy("ts").agg(F.min("seq").alias("seq")).join(gone, "ts").select("seq", "n")
    told = calls.select("seq", "op").join(flags, "seq", "left").join(first, "seq", "left")
    added = F.when(F.col("op") == "add", F.coalesce("added", F.lit(False)))
    return told.select("seq", "op", added.alias("added"), F.coalesce("n", F.lit(0)).alias("expired"))


class SlidingWindow:
    """Read access to the graph of a window at any clock value: ``SlidingWindow(events, 60).at(161.0).n_edges()``.

    What a Graph can be asked, the window can be asked itself, at the clock of its last event.  Events whose ts falls along
    seq are refused, by one pass over them (``check_clock``), and bad edges by another (``check_rows``).
    """

    def __init__(self, events: DataFrame, width: float, directed: bool = False, weighted: bool = False, n_nodes: int = 0, check_clock: bool = True, check_rows: bool = True):
        self.width = _checked(width)
        if check_clock:
            assert_monotone(events)
        w = F.col("w").cast("double") if weighted and "w" in events.columns else F.lit(1.0)
        self.events = events.withColumn("w", w)
        self.directed, self.weighted, self._ids = directed, weighted, n_nodes
        self._snapshot: Graph | None = None
        if check_rows:
            check_edges(self.events, weighted)

    def at(self, clock: float) -> Graph:
        """The graph at a clock value; nodes ever seen stay touched."""
        if not abs(clock) < float("inf"):
            raise ValueError("clock must be finite")
        live = live_edges(self.events, self.width, clock, self.directed).select("u", "v", "w")
        seen = self.events.filter((F.col("ts") <= clock) & (F.col("u") != F.col("v"))).select(F.explode(F.array("u", "v")).alias("id")).distinct()
        return Graph(live, seen, self.directed, self.weighted, self._ids)

    def snapshot(self) -> Graph:
        top = self.events.agg(F.max("ts")).first()[0]
        return self.at(0.0 if top is None else float(top))

    def advance(self, before: float, to: float) -> int:
        """Edges that moving the clock from before to ``to`` removes."""
        if not (abs(before) < float("inf") and abs(to) < float("inf") and to >= before):  # also false for what is no number
            raise ValueError("clock must be finite and not go back")
        seen = self.events.filter(F.col("ts") <= before)
        return episodes(seen, self.width, self.directed).filter((F.col("until") >= before) & (F.col("until") < to)).count()

    def __getattr__(self, name: str):
        if name.startswith(("_", "add", "remove", "update", "clear", "reserve")):
            raise AttributeError(name)
        if self._snapshot is None:
            self._snapshot = self.snapshot()
        return getattr(self._snapshot, name)
