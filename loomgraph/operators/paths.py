"""Distances from many sources at once, as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..plans.lineage import written

#: Tables of rounds that a plan reads before they become one.
KEPT = 16

def levels(arcs: DataFrame, sources: DataFrame) -> DataFrame:
    """(s, v, d): number of arcs from each of sources(s) to the nodes it reaches; a round for each level."""
    far = front = written(sources.select("s", F.col("s").alias("v"), F.lit(0.0).alias("d")))
    d = 0.0
    while not front.isEmpty():
        d += 1
        met = front.join(arcs.select(F.col("u").alias("v"), F.col("v").alias("to")), "v").select("s", F.col("to").alias("v")).distinct()
        front = written(met.join(far.select("s", "v"), ["s", "v"], "left_anti").withColumn("d", F.lit(d)))
        far = far.union(front)
        if d % KEPT == 0:
            far = written(far)
    return far


def distances(arcs: DataFrame, sources: DataFrame, delta: float | None = None) -> DataFrame:
    """(s, v, d): least sum of w along arcs(u, v, w), w > 0, from each of sources(s) to the nodes it reaches.

    Distances lie in buckets of width delta.  Each source settles its own lowest bucket: arcs no longer than delta are
    followed until the bucket stands still, then the longer ones, once, as they lead out of it.  So what is far away is not
    spread before it is final, as it would be if all that improved went on.  A round is one job for all sources.  The
    width changes the number of rounds, not the result; by default it is the mean weight over half the mean number of arcs
    of a node.  An equal distance in other summation order can differ in its last bits.
    """
    if delta is not None and not 0 < delta < float("inf"):
        raise ValueError("delta must be finite and positive")
    if delta is None:
        told = arcs.agg(F.avg("w").alias("w"), F.count(F.lit(1)).alias("n"), F.count_distinct("u").alias("u")).first()
        delta = 2 * told.w * told.u / told.n if told.n else 1.0
    step = arcs.select(F.col("u").alias("v"), F.col("v").alias("to"), "w")
    light, heavy = written(step.filter(F.col("w") <= delta)), written(step.filter(F.col("w") > delta))
    far = written(sources.select("s", F.col("s").alias("v"), F.lit(0.0).alias("d"), F.lit(True).alias("open"), F.lit(False).alias("done")))
    left, bucket = far.count(), F.rint(F.col("d") / delta)
    while left:
        lowest = far.filter("NOT done").groupBy("s").agg(F.min(F.struct(bucket.alias("at"), F.when(F.col("open"), 0).otherwise(1).alias("turn"))).alias("lowest"))
        now = far.join(lowest.select("s", "lowest.*"), "s", "left").withColumn("here", F.coalesce(~F.col("done") & (bucket == F.col("at")), F.lit(False)))
        spread = lambda by, turn: now.filter(F.col("here") & (F.col("turn") == turn) & (F.col("open") | F.lit(turn == 1))).join(by, "v").select("s", "to", (F.col("d") + F.col("w")).alias("new"))
        told = spread(light, 0).union(spread(heavy, 1)).groupBy("s", F.col("to").alias("v")).agg(F.min("new").alias("new"))
        moved = F.coalesce(F.col("new") < F.col("d"), F.col("d").isNull())
        here = F.coalesce("here", F.lit(False))
        both = now.join(told, ["s", "v"], "full").select(
            "s",
            "v",
            F.least("d", "new").alias("d"),
            (moved | (F.col("open") & ~(here & (F.col("turn") == 0)))).alias("open"),
            (~moved & (F.col("done") | (here & (F.col("turn") == 1)))).alias("done"),
        )
        seen = Observation()
        far = written(both.observe(seen, F.count_if(~F.col("done")).alias("left")))
        left = seen.get["left"]
    return far.select("s", "v", "d")
