"""Running degrees and strengths of an edge stream, in keyed state.

Each node keeps its neighbours in map state (one entry each, so a hub's are never read as a whole) and its degree and
strength in value state.  Both ends of an edge see the same rows, so each decides by itself what a row changes.  With a
width, an edge lives that long after it was last seen, and a timer of the node ends it.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

DEGREES = "id long, seq long, degree long, strength double"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Neighbours(StatefulProcessor):
    def __init__(self, width_ms: int | None):
        self.width_ms = width_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.near = handle.getMapState("near", "other long", "w double, until long")
        self.due = handle.getMapState("due", "at long, other long", "here boolean")
        self.total = handle.getValueState("total", "degree long, strength double, seq long")

    def _told(self, key, degree: int, strength: float, seq: int) -> Iterator[Row]:
        strength = strength if degree else 0.0
        self.total.update((degree, strength, seq))
        yield Row(id=key[0], seq=seq, degree=degree, strength=strength)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        degree, strength, seq = self.total.get() if self.total.exists() else (0, 0.0, -1)
        for r in sorted(rows, key=lambda r: r.seq):  # a micro-batch's rows of one node
            at = (r.other,)
            known = self.near.getValue(at) if self.near.containsKey(at) else None
            seq = max(seq, r.seq)
            if r.op == "remove":
                if known is not None:
                    self.near.removeKey(at)
                    degree, strength = degree - 1, strength - known[0]
                continue
            if r.op == "update" and known is None:
                continue
            until = 0
            if self.width_ms is not None:
                until = r.ts_ms + self.width_ms
                self.due.updateValue((until, r.other), (True,))
                self.handle.registerTimer(until + 1)
            elif known is not None and r.op == "add":
                continue  # it is there, and keeps its weight
            degree, strength = degree + (known is None), strength + r.w - (known[0] if known is not None else 0.0)
            self.near.updateValue(at, (r.w, until))
        yield from self._told(key, degree, strength, seq)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        degree, strength, seq = self.total.get()
        now, gone, before = expiredTimerInfo.getExpiryTimeInMs(), [], degree
        for at, other in self.due.keys():
            if at < now:
                gone.append((at, other))
        for at, other in gone:
            self.due.removeKey((at, other))
            known = self.near.getValue((other,)) if self.near.containsKey((other,)) else None
            if known is not None and known[1] == at:  # not seen since
                self.near.removeKey((other,))
                degree, strength = degree - 1, strength - known[0]
        if degree < before:
            yield from self._told(key, degree, strength, seq)

    def close(self) -> None:
        pass


def running_degrees(log: DataFrame, width_s: float | None = None, delay: str = "0 seconds") -> DataFrame:
    """(id, seq, degree, strength): the state of each node that a micro-batch or a timer changes; write with output mode update.

    Of several rows of a node in one batch the last one holds.

    log: a stream of (seq, op, u, v, w) with op add, remove or update; adding an edge that is there changes nothing.
    With ``width_s`` it has a column ts (timestamp) besides; adding an edge again restarts its time and replaces its weight,
    and edges not seen for width_s before the watermark go.  Self-loops are ignored.
    """
    spark = log.sparkSession
    if "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass", ""):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    if width_s is not None:
        if not 0 < width_s < float("inf"):
            raise ValueError("window must be finite and positive")
        log = log.withWatermark("ts", delay)
    ms = F.unix_millis("ts") if width_s is not None else F.lit(0).cast("long")
    far = lambda a, b: F.struct(F.col(a).alias("id"), F.col(b).alias("other"))
    kept = ["seq", "op", F.coalesce(F.col("w").cast("double"), F.lit(1.0)).alias("w"), ms.alias("ts_ms"), *(["ts"] if width_s is not None else [])]
    ends = log.filter("u <> v AND op IN ('add', 'remove', 'update')").select(F.explode(F.array(far("u", "v"), far("v", "u"))).alias("e"), *kept)
    keyed = ends.select("e.id", "e.other", "seq", "op", "w", "ts_ms", *(["ts"] if width_s is not None else [])).groupBy("id")
    width = None if width_s is None else int(width_s * 1000)
    return keyed.transformWithState(Neighbours(width), DEGREES, "Update", "None" if width is None else "EventTime")
