"""An undirected graph maintained from a log stream, at a cost that follows the change and not the graph.

Each micro-batch k writes what it changes, and only that, under ``batch=k``: edges (both directions, so that either end
finds them), nodes touched for the first time, components that became one, components that may have come apart, and
triangles won or lost by node.  The state before a batch is looked up for the batch's own nodes; tables lie in BUCKETS
folders by owner, of which a batch reads those that its nodes fall into.  A repeated batch replaces what it wrote, and reads
only earlier ones.  A clear makes readers start at its batch.

Components.  A node's label is its own id until a row says otherwise.  The edges of a batch are contracted to the labels of
their ends, and components of that graph, which is not larger than the batch, give rows (label, new label).  Labels follow
those rows, each at most as far as batches have renamed them.  A removal may split a component, so it is marked as stale;
``refresh`` labels the nodes of stale components anew and leaves the others.

Triangles.  Those won have a new edge and lie in the graph after the batch; those lost have a removed edge and lie in the
one before.  Both are listed from the changed edges, starting at the end with fewer neighbours, so a hub on the other end
is only asked whether it has these neighbours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.components import component_labels
from ..operators.log import lifetimes, touches, with_spans
from ..plans.lineage import written

BUCKETS = 32
SHAPES = {
    "edges": "a long, b long, w double, alive boolean",
    "nodes": "a long",
    "merges": "a long, to long",
    "labels": "a long, label long",
    "stale": "a long",
    "triangles": "a long, by long",
    "marks": "a long, cleared boolean, refreshed boolean",
}


def _bucket(col: str = "a"):
    return F.pmod(F.hash(col), F.lit(BUCKETS)).cast("int").alias("bucket")


def maintain_changes(log: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Applies the rows (seq, op, u, v, w) of a log stream; read the graph by Changes(spark, path)."""
    return log.writeStream.foreachBatch(lambda batch, k: Changes(batch.sparkSession, path).apply(batch, k)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


class Changes:
    """The graph in a folder, after the batches before ``before`` (all: None)."""

    def __init__(self, spark: SparkSession, path: str, before: int | None = None):
        self.spark, self.path, self.before = spark, path.rstrip("/"), before
        told = self._all("marks").agg(F.coalesce(F.max(F.when(F.col("cleared"), F.col("batch"))), F.lit(0)).alias("since"), F.coalesce(F.max(F.when(F.col("refreshed"), F.col("batch"))), F.lit(-1)).alias("fresh"), F.max("batch").alias("last")).first()
        self.since, self.fresh, self.last = told.since, max(told.fresh, told.since - 1), told.last

    def _all(self, name: str) -> DataFrame:
        shape = f"{SHAPES[name]}, batch int, bucket int"
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], shape)
        rows = self.spark.read.schema(shape).parquet(f"{self.path}/{name}")
        return rows if self.before is None else rows.filter(F.col("batch") < self.before)

    def rows(self, name: str, owners: DataFrame | None = None) -> DataFrame:
        """Rows since the last clear, of these owners(a) only if given."""
        found = self._all(name).filter(F.col("batch") >= self.since)
        if owners is None:
            return found
        here = [r.bucket for r in owners.select(_bucket()).distinct().collect()]  # at most BUCKETS
        return found.filter(F.col("bucket").isin(here)).join(owners, "a", "left_semi")

    def _write(self, name: str, rows: DataFrame, k: int) -> None:
        rows.withColumn("bucket", _bucket()).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{name}/batch={k}")

    # reading

    def arcs(self, owners: DataFrame | None = None) -> DataFrame:
        """(a, b, w): every edge in both directions, of these owners only if given."""
        last = self.rows("edges", owners).groupBy("a", "b").agg(F.max_by(F.struct("alive", "w"), "batch").alias("s"))
        return last.filter("s.alive").select("a", "b", "s.w")

    def edges(self) -> DataFrame:
        return self.arcs().filter("a < b").select(F.col("a").alias("u"), F.col("b").alias("v"), "w")

    def nodes(self) -> DataFrame:
        return self.rows("nodes").select(F.col("a").alias("id"))

    def roots(self, ids: DataFrame) -> DataFrame:
        """(a, root) for ids(a): labels followed to where no later batch has renamed them."""
        known = self.rows("labels", ids).groupBy("a").agg(F.max_by("label", "batch").alias("label"), F.max("batch").alias("at"))
        now = written(ids.join(known, "a", "left").select("a", F.coalesce("label", "a").alias("root"), F.coalesce("at", F.lit(-1)).alias("at")))
        while True:
            owners = now.select(F.col("root").alias("a")).distinct()
            later = self.rows("merges", owners).select(F.col("a").alias("root"), "to", F.col("batch").alias("then"))
            told = now.join(later, "root").filter("then > at").groupBy("a").agg(F.min_by(F.struct("to", "then"), "then").alias("s"))
            told = written(told)
            if told.isEmpty():
                return now.select("a", "root")
            now = written(now.join(told, "a", "left").select("a", F.coalesce("s.to", "root").alias("root"), F.coalesce("s.then", "at").alias("at")))

    def component_ids(self) -> DataFrame:
        """(id, component_id): the smallest id of the component; stale components are labelled anew first."""
        self.refresh()
        return self.roots(self.rows("nodes").select("a")).select(F.col("a").alias("id"), F.col("root").alias("component_id"))

    def local_triangles(self) -> DataFrame:
        """(id, triangles) of the nodes that lie in any."""
        return self.rows("triangles").groupBy(F.col("a").alias("id")).agg(F.sum("by").alias("triangles")).filter("triangles > 0")

    def n_triangles(self) -> int:
        return (self.rows("triangles").agg(F.sum("by")).first()[0] or 0) // 3

    # changing

    def refresh(self) -> None:
        """Labels the nodes of stale components anew."""
        stale = self.rows("stale").filter(F.col("batch") > self.fresh).select("a").distinct()
        if self.last is None or stale.isEmpty():
            return
        gone = self.roots(stale).select("root").distinct()
        inside = written(self.roots(self.rows("nodes").select("a")).join(gone, "root", "left_semi").select("a"))
        ends = self.arcs(inside).filter("a < b").select(F.col("a").alias("u"), F.col("b").alias("v"))
        found = component_labels(ends).select(F.col("id").alias("a"), F.col("component_id").alias("label"))
        self._write("labels", inside.join(found, "a", "left").select("a", F.coalesce("label", "a").alias("label")), self.last)
        self._mark(self.last, self.since == self.last and self._cleared(), True)
        self.fresh = self.last

    def _cleared(self) -> bool:
        return not self._all("marks").filter(F.col("cleared") & (F.col("batch") == self.last)).isEmpty()

    def _mark(self, k: int, cleared: bool, refreshed: bool) -> None:
        self._write("marks", self.spark.createDataFrame([(0, cleared, refreshed)], SHAPES["marks"]), k)

    def apply(self, batch: DataFrame, k: int) -> None:
        """Carries out the rows of one batch."""
        rows = written(batch.select("seq", "op", F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"), F.col("w").cast("double").alias("w")))
        cleared = not rows.filter("op = 'clear'").isEmpty()
        old = Changes(self.spark, self.path, k)
        if cleared:
            old.since = k  # nothing before is left
        pairs = rows.filter("op IN ('add', 'remove', 'update') AND u <> v").select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()
        near = written(old.arcs(pairs.select("a").distinct()).join(pairs, ["a", "b"], "left_semi"))
        before = near.select(F.col("a").alias("u"), F.col("b").alias("v"), "w")
        known = before.select(F.lit(-1).cast("long").alias("seq"), F.lit("add").alias("op"), "u", "v", "w")
        spans = written(with_spans(rows.unionByName(known)))
        after = lifetimes(spans).filter("died IS NULL").select("u", "v", F.col("weight").alias("x"))
        both = before.join(after, ["u", "v"], "full").filter("w IS NULL OR x IS NULL OR w <> x")
        moved = written(both.select("u", "v", "w", "x"))
        ends = F.explode(F.array(F.struct(F.col("u").alias("a"), F.col("v").alias("b")), F.struct(F.col("v").alias("a"), F.col("u").alias("b"))))
        self._write("edges", moved.select(ends.alias("e"), "x").select("e.a", "e.b", F.coalesce("x", F.lit(0.0)).alias("w"), F.col("x").isNotNull().alias("alive")), k)
        won, lost = moved.filter("w IS NULL").select("u", "v"), moved.filter("x IS NULL").select("u", "v")
        met = touches(spans, self._met(spans)).filter("until IS NULL AND seq >= 0").select(F.col("id").alias("a")).distinct()
        self._write("nodes", met.join(old.rows("nodes", met).select("a"), "a", "left_anti"), k)
        self._components(old, won, lost, k)
        self._triangles(old, won, lost, k)
        self._mark(k, cleared, False)

    def _met(self, spans: DataFrame) -> DataFrame:
        """Additions that touch nodes: all but those of edges that are there already touch them for the first time or again."""
        return spans.filter("op = 'add' AND u <> v AND seq >= 0")

    def _components(self, old: Changes, won: DataFrame, lost: DataFrame, k: int) -> None:
        ids = written(won.union(lost).select(F.explode(F.array("u", "v")).alias("a")).distinct())
        root = written(old.roots(ids))
        a, b = root.select(F.col("a").alias("u"), F.col("root").alias("ru")), root.select(F.col("a").alias("v"), F.col("root").alias("rv"))
        joined = component_labels(won.join(a, "u").join(b, "v").filter("ru <> rv"), "ru", "rv").filter("id <> component_id")
        joined = written(joined.select(F.col("id").alias("a"), F.col("component_id").alias("to")))
        self._write("merges", joined, k)
        split = lost.join(a, "u").select(F.col("ru").alias("a")).distinct()
        self._write("stale", split.join(joined, "a", "left").select(F.coalesce("to", "a").alias("a")).distinct(), k)

    def _triangles(self, old: Changes, won: DataFrame, lost: DataFrame, k: int) -> None:
        ids = written(won.union(lost).select(F.explode(F.array("u", "v")).alias("a")).distinct())
        there = written(old.arcs(ids).select("a", "b"))
        sides = lambda e: e.select("u", "v").union(e.select("v", "u")).toDF("a", "b")
        then = written(there.join(sides(lost), ["a", "b"], "left_anti").union(sides(won)))
        up, down = _closed(won, then), _closed(lost, there)
        by = up.withColumn("by", F.lit(1).cast("long")).union(down.withColumn("by", F.lit(-1).cast("long")))
        corner = by.select(F.explode(F.array("x", "y", "z")).alias("a"), "by").groupBy("a").agg(F.sum("by").alias("by")).filter("by <> 0")
        self._write("triangles", corner, k)


def _closed(changed: DataFrame, arcs: DataFrame) -> DataFrame:
    """(x, y, z): each triangle once that has an edge of changed(u, v) and else edges of arcs(a, b), which hold all of its ends."""
    degree = arcs.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    sized = changed.join(degree.select(F.col("a").alias("u"), F.col("n").alias("nu")), "u").join(degree.select(F.col("a").alias("v"), F.col("n").alias("nv")), "v")
    few, many = F.when(F.col("nu") <= F.col("nv"), F.col("u")).otherwise(F.col("v")), F.when(F.col("nu") <= F.col("nv"), F.col("v")).otherwise(F.col("u"))
    third = sized.select(few.alias("a"), many.alias("t")).join(arcs, "a").filter("b <> t").select(F.col("a").alias("s"), F.col("t").alias("a"), "b")
    closed = third.join(arcs, ["a", "b"], "left_semi")
    return closed.select(F.array_sort(F.array("s", "a", "b")).alias("t")).distinct().select(F.col("t")[0].alias("x"), F.col("t")[1].alias("y"), F.col("t")[2].alias("z"))
