"""EDGS graph files: a Spark data source that reads by byte range, and writes by byte range under a name that it gives up at the end.

Version 3, little-endian: "EDGS", u16 version, u8 flags (1 directed, 2 weighted), u64 id range, u64 nodes, u64 edges,
then ascending u32 node ids, then edges u32 u, u32 v[, f64 w].  Version 2 has the magic bytes reversed, no id range and no ids.
"""

from __future__ import annotations

import os
import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..operators.graph import EDGES, ID_END, Graph
from ..plans.lineage import cut

HEADS = {b"EDGS": 3, b"SGDE": 2}
BLOCK = 1_000_000


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def header(path: str) -> dict:
    """Layout of a file; RuntimeError if it is not a valid one."""
    fs, at = filesystem(path)
    info = fs.get_file_info(at)
    if info.type != pafs.FileType.File:
        raise RuntimeError(f"cannot open {path}")
    with fs.open_input_file(at) as f:
        head = f.read(31)
    if len(head) < 7 or head[:4] not in HEADS:
        raise RuntimeError("bad magic" if len(head) >= 4 else "truncated file")
    version, flags = struct.unpack_from("<HB", head, 4)
    if version not in (2, 3):
        raise RuntimeError(f"unsupported version {version}")
    if flags > 3:
        raise RuntimeError("unknown flags")
    start = 31 if version == 3 else 23
    if len(head) < start:
        raise RuntimeError("truncated file")
    ids, nodes, edges = struct.unpack_from("<QQQ", head, 7) if version == 3 else (0, *struct.unpack_from("<QQ", head, 7))
    listed = nodes if version == 3 else 0
    if ids > ID_END or version == 3 and nodes > ids:
        raise RuntimeError("bad node counts")
    size = 16 if flags & 2 else 8
    end = start + 4 * listed + size * edges
    if end != info.size:
        raise RuntimeError("truncated file" if end > info.size else "trailing data")
    return {"version": version, "directed": bool(flags & 1), "weighted": bool(flags & 2), "n_ids": ids, "nodes": nodes, "edges": edges, "start": start, "first_edge": start + 4 * listed, "size": size}


class Range(InputPartition):
    def __init__(self, kind: str, lo: int, hi: int):
        super().__init__((kind, lo, hi))
        self.kind, self.lo, self.hi = kind, lo, hi


class EdgsReader(DataSourceReader):
    def __init__(self, path: str, kind: str):
        self.path, self.kind, self.head = path, kind, header(path)

    def partitions(self):
        n = self.head["edges"] if self.kind == "edges" else self.head["nodes"] if self.head["version"] == 3 else 0
        return [Range(self.kind, k, min(n, k + BLOCK)) for k in range(0, n, BLOCK)] or [Range(self.kind, 0, 0)]

    def read(self, partition):
        fs, at = filesystem(self.path)
        h = self.head
        size, base = (h["size"], h["first_edge"]) if partition.kind == "edges" else (4, h["start"])
        with fs.open_input_file(at) as f:
            f.seek(base + size * partition.lo)
            data = f.read(size * (partition.hi - partition.lo))
        if partition.kind == "nodes":
            ids = np.frombuffer(data, "<u4")
            if partition.lo:  # the border with the part before
                with fs.open_input_file(at) as f:
                    f.seek(base + size * (partition.lo - 1))
                    ids = np.r_[np.frombuffer(f.read(size), "<u4"), ids]
            if (ids[1:] <= ids[:-1]).any():
                raise RuntimeError("bad touched list")
            ids = ids[1:] if partition.lo else ids
            yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int64))], ["id"])
            return
        rows = np.frombuffer(data, np.dtype([("u", "<u4"), ("v", "<u4")] + ([("w", "<f8")] if h["weighted"] else [])))
        w = rows["w"] if h["weighted"] else np.ones(len(rows))
        yield pa.RecordBatch.from_arrays([pa.array(rows["u"].astype(np.int64)), pa.array(rows["v"].astype(np.int64)), pa.array(w.astype(np.float64))], ["u", "v", "w"])


class EdgsSource(DataSource):
    """spark.read.format("edgs").option("part", "edges" or "nodes").load(path)"""

    @classmethod
    def name(cls):
        return "edgs"

    def schema(self):
        return EDGES if self.options.get("part", "edges") == "edges" else "id long"

    def reader(self, schema):
        return EdgsReader(self.options["path"], self.options.get("part", "edges"))

    def writer(self, schema, overwrite):
        return EdgsWriter(self.options["path"])


def load(spark: SparkSession, path: str) -> Graph:
    h = header(path)
    spark.dataSource.register(EdgsSource)
    edges = spark.read.format("edgs").option("part", "edges").load(path)
    if not h["directed"]:
        edges = edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "w")
    edges = cut(edges)  # the file is read once, and what was checked is what is used
    wrong = edges.groupBy("u", "v").agg(F.count(F.lit(1)).alias("n"), F.max("w").alias("hi"), F.min("w").alias("lo")).filter("n > 1 OR u = v OR NOT (lo > 0 AND hi < double('Infinity') AND NOT isnan(hi))")
    if not wrong.isEmpty():
        raise RuntimeError("invalid or duplicate edge")
    ends = edges.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    if h["version"] == 2:
        return Graph(edges, ends, h["directed"], h["weighted"], 0)
    nodes = spark.read.format("edgs").option("part", "nodes").load(path)
    try:
        nodes = cut(nodes)
        got = nodes.agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("top")).first()
    except Exception as e:
        if "bad touched list" in str(e):
            raise RuntimeError("bad touched list") from None
        raise
    if got.n != h["nodes"] or (got.top is not None and got.top >= h["n_ids"]):
        raise RuntimeError("bad touched list")
    if h["n_ids"] and not edges.filter((F.col("u") >= h["n_ids"]) | (F.col("v") >= h["n_ids"])).isEmpty():
        raise RuntimeError("invalid edge")
    if not ends.join(nodes, "id", "left_anti").isEmpty():
        raise RuntimeError("edge on an untouched node")
    return Graph(edges, nodes, h["directed"], h["weighted"], h["n_ids"])


class EdgsWriter(DataSourceArrowWriter):
    """Writes rows (at, data) into a file that is there in its full length: each task its own ranges, the same ones if it is
    repeated.  The file gets its name when all tasks are done.  Where a store has no writing within a file, the ranges are
    files named by their place, which ``composed`` joins."""

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator):
        fs, at = filesystem(self.path)
        n = 0
        if isinstance(fs, pafs.LocalFileSystem):
            with open(f"{at}.tmp", "r+b") as f:
                for batch in iterator:
                    for place, data in zip(*(batch.column(k).to_pylist() for k in range(2)), strict=True):
                        f.seek(place)
                        n += f.write(data)
            return Wrote(n)
        for batch in iterator:
            for place, data in zip(*(batch.column(k).to_pylist() for k in range(2)), strict=True):
                with fs.open_output_stream(f"{at}.parts/{place:020d}") as f:
                    f.write(data)
                n += len(data)
        return Wrote(n)

    def commit(self, messages):
        fs, at = filesystem(self.path)
        if isinstance(fs, pafs.LocalFileSystem):
            fs.move(f"{at}.tmp", at)

    def abort(self, messages):
        fs, at = filesystem(self.path)
        if fs.get_file_info(f"{at}.tmp").type == pafs.FileType.File:
            fs.delete_file(f"{at}.tmp")


@dataclass
class Wrote(WriterCommitMessage):
    n: int


def composed(spark: SparkSession, path: str) -> None:
    """Joins the ranges that a store without writing within files holds as files; one task streams them."""

    def run(batches):
        for _ in batches:
            pass
        fs, at = filesystem(path)
        found = sorted(x.path for x in fs.get_file_info(pafs.FileSelector(f"{at}.parts")))
        with fs.open_output_stream(f"{at}.tmp") as out:
            for x in found:
                with fs.open_input_stream(x, compression=None) as f:
                    while data := f.read(1 << 22):
                        out.write(data)
        fs.move(f"{at}.tmp", at)
        fs.delete_dir(f"{at}.parts")
        yield pa.record_batch({"n": pa.array([len(found)], pa.int64())})

    spark.range(1).coalesce(1).mapInArrow(run, "n long").collect()


def save(graph: Graph, path: str) -> None:
    """Tasks sort and encode ranges of rows and write them to their places: records have one width, so the number of rows in
    each partition says where it begins.  The driver writes the head and gives the file its name."""
    spark = graph.spark
    fs, at = filesystem(path)
    edges = cut(graph.edge_list().withColumn("part", F.spark_partition_id()))
    nodes = cut(graph.nodes().withColumn("part", F.spark_partition_id()))
    kind = np.dtype([("u", "<u4"), ("v", "<u4")] + ([("w", "<f8")] if graph.weighted else []))
    starts, n, m, base = [], 0, 0, 4 + struct.calcsize("<HBQQQ")
    for rows, size in ((nodes, 4), (edges, kind.itemsize)):
        here, total = {}, 0
        for r in sorted(rows.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: r.part):  # one row for each partition
            here[r.part] = base
            base, total = base + r.n * size, total + r.n
        starts.append(here)
        n, m = m, total
    top = nodes.agg(F.max("id")).first()[0]
    n_ids = max(graph.base_ids, graph.reserved, 0 if top is None else top + 1)
    head = b"EDGS" + struct.pack("<HBQQQ", 3, graph.directed | graph.weighted << 1, n_ids, n, m)

    def encoded(kind: np.dtype, begins: dict[int, int]):
        def run(batches):
            place = None
            for b in batches:
                if not b.num_rows:
                    continue
                rows = np.empty(b.num_rows, kind)
                for name in kind.names:
                    rows[name] = b.column(b.schema.get_field_index(name)).to_numpy()
                place = begins[b.column(b.schema.get_field_index("part"))[0].as_py()] if place is None else place
                yield pa.record_batch({"at": pa.array([place], pa.int64()), "data": pa.array([rows.tobytes()], pa.binary())})
                place += rows.nbytes

        return run

    local = isinstance(fs, pafs.LocalFileSystem)
    with fs.open_output_stream(f"{at}.tmp" if local else f"{at}.parts/{0:020d}") as f:
        f.write(head)
    if local:
        os.truncate(f"{at}.tmp", base)
    spark.dataSource.register(EdgsSource)
    data = nodes.mapInArrow(encoded(np.dtype([("id", "<u4")]), starts[0]), "at long, data binary").union(edges.mapInArrow(encoded(kind, starts[1]), "at long, data binary"))
    data.write.format("edgs").mode("append").save(path)
    if not local:
        composed(spark, path)


def save_parquet(graph: Graph, path: str) -> None:
    """Edges, nodes and flags as Parquet folders, for graphs that no single file should hold."""
    graph.edges.write.mode("overwrite").parquet(f"{path}/edges")
    graph.touched.write.mode("overwrite").parquet(f"{path}/nodes")
    graph.spark.createDataFrame([(graph.directed, graph.weighted, graph.n_ids())], "directed boolean, weighted boolean, n_ids long").write.mode("overwrite").parquet(f"{path}/meta")


def load_parquet(spark: SparkSession, path: str) -> Graph:
    m = spark.read.parquet(f"{path}/meta").first()
    return Graph(spark.read.parquet(f"{path}/edges"), spark.read.parquet(f"{path}/nodes"), m.directed, m.weighted, m.n_ids)
