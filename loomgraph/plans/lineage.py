"""Cutting lineage in iterative plans, in the folder the cluster shares."""

from __future__ import annotations

import atexit
import contextlib
import uuid

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see: ``spark.checkpoint.dir``.  Only a local session, as in tests, may go without it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file:///tmp/loomgraph-shared"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once into the shared folder, partition by partition."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


_WRITTEN: list[str] = []


def written(df: DataFrame) -> DataFrame:
    """``df`` computed once into a table in the shared folder, which goes when this driver ends.

    The plan that goes on from it knows the table's true size.  A checkpoint takes its size from the estimates of its plan,
    which joins multiply, so that in a loop they grow beyond all bounds, and with them the cost of planning.
    """
    spark = df.sparkSession
    path = scratch(spark, "table")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch(spark: SparkSession, what: str, suffix: str = "") -> str:
    """A new place in the shared folder; what is there goes when this driver ends."""
    if not _WRITTEN:
        atexit.register(_sweep)
    _WRITTEN.append(f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}{suffix}")
    return _WRITTEN[-1]


def filesystem(url: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a place in the shared folder."""
    for a in ("s3a://", "s3n://"):
        url = url.replace(a, "s3://", 1) if url.startswith(a) else url
    return pafs.FileSystem.from_uri(url if ":" in url else "file://" + url)


def _sweep() -> None:
    for path in _WRITTEN:
        with contextlib.suppress(OSError, ValueError):  # gone, or in a store that only Spark reaches
            fs, at = filesystem(path)
            (fs.delete_dir if fs.get_file_info(at).type == pafs.FileType.Directory else fs.delete_file)(at)
