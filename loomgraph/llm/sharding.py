"""Sharding by extendible hashing: a directory over hash-prefix bits, in which only oversized buckets split.

A row's hash is the first 60 bits of the MD5 of its key as text, so SQL engines agree on it.  A shard is a bit prefix: the
shortest one whose rows are within the byte limit together, or are one row.

BITS levels of the directory are found at a time: bytes per next BITS bits are summed (partially aggregated), and
each open bucket's at most 2**BITS sums decide where its sub-buckets stop splitting.  Rows of buckets that are still
too large go on to the next BITS bits.  Only (key, hash, size) moves for that, never a text.  The directory is a table
for each level, whose first (2**BITS rows) is broadcast; later ones are joined by prefix, and Spark broadcasts them only
below its own threshold.  Nothing is collected.  Writing moves each row once, to its shard.

Defined results: the size of a row counts the bytes of all its text and binary columns (null: 0), those of its nested columns
as JSON (null: 0), and 8 for each other one; where the table has a column named shard, folders and the column of read_shards
are named shard_1 (shard_2, ..., the first free name), and its own column is written as it is; an id column must not have
the name of a result column (ValueError);
a row larger than the limit is a shard by itself, marked oversized; repeated or null ids are rows of their own, and their
hash is that of the row's number; rows that agree in all 60 bits stay together; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import RID, cut, keyed

BITS, DIGITS = 12, 15
_SHARD, _SIZE = "__lg_shard", "__lg_size"


def leaf_depths(size: np.ndarray, rows: np.ndarray, limit: int) -> np.ndarray:
    """For each of a power of two of buckets the depth at which its prefix fits, or -1."""
    out = np.full(len(size), -1, np.int64)
    for depth in range(len(size).bit_length() - 1, -1, -1):
        s, n = (a.reshape(1 << depth, -1).sum(1) for a in (size, rows))
        fits = np.repeat((s <= limit) | (n <= 1), len(size) >> depth)
        out[fits] = depth
    return out


def row_bytes(df: DataFrame) -> Column:
    """The size of a row, as the limit counts it."""
    total = F.lit(0).cast("long")
    for f in df.schema.fields:
        col = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.ArrayType | T.MapType | T.StructType):
            size = F.when(col.isNotNull(), F.octet_length(F.to_json(F.struct(col.alias("v")))))
        else:
            size = F.octet_length(col) if isinstance(f.dataType, T.StringType | T.BinaryType) else F.lit(8)
        total = total + F.coalesce(size, F.lit(0))
    return total


def shard_column(df: DataFrame) -> str:
    """The name of the column of shards beside those of df."""
    taken = {c.lower() for c in df.columns}
    return next(n for n in ("shard", *(f"shard_{k}" for k in range(1, len(taken) + 2))) if n not in taken)


def _checked(limit_bytes: int, id_col: str) -> None:
    if limit_bytes < 1:
        raise ValueError("limit_bytes must be positive")
    if id_col.lower() in ("shard", "depth", "n_bytes", "oversized"):
        raise ValueError(f"the id column must not be named {id_col}")


def bits_of(key: str = RID) -> Column:
    """The hash of a row as text of 60 bits."""
    number = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, DIGITS), 16, 2)
    return F.lpad(number, 4 * DIGITS, "0")


def _splitter(limit: int, bits: int):
    def directory(key, part):
        size, rows = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64)
        at = np.array([int(x, 2) for x in part["sub"]], np.int64)
        size[at], rows[at] = part["bytes"], part["rows"]
        return pd.DataFrame({"prefix": key[0], "sub": part["sub"], "leaf": leaf_depths(size, rows, limit)[at]})

    return directory


def _directory(rows: DataFrame, limit: int) -> list[DataFrame]:
    """Per level of BITS bits, (prefix, sub, leaf): the depth below prefix at which sub stops splitting, or -1."""
    live = cut(rows.select(bits_of().alias("bits"), F.col(_SIZE).alias("size")))
    levels: list[DataFrame] = []
    while len(levels) < 4 * DIGITS // BITS:
        done = BITS * len(levels)
        tagged = live.withColumns({"prefix": F.substring("bits", 1, done) if done else F.lit(""), "sub": F.substring("bits", done + 1, BITS)})
        sums = tagged.groupBy("prefix", "sub").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
        levels.append(cut(sums.groupBy("prefix").applyInPandas(_splitter(limit, BITS), "prefix string, sub string, leaf long")))
        still = levels[-1].filter("leaf < 0")
        if still.isEmpty():
            break
        live = cut(tagged.join(still, ["prefix", "sub"], "left_semi").select("bits", "size"))
    return levels


def _sharded(rows: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """Rows with their shard; texts stay where they are while the directory is small."""
    out = rows.withColumn("_bits", bits_of()).withColumn(_SHARD, F.lit(None).cast("string"))
    for k, leaves in enumerate(levels):
        done, last = BITS * k, k == len(levels) - 1
        told = leaves.select(F.concat("prefix", "sub").alias("_at"), "leaf")
        out = out.withColumn("_at", F.substring("_bits", 1, done + BITS)).join(F.broadcast(told) if k == 0 else told, "_at", "left")
        depth = F.when(F.col("leaf") >= 0, F.col("leaf") + done)
        if last:  # all bits are used
            depth = F.coalesce(depth, F.when(F.col("leaf").isNotNull(), F.lit(done + BITS)))
        out = out.withColumn(_SHARD, F.coalesce(_SHARD, F.substring("_bits", F.lit(1), depth.cast("int")))).drop("_at", "leaf")
    return out.drop("_bits")


def _told(sharded: DataFrame, id_col: str, limit: int) -> DataFrame:
    depth = F.length(_SHARD).alias("depth")
    return sharded.select(F.col(id_col), F.col(_SHARD).alias("shard"), depth, F.col(_SIZE).alias("n_bytes"), (F.col(_SIZE) > limit).alias("oversized"))


def assign_shards(docs: DataFrame, limit_bytes: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, shard string of bits, depth int, n_bytes long, oversized boolean)."""
    _checked(limit_bytes, id_col)
    rows, _ = keyed(docs.withColumn(_SIZE, row_bytes(docs)), id_col, text_col)
    slim = rows.select(RID, id_col, _SIZE)
    return _told(_sharded(slim, _directory(slim, limit_bytes)), id_col, limit_bytes)


def write_shards(docs: DataFrame, path: str, limit_bytes: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes all rows of docs as Parquet, one folder (its name is shard_column's and the bits) for each shard; returns the assignment."""
    _checked(limit_bytes, id_col)
    rows, _ = keyed(docs.withColumn(_SIZE, row_bytes(docs)), id_col, text_col)
    slim = rows.select(RID, id_col, _SIZE)
    levels = _directory(slim, limit_bytes)
    name = shard_column(docs)
    placed = _sharded(rows, levels).select(*docs.columns, F.col(_SHARD).alias(name))
    placed.repartition(name).write.partitionBy(name).mode("overwrite").parquet(path)
    return _told(_sharded(slim, levels), id_col, limit_bytes)


def read_shards(docs: DataFrame, path: str) -> DataFrame:
    """The rows written of docs, with their shard in the column that shard_column names."""
    name = shard_column(docs)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.StringType())])
    back = docs.sparkSession.read.schema(schema).parquet(path)
    return back.withColumn(name, F.coalesce(name, F.lit("")))
