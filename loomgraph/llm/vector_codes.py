"""Compression of vectors to product codes in exact integers.

Each component x becomes floor(scale * x).  A vector is cut into equal parts, and each part position has a codebook of its
own: it starts with that part of the vectors of the smallest ids, and each round assigns every part of every vector to
its nearest entry and moves each entry to the floor of its parts' mean.  All rows take part in every round.

A task reads its rows once a round and sends sums and counts for each entry (as many numbers as the codebooks hold,
whatever the input), so a shuffle moves those and no vectors, a label or a group of equal vectors that holds a third of
all rows is no hot key, and the driver sees the sums of all tasks only as one row for each number of the codebooks.

The nearest entry is found by partial distances: dimensions go in descending variance of the codebook; the entry that
leads after the first ones is measured in full, and after each further dimension a mask drops what has strictly exceeded
that distance.  So ties survive, and the lowest index wins them.

Defined results: a null vector, or one with a null or non-finite component, is dropped.  The commonest length among the
rest (the longest of several) is that of the codebooks.  A vector of another length, or with a component so large that
squared distances might not fit 64 bits (|scale * x| > 2^30.5 / sqrt(length)), stays, with null code and error, and takes
no part in learning.  Fewer vectors than entries give as many entries as vectors.  Null ids come last, equal ids go by
vector.  Equal rows are all returned.  Labels may be null; these are one label.  An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, cut

OUT = ("code", "error", "label_error", "codebooks_sha256")
#: Vectors that are measured at a time.
BLOCK = 4_096
#: Dimensions that each entry is measured in before any is dropped.
LEAD = 2


def by_variance(book: np.ndarray) -> np.ndarray:
    """Dimensions of a codebook (entries x dimensions) in descending variance, the lower first of equal ones."""
    return np.argsort(-book.astype(float).var(axis=0), kind="stable")


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest entry, squared distance) of each row of x; ties to the lower index."""
    n, d = x.shape
    if not n or not d:
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    order = by_variance(book)
    x, book = np.ascontiguousarray(x[:, order].T), np.ascontiguousarray(book[:, order].T)
    lead = min(LEAD, d)
    run = np.zeros((n, book.shape[1]), np.int64)
    for j in range(lead):
        run += np.square(x[j][:, None] - book[j][None, :])
    guess = run.argmin(axis=1)
    best = run[np.arange(n), guess]
    for j in range(lead, d):
        best += np.square(x[j] - book[j][guess])
    row, entry = np.nonzero(run <= best[:, None])  # by row, then entry
    run = run[row, entry]
    for j in range(lead, d):
        run += np.square(x[j][row] - book[j][entry])
        live = run <= best[row]
        if not live.all():
            row, entry, run = row[live], entry[live], run[live]
    starts = np.searchsorted(row, np.arange(n))
    least = np.minimum.reduceat(run, starts)
    first = np.flatnonzero(run == least[row])
    found = first[np.searchsorted(row[first], np.arange(n))]
    return entry[found], least


class Reader:
    """Vectors of Arrow batches as integers."""

    def __init__(self, width: int, scale: int, largest: int):
        self.width, self.scale, self.largest = width, scale, largest

    def kept(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places of the rows that are not dropped, whether each can be measured, integers of those that can)."""
        n = len(col)
        flat, size = col.flatten(), np.diff(col.offsets.to_numpy())
        value = flat.to_numpy(zero_copy_only=False).astype(float)  # null becomes NaN
        size = np.where(col.is_null().to_numpy(zero_copy_only=False), 0, size)
        owner = np.repeat(np.arange(n), size)
        odd = np.zeros(n, bool)
        odd[owner[~np.isfinite(value)]] = True
        there = col.is_valid().to_numpy(zero_copy_only=False) & ~odd
        with np.errstate(invalid="ignore", over="ignore"):
            whole = np.floor(value * self.scale)
        fits = there & (size == self.width)
        fits[owner[~(np.abs(whole) <= self.largest)]] = False
        x = whole[np.repeat(fits, size)].astype(np.int64).reshape(-1, self.width) if self.width else np.zeros((int(fits.sum()), 0), np.int64)
        at = np.flatnonzero(there)
        return at, fits[at], x


def assigned(x: np.ndarray, books: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, one column for each part; error of each row)."""
    step = x.shape[1] // len(books)
    codes, error = np.zeros((len(x), len(books)), np.int64), np.zeros(len(x), np.int64)
    for p, book in enumerate(books):
        for a in range(0, len(x), BLOCK):
            codes[a : a + BLOCK, p], far = nearest(x[a : a + BLOCK, p * step : (p + 1) * step], book)
            error[a : a + BLOCK] += far
    return codes, error


def compress_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> DataFrame:
    """(id_col, code, error, label_error, codebooks_sha256) for each vector that is not dropped."""
    if parts < 1 or not 1 <= entries <= 256 or rounds < 0 or scale < 1:
        raise ValueError("parts, entries (at most 256) and scale must be positive, rounds not negative")
    if id_col in OUT:
        raise ValueError(f"the id column must not be named {id_col}")
    spark = vectors.sparkSession
    bound_batches(spark)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    sound = rows.filter("v IS NOT NULL AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))")
    common = sound.groupBy(F.size("v").alias("width")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("width")).first()
    width = common.width if common else 0
    if width % parts:
        raise ValueError(f"vectors of {width} components cannot be cut into {parts} equal parts")
    largest = isqrt(2**61 // max(width, 1))
    step = width // parts
    able = sound.filter((F.size("v") == width) & F.expr(f"forall(v, x -> abs(floor(x * {scale}D)) <= {largest})"))
    start = able.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select(F.transform("v", lambda x: F.floor(x * float(scale)).cast("long")).alias("v")).collect()
    first = np.array([r.v for r in start], np.int64).reshape(len(start), width)
    books = [first[:, p * step : (p + 1) * step] for p in range(parts)]
    reader = Reader(width, scale, largest)
    for _ in range(rounds if len(first) and width else 0):
        books = _moved(rows, reader, books)
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b.tolist() for c in e).encode()).hexdigest()
    schema = T.StructType([rows.schema["id"], rows.schema["label"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])

    def code(batches):
        for b in batches:
            at, fits, x = reader.kept(b.column(2))
            codes, far = assigned(x, books)
            hexed = np.array([f"{c:02x}" for c in range(256)], object)[codes]
            told, error = np.full(len(at), None, object), np.zeros(len(at), np.int64)
            told[fits] = ["".join(c) for c in hexed]
            error[fits] = far
            place = pa.array(at)
            yield pa.record_batch([b.column(0).take(place), b.column(1).take(place), pa.array(told, pa.string()), pa.array(error, pa.int64(), mask=~fits)], names=["id", "label", "code", "error"])

    coded = cut(rows.mapInArrow(code, schema))
    totals = coded.groupBy(F.col("label").alias("of")).agg(F.try_sum("error").alias("label_error"))
    joined = coded.join(totals, coded["label"].eqNullSafe(totals["of"]), "left")
    return joined.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _moved(rows: DataFrame, reader: Reader, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after one round: sums by task, then by number of the codebooks."""
    parts, (k, step) = len(books), books[0].shape

    def sums(batches):
        total, count = np.zeros((parts, k, step), np.int64), np.zeros((parts, k), np.int64)
        for b in batches:
            _, _, x = reader.kept(b.column(0))
            codes, _ = assigned(x, books)
            for p in range(parts):
                count[p] += np.bincount(codes[:, p], minlength=k)
                for e in np.unique(codes[:, p]):
                    total[p, e] += x[codes[:, p] == e, p * step : (p + 1) * step].sum(axis=0)
        place = np.flatnonzero(np.repeat(count.ravel(), step))
        yield pa.record_batch({"place": pa.array(place, pa.int64()), "s": pa.array(total.ravel()[place]), "n": pa.array(np.repeat(count.ravel(), step)[place])})

    got = rows.select("v").mapInArrow(sums, "place long, s long, n long").groupBy("place").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect()
    flat = np.concatenate([b.ravel() for b in books])
    for r in got:  # as many as the codebooks hold at most
        flat[r.place] = r.s // r.n
    return [b.reshape(k, step) for b in np.split(flat, parts)]
