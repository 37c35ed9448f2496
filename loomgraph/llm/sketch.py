"""Count-min sketch over 64-bit keys, kept sparse: built per chunk, merged by cell range, and told back to each chunk.

The sketch is one row of counters, SPARSE or more for each expected key, so it grows with the input without a bound.  It is
never laid out: a chunk of rows counts its keys as (cells it hits, whether once or more), split by range; one task merges a
range, of about RANGE_KEYS entries whatever the input, by adding counts; and what goes back to a chunk is which of its own
cells have a merged count of two or more.  A merged counter is never less than the true count of any key it serves, so a
key that occurs twice is always found repeated; of keys that occur once about one in SPARSE is too.

Answers are files of the shared folder by partition, and within them by chunk, named by the row keys it consists of.  The
second pass reads those of its own partition.  A chunk for which there is no answer, because the rows were dealt
differently the second time, counts all its keys as repeated: that costs time, not results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import STRETCH, mixed, pack_many, scratch_path, shared_table, shuffle_partitions, unpack_many

SPARSE, RANGE_KEYS = 16, 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)


def chunk_name(rids: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(np.ascontiguousarray(rids).tobytes()) - (1 << 63)


class Repeats:
    """The merged sketch, as chunks see it."""

    def __init__(self, folder: str, bits: int):
        self.folder, self.bits = folder, bits

    def cells(self, keys: np.ndarray) -> np.ndarray:
        return mixed(keys * _ODD) >> np.uint64(64 - self.bits)

    def among(self, again: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Which keys' cells are in ``again``, ascending."""
        out = np.zeros(len(keys), bool)
        for a in range(0, len(keys) if len(again) else 0, STRETCH):
            at = self.cells(keys[a : a + STRETCH])
            out[a : a + STRETCH] = again[np.minimum(np.searchsorted(again, at), len(again) - 1)] == at
        return out

    def reader(self) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        """For the task that calls it: (row keys of a chunk, keys) -> which keys may occur twice."""
        table = shared_table(f"{self.folder}/pid={TaskContext.get().partitionId()}")
        told: dict[int, list[tuple[int, bytes]]] = {}
        if table is not None:
            for chunk, part, data in zip(*(table.column(c).to_pylist() for c in ("chunk", "part", "data")), strict=True):
                told.setdefault(chunk, []).append((part, data))

        def repeated(rids: np.ndarray, keys: np.ndarray) -> np.ndarray:
            mine = told.get(chunk_name(rids))
            if mine is None:
                return np.ones(len(keys), bool)
            again = np.concatenate([np.cumsum(unpack_many(d, np.uint64)[0], dtype=np.uint64) for _, d in sorted(mine)])
            return self.among(again, keys)

        return repeated


def build(docs: DataFrame, keys_of: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[np.ndarray, np.ndarray]]], expected: int) -> Repeats:
    """Counts what keys_of yields (row keys and keys of one chunk) for the Arrow batches of docs.  expected: about how many keys."""
    spark = docs.sparkSession
    ranges = max(1, -(-expected // RANGE_KEYS))
    sketch = Repeats(scratch_path(spark, "sketch"), max(22, (SPARSE * max(expected, 1) - 1).bit_length()))
    width = -(-(1 << sketch.bits) // ranges)
    bounds = np.arange(ranges + 1, dtype=np.uint64) * np.uint64(width)

    def partial(batches):
        pid = TaskContext.get().partitionId()

        def counted(chunk):
            rids, at = chunk[0], sketch.cells(chunk[1])
            at.sort()
            fresh = np.r_[True, at[1:] != at[:-1]][: len(at)]
            n = np.r_[~fresh[1:], False][: len(at)][fresh].astype(np.uint8) + np.uint8(1)  # 2 where the next is the same cell
            at = at[fresh]
            edges = np.searchsorted(at, bounds).tolist()
            rows = [(part, pack_many(np.diff(at[a:b], prepend=np.uint64(0)), n[a:b])) for part, (a, b) in enumerate(pairwise(edges)) if a < b]
            name = chunk_name(rids)
            return pa.record_batch({"part": pa.array([r[0] for r in rows], pa.int64()), "pid": pa.array([pid] * len(rows), pa.int32()), "chunk": pa.array([name] * len(rows), pa.int64()), "data": pa.array([r[1] for r in rows], pa.binary())})

        return map(counted, keys_of(batches))  # no chunk is held while the next is gathered

    def merge(key, rows):
        found = [unpack_many(d, np.uint64, np.uint8) for d in rows["data"]]
        cells = [np.cumsum(gaps, dtype=np.uint64) for gaps, _ in found]
        _, which = np.unique(np.concatenate(cells), return_inverse=True)
        again = np.bincount(which, np.concatenate([n for _, n in found])) >= 2
        ends = np.cumsum([len(c) for c in cells])
        data = [pack_many(np.diff(c[again[which[e - len(c) : e]]], prepend=np.uint64(0))) for c, e in zip(cells, ends, strict=True)]
        return pd.DataFrame({"pid": rows["pid"], "chunk": rows["chunk"], "part": key[0], "data": data})

    merged = docs.mapInArrow(partial, "part long, pid int, chunk long, data binary").groupBy("part").applyInPandas(merge, "pid int, chunk long, part long, data binary")
    merged.repartition("pid").write.partitionBy("pid").parquet(sketch.folder)
    return sketch


#: Counters of a frequency table: 2 bytes each, so 64 MB at most, whatever the input.
FREQUENCY_CELLS = 1 << 25
RANGE = 1 << 20


class Frequencies:
    """Approximate counts of keys in one row of counters, to order keys by; never below the true count up to 65,535."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts

    def of(self, keys: np.ndarray) -> np.ndarray:
        return self.counts[((mixed(keys * _ODD) >> np.uint64(32)) * np.uint64(len(self.counts))) >> np.uint64(32)]


def frequencies(rows: DataFrame, keys_of: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], expected: int) -> Frequencies:
    """Counts what keys_of yields for the Arrow batches of rows.  expected: about how many keys."""
    cells = int(min(max(2 * expected, 1 << 12), FREQUENCY_CELLS))
    salts = shuffle_partitions(rows.sparkSession)

    def partial(batches):
        pid = TaskContext.get().partitionId()
        for keys in keys_of(batches):
            at, n = np.unique(((mixed(keys * _ODD) >> np.uint64(32)) * np.uint64(cells)) >> np.uint64(32), return_counts=True)
            ranges = (at // np.uint64(RANGE)).astype(np.int64)
            for a, b in pairwise([*np.flatnonzero(np.r_[True, ranges[1:] != ranges[:-1]]), len(at)] if len(at) else []):
                inner = (at[a:b] - np.uint64(ranges[a] * RANGE)).astype(np.uint32)
                yield pa.record_batch({"part": pa.array([ranges[a]], pa.int32()), "salt": pa.array([pid % salts], pa.int32()), "data": pa.array([pack_many(np.diff(inner, prepend=np.uint32(0)), np.minimum(n[a:b], 65535).astype(np.uint16))], pa.binary())})

    def merge(key, blobs):
        count = np.zeros(RANGE, np.int64)
        for data in blobs["data"]:
            gaps, n = unpack_many(data, np.uint32, np.uint16)
            count[np.cumsum(gaps, dtype=np.int64)] += n
        at = np.flatnonzero(count)
        packed = pack_many(np.diff(at, prepend=0).astype(np.uint32), np.minimum(count[at], 65535).astype(np.uint16))
        return pd.DataFrame({"part": [key[0]], "data": [packed]})

    # A range's chunks are summed in as many groups as there are partitions, then the groups.
    merged = rows.mapInArrow(partial, "part int, salt int, data binary").groupBy("part", "salt").applyInPandas(merge, "part int, data binary").groupBy("part").applyInPandas(merge, "part int, data binary")
    counts = np.zeros(-(-cells // RANGE) * RANGE, np.uint16)
    for r in merged.toLocalIterator():  # bounded by FREQUENCY_CELLS
        gaps, n = unpack_many(bytes(r.data), np.uint32, np.uint16)
        counts[r.part * RANGE + np.cumsum(gaps, dtype=np.int64)] = n
    return Frequencies(counts[:cells])
