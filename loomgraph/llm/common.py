"""Helpers shared by the corpus operators: row keys, word hashing, array packing, shared folder."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import uuid
from collections.abc import Callable
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import cut, shared_folder

#: Internal key column.  Operators never use a name a caller's table is likely to have.
RID = "__lg_rid"
#: Distinct words whose hash a Python worker remembers (about 50 MB); beyond it the memo starts afresh.
WORD_MEMO = 200_000
#: Entries that hashing takes at a time, so that what it holds in between stays small and in the cache.
STRETCH = 1 << 15
#: Bytes of rows that an executor and a Python worker pass each other at a time, where the session names no other bound.
BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


def bound_batches(spark: SparkSession) -> None:
    """Batches bounded by bytes as well as rows, so that long texts don't add up to large ones on either side."""
    if BATCH[0] not in spark.conf.getAll:
        spark.conf.set(*BATCH)


_SCRATCH: list[str] = []


def scratch_path(spark: SparkSession, what: str) -> str:
    """A new place in the shared folder; it goes when this driver ends, as results are read from it until then."""
    if not _SCRATCH:
        atexit.register(_sweep)
    _SCRATCH.append(f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}")
    return _SCRATCH[-1]


def _sweep() -> None:
    for path in _SCRATCH:
        with contextlib.suppress(OSError):  # never written, or gone
            fs, at = filesystem(path)
            fs.delete_dir(at)


def filesystem(url: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a place in the shared folder."""
    for a, b in (("s3a://", "s3://"), ("s3n://", "s3://")):
        url = b + url[len(a) :] if url.startswith(a) else url
    return pafs.FileSystem.from_uri(url if "://" in url or url.startswith("file:") else "file://" + url)


def publish(fs: pafs.FileSystem, temp: str, final: str) -> None:
    """Gives a finished file its name, also where an earlier attempt of the same task has left one."""
    if fs.get_file_info(final).type == pafs.FileType.File:
        fs.delete_file(final)
    fs.move(temp, final)


def shared_table(folder: str) -> pa.Table | None:
    """Rows of the Parquet files in a shared folder; None if there is none."""
    fs, at = filesystem(folder)
    if fs.get_file_info(at).type != pafs.FileType.Directory:
        return None
    return pq.read_table(at, filesystem=fs, partitioning=None)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, bool]:
    """``docs`` with a unique, not-null long RID that orders rows by (id, nulls last; then text), and whether it is the id.

    Unique integer ids are used as they are: finding that out moves one long per row.  Where ids repeat or are
    null, each row is a document of its own and gets a number in that order; rows equal in both columns are
    numbered in any order, which no result depends on but for which of the equal rows carries it.
    """
    integral = dict(docs.dtypes)[id_col] in ("bigint", "int", "smallint", "tinyint")
    if integral:
        odd = docs.groupBy(F.col(id_col).alias(RID)).agg(F.count(F.lit(1)).alias("n"))
        if odd.filter("n > 1 OR " + RID + " IS NULL").isEmpty():
            return docs.withColumn(RID, F.col(id_col).cast("long")), True
    order = [F.col(id_col).asc_nulls_last(), F.col(text_col).asc_nulls_first()]
    ranged = docs.repartitionByRange(shuffle_partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
    return cut(ranged.withColumn(RID, F.monotonically_increasing_id())), False


def make_room(memo: dict, most: int) -> None:
    """Forgets the older half of a memo that is full."""
    if len(memo) >= most:
        for k in list(islice(memo, most // 2)):
            del memo[k]


class WordHashes(dict):
    """word (bytes) -> 64-bit hash, computed once per word and worker."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        make_room(self, WORD_MEMO)
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_KEPT: dict[str, object] = {}


def kept(name: str, make: Callable[[], object]) -> object:
    """What this Python worker keeps from task to task: one thing, so that what an earlier operator needed goes when another begins."""
    if name not in _KEPT:
        _KEPT.clear()
        free_at_once()
        with contextlib.suppress(OSError, AttributeError, TypeError):
            ctypes.CDLL(None).malloc_trim(0)
        pa.default_memory_pool().release_unused()
        _KEPT[name] = make()
    return _KEPT[name]


def word_hashes() -> WordHashes:
    """The worker's memo."""
    return kept("words", WordHashes)


@lru_cache(maxsize=1)
def free_at_once() -> None:
    """In this worker, arrays of a megabyte or more go back to the system when they are freed, where the C library has such a setting.

    Else it keeps tens of megabytes for later, in each worker, and workers that wait for a task count as well.
    """
    with contextlib.suppress(OSError, AttributeError, TypeError):
        ctypes.CDLL(None).mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD


def coefficients(k: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads every input bit over the word (the finaliser of splitmix64)."""
    out = np.empty_like(h)
    for a in range(0, len(h), STRETCH):
        x = h[a : a + STRETCH]
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out[a : a + STRETCH] = x ^ (x >> np.uint64(31))
    return out


def windows(w: np.ndarray, coef: np.ndarray) -> np.ndarray:
    """Multilinear hash of each run of len(coef) consecutive entries of w."""
    h = np.zeros(max(len(w) - len(coef) + 1, 0), np.uint64)
    for a in range(0, len(h), STRETCH):
        some = h[a : a + STRETCH]
        for j, c in enumerate(coef):
            some += w[a + j : a + j + len(some)] * c
        some[:] = mixed(some)
    return h


def grouped(which: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Places in order of (which, h), equal pairs in any order; which from 0.

    One sort of a packed key; where its bits do not tell two values apart, a sort by both.
    """
    bits = int(which.max()).bit_length() if len(which) else 0
    key = h if not bits else which.astype(np.uint64) << np.uint64(64 - bits) | h >> np.uint64(bits)
    order = np.argsort(key)
    if bits:
        key, seen = key[order], h[order]
        if np.any((key[1:] == key[:-1]) & (seen[1:] != seen[:-1])):
            return np.lexsort((h, which))
    return order


def pack(a: np.ndarray) -> bytes:
    """Fixed-width integers split into byte planes and compressed: constant high bytes cost nothing."""
    raw = np.ascontiguousarray(a)
    planes = raw.view(np.uint8).reshape(len(raw), raw.dtype.itemsize).T.tobytes() if len(raw) else b""
    return bytes(pa.compress(planes, codec="zstd", asbytes=True)) if planes else b""


def unpack(data: bytes, n: int, dtype) -> np.ndarray:
    if not n:
        return np.zeros(0, dtype)
    size = np.dtype(dtype).itemsize
    planes = np.frombuffer(pa.decompress(data, n * size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).view(dtype).reshape(n)


def pack_many(*arrays: np.ndarray) -> bytes:
    """Equally long arrays in one value; the reader names the dtypes again."""
    parts = [pack(a) for a in arrays]
    head = np.array([len(arrays[0]), *map(len, parts)], "<u4").tobytes()
    return head + b"".join(parts)


def unpack_many(data: bytes, *dtypes) -> list[np.ndarray]:
    n, *sizes = np.frombuffer(data, "<u4", 1 + len(dtypes)).tolist()
    at, out = 4 * (1 + len(dtypes)), []
    for size, dtype in zip(sizes, dtypes, strict=True):
        out.append(unpack(data[at : at + size], n, dtype))
        at += size
    return out


def seal(*arrays: np.ndarray) -> bytes:
    """Arrays of any lengths in one value, which names their types."""
    parts = [pack(a) for a in arrays]
    heads = [np.dtype(a.dtype).str.encode() + np.array([len(a), len(p)], "<u8").tobytes() for a, p in zip(arrays, parts, strict=True)]
    return len(arrays).to_bytes(1, "little") + b"".join(heads) + b"".join(parts)


def unseal(data: bytes) -> list[np.ndarray]:
    at, out = 1 + 19 * data[0], []
    for k in range(data[0]):
        head = data[1 + 19 * k : 20 + 19 * k]
        n, size = np.frombuffer(head, "<u8", 2, 3).tolist()
        out.append(unpack(data[at : at + size], n, np.dtype(head[:3].decode())))
        at += size
    return out
