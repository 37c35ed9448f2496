"""Substring dedup: remove passages that already occurred earlier in the corpus.

A window is ``width`` consecutive words of one document.  Documents are ordered by id.  Every word covered by a
window whose word sequence also starts earlier (in an earlier document, or earlier in the same one) is removed;
all windows are judged on the input.

Plan
    1. A count-min sketch of all windows is built per chunk, merged by range, and told back to the chunks (sketch.py).
    2. A second pass hashes windows again, keeps those estimated repeated, and groups them exactly.  Of each
       sequence a chunk ships only its earliest window: the others are already known to be later ones.  So a
       passage that a third of all documents carry costs one entry per chunk.  Windows are compared by 96 hash
       bits of two independent multilinear hashes over 64-bit word hashes.
    3. Spans to remove meet the texts once, dealt by document.

Defined results: null and empty texts have no words; texts shorter than a window lose nothing; ids that repeat or
are null make documents of their own, ordered by (id, nulls last; text), so of two equal rows one is the later copy;
an empty table gives an empty table.  Input columns are kept; of clashing names the operator's column wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import RID, bound_batches, coefficients, keyed, pack_many, shuffle_partitions, unpack_many, windows, word_hashes
from .sketch import build

#: Words a task hashes at once.
CHUNK = 1_500_000
#: Bytes of text for each range of window hashes and each bucket of documents, so that neither grows with the input.
PART_BYTES = 64 << 20
_BUCKET, _KIND, _BLOB = "__lg_bucket", "__lg_kind", "__lg_blob"


def chunks(batches, size: int = CHUNK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row keys, word offsets, word hashes) of some documents at a time, rows in key order."""
    memo, rids, words, total = word_hashes(), [], [], 0

    def flush():
        order = np.argsort(np.array(rids, np.int64), kind="stable")
        sizes = np.array([len(words[i]) for i in order], np.int64)
        out = np.array(rids, np.int64)[order], np.r_[0, np.cumsum(sizes)], np.concatenate([words[i] for i in order])
        rids.clear()
        words.clear()
        return out

    for b in batches:
        for rid, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            w = memo.of((text.as_py() or "").encode("utf-8", "replace").split())
            if len(w):
                rids.append(rid)
                words.append(w)
                total += len(w)
            if total >= size:
                yield flush()
                total = 0
    if total:
        yield flush()


def starts_in(offsets: np.ndarray, width: int) -> np.ndarray:
    """Places in the concatenated words at which a window of one document starts."""
    n = int(offsets[-1])
    ok = np.zeros(n + 1, np.int8)
    a, b = offsets[:-1], np.maximum(offsets[1:] - width + 1, offsets[:-1])
    np.add.at(ok, a, 1)
    np.add.at(ok, b, -1)
    return np.flatnonzero(np.cumsum(ok[:-1], dtype=np.int8))  # 0 or 1


def spans_of(doc: np.ndarray, start: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Adjoining windows joined: (doc, first word, end) from windows sorted by (doc, start)."""
    if not len(doc):
        return doc, start, start
    fresh = np.r_[True, (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + width)]
    last = np.r_[fresh[1:], True]
    return doc[fresh], start[fresh], start[last] + width


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 20) -> DataFrame:
    """docs with n_words, n_removed (long) and kept_text (kept words joined by one space)."""
    if width < 1:
        raise ValueError("width must be positive")
    spark = docs.sparkSession
    bound_batches(spark)
    rows, _ = keyed(docs.drop("n_words", "n_removed", "kept_text"), id_col, text_col)
    slim = rows.select(RID, F.col(text_col).alias("t"))
    size = slim.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    c1, c2 = coefficients(width, 11), coefficients(width, 29)

    def hashed(chunk):
        rids, offsets, w = chunk
        return rids, windows(w, c1)[starts_in(offsets, width)]

    filt = build(slim, lambda batches: map(hashed, chunks(batches)), size // 6)
    parts = max(shuffle_partitions(spark), -(-size // PART_BYTES))  # of hash ranges, and of documents: tasks pass each other one blob per pair

    def bucket(rid: np.ndarray) -> np.ndarray:
        return (rid ^ rid >> 9 ^ rid >> 21) % parts

    bucket_sql = F.expr(f"int(pmod({RID} ^ shiftright({RID}, 9) ^ shiftright({RID}, 21), {parts}))")

    def split(kind: int, part: np.ndarray, *cols: np.ndarray):
        order = np.argsort(part, kind="stable")
        p = part[order]
        edges = [*np.flatnonzero(np.r_[True, p[1:] != p[:-1]]), len(p)] if len(p) else []
        for a, b in pairwise(edges):
            yield kind, int(p[a]), pack_many(*(c[order[a:b]] for c in cols))

    def batch_of(rows):
        salt = TaskContext.get().partitionId()  # spans found here only pass through, so they need not meet
        return pa.record_batch({"kind": pa.array([r[0] for r in rows], pa.int32()), "salt": pa.array([salt * r[0] for r in rows], pa.int32()), "part": pa.array([r[1] for r in rows], pa.int32()), "data": pa.array([r[2] for r in rows], pa.binary())})

    def repeats(look, chunk):
        rids, offsets, w = chunk
        at = starts_in(offsets, width)
        h1 = windows(w, c1)[at]
        keep = look(rids, h1)
        at, h1 = at[keep], h1[keep]
        if not len(at):
            return []
        h2 = (windows(w, c2)[at] >> np.uint64(32)).astype(np.uint32)
        which = np.searchsorted(offsets, at, side="right") - 1
        doc, start = rids[which], (at - offsets[which]).astype(np.int64)
        order = np.lexsort((h2, h1))  # stable, and rows are in (document, start) order
        s1, s2 = h1[order], h2[order]
        first = np.r_[True, (s1[1:] != s1[:-1]) | (s2[1:] != s2[:-1])]
        later = np.sort(order[~first])
        out = []
        if len(later):
            d, a, b = spans_of(doc[later], start[later], width)
            out += split(1, bucket(d), d, a, b)
        lead = order[first]
        out += split(0, ((h1[lead] >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64), h1[lead], h2[lead], doc[lead], start[lead].astype(np.uint32))
        return [batch_of(out)]

    def candidates(batches):
        look = filt.reader()
        for found in map(lambda chunk: repeats(look, chunk), chunks(batches)):  # no chunk is held while the next is gathered
            yield from found

    def judge(key, blobs):
        kind, _, part = key
        if kind == 1:
            return pd.DataFrame({_BUCKET: part, _BLOB: blobs["data"]})
        cols = [np.concatenate(x) for x in zip(*(unpack_many(d, np.uint64, np.uint32, np.int64, np.uint32) for d in blobs["data"]), strict=True)]
        h1, h2, doc, start = cols
        order = np.lexsort((start, doc, h2, h1))
        s1, s2 = h1[order], h2[order]
        later = order[np.r_[False, (s1[1:] == s1[:-1]) & (s2[1:] == s2[:-1])]]
        later = later[np.lexsort((start[later], doc[later]))]
        d, a, b = spans_of(doc[later], start[later].astype(np.int64), width)
        got = list(split(1, bucket(d), d, a, b))
        return pd.DataFrame({_BUCKET: pd.Series([g[1] for g in got], dtype="int32"), _BLOB: [g[2] for g in got]})

    found = slim.mapInArrow(candidates, "kind int, salt int, part int, data binary").groupBy("kind", "salt", "part").applyInPandas(judge, f"{_BUCKET} int, {_BLOB} binary")
    dealt = rows.withColumn(_BUCKET, bucket_sql).withColumn(_KIND, F.lit(1)).unionByName(found.withColumn(_KIND, F.lit(0)), allowMissingColumns=True)
    dealt = dealt.repartition(parts, _BUCKET).sortWithinPartitions(_BUCKET, _KIND)
    kept = [c for c in rows.columns if c != RID]
    out_schema = T.StructType([*(rows.schema[c] for c in kept), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())])

    def apply(batches):
        here, spans = None, {}
        for b in batches:
            col = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            kinds, buckets = col[_KIND].to_numpy(), col[_BUCKET].to_numpy()
            n_words, n_removed, texts, take = [], [], [], []
            rids, blobs, text = col[RID], col[_BLOB], col[text_col]
            for i in range(len(kinds)):
                if buckets[i] != here:
                    here, spans = buckets[i], {}
                if kinds[i] == 0:
                    for d, x, y in zip(*(c.tolist() for c in unpack_many(blobs[i].as_py(), np.int64, np.int64, np.int64)), strict=True):
                        spans.setdefault(d, []).append((x, y))
                    continue
                words = (text[i].as_py() or "").encode("utf-8", "replace").split()
                n_words.append(len(words))
                kept_words, end = [], 0
                for x, y in sorted(spans.get(rids[i].as_py(), ())):
                    kept_words += words[end:x] if x > end else ()
                    end = max(end, y)
                kept_words = kept_words + words[end:] if end else words
                n_removed.append(len(words) - len(kept_words))
                texts.append(b" ".join(kept_words).decode())
                take.append(i)
            if take:
                at = pa.array(take)
                yield pa.record_batch([*(col[c].take(at) for c in kept), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(texts, pa.string())], names=[*kept, "n_words", "n_removed", "kept_text"])

    return dealt.mapInArrow(apply, out_schema)
