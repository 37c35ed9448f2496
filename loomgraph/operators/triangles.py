"""Triangles.

In blocks between three colours of nodes, in which sorted lists of neighbours are intersected.  Edges that live for intervals
bring these along, and a triangle lives where the lives of its edges meet.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import pairwise
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import written

#: Edges of a block that a task holds (two longs each), as a mean, and least number of colours.
BLOCK_EDGES, LEAST_COLOURS = 2_000_000, 4
#: Pairs of neighbours that are looked up at a time.
LOOKUPS = 500_000


def _found(u: np.ndarray, v: np.ndarray, rows: bool = False) -> Iterator[tuple[np.ndarray, ...]]:
    """Places (x, y, z) in the sorted ids of each triangle of a block of edges, a run at a time; ids, first, are yielded as x.

    With ``rows`` an edge may have several: then the places of the three edges follow x, y, z, and after the ids comes the
    order of the given rows by edge, and where in it each edge begins.

    An edge goes from its end of fewer edges to the other.  For each edge the shorter list of its ends' targets is looked
    up in the longer one, by binary search in the sorted edges, so no list is longer than the square root of the edges.
    """
    ids = np.unique(np.r_[u, v])
    n = len(ids)
    a, b = (np.searchsorted(ids, x).astype(np.int32) for x in (u, v))  # places within a block take half of what ids take
    del u, v
    degree = np.bincount(a, minlength=n) + np.bincount(b, minlength=n)
    rank = np.empty(n, np.int32)
    rank[np.lexsort((np.arange(n), degree))] = np.arange(n, dtype=np.int32)
    a, b = rank[a], rank[b]
    key = np.minimum(a, b).astype(np.int64)
    key *= n
    key += np.maximum(a, b)
    del a, b
    if rows:
        order = np.argsort(key, kind="stable")
        key = key[order]
    else:
        key.sort()
    fresh = np.diff(key, prepend=-1) != 0
    runs_at = np.flatnonzero(fresh) if rows else None
    key = key[fresh]
    lo = (key // n).astype(np.int32)
    hi = (key % n).astype(np.int32)
    start = np.searchsorted(lo, np.arange(n + 1))
    size = np.diff(start)
    back = np.argsort(rank)  # rank -> place
    yield (ids, order, np.r_[runs_at, len(order)]) if rows else (ids, back, back)
    swap = size[hi] < size[lo]
    few, many = np.where(swap, hi, lo), np.where(swap, lo, hi)
    upto = np.cumsum(size[few])
    at = 0
    while at < len(key):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + LOOKUPS, side="right")))
        runs = size[few[at:end]]
        which = np.repeat(np.arange(at, end), runs)
        inner = np.arange(len(which)) - np.repeat(np.cumsum(runs) - runs, runs)
        third = hi[start[few[which]] + inner]
        asked = many[which].astype(np.int64) * n + third
        place = np.searchsorted(key, asked)
        closed = (place < len(key)) & (key[np.minimum(place, len(key) - 1)] == asked)
        corners = back[lo[which[closed]]], back[hi[which[closed]]], back[third[closed]]
        yield (*corners, which[closed], (start[few[which]] + inner)[closed], place[closed]) if rows else corners
        at = end


def _colours(ids: np.ndarray, colours: int) -> np.ndarray:
    """A number below ``colours`` for each id, by the upper bits of a product, so that ids in order are spread."""
    return (((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(colours)).astype(np.int64)


#: Edges that a task deals to blocks at a time; each block gets its own as one row of packed numbers.
DEALT = 500_000


def _packed(x: np.ndarray) -> bytes:
    """Numbers in as few bytes each as hold them; the first byte tells how many."""
    wide = np.int64 if len(x) and x.min() < 0 else next(t for t in (np.uint8, np.uint16, np.uint32, np.int64) if not len(x) or x.max() <= np.iinfo(t).max)
    return bytes([np.dtype(wide).itemsize]) + x.astype(wide).tobytes()


def _unpacked(b: bytes) -> np.ndarray:
    return np.frombuffer(b, {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.int64}[b[0]], offset=1).astype(np.int64)


def _blocks(edges: DataFrame, tell, schema: str, kept: bool = False, more: Sequence[str] = ()) -> DataFrame:
    """What ``tell(ids, x, y, z)`` gives for the triangles of edges(u, v), found in blocks: no pair of edges is ever a row.

    Nodes get one of a few colours.  A block is a set of three colours and the edges between them, so an edge is in as many
    blocks as there are colours; a triangle belongs to the block of just its colours.  There are more colours the more edges
    there are, or the more the largest hub has, so a block stays within a task's memory.  ``kept``: edges are a table already.
    A task deals its edges by block and packs them, so a copy of an edge takes few bytes, not a row.

    ``more``: columns of whole numbers told too, then of an edge as many rows as there are; ``tell(ids, triangles)`` gets an
    iterator of (x, y, z, rows of the first, second and third edge), the columns' values, and where each edge's rows begin.
    """
    more = list(more)
    edges = edges if kept else written(edges.select("u", "v", *more))
    ends = edges.select(F.explode(F.array("u", "v")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("d"))
    got = ends.agg(F.sum("d").alias("ends"), F.max("d").alias("top")).first()
    colours = max(LEAST_COLOURS, isqrt(3 * (got.ends or 0) // BLOCK_EDGES) + 1, 2 * (got.top or 0) // BLOCK_EDGES + 1)

    def deal(columns: list[np.ndarray]):
        cu, cv = _colours(columns[0], colours), _colours(columns[1], colours)
        low, high = np.minimum(cu, cv), np.maximum(cu, cv)
        order = np.lexsort((columns[1], columns[0], high, low))  # edges between the same colours go to the same blocks
        low, high, columns = low[order], high[order], [c[order] for c in columns]
        pair = low * colours + high
        cuts = [0, *(np.flatnonzero(np.diff(pair)) + 1).tolist(), len(pair)] if len(pair) else [0]
        blocks, data = [], []
        for lo, hi in pairwise(cuts):
            u = columns[0][lo:hi]  # sorted, so steps are told
            packed = [int(u[0]), _packed(np.diff(u, prepend=u[0])), *(_packed(c[lo:hi]) for c in columns[1:])]
            for k in range(colours):
                a, b, c = sorted((int(low[lo]), int(high[lo]), k))
                blocks.append((a * colours + b) * colours + c)
                data.append(packed)
        for at in range(0, len(blocks), 256):  # few enough for a batch to be small
            some = data[at : at + 256]
            whole = [pa.array(blocks[at : at + 256], pa.int64()), pa.array([d[0] for d in some], pa.int64())]
            yield pa.record_batch(whole + [pa.array([d[k] for d in some], pa.binary()) for k in range(1, len(names) + 1)], names=["block", "base", *names])

    names = [f"c{k}" for k in range(2 + len(more))]

    def dealt(batches):
        parts, held = [], 0
        for b in batches:
            parts.append([c.to_numpy() for c in b.columns])
            held += b.num_rows
            if held >= DEALT:
                yield from deal([np.concatenate(c) for c in zip(*parts, strict=True)])
                parts, held = [], 0
        if held:
            yield from deal([np.concatenate(c) for c in zip(*parts, strict=True)])

    def listed(block: int, parts: list):
        u = np.concatenate([p[0] + np.cumsum(_unpacked(p[1])) for p in parts])
        v, *rest = (np.concatenate([_unpacked(p[k]) for p in parts]) for k in range(2, len(names) + 1))
        parts.clear()
        found = _found(u, v, bool(more))
        del u, v
        ids, order, begins = next(found)
        of = _colours(ids, colours)
        want = np.array([block // colours**2, block // colours % colours, block % colours])

        def own():
            for x, y, z, *at in found:
                mine = (np.sort(np.stack([of[x], of[y], of[z]]), axis=0) == want[:, None]).all(axis=0)
                yield x[mine], y[mine], z[mine], *(e[mine] for e in at)

        if more:
            yield from tell(ids, own(), [c[order] for c in rest], begins)
        else:
            for x, y, z, *_ in own():
                yield tell(ids, x, y, z)

    def run(batches):
        here, parts = None, []
        for b in batches:
            for block, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if parts and block != here:
                    yield from listed(here, parts)
                    parts = []
                here = block
                parts.append(row)
        if parts:
            yield from listed(here, parts)

    tasks = max(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    packed = edges.select("u", "v", *more).mapInArrow(dealt, ", ".join(["block long", "base long", *(f"{n} binary" for n in names)]))
    return packed.repartition(tasks, "block").sortWithinPartitions("block").mapInArrow(run, schema)


def listing(edges: DataFrame) -> DataFrame:
    """(a, b, c) with a < b < c for canonical undirected edges (u < v, each once), which are computed once and kept."""

    def tell(ids, x, y, z):
        t = np.sort(np.stack([ids[x], ids[y], ids[z]]), axis=0)
        return pa.record_batch({n: pa.array(c) for n, c in zip("abc", t, strict=True)})

    return _blocks(edges, tell, "a long, b long, c long")


def corners(edges: DataFrame, kept: bool = False) -> DataFrame:
    """(id, triangles) of the nodes that lie in any, counted by block before anything is shuffled again."""

    def tell(ids, x, y, z):
        n = np.bincount(np.concatenate([x, y, z]), minlength=len(ids))
        at = np.flatnonzero(n)
        return pa.record_batch({"id": pa.array(ids[at]), "n": pa.array(n[at].astype(np.int64))})

    return _blocks(edges, tell, "id long, n long", kept).groupBy("id").agg(F.sum("n").alias("triangles"))


def count(edges: DataFrame) -> int:
    one = _blocks(edges, lambda ids, x, y, z: pa.record_batch({"n": pa.array([len(x)], pa.int64())}), "n long")
    return one.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def _together(found, lives: list[np.ndarray], begins: np.ndarray):
    """(x, y, z, k1, k2) for triangles whose edges have rows of lives [k1, k2): all times at which all three live."""
    k1, k2 = lives
    many = np.diff(begins)

    def met(at, edge, a, b):
        """Each triangle once for each life of an edge that meets what is left of it."""
        n = many[edge]
        of = np.repeat(np.arange(len(edge)), n)
        row = np.repeat(begins[edge], n) + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        a, b = np.maximum(a[of], k1[row]), np.minimum(b[of], k2[row])
        on = a < b
        return at[of[on]], a[on], b[on]

    for x, y, z, *edges in found:
        upto = np.cumsum(np.prod([many[e] for e in edges], axis=0))
        lo = 0
        while lo < len(x):  # few enough for what they may become
            hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + 2 * LOOKUPS, side="right")))
            at, a, b = np.arange(lo, hi), np.zeros(hi - lo, np.int64), np.full(hi - lo, np.iinfo(np.int64).max)
            for e in edges:
                at, a, b = met(at, e[at], a, b)
            yield x[at], y[at], z[at], a, b
            lo = hi


def changes(lives: DataFrame) -> DataFrame:
    """(id, k, by): by how many the triangles of node id change at k, for a table of edges(u, v, k1, k2), u < v, that live at k1 <= k < k2.

    An edge may have several lives that lie apart.  Counted by block, so a triangle is never a row.
    """

    def tell(ids, found, columns, begins):
        keys, sums = np.empty(0, np.int64), np.empty(0, np.int64)
        top = int(columns[1].max(initial=0)) + 1
        for x, y, z, a, b in _together(found, columns, begins):
            nodes = np.concatenate([x, y, z]).astype(np.int64) * top
            key = np.concatenate([keys, nodes + np.tile(a, 3), nodes + np.tile(b, 3)])
            by = np.concatenate([sums, np.ones(3 * len(a), np.int64), -np.ones(3 * len(a), np.int64)])
            keys, back = np.unique(key, return_inverse=True)
            sums = np.bincount(back, by, len(keys)).astype(np.int64)
        yield pa.record_batch({"id": pa.array(ids[keys // top]), "k": pa.array(keys % top), "by": pa.array(sums)})

    return _blocks(lives, tell, "id long, k long, by long", True, ("k1", "k2")).groupBy("id", "k").agg(F.sum("by").alias("by")).filter("by <> 0")


def closed_at(edges: DataFrame) -> DataFrame:
    """(k, n): how many triangles of a table of edges(u, v, k), u < v, each once, have k as the largest of their edges' k."""

    def tell(ids, found, columns, begins):
        k = columns[0]
        keys, sums = np.empty(0, np.int64), np.empty(0, np.int64)
        for _, _, _, p, q, r in found:
            last, n = np.unique(np.maximum(np.maximum(k[p], k[q]), k[r]), return_counts=True)
            keys, back = np.unique(np.concatenate([keys, last]), return_inverse=True)
            sums = np.bincount(back, np.concatenate([sums, n]), len(keys)).astype(np.int64)
        yield pa.record_batch({"k": pa.array(keys), "n": pa.array(sums)})

    return _blocks(edges, tell, "k long, n long", True, ("k",)).groupBy("k").agg(F.sum("n").alias("n"))


def local(edges: DataFrame, nodes: DataFrame, kept: bool = False) -> DataFrame:
    return nodes.join(corners(edges, kept), "id", "left").select("id", F.coalesce("triangles", F.lit(0)).alias("triangles"))


def clustering(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    edges = written(edges.select("u", "v"))
    degree = edges.select(F.explode(F.array("u", "v")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("d"))
    both = local(edges, nodes, kept=True).join(degree, "id", "left")
    d = F.col("d")
    return both.select("id", F.when(d >= 2, 2.0 * F.col("triangles") / (d * (d - 1))).otherwise(F.lit(0.0)).alias("clustering"))
