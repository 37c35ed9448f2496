"""Near duplicates: Jaccard join over word shingles by grouped prefixes.

Two documents link when their shingle sets have 100 * |intersection| >= percent * |union|.  The result is one row
per document with its set size and component, so copies are never expanded into pairs.

Plan
    1. A count-min sketch over shingles (sketch.py) tells which may occur in a second document.  A document can
       only link if ``percent`` of its set occurs elsewhere, so most documents end here, in the map task that read
       them, with nothing shuffled.  Refusing is exact: the sketch never underestimates.
    2. Identical sets of the rest collapse to the smallest id (128-bit digest of the set).
    3. Shingles are ordered: those of one document first, then by a frequency table over the remaining sets, rare
       ones first (its errors cost time, not links).  Of two sets that link,
       the first n - ceil(percent n) + 1 shingles (the prefix) share one.  Sets with equal size and prefix form
       one group; groups, not documents, are posted under the shingles of their prefix.
    4. Pairs of groups that share a shingle pass the size filter and the positional filter (what can still overlap
       behind the shared shingle); their members are then compared on whole sets.
       Comparing all members of a large cluster is never needed: they first meet one pivot group per shingle, and
       only pairs that are not yet known to be connected are compared after that.  All of those are compared, without
       a limit.
    5. Components of the verified links (large-star, small-star), first of those with pivots; the later links join
       whole components, so the second graph has components as its nodes.

Shingles are compared by 64-bit hashes.

Defined results: null or empty text, or one without words: an empty set, linked with nothing, component its own id.
Fewer words than a shingle: the whole sequence is the only shingle.  Repeated or null ids: each row is a document
of its own (see common.keyed), reported under its id; a component's id is then the smallest id among its rows, nulls
last.  Other columns are not returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import component_labels
from .common import RID, bound_batches, coefficients, cut, keyed, scratch_path, windows, word_hashes
from .sketch import build, frequencies

#: Words of a chunk, which is counted as one, and of a piece, whose sets are made at once.
CHUNK, PIECE = 1_000_000, 1 << 17


def shingle_sets(batches, width: int, size: int = CHUNK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row keys, offsets, shingle hashes): for each document its distinct shingles, ascending."""
    memo, coef = word_hashes(), [coefficients(k, 1000 + k) for k in range(width + 1)]
    rids: list[int] = []
    words: list[np.ndarray] = []
    done: list[tuple[np.ndarray, np.ndarray]] = []
    total = held = 0

    def sets():
        """Numbers of shingles, and shingles, of the documents since the last call."""
        sizes = np.array([len(w) for w in words], np.int64)
        ends = np.cumsum(sizes)
        all_words = np.concatenate(words) if words else np.zeros(0, np.uint64)
        full = windows(all_words, coef[width])
        which = np.repeat(np.arange(len(words)), np.maximum(sizes - width + 1, 0))
        first = np.repeat(ends - sizes - np.r_[0, np.cumsum(np.maximum(sizes - width + 1, 0))[:-1]], np.maximum(sizes - width + 1, 0)) if len(words) else np.zeros(0, np.int64)
        h = full[first + np.arange(len(which))] if len(which) else np.zeros(0, np.uint64)
        short = [(i, windows(w, coef[len(w)])[0]) for i, w in enumerate(words) if 0 < len(w) < width]
        which = np.r_[which, np.array([i for i, _ in short], np.int64)].astype(np.int64)
        h = np.r_[h, np.array([x for _, x in short], np.uint64)]
        order = np.lexsort((h, which))
        which, h = which[order], h[order]
        fresh = np.r_[True, (which[1:] != which[:-1]) | (h[1:] != h[:-1])] if len(h) else np.zeros(0, bool)
        which, h = which[fresh], h[fresh]
        n = np.bincount(which, minlength=len(words))
        words.clear()
        return n, h

    def flush():
        done.append(sets())
        n, h = (np.concatenate(x) for x in zip(*done, strict=True))
        out = np.array(rids, np.int64), np.r_[0, np.cumsum(n)], h
        done.clear()
        rids.clear()
        return out

    for b in batches:
        for rid, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            w = memo.of((text.as_py() or "").encode("utf-8", "replace").lower().split())
            rids.append(rid)
            words.append(w)
            total += len(w) + 1
            held += len(w) + 1
            if total >= size:
                yield flush()
                total = held = 0
            elif held >= PIECE:
                done.append(sets())
                held = 0
    if rids:
        yield flush()


def least_overlap(n: int, percent: int) -> int:
    """A set of n needs so many shared shingles to link with anything."""
    return -(-percent * n // 100)


def _links(pairs: DataFrame, sets: DataFrame, percent: int, keep: tuple[str, str] = ("a", "b"), counts: bool = False) -> DataFrame:
    """Of distinct pairs (a, b) of set ids, those that link, by comparing whole sets; the columns ``keep`` as (a, b), with ``counts`` also n_common and n_union."""
    left = sets.select(F.col("gid").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("gid").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))

    def compare(batches):
        for batch in batches:
            a, b, common, union = [], [], [], []
            cols = [batch.column(i) for i in range(6)]
            for i in range(batch.num_rows):
                ta, tb = (np.frombuffer(cols[k][i].as_py(), "<u8") for k in (3, 5))
                both = len(np.intersect1d(ta, tb, assume_unique=True))
                either = cols[2][i].as_py() + cols[4][i].as_py() - both
                if 100 * both >= percent * either:
                    a.append(cols[0][i].as_py())
                    b.append(cols[1][i].as_py())
                    common.append(both)
                    union.append(either)
            out = {"a": a, "b": b} | ({"n_common": common, "n_union": union} if counts else {})
            yield pa.record_batch({k: pa.array(x, pa.int64()) for k, x in out.items()})

    joined = pairs.join(left, "a").join(right, "b").select(*(F.col(k).alias(f"k{i}") for i, k in enumerate(keep)), "na", "ta", "nb", "tb")
    return joined.mapInArrow(compare, "a long, b long" + ", n_common long, n_union long" * counts)


def _may_link(percent: int) -> str:
    """Size and positional filter on a shared shingle of groups x and y."""
    need = f"ceil({percent} * (x.n + y.n) / {100 + percent}D - 1e-9)"
    return f"100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n) AND 1 + least(x.n - x.pos - 1, y.n - y.pos - 1) >= {need}"


def near_duplicate_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 75) -> DataFrame:
    """(id_col, n_shingles long, component_id): one row per row of docs."""
    rows, plain = keyed(docs.select(F.col(id_col), F.col(text_col)), id_col, text_col)
    out = _rooted(rows, text_col, width, percent)
    if plain:
        kind = docs.schema[id_col].dataType
        return out.select(F.col("rid").cast(kind).alias(id_col), F.col("n").alias("n_shingles"), F.col("root").cast(kind).alias("component_id"))
    names = rows.select(F.col(RID).alias("rid"), F.col(id_col).alias("_id"))
    roots = names.select(F.col("rid").alias("root"), F.col("_id").alias("component_id"))
    return out.join(names, "rid").join(roots, "root").select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 75) -> DataFrame:
    """docs with only the first row of each component, all columns as they were."""
    rows, _ = keyed(docs, id_col, text_col)
    gone = _rooted(rows, text_col, width, percent).filter("rid <> root").select(F.col("rid").alias(RID))
    return rows.join(gone, RID, "left_anti").select(*docs.columns)


def near_duplicate_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 75) -> tuple[DataFrame, DataFrame]:
    """All links: pairs (a, b, n_common long, n_union long), a before b, of representatives, and (id_col, row long, representative long, n_shingles long).

    Rows with the same set are a class, and its first row represents it: rows of one class, of at least one shingle,
    link with each other, rows of two classes link where their representatives do.  ``row`` is the id where ids are
    unique integers, else a number of the row; a, b and representative are such rows.  Every candidate pair is compared,
    so unlike components the work grows with the square of a cluster's number of different sets.
    """
    rows, _ = keyed(docs.select(F.col(id_col), F.col(text_col)), id_col, text_col)
    found, sets = _distinct_sets(rows, text_col, width, percent)
    members, postings = _posted(sets, percent)
    across = postings.alias("x").join(postings.alias("y"), "token").filter(f"x.grp < y.grp AND {_may_link(percent)}").select(F.expr("x.grp").alias("ga"), F.expr("y.grp").alias("gb")).distinct()
    ma, mb = (members.select(F.col("grp").alias(g), F.col("gid").alias(m)) for g, m in (("ga", "x"), ("gb", "y")))
    inside = ma.join(mb, F.col("ga") == F.col("gb")).filter("x < y").select("x", "y")
    candidates = across.join(ma, "ga").join(mb, "gb").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).union(inside.toDF("a", "b"))
    pairs = cut(_links(candidates, sets, percent, counts=True))
    names = rows.select(F.col(id_col), F.col(RID).alias("rid"))
    known = found.select("rid", "n", "fp").join(sets.select("fp", "gid"), "fp", "left").select("rid", "n", F.coalesce("gid", "rid").alias("representative"))
    return pairs, names.join(known, "rid").select(id_col, F.col("rid").alias("row"), "representative", F.col("n").alias("n_shingles"))


def _rooted(rows: DataFrame, text_col: str, width: int, percent: int) -> DataFrame:
    """(rid, n, root) of keyed rows."""
    found, sets = _distinct_sets(rows, text_col, width, percent)
    by_fp = cut(sets.select("fp", "gid").join(_set_labels(sets, percent), "gid", "left").select("fp", F.coalesce("root", "gid").alias("root")))
    known = found.select("rid", "n", "fp").filter("fp IS NOT NULL").join(by_fp, "fp", "left").select("rid", "n", "root")
    alone = found.select("rid", "n", "fp").filter("fp IS NULL").select("rid", "n", F.col("rid").alias("root"))
    return known.union(alone)


def _distinct_sets(rows: DataFrame, text_col: str, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(rid, n, fp or null where nothing can link, tokens) of keyed rows, and (fp, gid, n, tokens) of each set that may link."""
    if width < 1 or not 0 < percent <= 100:
        raise ValueError("width must be positive and percent in 1..100")
    spark = rows.sparkSession
    bound_batches(spark)
    slim = rows.select(RID, F.col(text_col).alias("t"))
    size = slim.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    filt = build(slim, lambda bs: ((rids, h) for rids, _, h in shingle_sets(bs, width)), size // 6)

    def survivors(batches):
        import xxhash

        look = filt.reader()
        for rids, offsets, h in shingle_sets(batches, width):
            again = look(rids, h)
            n = np.diff(offsets)
            shared = np.diff(np.r_[0, np.cumsum(again)][offsets])
            fps, tokens, seen = [None] * len(rids), [None] * len(rids), set()
            for i in np.argsort(rids, kind="stable"):
                if n[i] and shared[i] >= least_overlap(int(n[i]), percent):
                    a, b = offsets[i], offsets[i + 1]
                    fps[i] = fp = xxhash.xxh3_128_digest(h[a:b].tobytes())
                    if fp not in seen:
                        seen.add(fp)
                        tokens[i] = h[a:b][again[a:b]].tobytes()
            yield pa.record_batch({"rid": pa.array(rids), "n": pa.array(n.astype(np.int64)), "fp": pa.array(fps, pa.binary()), "tokens": pa.array(tokens, pa.binary())})

    at = scratch_path(spark, "shingles")
    slim.mapInArrow(survivors, "rid long, n long, fp binary, tokens binary").write.parquet(at)
    found = spark.read.parquet(at)
    sets_at = scratch_path(spark, "sets")
    found.filter("tokens IS NOT NULL").groupBy("fp").agg(F.min("rid").alias("gid"), F.first("n").alias("n"), F.first("tokens").alias("tokens")).write.parquet(sets_at)
    return found, spark.read.parquet(sets_at)


def _posted(sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(gid, grp) of the sets in groups, and (token, grp, n, pos) of the groups' prefixes."""

    def tokens_of(batches):
        for b in batches:
            yield np.frombuffer(b"".join(b.column(0).to_pylist()), "<u8")

    total = sets.agg(F.sum(F.octet_length("tokens"))).first()[0] or 0
    rarity = sets.sparkSession.sparkContext.broadcast(frequencies(sets.select("tokens"), tokens_of, total // 8))

    def first_of(data: bytes, k: int) -> bytes:
        t = np.frombuffer(data, "<u8")
        return t[np.lexsort((t, rarity.value.of(t)))[:k]].tobytes() if k > 0 else b""

    def prefixes(batches):
        for b in batches:
            n, tokens = b.column(1).to_numpy(), b.column(2)
            cut_at = [int(n[i]) - least_overlap(int(n[i]), percent) + 1 for i in range(len(n))]
            unique = [int(n[i]) - len(tokens[i].as_py()) // 8 for i in range(len(n))]
            yield pa.record_batch({"gid": b.column(0), "n": b.column(1), "skip": pa.array(unique, pa.int64()), "prefix": pa.array([first_of(tokens[i].as_py(), c - s) for i, (c, s) in enumerate(zip(cut_at, unique, strict=True))], pa.binary())})

    def post(batches):
        for b in batches:
            arrays = [np.frombuffer(x.as_py(), "<i8") for x in b.column(3)]
            sizes = [len(a) for a in arrays]
            rep = lambda c: np.repeat(b.column(c).to_numpy(), sizes)
            pos = np.concatenate([np.arange(s) for s in sizes] or [np.zeros(0, np.int64)])
            yield pa.record_batch({"token": pa.array(np.concatenate(arrays or [np.zeros(0, np.int64)])), "grp": pa.array(rep(0)), "n": pa.array(rep(1)), "pos": pa.array((pos + rep(2)).astype(np.int64))})

    pre = sets.select("gid", "n", "tokens").mapInArrow(prefixes, "gid long, n long, skip long, prefix binary")
    groups = pre.filter("length(prefix) > 0").groupBy("n", "prefix").agg(F.min("gid").alias("grp"), F.first("skip").alias("skip"))
    groups = cut(groups)
    members = cut(pre.select("gid", "n", "prefix").join(groups.select("n", "prefix", "grp"), ["n", "prefix"]).select("gid", "grp"))
    postings = groups.select("grp", "n", "skip", "prefix").mapInArrow(post, "token long, grp long, n long, pos long")
    return members, cut(postings)


def _set_labels(sets: DataFrame, percent: int) -> DataFrame:
    """(gid, root): the smallest set id of each set's component; a set that is not returned is alone."""
    members, postings = _posted(sets, percent)
    pivots = cut(postings.groupBy("token").agg(F.min(F.struct("grp", "n", "pos")).alias("p"), F.count(F.lit(1)).alias("c")).filter("c > 1").select("token", "p.grp", "p.n", "p.pos"))
    met = postings.alias("x").join(pivots.alias("y"), "token").filter(f"x.grp <> y.grp AND {_may_link(percent)}").select(F.expr("x.grp").alias("grp"), F.expr("y.grp").alias("b")).distinct()
    pairs = met.join(members, "grp").select(F.col("gid").alias("a"), "b").union(members.filter("gid <> grp").select(F.col("gid").alias("a"), F.col("grp").alias("b")))
    labels = component_labels(_links(pairs, sets, percent), "a", "b").select(F.col("id").alias("gid"), F.col("component_id").alias("label"))
    # What no pivot has connected: every remaining pair of members of different components.
    named = cut(members.join(labels, "gid", "left").select("gid", "grp", F.coalesce("label", "gid").alias("label")))
    mixed_groups = named.groupBy("grp").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
    open_tokens = postings.join(mixed_groups, "grp").groupBy("token").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter("lo <> hi").select("token")
    live = cut(postings.join(open_tokens, "token").join(mixed_groups, "grp"))
    known = "x.lo = x.hi AND y.lo = y.hi AND x.lo = y.lo"  # all members of both groups are in one component already
    across = live.alias("x").join(live.alias("y"), "token").filter(f"x.grp < y.grp AND NOT ({known}) AND {_may_link(percent)}").select(F.expr("x.grp").alias("ga"), F.expr("y.grp").alias("gb")).distinct()
    inside = mixed_groups.filter("lo <> hi").select(F.col("grp").alias("ga"), F.col("grp").alias("gb"))
    ma = named.select(F.col("grp").alias("ga"), F.col("gid").alias("a"), F.col("label").alias("la"))
    mb = named.select(F.col("grp").alias("gb"), F.col("gid").alias("b"), F.col("label").alias("lb"))
    rest = across.union(inside).join(ma, "ga").join(mb, "gb").filter("la <> lb AND (ga < gb OR a < b)").select("a", "b", "la", "lb").distinct()
    merged = component_labels(_links(rest, sets, percent, ("la", "lb")), "a", "b").select(F.col("id").alias("label"), F.col("component_id").alias("root"))
    return named.join(merged, "label", "left").select("gid", F.coalesce("root", "label").alias("root"))
