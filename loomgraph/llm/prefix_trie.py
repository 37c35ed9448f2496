"""The trie of conversations: a node for each distinct sequence of first turns, with what shares it.

Texts never move.  A turn becomes a digest of (role, text) and a length before the first shuffle.  A node is named by its
depth and a polynomial of its turns' digests modulo 2^127 - 1, which can be carried over the border of a partition: turns
are dealt by ranges of (block, conversation, turn), so a conversation of any length is spread over tasks, and a table of
one row for each partition says what enters each of them.

Each task walks its turns and keeps a table of the nodes it has met, combined by name; a table that is full leaves as a
partial trie and a new one begins, so memory is bounded.  Partial tries are merged in rounds keyed by node, from many
slots to few to one: member counts add up, and the lists of conversations that end at a node stay in pieces.  A node
that a third of all conversations share is one row from each task.  The lists are hashed by a stream over sorted rows.

The roll-up from the leaves doubles its reach: after k rounds each node has the sums over its descendants within 2^k
levels and knows its ancestor 2^k levels up, so the number of rounds is the logarithm of the depth.

Defined results: turns of a conversation go by turn (null first); several with one number go by the digest of (role,
text), so that the order of rows never matters.  Null role and text are empty.  Rows without a conversation id belong to
no conversation.  Equal conversations are members of the same nodes.  An empty table has no nodes, not even a root.
"""

from __future__ import annotations

import hashlib
from copy import copy
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, cut, shuffle_partitions

PRIME = 2**127 - 1
BASE = int.from_bytes(hashlib.sha256(b"turns of a conversation").digest(), "big") % PRIME
ROOT = 1
#: Nodes and ends that a task holds before it lets them go as a partial trie.
HELD = 50_000
#: Partial tries that meet in one merge.
FAN_IN = 64
PARTIAL = "part int, node binary, parent binary, depth long, conv long, n long, chars long, ends array<long>"


def _name(state: int) -> bytes:
    return state.to_bytes(16, "big")


def _step(state: int, digest: int) -> int:
    return (state * BASE + digest) % PRIME


class Walk:
    """Where a walk through the sorted turns stands: conversation, own turns seen, node, and the first turns of its block."""

    def __init__(self, conv=None, block=None, first=(), seen=0, state=ROOT, depth=0):
        self.conv, self.block, self.first, self.seen, self.state, self.depth = conv, block, list(first), seen, state, depth

    def enter(self, conv: int, block: int, head: int) -> list[tuple[int, int]]:
        """Begins a conversation; the turns it takes from its block's first one."""
        if block != self.block:
            self.block, self.first = block, []
        self.conv, self.seen, self.state, self.depth = conv, 0, ROOT, 0
        return [] if conv == block else self.first[:head]

    def follow(self, digest: int) -> None:
        self.state, self.depth = _step(self.state, digest), self.depth + 1


def _runs(batches):
    """(block, conv, head, rows (digest, chars)) for each run of a conversation in a batch."""
    for b in batches:
        rows = zip(*(b.column(i).to_pylist() for i in range(5)), strict=True)
        for key, run in groupby(rows, key=lambda r: r[:3]):
            yield *key, [(int.from_bytes(r[3], "big") % PRIME, r[4]) for r in run]


def _summary(most: int):
    """One row for each partition: its first conversation, and its last one as a polynomial that any state can enter."""

    def run(batches):
        first = last = base = None
        for b in batches:
            part = b.column(5)[0].as_py() if b.num_rows else None
            for block, conv, head, rows in _runs([b]):
                if last is None or last[1] != conv:
                    alone = last is None
                    first = conv if alone else first
                    last = [block, conv, head, 0, 0, [], alone]
                    if base is None or base[0] != block:
                        base = [block, [], False]
                    if conv == block:
                        base = [block, [], alone]
                for digest, chars in rows:
                    last[3], last[4] = last[3] + 1, _step(last[4], digest)
                    if len(last[5]) < most:
                        last[5].append((digest, chars))
                if conv == block:
                    base[1] = last[5]
        if last is not None:
            turns = lambda rows: [{"x": _name(x), "chars": c} for x, c in rows]
            yield pa.RecordBatch.from_pylist([{"part": part, "first": first, "block": last[0], "conv": last[1], "head": last[2], "n": last[3], "v": _name(last[4]), "own": turns(last[5]), "alone": last[6], "base": turns(base[1]), "base_alone": base[2]}], schema=_SUMMARY)

    return run


_TURN = pa.list_(pa.struct([("x", pa.binary()), ("chars", pa.int64())]))
_SUMMARY = pa.schema([("part", pa.int32()), ("first", pa.int64()), ("block", pa.int64()), ("conv", pa.int64()), ("head", pa.int32()), ("n", pa.int64()), ("v", pa.binary()), ("own", _TURN), ("alone", pa.bool_()), ("base", _TURN), ("base_alone", pa.bool_())])
_SUMMARY_SQL = "part int, first long, block long, conv long, head int, n long, v binary, own array<struct<x binary, chars long>>, alone boolean, base array<struct<x binary, chars long>>, base_alone boolean"


def _entries(summaries: list, most: int) -> tuple[dict[int, Walk], dict[int, bool]]:
    """(what enters each partition, whether its last conversation ends there), from one row for each partition in order."""
    enters, ends, at, before = {}, {}, Walk(), None
    turns = lambda rows: [(int.from_bytes(r["x"], "big"), r["chars"]) for r in rows]
    for s in summaries:
        if before is not None:
            ends[before] = s.first != at.conv
        enters[s.part] = Walk(at.conv, at.block, at.first, at.seen, at.state, at.depth)
        goes_on = s.alone and s.conv == at.conv
        base = turns(s.base)
        if s.block == at.block and (not base or (s.base_alone and at.conv == s.block)):
            base = (at.first + base)[:most]
        if not goes_on:
            at.block = s.block
            at.first = [] if s.conv == s.block else base
            for digest, _ in at.enter(s.conv, s.block, s.head):
                at.follow(digest)
        at.first = base
        own = turns(s.own)
        skipped = min(max(0, s.head - at.seen), s.n) if s.conv != s.block else 0
        value = int.from_bytes(s.v, "big")
        for k, (digest, _) in enumerate(own[:skipped]):
            value -= digest * pow(BASE, s.n - 1 - k, PRIME)
        at.state = (at.state * pow(BASE, s.n - skipped, PRIME) + value) % PRIME
        at.depth += s.n - skipped
        at.seen += s.n
        before = s.part
    if before is not None:
        ends[before] = True
    return enters, ends


def _partial(enters: dict[int, Walk], ends: dict[int, bool], most: int):
    def run(batches):
        nodes: dict[int, list] = {}  # state -> parent, depth, smallest member, members, chars, ends
        held, at, part = 0, None, None

        def meet(parent, chars):
            known = nodes.get(at.state)
            if known is None:
                nodes[at.state] = [parent, at.depth, at.conv, 1, chars, []]
            else:
                known[3] += 1
                known[2] = min(known[2], at.conv)

        def move(digest, chars):
            parent = at.state
            at.follow(digest)
            meet(parent, chars)

        def end():
            if at.state not in nodes:  # met before the last table left
                nodes[at.state] = [None, at.depth, at.conv, 0, None, []]
            nodes[at.state][5].append(at.conv)

        def leave():
            rows = list(nodes.items())
            nodes.clear()
            for a in range(0, len(rows), 8_192):
                cols = list(zip(*[(part, _name(k), None if v[0] is None else _name(v[0]), *v[1:]) for k, v in rows[a : a + 8_192]], strict=True))
                kinds = [pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["part", "node", "parent", "depth", "conv", "n", "chars", "ends"])

        begun = False
        for b in batches:
            if not b.num_rows:
                continue
            if at is None:
                part = b.column(5)[0].as_py()
                at = copy(enters[part])
                at.first = list(at.first)
            for block, conv, head, rows in _runs([b]):
                if conv != at.conv:
                    if begun:  # else it ended in an earlier partition
                        end()
                        held += 1
                    taken = at.enter(conv, block, head)
                    meet(None, None)
                    for digest, chars in taken:
                        move(digest, chars)
                begun = True
                for digest, chars in rows:
                    at.seen += 1
                    if conv == block or at.seen > head:
                        move(digest, chars)
                    if conv == block and len(at.first) < most:
                        at.first.append((digest, chars))
                    if len(nodes) + held >= HELD:
                        yield from leave()
                        held = 0
        if at is not None:
            if ends[part]:
                end()
            yield from leave()

    return run


def _merged(tries: DataFrame, *by: str) -> DataFrame:
    """Partial tries with the same keys as one."""
    return tries.groupBy("node", *by).agg(F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.min("conv").alias("conv"), F.sum("n").alias("n"), F.max("chars").alias("chars"))


def prefix_trie(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", block: Column | None = None, head: Column | None = None, most_head: int = 0) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), one row for each node.

    conv_id is the smallest member, whatever conv_col is called.  With ``block`` and ``head`` (columns over conv_col) a
    conversation is rebuilt first: its first ``head`` turns are those of the conversation whose id is its block, as far as
    there are any, and its own turns follow from behind its own first ``head``.  head is most_head at most.
    """
    spark = conversations.sparkSession
    bound_batches(spark)
    if (block is None) != (head is None) or most_head < 0:
        raise ValueError("block and head go together, with the largest head")
    most = most_head
    ident = F.col(conv_col).cast("long")
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    digest = F.unhex(F.left(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256), F.lit(32)))
    turns = conversations.filter(ident.isNotNull()).select((ident if block is None else block.cast("long")).alias("block"), ident.alias("conv"), F.lit(0).alias("head") if head is None else F.least(F.greatest(head.cast("int"), F.lit(0)), F.lit(most)).alias("head"), digest.alias("x"), F.char_length(text).cast("long").alias("chars"), F.col(turn_col).alias("turn"))
    order = [F.col("block"), F.col("block") != F.col("conv"), F.col("conv"), F.col("turn").asc_nulls_first(), F.col("x")]
    dealt = turns.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    dealt = cut(dealt.select("block", "conv", "head", "x", "chars", F.spark_partition_id().alias("part")))
    summaries = sorted(dealt.mapInArrow(_summary(most), _SUMMARY_SQL).collect(), key=lambda s: s.part)  # one small row for each partition
    enters, ends = _entries(summaries, most)
    partial = cut(dealt.mapInArrow(_partial(enters, ends, most), PARTIAL))
    tries, slots = partial.drop("ends"), len(summaries)
    while slots > FAN_IN:
        slots = -(-slots // FAN_IN)
        tries = _merged(tries.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("int")), "part")
    nodes = cut(_merged(tries))
    children = nodes.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    above = nodes.select(F.col("node").alias("parent"), F.col("conv").alias("parent_conv_id"))
    known = nodes.join(children, "node", "left").join(above, "parent", "left")
    known = cut(known.withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    own = (F.col("n") - 1) * F.coalesce("chars", F.lit(0))
    totals = rolled_up(known.select("node", "parent", "depth", (F.col("n_children") == 0).cast("long").alias("n_leaves"), own.alias("saved_tokens")), ["n_leaves", "saved_tokens"])
    listed = partial.filter("size(ends) > 0").select("node", F.explode("ends").alias("conv")).repartition("node").sortWithinPartitions("node", "conv")
    lists = listed.mapInArrow(_hashed, "node binary, ends_sha256 string")
    out = known.join(totals, "node").join(lists, "node", "left")
    empty = hashlib.sha256(b"").hexdigest()
    return out.select(F.col("conv").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"))


def _hashed(batches):
    """SHA-256 of each node's sorted conversations, comma-joined, as they stream by."""
    here, sha = None, None
    for b in batches:
        out = []
        for node, run in groupby(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True), key=lambda r: r[0]):
            ids = ",".join(str(r[1]) for r in run).encode()
            if node == here:
                sha.update(b"," + ids)
            else:
                if sha is not None:
                    out.append((here, sha.hexdigest()))
                here, sha = node, hashlib.sha256(ids)
        yield pa.record_batch([pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.string())], names=["node", "ends_sha256"])
    if sha is not None:
        yield pa.record_batch([pa.array([here], pa.binary()), pa.array([sha.hexdigest()], pa.string())], names=["node", "ends_sha256"])


def rolled_up(nodes: DataFrame, sums: list[str]) -> DataFrame:
    """(node, sums): sums over each node's subtree, itself included, of nodes(node, parent, depth, sums)."""
    now = cut(nodes.select("node", F.col("parent").alias("up"), "depth", *sums))
    deepest = now.agg(F.max("depth")).first()[0] or 0
    reach = 1
    while reach <= deepest:
        told = now.filter("up IS NOT NULL").groupBy(F.col("up").alias("node")).agg(*[F.sum(c).alias(f"_{c}") for c in sums])
        summed = now.join(told, "node", "left").select("node", "up", "depth", *[(F.col(c) + F.coalesce(F.col(f"_{c}"), F.lit(0))).alias(c) for c in sums])
        reach *= 2
        if reach <= deepest:
            # Nodes nearer to the root have no ancestor that far up: with their own name, made longer, they meet nobody and no nulls pile up.
            jump = now.filter("up IS NOT NULL").select(F.col("node").alias("up"), F.col("up").alias("next"))
            far = F.when(F.col("depth") >= reach, F.col("up")).otherwise(F.concat("node", F.lit(b"-")))
            summed = summed.withColumn("up", far).join(jump, "up", "left").select("node", F.col("next").alias("up"), "depth", *sums)
        now = cut(summed)
    return now.select("node", *sums)
