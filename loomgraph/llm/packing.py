"""Best-fit packing of tokenised documents into sequences, planned on the length histogram.

Documents are tokenised once, cut into pieces of at most ``capacity`` tokens, and described by one small row per
piece.  Best-fit decreasing then runs over the counts per length (at most ``capacity`` numbers, whatever the input)
and yields runs: items of one length, by rank, into consecutive sequences at one offset.  A piece takes its slot by
joining the runs on length and rank within length.  Ranks are counted in hashed buckets of each length, with
offsets from the bucket counts, so no task ever holds all pieces of a common length.

Defined results: null text is an empty text, one piece holding just the end id; ids that repeat or are null are
documents of their own (their pieces are told apart by row); an empty table gives an empty table.  Only the id is
returned besides the result columns.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from bisect import bisect_left, insort
from itertools import filterfalse, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bpe import byte_alphabet
from .common import RID, cut, kept, keyed, make_room, shuffle_partitions

#: Pieces whose ids a Python worker remembers.
MEMO = 400_000
#: How this tokeniser splits normalised text (letters, numbers and white space are filled in).
PIECES = "'s|'t|'re|'ve|'m|'ll|'d|[{L}]+|[{N}]|[^{S}{L}{N}]+"
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Runs up to this number are broadcast (40 bytes each); beyond it they are joined by a shuffle.
BROADCAST_RUNS = 100_000


def plan_best_fit(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Runs (length, first rank, end rank, first sequence, offset) and the number of sequences."""
    free: dict[int, list[tuple[int, int]]] = {}
    rooms: list[int] = []
    runs, sequences = [], 0

    def put(room: int, first: int, n: int) -> None:
        if room:
            if room not in free:
                free[room] = []
                insort(rooms, room)
            free[room].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            k = bisect_left(rooms, length)
            if k < len(rooms):
                room = rooms[k]
                first, n = free[room].pop()
                take = min(n, left)
                if take < n:
                    free[room].append((first + take, n - take))
                elif not free[room]:
                    del free[room], rooms[k]
            else:
                room, first, take = capacity, sequences, -(-left // (capacity // length))
                sequences += take
            runs.append((length, rank, rank + take, first, capacity - room))
            put(room - length, first, take)
            rank, left = rank + take, left - take
    return runs, sequences


class PieceEncoder:
    """Ids of texts by the tokenizers library, at a fraction of its calls.

    The tokeniser normalises and splits a text, drops white space, and merges within each piece.  Below U+0250 (but for
    three letters whose lower case lies outside) normalising is lower-casing character by character, so texts are split
    here by the tokeniser's own pattern, and only pieces not met before go to the library: byte-mapped, joined by
    blanks, GROUP at once, told apart by their end-of-word tokens.  Words with other characters or with an added token
    go to the whole tokeniser.
    """

    GROUP = 20_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.merger = Tokenizer.from_file(path), Tokenizer.from_file(path)
        for t in (self.tokenizer, self.merger):
            t.no_truncation()
            t.no_padding()
        self.merger.normalizer = None
        self.merger.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for s, i in vocab.items() if s.endswith("</w>")]] = True
        self.mapped = {b: c for c, b in byte_alphabet().items() if b != 0x20}
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        beyond = re.compile("[\u0130\u023a\u023e\u0250-\U0010ffff]").search
        self.odd = lambda text: any(map(text.__contains__, added)) or not text.isascii() and beyond(text) is not None
        of = lambda kind: re.escape("".join(chr(c) for c in range(0x250) if unicodedata.category(chr(c))[0] == kind))
        self.split = re.compile(PIECES.format(L=of("L"), N=of("N"), S=SPACE)).findall
        self.runs = re.compile(f"[^{SPACE}]+").findall
        self.memo: dict[str, bytes] = {}

    def _learn(self, fresh: list[str]) -> None:
        make_room(self.memo, MEMO)
        for k in range(0, len(fresh), self.GROUP):
            part = fresh[k : k + self.GROUP]
            text = " ".join(part).encode().decode("latin-1").translate(self.mapped)
            ids = np.array(self.merger.encode(text, add_special_tokens=False).ids, "<u4")
            ends = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            data, last = ids.tobytes(), 0
            for p, e in zip(part, ends, strict=True):
                self.memo[p] = data[4 * last : 4 * e]
                last = e

    def _plain(self, text: str) -> bytes:
        pieces = self.split(text.lower())
        if fresh := list(filterfalse(self.memo.__contains__, set(pieces))):
            self._learn(fresh)
        try:
            return b"".join(map(self.memo.__getitem__, pieces))
        except KeyError:  # what this text needs was forgotten to make room
            self.memo.clear()
            return self._plain(text)

    def encode(self, text: str | None) -> bytes:
        text = text or ""
        if not self.odd(text):
            return self._plain(text)
        out: list[bytes] = []
        for odd, words in groupby(self.runs(text), self.odd):
            if odd:
                out += [np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, "<u4").tobytes() for w in words]
            else:
                out.append(self._plain(" ".join(words)))
        return b"".join(out)


def encoder_of(path: str) -> PieceEncoder:
    """The worker's encoder."""
    return kept(f"encoder of {path}", lambda: PieceEncoder(path))


def token_pieces(docs: DataFrame, path: str, capacity: int, end_id: int) -> DataFrame:
    """(rid, id, piece, start, length, ids_crc32) from (rid, id, text)."""

    def run(batches):
        encoder = encoder_of(path)
        end = end_id.to_bytes(4, "little")
        for b in batches:
            rid, ids, piece, start, length, crc = [], [], [], [], [], []
            for r, i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                data = encoder.encode(t.as_py()) + end
                for k in range(0, len(data), 4 * capacity):
                    part = data[k : k + 4 * capacity]
                    rid.append(r)
                    ids.append(i)
                    piece.append(k // (4 * capacity))
                    start.append(k // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.record_batch([pa.array(rid, pa.int64()), pa.array(ids, b.schema.field(1).type), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["rid", "id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("rid", "id", "text").mapInArrow(run, f"rid bigint, id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def pack_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """(id_col, piece, start, length, ids_crc32, sequence_id, offset): one row per piece."""
    spark = docs.sparkSession
    rows, _ = keyed(docs.select(id_col, text_col), id_col, text_col)
    pieces = cut(token_pieces(rows.select(F.col(RID).alias("rid"), F.col(id_col).alias("id"), F.col(text_col).alias("text")), path, capacity, end_id))
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most capacity rows
    runs, _ = plan_best_fit(counts, capacity)
    buckets = max(4 * shuffle_partitions(spark), sum(counts.values()) // 20_000)
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("rid", "piece"), F.lit(buckets)))
    per = dealt.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = per.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))).select("length", "bucket", F.coalesce("before", F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("rid", "piece")) - 1
    ranked = dealt.withColumn("within", within).join(cut(before), ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("within"))
    slots = spark.createDataFrame(runs, "length long, lo long, hi long, first long, offset long")
    if len(runs) <= BROADCAST_RUNS:
        slots = F.broadcast(slots)
    placed = ranked.join(slots, (ranked["length"] == slots["length"]) & (ranked["rank"] >= slots["lo"]) & (ranked["rank"] < slots["hi"]))
    return placed.select(F.col("id").alias(id_col), "piece", "start", ranked["length"], "ids_crc32", (F.col("first") + F.col("rank") - F.col("lo")).alias("sequence_id"), "offset")
