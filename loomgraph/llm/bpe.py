"""Byte-level BPE as a streaming transducer with bounded lookahead, and decoding as a byte-to-text state machine.

Encoding
    Text goes through a stream encoder in blocks.  It is cut at added tokens, then into units (a run of white space with
    the run of other characters behind it), then by the pre-tokeniser's pattern; no merge crosses these cuts.  A cut is
    made once what has been seen decides it: the encoder holds back the start of a possible added token and the last
    unit; of a unit longer than WAIT characters it emits pieces, and of a piece that does not end it emits tokens.  There
    a transducer holds a buffer of bytes and emits a token once no continuation can change it.

    How far a continuation reaches back is computed from the merge list.  Apply the rules in order to a text and to
    a continuation of it, and call the front the place up to which both have the same tokens.  Rule (u, v) moves the
    front back only when it merges across it in one of the two, by at most len(u) bytes, and once per rule as equal
    neighbours merge from the left.  A later rule (u', v') can move it on only if v' starts at the new front, that is
    if u lies on the left spine of v'.  The longest chain of such rules, each of a later rank, weighed by len(u), is
    the sufficient lookahead: a token that ends that many bytes before the end of the buffer is stable.  Tokens
    behind a token border encode as they would alone, so the buffer restarts there and memory stays constant.

    Short units and pieces are memoised per worker; their number is bounded.  Of a run of texts, those not met before are
    first merged side by side, one rule in each of them a round; the stream encoder then finds them, or merges alone.

Decoding
    Tokens are mapped to bytes, and an incremental UTF-8 machine turns bytes to text, as the encoder emits them, a
    bounded run of tokens at a time; bytes that are not text become U+FFFD, as in the tokenizers library.

Defined results: null text counts as empty (no tokens); the file's added tokens inside a text become their ids.
Other columns than those named are not returned.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import struct
from functools import lru_cache
from itertools import pairwise, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import make_room

#: Fixed value: the splitting pattern of this family of byte-level tokenisers.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Fixed value: Unicode White_Space, as the pattern's \s.
_WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
UNIT = f"[{_WHITE}]*[^{_WHITE}]+|[{_WHITE}]+"
#: Units that are surely one piece: letters below U+0250, a blank before them or not.
WORD = " ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+"
MEMO, PIECE_MEMO, MEMO_CHARS, RUN = 300_000, 300_000, 64, 65_536
#: Characters of texts whose new pieces are merged side by side, and widths of these in bytes; longer pieces are merged alone.
LEARN, WIDTHS = 1 << 20, (0, 8, 12, 16, 24, 48)
#: Characters of text that the stream encoder takes at a time, and of a unit or piece that it waits for the end of.
BLOCK, WAIT = 4_096, 1_024


def byte_alphabet() -> dict[str, int]:
    """Character -> byte: printable Latin-1 stands for itself, the other bytes for U+0100 onwards in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Merges:
    """Vocabulary and merge list of a tokenizers file, by byte strings."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, alphabet = spec["model"], byte_alphabet()
        as_bytes = lambda s: bytes(alphabet[c] for c in s)
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        ids = {as_bytes(s): i for s, i in model["vocab"].items() if s not in self.added}
        self.byte_id = [ids[bytes([b])] for b in range(256)]
        self.bytes_of: list[bytes] = [b""] * (max([*ids.values(), *self.added.values()]) + 1)
        for s, i in ids.items():
            self.bytes_of[i] = s
        for s, i in self.added.items():
            self.bytes_of[i] = s.encode()
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for k, m in enumerate(model["merges"]):
            a, b = (as_bytes(x) for x in (m if isinstance(m, list) else m.split(" ")))
            self.rank.setdefault((ids[a], ids[b]), (k, ids[a + b]))
        #: The same rules as one number each, so that the lowest of a list is found at once: rank * base + token.
        self.base = len(self.bytes_of)
        self.rule = {pair: k * self.base + new for pair, (k, new) in self.rank.items()}
        self.none = (len(model["merges"]) + 1) * self.base
        #: The same rules as arrays, for many byte strings at once; ``base`` stands behind the end of a string.
        pairs = np.array([(a * (self.base + 1) + b, k, new) for (a, b), (k, new) in self.rank.items()], np.int64).reshape(-1, 3)
        pairs = pairs[np.argsort(pairs[:, 0])]
        self.pair = np.append(pairs[:, 0], np.iinfo(np.int64).max)
        self.rank_of_pair = np.append(pairs[:, 1], len(model["merges"])).astype(np.int32)
        self.made = np.zeros(len(model["merges"]), np.int32)
        self.made[pairs[:, 1]] = pairs[:, 2]
        end = [*self.byte_id, self.base]
        self.rank_of_bytes = self._ranks(np.repeat(end, 257), np.tile(end, 257)).reshape(257, 257)
        self.lookahead = self._lookahead()

    def _lookahead(self) -> int:
        """Bytes of the longest chain of rules that can pass a change on to the left."""
        made: dict[int, tuple[int, int]] = {}
        best: dict[int, int] = {}
        longest = 0
        for (u, v), (_, new) in self.rank.items():  # in order of rank
            reach, t = 0, v
            while True:
                reach = max(reach, best.get(t, 0))
                if t not in made:
                    break
                t = made[t][0]
            reach += len(self.bytes_of[u])
            best[u] = max(best.get(u, 0), reach)
            longest = max(longest, reach)
            made.setdefault(new, (u, v))
        return longest

    def merge(self, data: bytes) -> list[int]:
        """The tokens of a whole byte string: always the leftmost pair of lowest rank."""
        t = [self.byte_id[b] for b in data]
        rank = self.rank
        if len(t) <= 48:
            get, base, none = self.rule.get, self.base, self.none
            rules = list(map(get, pairwise(t), repeat(none)))  # of each pair; a merge changes those beside it
            while rules and (low := min(rules)) < none:
                i = rules.index(low)
                new = low % base
                t[i : i + 2] = [new]
                del rules[i]
                if i:
                    rules[i - 1] = get((t[i - 1], new), none)
                if i < len(rules):
                    rules[i] = get((new, t[i + 1]), none)
            return t
        n = len(t)
        after, before, live = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r[0], i, r[1], t[i], t[i + 1]) for i in range(n - 1) if (r := rank.get((t[i], t[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, new, a, b = heapq.heappop(heap)
            j = after[i] if live[i] else n
            if not live[i] or j >= n or t[i] != a or t[j] != b:
                continue
            t[i], live[j], after[i] = new, False, after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (r := rank.get((t[x], t[y]))):
                    heapq.heappush(heap, (r[0], x, r[1], t[x], t[y]))
        return [x for x, ok in zip(t, live, strict=True) if ok]


    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the rule of each pair of tokens; the number of all rules where there is none."""
        key = a.astype(np.int64) * (self.base + 1) + b
        at = np.searchsorted(self.pair, key)
        return np.where(self.pair[at] == key, self.rank_of_pair[at], self.rank_of_pair[-1])

    def merge_all(self, strings: list[bytes]) -> list[bytes]:
        """Of each string what merge() gives, as little-endian unsigned 32-bit ids: a round makes the next merge in all of them."""
        out = [b""] * len(strings)
        sizes, ids = np.fromiter(map(len, strings), np.int64, len(strings)), np.array([*self.byte_id, self.base], np.int32)
        for k in np.flatnonzero(sizes > WIDTHS[-1]).tolist():
            out[k] = np.array(self.merge(strings[k]), "<u4").tobytes()
        for least, width in pairwise(WIDTHS):
            chosen = np.flatnonzero((sizes > least) & (sizes <= width))
            laid = b"".join([strings[k].ljust(width, b"\0") for k in chosen.tolist()])
            given = np.full((len(chosen), width + 1), 256, np.int16)
            given[:, :-1] = np.frombuffer(laid, np.uint8).reshape(-1, width)
            given[np.arange(width + 1) >= sizes[chosen][:, None]] = 256
            t, ranks = ids[given], self.rank_of_bytes[given[:, :-1], given[:, 1:]]
            ends, rows = np.empty_like(t), np.arange(len(chosen))
            while len(rows):
                at = ranks.argmin(1)  # the leftmost of the lowest
                low = ranks[np.arange(len(rows)), at]
                go = low < self.rank_of_pair[-1]
                if not go.all():
                    ends[rows[~go]] = t[~go]
                    rows, t, ranks, at, low = rows[go], t[go], ranks[go], at[go], low[go]
                n, new = np.arange(len(rows)), self.made[low]
                behind = np.arange(width) > at[:, None]
                np.copyto(t[:, :-1], t[:, 1:], where=behind)
                np.copyto(ranks[:, :-1], ranks[:, 1:], where=behind[:, :-1])
                t[n, at] = new
                ranks[n, at] = self._ranks(new, t[n, at + 1])
                left = np.flatnonzero(at)
                ranks[left, at[left] - 1] = self._ranks(t[left, at[left] - 1], new[left])
            data, many = ends.astype("<u4").tobytes(), (ends != self.base).sum(1).tolist()
            for r, (k, m) in enumerate(zip(chosen.tolist(), many, strict=True)):
                out[k] = data[4 * r * (width + 1) : 4 * (r * (width + 1) + m)]
        return out


class Transducer:
    """Bytes in, stable tokens out; never holds more than about two lookaheads and a block."""

    def __init__(self, merges: Merges, block: int = 512):
        self.merges, self.block, self.buffer = merges, block, b""

    def feed(self, data: bytes) -> list[int]:
        out: list[int] = []
        for k in range(0, len(data), self.block):
            self.buffer += data[k : k + self.block]
            if len(self.buffer) >= self.merges.lookahead + self.block:
                stable, end = len(self.buffer) - self.merges.lookahead, 0
                for token in self.merges.merge(self.buffer):
                    size = len(self.merges.bytes_of[token])
                    if end + size > stable:
                        break
                    out.append(token)
                    end += size
                self.buffer = self.buffer[end:]
        return out

    def finish(self) -> list[int]:
        out, self.buffer = self.merges.merge(self.buffer), b""
        return out


class Encoder:
    """text -> ids (little-endian unsigned 32-bit)."""

    def __init__(self, path: str):
        import re

        import regex

        self.merges = Merges(path)
        self.piece = regex.compile(PATTERN)
        self.pieces = self.piece.findall
        self.units = re.compile(UNIT).findall
        self.word = re.compile(WORD).fullmatch
        self.unit_end = re.compile(f"(?s).*[^{_WHITE}](?=[{_WHITE}])")
        self.classes = [(True, regex.compile(r"\s+")), *((False, regex.compile(p)) for p in (r"\p{L}+", r"\p{N}+", r"[^\s\p{L}\p{N}]+"))]
        self.added = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.merges.added, key=len, reverse=True)) + ")") if self.merges.added else None
        self.longest_added = max(map(len, self.merges.added), default=0)
        self.machine = Transducer(self.merges)  # of pieces whose end is known; empty between them
        self.memo: dict[str, bytes] = {}
        self.piece_memo: dict[str, bytes] = {}
        self.old_memo, self.old_piece_memo = dict[str, bytes](), dict[str, bytes]()

    def learn(self, texts: list[str]) -> None:
        """Memoises the short units of some texts, whose pieces are merged all at once."""
        units: set[str] = set()
        for text in texts:
            units.update(self.units(text))
        if len(self.memo) >= MEMO // 2:  # half is forgotten, but for what is met again before the next time
            self.memo, self.old_memo = {}, self.memo
        if len(self.piece_memo) >= PIECE_MEMO // 2:
            self.piece_memo, self.old_piece_memo = {}, self.piece_memo
        memo, known = self.memo, self.piece_memo
        units.difference_update(memo)
        for u in units & self.old_memo.keys():
            memo[u] = self.old_memo[u]
        fresh = [u for u in units if u not in memo and len(u) <= MEMO_CHARS]
        pieces: list[str] = []
        ends = [len(pieces) for u in fresh if pieces.extend((u,) if self.word(u) else self.pieces(u)) is None]
        new = set(pieces).difference(known)
        for p in new & self.old_piece_memo.keys():
            known[p] = self.old_piece_memo[p]
        new = [p for p in new if p not in known]
        known.update(zip(new, self.merges.merge_all([p.encode("utf-8", "replace") for p in new]), strict=True))
        ids = list(map(known.__getitem__, pieces))
        memo.update(zip(fresh, [ids[a] if b - a == 1 else b"".join(ids[a:b]) for a, b in pairwise([0, *ends])], strict=True))

    def _unit(self, unit: str) -> bytes:
        got = self.memo.get(unit)
        if got is None:
            got = b"".join(map(self._piece, self.pieces(unit)))
            if len(unit) <= MEMO_CHARS:
                make_room(self.memo, MEMO)
                self.memo[unit] = got
        return got

    def _piece(self, piece: str) -> bytes:
        got = self.piece_memo.get(piece)
        if got is None:
            ids = self.machine.feed(piece.encode("utf-8", "replace"))
            ids += self.machine.finish()
            got = struct.pack(f"<{len(ids)}I", *ids)
            if len(piece) <= MEMO_CHARS:
                make_room(self.piece_memo, PIECE_MEMO)
                self.piece_memo[piece] = got
        return got

    def closed(self, text: str) -> bytes:
        """Tokens of a text that nothing continues, without added tokens."""
        units = self.units(text)
        try:
            return b"".join(map(self.memo.__getitem__, units))
        except KeyError:
            memo, unit = self.memo.get, self._unit
            return b"".join([memo(u) or unit(u) for u in units])

    def stream(self, text: str | None, block: int = BLOCK):
        """Tokens of a text, as they are emitted."""
        machine, text = StreamEncoder(self), text or ""
        for k in range(0, len(text) - block, block):
            if k and k % LEARN < block:  # the first run is learned with the texts around it
                self.learn([text[k : k + LEARN]])
            yield machine.feed(text[k : k + block])
        yield machine.finish(text[(max(len(text) - 1, 0)) // block * block :])

    def encode(self, text: str | None) -> bytes:
        return b"".join(self.stream(text))


class StreamEncoder:
    """Text in, stable tokens out (ids as in Encoder); holds about WAIT characters besides the block it was given."""

    def __init__(self, encoder: Encoder, wait: int = WAIT):
        self.encoder, self.wait, self.held = encoder, max(wait, 3), ""  # three characters tell a contraction
        self.machine: Transducer | None = None  # of a piece whose end has not come
        self.run = None  # (whether it is white space, pattern of its characters)

    def feed(self, text: str) -> bytes:
        self.held += text
        out: list[bytes] = []
        longest = self.encoder.longest_added
        while self.encoder.added and (m := self.encoder.added.search(self.held)) and m.start() + longest <= len(self.held):
            out.append(self._close(m.start()))
            out.append(self._ids([self.encoder.merges.added[m[0]]]))
            self.held = self.held[m.end() :]
        size = len(self.held) - max(longest - 1, 0)
        if size > 0:
            out.append(self._advance(size))
        return b"".join(out)

    def finish(self, text: str = "") -> bytes:
        self.held += text
        out: list[bytes] = []
        while self.encoder.added and (m := self.encoder.added.search(self.held)):
            out.append(self._close(m.start()))
            out.append(self._ids([self.encoder.merges.added[m[0]]]))
            self.held = self.held[m.end() :]
        out.append(self._close(len(self.held)))
        self.held = ""
        return b"".join(out)

    @staticmethod
    def _ids(ids: list[int]) -> bytes:
        return np.array(ids, "<u4").tobytes()

    def _leave(self, part: str) -> tuple[bytes, int]:
        """The rest of the open piece, and where in part it ends; part goes on behind it or nothing follows."""
        white, pattern = self.run
        m = pattern.match(part)
        end = m.end() if m else 0
        if white and end < len(part):  # the last of the white space goes to what follows
            end -= 1
        out = self.machine.feed(part[:end].encode("utf-8", "replace")) + self.machine.finish()
        self.machine = self.run = None
        return self._ids(out), end

    def _close(self, size: int) -> bytes:
        """Tokens of the first ``size`` characters held, which nothing continues; they stay held."""
        part, out = self.held[:size], b""
        if self.machine:
            out, end = self._leave(part)
            part = part[end:]
        return out + self.encoder.closed(part)

    def _advance(self, size: int) -> bytes:
        """Tokens of the first ``size`` characters held, as far as they do not depend on what follows; lets go of what they cover."""
        out: list[bytes] = []
        at = 0
        if self.machine:
            white, pattern = self.run
            m = pattern.match(self.held, 0, size)
            if m and m.end() == size:
                keep = size - white
                out.append(self._ids(self.machine.feed(self.held[:keep].encode("utf-8", "replace"))))
                self.held = self.held[keep:]
                return out[0]
            found, at = self._leave(self.held[:size])
            out.append(found)
        if m := self.encoder.unit_end.match(self.held, at, size):
            out.append(self.encoder.closed(self.held[at : m.end()]))
            at = m.end()
        if size - at > self.wait:
            for m in self.encoder.piece.finditer(self.held, at, size):
                # A piece depends on the character behind it, on one more where white space ends, and on three from its start.
                if m.end() + 2 > size or m.start() + 3 > size:
                    if m.end() == size and size - m.start() > self.wait:
                        self.run = next((w, p) for w, p in self.encoder.classes if p.match(self.held, size - 1, size))
                        self.machine = Transducer(self.encoder.merges)
                        keep = size - self.run[0]
                        out.append(self._ids(self.machine.feed(self.held[m.start() : keep].encode("utf-8", "replace"))))
                        at = keep
                    break
                out.append(self.encoder._unit(m[0]) if m.end() - m.start() <= MEMO_CHARS else self._whole(m[0]))
                at = m.end()
        self.held = self.held[at:]
        return b"".join(out)

    def _whole(self, piece: str) -> bytes:
        machine = Transducer(self.encoder.merges)
        return self._ids(machine.feed(piece.encode("utf-8", "replace")) + machine.finish())


@lru_cache(maxsize=2)
def encoder_of(path: str) -> Encoder:
    """One encoder per Python worker, kept from task to task."""
    return Encoder(path)


class Decoder:
    """ids -> text, as they come and a bounded run of tokens at a time."""

    def __init__(self, merges: Merges):
        self.laid = np.frombuffer(b"".join(merges.bytes_of), np.uint8)
        self.sizes = np.fromiter(map(len, merges.bytes_of), np.int32, len(merges.bytes_of))
        self.starts = np.cumsum(self.sizes, dtype=np.int32) - self.sizes
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: bytes):
        numbers = np.frombuffer(ids, "<u4")
        for k in range(0, len(numbers), RUN):
            some = numbers[k : k + RUN]
            sizes = self.sizes[some]
            ends = np.cumsum(sizes, dtype=np.int32)
            at = np.repeat(self.starts[some] - ends + sizes, sizes)
            at += np.arange(len(at), dtype=np.int32)
            yield self.machine.decode(self.laid[at].tobytes())

    def finish(self) -> str:
        """What an unfinished character at the end gives; ready for the next text."""
        out = self.machine.decode(b"", final=True)
        self.machine.reset()
        return out

    def runs(self, ids: bytes):
        yield from self.feed(ids)
        yield self.finish()


def learned(encoder: Encoder, texts):
    """The texts of an Arrow column, once the encoder has learned from a run of them."""
    run, size = [], 0
    for t in texts:
        run.append(t.as_py() or "")
        size += len(run[-1])
        if size >= LEARN:
            encoder.learn([x[:LEARN] for x in run])
            yield from run
            run, size = [], 0
    encoder.learn([x[:LEARN] for x in run])
    yield from run


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids array<long>)."""

    def run(batches):
        encoder = encoder_of(path)
        for b in batches:
            ids = [np.frombuffer(encoder.encode(t), "<u4").astype(np.int64) for t in learned(encoder, b.column(1))]
            yield pa.record_batch([b.column(0), pa.array(ids, pa.list_(pa.int64()))], names=[id_col, "ids"])

    slim = docs.select(F.col(id_col), F.col(text_col))
    return slim.mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, ids array<bigint>")


def decode(tokens: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id_col, text); null ids give empty text."""

    def run(batches):
        decoder = Decoder(encoder_of(path).merges)
        for b in batches:
            texts = ["".join(decoder.runs(np.array(i.as_py() or [], "<u4").tobytes())) for i in b.column(1)]
            yield pa.record_batch([b.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    slim = tokens.select(F.col(id_col), F.col(ids_col))
    return slim.mapInArrow(run, f"`{id_col}` {tokens.schema[id_col].dataType.simpleString()}, text string")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens, ids_sha256, decoded_sha256): encodes and decodes in one pass over the texts, no shuffle."""

    def run(batches):
        encoder = encoder_of(path)
        decoder = Decoder(encoder.merges)
        for b in batches:
            n, a, d = [], [], []
            for t in learned(encoder, b.column(1)):
                count, hashed, text = 0, hashlib.sha256(), hashlib.sha256()
                for ids in encoder.stream(t):
                    count += len(ids) // 4
                    hashed.update(ids)
                    for part in decoder.feed(ids):
                        text.update(part.encode())
                text.update(decoder.finish().encode())
                n.append(count)
                a.append(hashed.hexdigest())
                d.append(text.hexdigest())
            yield pa.record_batch([b.column(0), pa.array(n, pa.int64()), pa.array(a), pa.array(d)], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    slim = docs.select(F.col(id_col), F.col(text_col))
    return slim.mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
