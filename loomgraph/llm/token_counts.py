"""Token counts of a unigram tokeniser without tokenising: count-only Viterbi over Aho-Corasick matches.

The automaton yields, for each end position, the vocabulary pieces that end there, longest first.  Dynamic programming
keeps, per position, the best score and the number of pieces on the best path, nothing else.  A candidate replaces the
best only if its score is strictly greater, and longer pieces come first: the tokeniser visits starts in ascending
order with the same rule, so ties fall alike.  A character without a one-character piece may be unknown, at the lowest
score less 10; unknown characters count as their bytes with byte fallback, else a run of them is one token.

What is counted: the pieces on the best path of the unigram model that has the given pieces and scores, which is what the
sentencepiece library counts for a model of type unigram without a normaliser.  A file of type BPE has ranks for scores and
another algorithm; of such a file this takes pieces and ranks as the unigram vocabulary, and the counts are not those of
the file's own BPE (on prose mostly higher, by 10 to 16 % in samples).  The query does so, as no unigram file is at hand.

Text is the tokeniser's: blanks become U+2581, with one in front.  Where no piece holds U+2581 behind another
character and all scores are whole numbers (their sums are then exact in any order), the best path splits at each such
mark, so counts of units are memoised per worker; otherwise a text is one unit.

Defined results: null text counts as empty, which has no tokens.  Other columns are not returned.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import make_room

MARK, MEMO = "▁", 400_000


class Unigram:
    """pieces: (string, score) by id."""

    def __init__(self, pieces: list[tuple[str, float]], unk_id: int = 0, byte_fallback: bool = True):
        self.pieces, self.unk_id = pieces, unk_id
        known = {p for p, _ in pieces}
        self.bytes_known = byte_fallback and all(f"<0x{b:02X}>" in known for b in range(256))
        self.splits = not any(MARK in p.lstrip(MARK) for p in known) and MARK in known and all(float(s).is_integer() for _, s in pieces)
        self.unknown_score = min(s for _, s in pieces) - 10.0

    @classmethod
    def from_sentencepiece(cls, path: str) -> Unigram:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        return cls([(m.id_to_piece(i), m.get_score(i)) for i in range(m.get_piece_size())], m.unk_id())

    def counter(self):
        """A function from text to its number of tokens."""
        import re

        import ahocorasick

        machine = ahocorasick.Automaton()
        for p, s in self.pieces:
            if p and p not in machine:
                machine.add_word(p, (len(p), s))
        machine.make_automaton()
        bytes_known, unknown = self.bytes_known, self.unknown_score

        def viterbi(text: str) -> int:
            n = len(text)
            best, count, open_run = [0.0] + [None] * n, [0] * (n + 1), [False] * (n + 1)
            matches = iter(machine.iter(text))
            at = next(matches, None)
            for end in range(1, n + 1):
                top = None
                single = False
                while at is not None and at[0] == end - 1:
                    size, score = at[1]
                    start = end - size
                    single |= size == 1
                    value = score + best[start]
                    if top is None or value > top:
                        top, c, run = value, count[start] + 1, False
                    at = next(matches, None)
                if not single:
                    value = unknown + best[end - 1]
                    if top is None or value > top:
                        top, run = value, True
                        c = count[end - 1] + (len(text[end - 1].encode("utf-8", "replace")) if bytes_known else 0 if open_run[end - 1] else 1)
                best[end], count[end], open_run[end] = top, c, run
            return count[n]

        if not self.splits:
            return lambda text: viterbi(MARK + text.replace(" ", MARK)) if text else 0
        units = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+").findall
        memo: dict[str, int] = {}

        def unit(u: str) -> int:
            got = viterbi(u)
            if len(u) <= 64:
                make_room(memo, MEMO)
                memo[u] = got
            return got

        def whole(text: str) -> int:
            get = memo.get
            return sum([get(u) or unit(u) for u in units(MARK + text.replace(" ", MARK))]) if text else 0

        return whole


@lru_cache(maxsize=2)
def counter_of(path: str):
    """One counter per Python worker, kept from task to task."""
    return Unigram.from_sentencepiece(path).counter()


def count_tokens(docs: DataFrame, model: Unigram | str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens long).  model: a Unigram, or the path of a sentencepiece model whose pieces and scores are used."""

    def run(batches):
        count = counter_of(model) if isinstance(model, str) else model.counter()
        for b in batches:
            n = [count(t.as_py() or "") for t in b.column(1)]
            yield pa.record_batch([b.column(0), pa.array(n, pa.int64())], names=[id_col, "n_tokens"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_tokens bigint")
