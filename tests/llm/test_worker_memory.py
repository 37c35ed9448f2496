"""What the kernels of near and passage dedup hold in a worker besides their input and result (finding of round 4: pipeline, memory of an executor)."""

import tracemalloc

import numpy as np
import pyarrow as pa

from loomgraph.llm import packing
from loomgraph.llm.common import _KEPT, STRETCH, coefficients, kept, mixed, windows, word_hashes
from loomgraph.llm.jaccard import shingle_sets
from loomgraph.llm.sketch import Repeats
from loomgraph.llm.substring_dedup import chunks, starts_in

MB = 1 << 20


def peak(f):
    tracemalloc.start()
    try:
        f()
        return tracemalloc.get_traced_memory()[1] / MB
    finally:
        tracemalloc.stop()


def whole(w, coef):
    h = sum((w[j : len(w) - len(coef) + 1 + j] * c for j, c in enumerate(coef)), np.zeros(max(len(w) - len(coef) + 1, 0), np.uint64))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def test_hashes_by_stretches_equal_those_of_the_whole_and_hold_little():
    coef = coefficients(20, 11)
    for n in (0, 5, 20, STRETCH + 18, STRETCH + 19, STRETCH + 20, 3 * STRETCH):
        w = np.random.default_rng(n).integers(0, 2**63, n, dtype=np.uint64)
        if n >= 20:
            assert np.array_equal(windows(w, coef), whole(w, coef))
        assert len(windows(w, coef)) == max(n - 19, 0) and len(mixed(w)) == n
    w = np.random.default_rng(1).integers(0, 2**63, MB, dtype=np.uint64)
    assert peak(lambda: windows(w, coef)) < 12  # the result has 8
    assert peak(lambda: mixed(w)) < 12


def test_looking_up_repeats_holds_little():
    keys = np.arange(MB, dtype=np.uint64)
    sketch = Repeats("none", 40)
    cells = np.unique(sketch.cells(keys[::3]))
    whole = np.isin(sketch.cells(keys), cells)
    look = lambda: sketch.among(cells, keys)
    assert np.array_equal(look(), whole)
    assert not sketch.among(cells[:0], keys).any()
    assert peak(look) < 8


def test_no_chunk_is_held_while_the_next_is_gathered():
    texts = [" ".join(f"w{(i * 7919 + j) % 5000}" for j in range(1000)) for i in range(1200)]
    batches = [pa.record_batch({"r": pa.array(range(k, k + 100)), "t": pa.array(texts[k : k + 100])}) for k in range(0, 1200, 100)]
    word_hashes().of([f"w{i}".encode() for i in range(5000)])
    coef, seen = coefficients(20, 11), []

    def passages():
        for _, offsets, w in chunks(batches, 400_000):
            seen.append(len(windows(w, coef)[starts_in(offsets, 20)]))

    assert peak(passages) < 17  # a chunk's hashes are 3 MB
    assert sum(seen) == 1200 * 981
    sets = []
    assert peak(lambda: sets.extend(len(h) for _, _, h in shingle_sets(batches, 5, 400_000))) < 20
    assert sum(sets) == 1200 * 996


def test_a_worker_keeps_one_thing(monkeypatch):
    memo = word_hashes()
    assert word_hashes() is memo and kept("words", list) is memo
    monkeypatch.setattr(packing, "PieceEncoder", lambda path: [path])
    encoder = packing.encoder_of("some.json")
    assert packing.encoder_of("some.json") is encoder and list(_KEPT.values()) == [encoder]
    assert packing.encoder_of("other.json") == ["other.json"] and len(_KEPT) == 1
    assert word_hashes() is not memo and len(_KEPT) == 1
