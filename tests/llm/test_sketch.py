"""The sparse count-min sketch: nothing that repeats is lost, little else is let through, and other chunks fall back safely."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from loomgraph.llm import sketch

N = 3_000


def reader_of_chunks():
    """A function of its own, since workers don't import test modules: each batch is a chunk."""

    def keys_of(batches):
        for b in batches:
            rids = b.column(0).to_numpy()
            yield rids, np.concatenate([np.array(x.as_py(), np.uint64) for x in b.column(1)] or [np.zeros(0, np.uint64)])

    return keys_of


def judged(df, repeats):
    keys_of = reader_of_chunks()

    def run(batches):
        look = repeats.reader()
        for b in batches:
            rids, keys = next(keys_of([b]))
            yield pa.record_batch({"key": pa.array(keys.astype(np.int64)), "again": pa.array(look(rids, keys))})

    return [(r.key, r.again) for r in df.mapInArrow(run, "key long, again boolean").collect()]


@pytest.mark.parametrize("range_keys", [1 << 20, 500])
def test_sketch_counts_over_chunks(spark, monkeypatch, range_keys):
    monkeypatch.setattr(sketch, "RANGE_KEYS", range_keys)
    rng = np.random.default_rng(3)
    rows = [(i, [int(x) for x in rng.integers(0, 2**62, 4)] + [int(x) for x in rng.integers(0, 300, 1)]) for i in range(N)]
    df = spark.createDataFrame(rows, "rid long, keys array<long>").repartition(3, "rid").sortWithinPartitions("rid")
    df = df.checkpoint()
    true = Counter(k for _, row in rows for k in row)
    repeats = sketch.build(df, reader_of_chunks(), 5 * N)
    got = judged(df, repeats)
    assert len(got) == 5 * N and all(again for k, again in got if true[k] > 1)
    once = [again for k, again in got if true[k] == 1]
    assert sum(once) < 0.12 * len(once)
    other = judged(df.repartition(2, "keys"), repeats)  # chunks that were never counted
    assert len(other) == 5 * N and all(again for k, again in other if true[k] > 1)


def test_sketch_of_nothing(spark):
    df = spark.createDataFrame([], "rid long, keys array<long>")
    assert judged(df, sketch.build(df, reader_of_chunks(), 0)) == []


def test_frequencies_add_up(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [int(x) for x in rng.zipf(1.5, 6) % 500]) for i in range(800)]
    df = spark.createDataFrame(rows, "rid long, keys array<long>").repartition(5)
    true = Counter(k for _, row in rows for k in row)
    table = sketch.frequencies(df.select("keys"), lambda bs: (np.concatenate([np.array(x.as_py(), np.uint64) for x in b.column(0)]) for b in bs), 4_800)
    found = table.of(np.array(list(true), np.uint64))
    assert all(f >= min(true[k], 65_535) for f, k in zip(found, true, strict=True)) and sum(f > true[k] for f, k in zip(found, true, strict=True)) < 0.2 * len(true)
