"""The pipeline and its quality, near-duplicate and packing stages against brute force, nulls and empty tables included."""

import random
import zlib

import numpy as np
from test_links import brute
from test_llm import WORDS, corpus, naive_windows, normal, shingles
from tokenizers import Tokenizer

import corpus_pipeline
from loomgraph.llm import quality
from loomgraph.llm.queries import TRAIN_ROWS, tokenizer

SHAPE = "doc_id long, text string, lang string, source string, n_chars long"


def tables(spark, path, texts, empty=False):
    d = f"file://{path}"
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in texts], SHAPE)
    docs.write.parquet(f"{d}/documents.parquet")
    labels = [] if empty else [(i, int(i < 500), 0) for i, _ in texts if i is not None and i % 3] + [(None, 1, 0), (1, None, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return docs, d


def texts():
    rng = random.Random(12)
    base = [" ".join(rng.choices([w + c for w in WORDS for c in "abcdef"], k=60)) for _ in range(30)]
    near = [" ".join([*t.split()[:-1], "other"]) for t in base[:8]]
    shared = [f"{' '.join(base[20 + k].split()[:40])} {' '.join(rng.choices(WORDS, k=60))}" for k in range(4)]
    good = [*base, *near, *base[:4], *(t.replace(" ", "\n ") for t in base[4:8]), *shared]
    bad = [" ".join(w + "###" for w in rng.choices(WORDS, k=60)) for _ in range(20)]
    return [*enumerate(good, 1), *enumerate(bad, 500), (900, None), (901, ""), (902, " \n ")]


def without_near(rows):
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in brute({i: shingles(t) for i, t in rows}):
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return [(i, t) for i, t in rows if find(i) == i]


def without_copies(rows):
    first = {}
    for i, t in sorted(rows):
        first.setdefault(normal(t), i)
    return [(i, t) for i, t in rows if first[normal(t)] == i]


def without_passages(rows, width=20):
    gone = naive_windows(rows, width)
    return [(i, " ".join(x for k, x in enumerate(t.split()) if k not in gone[i]) if gone[i] else t) for i, t in rows]


def pieces(rows, size=2048):
    t = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    out = {}
    for i, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), size):
            part = ids[k : k + size]
            out[i, k // size] = (k, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    return out


def placed(got):
    """Pieces as returned, after a check that sequences hold them without gap or overlap."""
    room = {}
    for r in got:
        room.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for items in room.values():
        at = 0
        for o, n in sorted(items):
            assert o == at
            at += n
        assert at <= 2048
    found = {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got}
    assert len(found) == len(got)
    return found


def judged(spark, docs, d):
    """Ids that the model keeps, by its scores."""
    scored = quality.score_quality(docs, spark.read.parquet(f"{d}/labels.parquet"), train_filter=TRAIN_ROWS).collect()
    assert len(scored) == docs.count()
    return {r.doc_id for r in scored if r.score >= 0.3}


def test_run_against_brute_force(spark, tmp_path):
    rows = texts()
    docs, d = tables(spark, tmp_path, rows)
    kept = judged(spark, docs, d)
    assert {i for i, _ in rows if i < 500} <= kept and not kept & set(range(500, 520))
    left = [(i, t) for i, t in rows if i in kept]
    out = corpus_pipeline.quality_stage(spark, docs, d)
    assert out.columns == docs.columns and sorted((r.doc_id, r.text) for r in out.collect() if r.text) == sorted((i, t) for i, t in left if t)
    assert {r.doc_id for r in out.collect()} == kept
    near = corpus_pipeline.near_stage(spark, docs, d)
    assert near.columns == docs.columns and {r.doc_id: r.text for r in near.collect()} == dict(without_near(rows))
    assert placed(corpus_pipeline.packing_stage(spark, docs, d).collect()) == pieces(rows)
    last = left
    for step in (without_copies, without_near, without_passages):
        last = step([(i, t or "") for i, t in last])
    assert placed(corpus_pipeline.run(spark, d).collect()) == pieces(last)
    assert len(last) < len(left) and dict(last) != {i: t for i, t in left if i in dict(last)}


def test_run_on_odd_and_empty_tables(spark, tmp_path):
    odd = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "g h i"), (None, None)]
    _, d = tables(spark, tmp_path / "odd", odd, empty=True)  # no labels: every score is 0.5
    assert sorted(str(r.doc_id) for r in corpus_pipeline.run(spark, d).collect()) == ["1", "None", "None"]
    _, d = tables(spark, tmp_path / "none", [], empty=True)
    assert corpus_pipeline.run(spark, d).collect() == []
