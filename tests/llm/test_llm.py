import base64
import hashlib
import itertools
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from loomgraph.llm import bm25, bpe, exact_dedup, jaccard, packing, quality, sharding, substring_dedup, token_counts, warc
from loomgraph.llm.queries import tokenizer

WORDS = "the of a in to alpha beta gamma delta eps zeta eta theta iota".split()


def corpus(seed, n=60):
    rng = random.Random(seed)
    base = [" ".join(rng.choices(WORDS, k=rng.randrange(0, 70))) for _ in range(n // 2)]
    out = []
    for i in range(n):
        t = rng.choice(base)
        w = t.split()
        if w and rng.random() < 0.6:
            w[rng.randrange(len(w))] = rng.choice(WORDS).upper()
            if rng.random() < 0.5:
                w += rng.choice(base).split()
        out.append((i, rng.choice([" ", "\n", "\t "]).join(w)))
    return [*out, (n, None), (n + 1, ""), (n + 2, " \n "), (n + 3, "one two"), (n + 4, "x" * 30_000), (n + 5, "w " * 9_000)]


def frame(spark, rows, extra=True):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.selectExpr("*", "doc_id AS kept", "'z' AS hash", "1 AS n", "2 AS rank") if extra else df


def collected(df):
    return [r.asDict() for r in df.collect()]


def normal(t):
    import re

    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


@pytest.mark.parametrize("bits", [128, 4])
def test_exact_dedup(spark, bits):
    rows = corpus(1) + [(900 + k, ("lorem ipsum and then dolor " * 300) + "ab"[k % 2]) for k in range(4)]
    groups = {}
    for i, t in rows:
        groups.setdefault(normal(t), []).append(i)
    got = {r["doc_id"]: r for r in collected(exact_dedup.exact_duplicates(frame(spark, rows), digest_bits=bits))}
    assert len(got) == len(rows)
    for i, t in rows:
        g, r = groups[normal(t)], got[i]
        assert (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) == (min(g), len(g), i == min(g), hashlib.sha256(normal(t).encode()).hexdigest())


def test_exact_dedup_odd_ids(spark):
    rows = [(1, "a b"), (1, "a b"), (None, "a  b"), (1, "c"), (None, None)]
    got = collected(exact_dedup.exact_duplicates(frame(spark, rows)))
    assert len(got) == 5 and sum(r["kept"] for r in got) == 3
    assert exact_dedup.drop_exact_duplicates(frame(spark, rows)).count() == 3
    assert exact_dedup.exact_duplicates(frame(spark, [])).count() == 0


def naive_windows(rows, width):
    seen, gone = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        w = (t or "").encode().split()
        gone[i] = set()
        for k in range(len(w) - width + 1):
            key = tuple(w[k : k + width])
            if key in seen:
                gone[i] |= set(range(k, k + width))
            seen.add(key)
    return gone


@pytest.mark.parametrize("width", [3, 20])
def test_substring_dedup(spark, width):
    rows = corpus(2)
    gone = naive_windows(rows, width)
    got = collected(substring_dedup.dedup_substrings(frame(spark, rows), width=width))
    assert len(got) == len(rows)
    for r in got:
        w = (r["text"] or "").split()
        assert (r["n_words"], r["n_removed"]) == (len(w), len(gone[r["doc_id"]]))
        assert r["kept_text"] == " ".join(x for k, x in enumerate(w) if k not in gone[r["doc_id"]])
    assert substring_dedup.dedup_substrings(frame(spark, [])).count() == 0
    twice = collected(substring_dedup.dedup_substrings(frame(spark, [(1, "a b c"), (1, "a b c"), (None, "a b c")]), width=3))
    assert sorted(r["n_removed"] for r in twice) == [0, 3, 3]


def shingles(t, k=5):
    w = (t or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, 1))} if w else set()


def test_jaccard(spark):
    rows = corpus(3, 90)
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in collected(jaccard.near_duplicate_components(frame(spark, rows)))}
    assert got == {i: (len(s), find(i)) for i, s in sets.items()}
    assert len({c for _, c in got.values()}) < len(rows)
    assert jaccard.near_duplicate_components(frame(spark, [])).count() == 0
    odd = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, None)]
    assert jaccard.drop_near_duplicates(frame(spark, odd)).count() == 2


def test_bpe_against_library(spark):
    from tokenizers import Tokenizer

    path = tokenizer("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    texts = ["", "  ", "a  b\n\n c\t", "don't we'll I'M", "x<|endoftext|>y", "é́ü ß 日本語 🙂", "ab" * 2000, " " * 700 + "x", "x\x1cy\x85z 　 q", "123 4,5"] + [x or "" for _, x in corpus(4)[:40]]
    encoder = bpe.Encoder(path)
    decoder = bpe.Decoder(encoder.merges)
    for x in texts:
        ids = t.encode(x, add_special_tokens=False).ids
        assert np.frombuffer(encoder.encode(x), "<u4").tolist() == ids
        assert "".join(decoder.runs(np.array(ids, "<u4").tobytes())) == t.decode(ids, skip_special_tokens=False)
    assert "".join(decoder.runs(np.array([encoder.merges.byte_id[0xE6]], "<u4").tobytes())) == "�"
    assert "".join(decoder.runs(np.array([encoder.merges.byte_id[65]], "<u4").tobytes())) == "A"
    rng = random.Random(1)
    for _ in range(20):
        data = "".join(rng.choices(["the", "ing", " ", "er", "a", "--", "é", "中"], k=900)).encode()
        machine, out = bpe.Transducer(encoder.merges, 64), []
        for k in range(0, len(data), 37):
            out += machine.feed(data[k : k + 37])
        assert out + machine.finish() == encoder.merges.merge(data)
        assert len(machine.buffer) <= 2 * (encoder.merges.lookahead + 64)
    df = frame(spark, [(1, "hello world"), (2, None)])
    back = bpe.decode(bpe.encode(df, path), path)
    assert {r["doc_id"]: r["text"] for r in collected(back)} == {1: "hello world", 2: ""}


def test_bpe_emits_before_the_end(spark):
    """Real documents and one piece without end: most tokens leave before the text ends, and little is held."""
    encoder = bpe.Encoder(tokenizer("byte_bpe_50k.json"))
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    early = total = 0
    for text in [t for t in texts if t] + ["ab" * 40_000, " " * 50_000 + "x", "no-spaces," * 6_000]:
        machine, out, held = bpe.StreamEncoder(encoder), [], 0
        for k in range(0, len(text), 512):
            out.append(machine.feed(text[k : k + 512]))
            held = max(held, len(machine.held) + (len(machine.machine.buffer) if machine.machine else 0))
        last = machine.finish()
        assert b"".join(out) + last == b"".join(encoder.stream(text, 1 << 30))
        assert held < 5_000
        early, total = early + sum(map(len, out)), total + sum(map(len, out)) + len(last)
    assert early > 0.6 * total


def test_bpe_stream_cuts_anywhere():
    from tokenizers import Tokenizer

    path = tokenizer("byte_bpe_50k.json")
    library, encoder, rng = Tokenizer.from_file(path), bpe.Encoder(path), random.Random(7)
    atoms = ["'s", "'re", "'", "r", "e", "the ", " ", "  ", "\n", "\u3000", "23", "!", "--", "é", "\u0301", "🙂", "<|endoftext|>", "<|endof", "|>", "\x1c"]
    for _ in range(800):
        text = "".join(rng.choices(rng.choice([rng.sample(atoms, 3), atoms]), k=rng.choice([3, 20, 200])))
        machine, out, k = bpe.StreamEncoder(encoder, rng.choice([3, 8, 40])), b"", 0
        while k < len(text):
            size = rng.choice([1, 2, 5, 17, 90])
            out += machine.feed(text[k : k + size])
            k += size
        assert np.frombuffer(out + machine.finish(), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_round_trip_and_counts_through_spark(spark):
    """The functions behind op4 and op5 on nulls, empty, long and repeated rows, clashing names and empty tables."""
    from tokenizers import Tokenizer

    rows = [*corpus(4)[:30], *corpus(4)[-6:], (None, "null id"), (7, "repeated"), (7, "repeated"), (8, "x<|endoftext|>y")]
    df = frame(spark, rows).selectExpr("*", "5 AS n_tokens", "'q' AS ids_sha256")
    path = tokenizer("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((str(i), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    got = bpe.round_trip(df, path)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in collected(got)) == sorted(want)
    assert bpe.round_trip(df.limit(0), path).count() == 0
    counted = token_counts.count_tokens(df, tokenizer("piece_bpe_32k.model"))
    unigram = token_counts.Unigram.from_sentencepiece(tokenizer("piece_bpe_32k.model")).counter()
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in collected(counted)) == sorted((str(i), unigram(t or "")) for i, t in rows)
    assert token_counts.count_tokens(df.limit(0), tokenizer("piece_bpe_32k.model")).count() == 0


def test_token_counts_against_library():
    from tokenizers import Tokenizer, models

    exact = token_counts.Unigram.from_sentencepiece(tokenizer("piece_bpe_32k.model"))
    loose = token_counts.Unigram([("<unk>", 0.0), ("▁", -2.5), ("a", -1.25), ("b", -1.25), ("ab", -2.5), ("ba", -2.1), ("▁a", -3.75)], 0, False)
    texts = [x for _, x in corpus(5)[:40] if x] + ["日本\n語 <s> 🙂🙂x", "  two  blanks ", "abba ab?? ba?a"]
    for model, fallback in ((exact, True), (loose, False)):
        library = Tokenizer(models.Unigram(model.pieces, model.unk_id, fallback))
        count = model.counter()
        for x in texts:
            assert count(x) == len(library.encode("▁" + x.replace(" ", "▁")).ids)
    assert count("") == 0 and exact.splits and not loose.splits


def members(files):
    """The gzip members of all archives."""
    for r in files.collect():
        with open(r.path, "rb") as f:
            data = f.read()
        while data:
            z = zlib.decompressobj(31)
            z.decompress(data)
            yield data[: len(data) - len(z.unused_data)]
            data = z.unused_data


def test_damaged_archives(spark, tmp_path):
    whole = [warc.record([("WARC-Type", "response"), ("WARC-Record-ID", f"<{k}>")], b"HTTP/1.1 200 OK\r\n\r\nbody%d" % k) for k in range(3)]
    cases = {
        "good": b"".join(whole),
        "cut": b"".join(whole)[:-20],
        "gap": b"\r\n" + whole[0] + b"\r\n\r\n" + whole[1],
        "none": b"",
        "lengthless": whole[0] + b"WARC/1.1\r\nWARC-Type: response\r\n\r\nx\r\n\r\n",
        "text": whole[0] + b"this is no record\r\n\r\n",
        "badzip": b"\x1f\x8b" + b"junk" * 9,
        "badnumber": whole[0].replace(b"WARC-Type", b"WARC-Segment-Number: one\r\nWARC-Type"),
    }
    for name, data in cases.items():
        (tmp_path / name).write_bytes(data)
    files = spark.createDataFrame([(f"file://{tmp_path}/{n}",) for n in cases], "path string")
    got = collected(warc.read_warc(files))
    errors = sorted(r["error"].split(":")[1].rpartition("/")[2] for r in got if r["error"])
    assert errors == ["badnumber", "badzip", "cut", "lengthless", "text"]
    good = sorted(bytes(r["payload"]).decode() for r in got if not r["error"])
    assert good == sorted(["body0", "body1", "body2"] + ["body0", "body1"] * 2 + ["body0"] * 2)
    slim = collected(warc.read_warc(files, with_payload=False))
    assert all(r["payload"] is None for r in slim) and sorted(r["payload_bytes"] or 0 for r in slim) == sorted(r["payload_bytes"] or 0 for r in got)


def test_warc(spark, tmp_path):
    rng = random.Random(3)
    pages = [(i, f"http://x/{i}", rng.choice(["", None, "é" * 50, "p" * 40_000, "".join(rng.choices("abc\r\n", k=5000))])) for i in range(30)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    files, _ = warc.write_warc(df, f"file://{tmp_path}/w", segment=3000, roll=4000)
    assert files.count() > 3
    got = {int(r["record_id"][10:-1]): r for r in collected(warc.read_warc(files))}
    last = {h or "": i for i, _, h in pages}
    for i, _, h in pages:
        data = (h or "").encode()
        r = got[i]
        assert r["error"] is None and (r["payload_bytes"], r["payload_digest"]) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        if last[h or ""] == i:
            assert r["record_type"] == "response" and bytes(r["payload"]) == data
        else:
            assert r["record_type"] == "revisit" and r["refers_to"] == f"<urn:page:{last[h or '']}>"
    with pytest.raises(ValueError):
        warc.unchunked(b"3\r\nabXX")
    assert any("continuation" in zlib.decompress(m, 31).decode("latin-1") for m in members(files))
    head = "warc-record-id: <o>\nwarc-type: response"
    assert warc.reassembled([(1, None, head, b"ab")], "<o>")[-1] == "missing segments"
    assert warc.reassembled([(1, None, head, b"ab"), (2, 9, None, b"c")], "<o>")[-1] == "total length differs"
    empty, _ = warc.write_warc(df.limit(0), f"file://{tmp_path}/e")
    assert warc.read_warc(empty).count() == 0


def shards_by_hand(sizes, limit):
    """{key: shard}: the shortest prefix of each row's hash whose rows fit or are one."""
    bits = {i: f"{int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16):060b}" for i in sizes}
    out = {}
    for i, b in bits.items():
        for depth in range(61):
            mine = [j for j, x in bits.items() if x.startswith(b[:depth])]
            if sum(sizes[j] for j in mine) <= limit or len(mine) == 1:
                out[i] = b[:depth]
                break
    return out


@pytest.mark.parametrize("limit", [4_000, 60, 10**6])
def test_sharding(spark, tmp_path, limit):
    rows = corpus(6)
    docs = frame(spark, rows)
    sizes = {i: len(t or "") + 8 * 4 + 1 for i, t in rows}  # text and hash count their bytes, the other columns 8
    want = shards_by_hand(sizes, limit)
    got = {r["doc_id"]: r for r in collected(sharding.assign_shards(docs, limit))}
    assert {i: r["shard"] for i, r in got.items()} == want
    assert all((r["depth"], r["n_bytes"], r["oversized"]) == (len(want[i]), sizes[i], sizes[i] > limit) for i, r in got.items())
    given = sharding.write_shards(docs, f"file://{tmp_path}/s", limit)
    assert given.count() == len(rows)
    back = collected(sharding.read_shards(docs, f"file://{tmp_path}/s"))
    assert {r["doc_id"]: (r["shard"], r["text"]) for r in back} == {i: (want[i], t) for i, t in rows}


def test_sharding_beyond_one_level_of_the_directory(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BITS", 2)
    rows = [(i, "x" * (i % 50)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = shards_by_hand({i: i % 50 + 8 for i, _ in rows}, 120)
    assert {r["doc_id"]: r["shard"] for r in collected(sharding.assign_shards(df, 120))} == want
    assert max(map(len, want.values())) > 4
    same = collected(sharding.assign_shards(frame(spark, [(1, "abcd")] * 6 + [(None, None)]), 8))
    assert len(same) == 7 and sharding.assign_shards(frame(spark, []), 8).count() == 0


def test_quality(spark):
    rng = random.Random(2)
    good = [(i, " ".join(rng.choices(WORDS, k=60)) + ".") for i in range(120)]
    bad = [(500 + i, " ".join(w + "###" for w in rng.choices(WORDS, k=60))) for i in range(40)]
    labels = spark.createDataFrame([(i, int(i < 500)) for i, _ in good[:90] + bad[:30]] + [(1, None), (None, 1)], "doc_id long, quality int")
    got = {r["doc_id"]: r["score"] for r in collected(quality.score_quality(frame(spark, good + bad + [(900, None)]), labels))}
    assert len(got) == 161 and all(0 <= s <= 1 for s in got.values())
    assert all(got[i] >= 0.3 for i, _ in good[90:]) and all(got[i] < 0.3 for i, _ in bad[30:])
    none = collected(quality.score_quality(frame(spark, good[:3]), labels.limit(0)))
    assert [r["score"] for r in none] == [0.5] * 3


def test_quality_on_odd_rows(spark):
    """A column named score, repeated and null ids with labels, very long texts; the sample stays bounded where ids repeat."""
    rng = random.Random(5)
    rows = [(i % 40, " ".join(rng.choices(WORDS, k=50)) + ".") for i in range(160)] + [(100 + i, "### " * 40) for i in range(40)]
    rows += [(None, None), (None, "a b"), (7, "word " * 20_000)]
    labels = spark.createDataFrame([(i, 1) for i in range(40)] + [(100 + i, 0) for i in range(40)] + [(3, 0)], "doc_id long, quality int")
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'old' AS score", "1 AS y", "2 AS t")
    for most in (20_000, 60):
        got = collected(quality.score_quality(df, labels, max_train=most))
        assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
        assert Counter((r["doc_id"], r["text"]) for r in got) == Counter(rows)
        by = {}
        for r in got:
            by.setdefault(r["text"], set()).add(r["score"])
        assert all(len(s) == 1 for s in by.values())
    assert quality.score_quality(df.limit(0), labels).count() == 0


def test_packing(spark):
    from tokenizers import Tokenizer

    path = tokenizer("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    rows = corpus(7) + [(300, "İstanbul ΣΑΣ é<|endoftext|>x don't 12\x1c3 ﬁ")]
    got = collected(packing.pack_documents(frame(spark, rows), path, capacity=64))
    by, room = {}, {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
        room.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(by) == {i for i, _ in rows}
    for i, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        for k, r in enumerate(sorted(by[i], key=lambda r: r["piece"])):
            part = ids[64 * k : 64 * k + 64]
            assert (r["piece"], r["start"], r["length"], r["ids_crc32"]) == (k, 64 * k, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
        assert len(by[i]) == -(-len(ids) // 64)
    for items in room.values():
        at = 0
        for o, n in sorted(items):
            assert o == at
            at += n
        assert at <= 64
    assert len(room) <= -(-sum(r["length"] for r in got) // 64) * 1.1 + 1
    assert packing.pack_documents(frame(spark, []), path).count() == 0
    assert packing.pack_documents(frame(spark, [(1, "a"), (1, "a"), (None, None)]), path).count() == 3


def best_by_hand(docs, asked, k, round_to=9):
    """{query: [(document, score)]} over {id: text}, ties by id."""
    words = {i: (t or "").encode().lower().split() for i, t in docs}
    n, avg = len(words), sum(map(len, words.values())) / max(len(words), 1)
    df = {}
    for w in words.values():
        for x in set(w):
            df[x] = df.get(x, 0) + 1
    out = {}
    for q, t in asked:
        scores = []
        for i, w in words.items():
            s = sum(np.log(1 + (n - df[x] + 0.5) / (df[x] + 0.5)) * w.count(x) * 2.2 / (w.count(x) + 1.2 * (0.25 + 0.75 * len(w) / avg)) for x in set((t or "").encode().lower().split()) if x in w)
            if s > 0:
                scores.append((-round(s, round_to), i))
        if scores:
            out[q] = [(i, -s) for s, i in sorted(scores)[:k]]
    return out


def hits(df):
    out = {}
    for r in sorted(collected(df), key=lambda r: (str(r["query_id"]), r["rank"])):
        out.setdefault(r["query_id"], []).append((r["doc_id"], r["score"]))
    return out


def assert_same_hits(got, want):
    assert got.keys() == want.keys()
    for q, w in want.items():
        assert [i for i, _ in got[q]] == [i for i, _ in w] and all(abs(a - b) < 1e-6 for (_, a), (_, b) in zip(got[q], w, strict=True))


@pytest.mark.parametrize("shard_bytes", [1 << 25, 9_000])
def test_bm25(spark, monkeypatch, shard_bytes):
    """One shard, and rounds of several; null, empty, long and repeated texts among documents and queries."""
    monkeypatch.setattr(bm25, "SHARD_BYTES", shard_bytes)
    monkeypatch.setattr(bm25, "FIRST", 1)
    rows = corpus(8, 150) + [(800 + k, "three equal texts") for k in range(6)]
    d = frame(spark, rows)
    asked = [(i, t) for i, t in rows if i % 7 == 0 or i >= 150]
    want = best_by_hand(rows, asked, 10)
    assert_same_hits(hits(bm25.search(d, frame(spark, asked))), want)
    ties = want[800]
    assert [i for i, _ in ties][:6] == list(range(800, 806))
    assert bm25.search(d.limit(0), d).count() == bm25.search(d, d.limit(0)).count() == 0


def test_bm25_pruning_is_exact_on_many_blocks(spark):
    """A shard of many superblocks, with and without a threshold, against all scores; some postings stay unread."""
    rng = np.random.default_rng(4)
    n, vocabulary = 5_000, 900
    weight = 1 / np.arange(1, vocabulary + 1)
    lens = np.r_[rng.integers(1, 60, n - 40), rng.integers(400, 900, 40)]
    doc = np.repeat(np.arange(n), lens)
    term = np.concatenate([rng.choice(vocabulary, m, p=weight / weight.sum()) + vocabulary * (i % 3) for i, m in enumerate(lens)])
    (doc, term), tf = np.unique(np.stack([doc, term]), axis=1, return_counts=True)
    data = bm25.index_of(np.arange(n) + 10, lens, doc, term.astype(np.uint64), tf)
    shard = bm25.Shard(data, float(lens.mean()), 1.2, 0.75)
    df = np.bincount(term, minlength=3 * vocabulary)
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
    asked = rng.choice(n, 40, replace=False)
    sets = [np.unique(term[doc == q]) for q in asked]
    terms, which = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.r_[0, np.cumsum([len(s) for s in sets])]
    norm = tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * lens[doc] / lens.mean()))
    least = np.zeros(len(asked))
    for again in range(2):
        shard.all_postings = shard.read_postings = 0
        q, i, s = (np.array(x) for x in shard.answer(starts, which, terms.astype(np.uint64), idf[terms], least, 10))
        for x, mine in enumerate(sets):
            use = np.isin(term, mine)
            score = np.bincount(doc[use], norm[use] * idf[term[use]], n)
            best = np.lexsort((np.arange(n), -np.round(score, 9)))[:10]
            best = best[score[best] > 0]
            found = sorted(zip(np.round(-s[q == x], 9), i[q == x], strict=True))[:10]
            assert [b for _, b in found] == (best + 10).tolist()
            least[x] = score[best[-1]] * (1 - 1e-12) if len(best) == 10 else 0
        if again:
            assert shard.read_postings < shard.all_postings


def test_bpe_merges_each_piece_once(monkeypatch):
    """A piece in units of different kinds is merged once, and short pieces of all lengths are as in the library."""
    import tokenizers

    path = tokenizer("byte_bpe_50k.json")
    encoder, library = bpe.Encoder(path), tokenizers.Tokenizer.from_file(path)
    merged, merge = [], encoder.merges.merge
    monkeypatch.setattr(encoder.merges, "merge", lambda data: merged.append(data) or merge(data))
    rng = random.Random(6)
    words = ["".join(rng.choice("aaeinorst" + "hlé日" * (k % 3)) for _ in range(k % 60 + 1)) for k in range(600)]
    for text in (" ".join(words), ", ".join(words), ". ".join(reversed(words))):
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    short = [m for m in merged if 0 < len(m.decode()) <= bpe.MEMO_CHARS]
    assert len(short) == len(set(short)) > 500


def test_bm25_words_are_hashed_a_column_at_a_time(monkeypatch):
    """The words that bytes.split() gives, equal hashes for equal words only, and no call for each short word."""
    import xxhash

    calls, one = [], xxhash.xxh3_64_intdigest
    monkeypatch.setattr(xxhash, "xxh3_64_intdigest", lambda w: calls.append(w) or one(w))
    rng = np.random.default_rng(8)
    parts = np.array(["a", "B", "Z", " ", "\t", "\n", "\x0b", "\x0c", "\r", "\x00", "\x1c", "\x85", "\u3000", "é", "日本", "x" * 40], object)
    texts = [None, "", " ", "a A", "Z" * 300_000 + " b  " + "y" * 131_072 + " c", "d e " * 60_000]
    texts += ["".join(rng.choice(parts, n)) for n in rng.integers(0, 50, 1_500)]
    ids, lens, doc, term, tf = (np.concatenate(x) for x in zip(*bm25.doc_terms([pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], names=["i", "t"])], 1 << 40), strict=True))
    words = [(t or "").encode().lower().split() for t in texts]
    assert ids.tolist() == list(range(len(texts))) and lens.tolist() == [len(w) for w in words]
    hashes = {}
    for d, w in enumerate(words):
        mine = doc == d
        assert sorted(tf[mine].tolist()) == sorted(w.count(x) for x in set(w)) if len(w) < 1_000 else tf[mine].tolist() == [60_000] * 2
        if len(set(w)) == 1:
            assert hashes.setdefault(w[0], int(term[mine][0])) == int(term[mine][0])
    assert len(np.unique(term)) == len({x for w in words for x in w}) and len(set(hashes.values())) == len(hashes) > 20
    assert all(len(x) > 32 for x in calls)


def test_bm25_scores_a_querys_documents_together(monkeypatch):
    """Documents near the threshold are scored again in one call for each query, also where many copies tie."""
    n = 4_000
    lens, doc, term = np.full(n, 3), np.repeat(np.arange(n), 3), np.tile(np.arange(3), n)
    term[doc % 2 == 1] += 3
    shard = bm25.Shard(bm25.index_of(np.arange(n)[::-1], lens, doc, term.astype(np.uint64), np.ones(3 * n, np.int64)), 3.0, 1.2, 0.75)
    calls, exact = [], shard.exact
    monkeypatch.setattr(shard, "exact", lambda *x: calls.append(x) or exact(*x))
    q, i, s = shard.answer(np.array([0, 3, 6]), np.arange(6), np.arange(6, dtype=np.uint64), np.ones(6), np.zeros(2), 10)
    assert len(calls) == 2 and q == [0] * 10 + [1] * 10
    assert i == [*range(1, 20, 2), *range(0, 20, 2)] and np.allclose(s, 3)


def test_bm25_odd_ids(spark):
    texts = ["a b c", "a b", None, "", "c d e f", "a b c"]
    for ids, kind in ((["x", "y", "z", "u", "v", "w"], "string"), ([1, 1, 2, None, 3, 3], "long")):
        d = spark.createDataFrame(list(zip(ids, texts, strict=True)), f"doc_id {kind}, text string").selectExpr("*", "1 AS rank", "2 AS score", "3 AS query_id")
        got = collected(bm25.search(d, d, k=3))
        asked = [(i, t) for i, t in zip(ids, texts, strict=True) if i is not None]
        want = []  # rows with equal ids are queries and documents of their own
        for q, t in asked:
            numbered = list(enumerate(x for _, x in asked))
            best = best_by_hand(numbered, [(0, t)], 3).get(0, [])
            want += [(str(q), round(s, 6)) for _, s in best]
        assert sorted((str(r["query_id"]), round(r["score"], 6)) for r in got) == sorted(want)
        assert all(r["doc_id"] is not None for r in got) and {type(r["doc_id"]) for r in got} == {str if kind == "string" else int}


def test_pipeline_stages(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "passage_dedup", "packing"]
    rows = corpus(9)
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    exact = corpus_pipeline.exact_stage(spark, df, "")
    assert exact.columns == df.columns and exact.count() == len({normal(t) for _, t in rows})
    out = corpus_pipeline.passage_stage(spark, df, "")
    gone = naive_windows(rows, 20)
    for r in collected(out):
        w = [x for k, x in enumerate((dict(rows)[r["doc_id"]] or "").split()) if k not in gone[r["doc_id"]]]
        assert (r["text"] or "").split() == w


def test_bpe_merges_the_pieces_of_a_run_of_texts_side_by_side(monkeypatch):
    """What the stream encoder looks up has been merged at once, the same as one at a time, also when a memo is full or a text is long."""
    import tokenizers

    path = tokenizer("byte_bpe_50k.json")
    encoder, library = bpe.Encoder(path), tokenizers.Tokenizer.from_file(path)
    alone, merge = [], encoder.merges.merge
    monkeypatch.setattr(encoder.merges, "merge", lambda data: alone.append(data) or merge(data))
    rng = random.Random(8)
    words = ["".join(rng.choice("aaeinorst" + "hlé日'9\x00" * (k % 3)) for _ in range(k % 60 + 1)) for k in range(3_000)]
    strings = [w.encode() for w in words] + [b"", b"aaaaaaaa", bytes(range(256))]
    assert encoder.merges.merge_all(strings) == [np.array(merge(x), "<u4").tobytes() for x in strings]
    assert encoder.merges.merge_all([]) == []
    alone.clear()
    texts = [" ".join(words[k : k + 30]) for k in range(0, 3_000, 30)]
    seen = [encoder.encode(t) for t in bpe.learned(encoder, pa.array(texts))]
    assert all(len(x) > bpe.WIDTHS[-1] for x in alone)
    odd = ["", "  \n x<|endoftext|>y  ", None, "q" * 90 + " " + "é" * 70]
    texts, seen = texts + odd, seen + [encoder.encode(t) for t in bpe.learned(encoder, pa.array(odd))]
    for small in (seen, None):
        if small is None:
            monkeypatch.setattr(bpe, "MEMO", 40)
            monkeypatch.setattr(bpe, "PIECE_MEMO", 40)
            monkeypatch.setattr(bpe, "LEARN", 700)
            small = [encoder.encode(t) for t in bpe.learned(encoder, pa.array(texts))]
        for text, ids in zip(texts, small, strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == library.encode(text or "", add_special_tokens=False).ids


def test_warc_segments_meet_wherever_they_lie(spark, tmp_path):
    """Records are joined where they are read, and only loose segments are kept; repeats, gaps and contradictions in other archives count as before."""
    from loomgraph.llm import common

    pages = [(i, f"http://x/{i}", chr(97 + i) * (5_000 * i)) for i in range(8)]
    files, _ = warc.write_warc(spark.createDataFrame(pages, "page_id long, url string, html string"), f"file://{tmp_path}/w", segment=3000)
    got = warc.read_warc(files, with_payload=False)
    kept = spark.read.parquet(common._SCRATCH[-1])
    assert kept.filter("block IS NOT NULL").count() == 0 < kept.filter("origin IS NOT NULL").count()
    assert sorted((int(r["record_id"][10:-1]), r["payload_bytes"]) for r in collected(got)) == [(i, len(h)) for i, _, h in pages]

    rng = random.Random(4)
    places, told = [b""] * 4, {}
    for k in range(60):
        origin, parts, body = f"<{k}>", rng.randint(1, 4), b"HTTP/1.1 200 OK\r\n\r\n" + b"%d" % k * 20
        size = -(-len(body) // parts)
        of = []
        for n in range(1, parts + 1):
            of.append((n, len(body) if n == parts else None, body[(n - 1) * size : n * size]))
        given = [list(of) for _ in range(k % 3)]  # whole, in so many places
        for _ in range(rng.choice([0, 0, 1, 3]) if given else 3):
            n, total, block = rng.choice(of)
            given.append([rng.choice([(n, total, block), (n, total, block), (n, total, block + b"!"), (n + parts, total, block), (0, None, block), (n, total or 7, block)])])
        for run in given:
            data = b""
            for n, total, block in run:
                more = [("WARC-Type", "response"), ("WARC-Record-ID", origin)] if n == 1 else [("WARC-Type", "continuation"), ("WARC-Record-ID", f"{origin}:{n}"), ("WARC-Segment-Origin-ID", origin)]
                heads = [*more, ("WARC-Segment-Number", str(n)), *([] if total is None else [("WARC-Segment-Total-Length", str(total))])]
                data += warc.record(heads, block)
                head = "\n".join(f"{a.lower()}: {b}" for a, b in [*heads, ("Content-Length", str(len(block)))]) if n == 1 else None
                told.setdefault(origin, []).append((n, total, head, block))
            places[rng.randrange(4)] += data
    for n, data in enumerate(places):
        (tmp_path / f"p{n}").write_bytes(data)
    there = spark.createDataFrame([(f"file://{tmp_path}/p{n}",) for n in range(4)], "path string")
    expected = {origin: warc.reassembled(segments, origin) for origin, segments in told.items()}
    assert {e[-1] for e in expected.values()} == {None, "missing segments", "contradicting segments"}
    rows = collected(warc.read_warc(there))
    assert len(rows) == len(expected)
    for r in rows:
        e = expected[r["record_id"]]
        assert (r["record_type"], r["payload"] and bytes(r["payload"]), r["payload_bytes"], r["payload_digest"], r["error"]) == (e[1], *e[4:])


def test_bpe_learns_a_long_text_in_runs(monkeypatch):
    """Behind the first run of a long text, pieces are merged side by side as well."""
    import tokenizers

    path = tokenizer("byte_bpe_50k.json")
    encoder, library = bpe.Encoder(path), tokenizers.Tokenizer.from_file(path)
    alone, merge = [], encoder.merges.merge
    monkeypatch.setattr(encoder.merges, "merge", lambda data: alone.append(data) or merge(data))
    monkeypatch.setattr(bpe, "LEARN", 3 * bpe.BLOCK)
    rng = random.Random(9)
    text = " ".join("".join(rng.choice("aaeinorstlé") for _ in range(rng.randint(1, 12))) for _ in range(12_000))
    (ids,) = [encoder.encode(t) for t in bpe.learned(encoder, pa.array([text]))]
    assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert len(alone) < 50  # units across the borders of blocks and runs
