"""Vector codes, the conversation trie and page texts against brute force, and on odd rows."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import html_extract, prefix_trie, queries, vector_codes
from loomgraph.llm.html_extract import Page

# vector codes


def codes_by_brute_force(rows, parts, entries, rounds):
    kept = [(i, v, lab) for i, v, lab in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    whole = [[int(np.floor(4096 * x)) for x in v] for _, v, _ in kept]
    step = len(whole[0]) // parts
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][1]))[:entries]
    books = [[whole[k][p * step : (p + 1) * step] for k in order] for p in range(parts)]

    def assign():
        out = []
        for v in whole:
            far = [[sum((a - b) ** 2 for a, b in zip(v[p * step : (p + 1) * step], e, strict=True)) for e in books[p]] for p in range(parts)]
            out.append([(min(f), f.index(min(f))) for f in far])
        return out

    for _ in range(rounds):
        got = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [v[p * step : (p + 1) * step] for v, g in zip(whole, got, strict=True) if g[p][1] == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    got = assign()
    errors = [sum(d for d, _ in g) for g in got]
    labels = Counter()
    for (_, _, lab), e in zip(kept, errors, strict=True):
        labels[lab] += e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return Counter((i, "".join(f"{e:02x}" for _, e in g), err, labels[lab], sha) for (i, _, lab), g, err in zip(kept, got, errors, strict=True))


@pytest.mark.parametrize("entries", [16, 3])
def test_vector_codes(spark, entries):
    rng = random.Random(entries)
    rows = [(k, [rng.choice([-0.5, 0.0, 0.25, rng.uniform(-1, 1)]) for _ in range(8)], rng.choice([0, 1, None])) for k in range(160)]
    rows += [(k, rows[0][1], 0) for k in range(200, 260)]  # a third are copies
    rows += [(5, rows[5][1], 1), (5, rows[6][1], 1), (None, rows[7][1], None), (None, rows[8][1], 2)]
    rows += [(900, None, 1), (901, [None] + [0.0] * 7, 1), (902, [float("nan")] * 8, 1), (903, [float("-inf")] * 8, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "'x' AS code", "1L AS error", "'c' AS id", "2 AS v", "0 AS place").repartition(5)
    got = vector_codes.compress_vectors(df, parts=4, entries=entries, rounds=3).collect()
    assert Counter(tuple(r) for r in got) == codes_by_brute_force(rows, 4, entries, 3)


def test_vector_codes_on_odd_tables(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert vector_codes.compress_vectors(spark.createDataFrame([], schema)).collect() == []
    assert vector_codes.compress_vectors(spark.createDataFrame([(1, None, 1)], schema)).collect() == []
    rows = [(1, [0.5, 1.0], 1), (2, [0.25, 1.0], None), (3, [1.0], 1), (4, [1e30, 0.0], None), (5, [], 1)]
    got = {r.vec_id: (r.code, r.error, r.label_error) for r in vector_codes.compress_vectors(spark.createDataFrame(rows, schema), parts=2).collect()}
    assert got == {1: ("0000", 0, 0), 2: ("0100", 0, 0), 3: (None, None, 0), 4: (None, None, 0), 5: (None, None, 0)}
    with pytest.raises(ValueError):
        vector_codes.compress_vectors(spark.createDataFrame(rows, schema), parts=3)
    with pytest.raises(ValueError):
        vector_codes.compress_vectors(spark.createDataFrame([(1, [1.0], 1)], "code long, embedding array<float>, label int"), id_col="code")


@pytest.mark.parametrize("d", [1, 2, 3, 8, 31])
def test_partial_distances_find_the_nearest(d):
    rng = np.random.default_rng(d)
    x, book = rng.integers(-3, 4, (500, d)), rng.integers(-3, 4, (16, d))
    far = np.square(x[:, None, :] - book[None, :, :]).sum(axis=2)
    entry, least = vector_codes.nearest(x, book)
    assert (entry == far.argmin(axis=1)).all() and (least == far.min(axis=1)).all()  # many ties


# conversation trie


def trie_by_brute_force(rows, block=None, head=None):
    turns = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            x = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]
            turns[c].append(((t is not None, t or 0), x, (role, text)))
    own = {c: [r[2] for r in sorted(v, key=lambda r: r[:2])] for c, v in turns.items()}
    built = {c: (own.get(block(c), [])[: head(c)] + v[head(c) :] if block else v) for c, v in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, v in sorted(built.items()):
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
        ends[tuple(v)].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * (len(p[-1][1]) if p else 0)
    sha = lambda p: hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest()
    return Counter((m[0], len(p), members[p[:-1]][0] if p else None, len(m), children[p], leaves[p], saved[p], sha(p)) for p, m in members.items())


def random_turns(seed, n=60, longest=7):
    rng = random.Random(seed)
    said = [("user", "hi"), ("assistant", "hello ☃"), ("user", "a"), (None, None), ("", ""), ("user", "long " * 50)]
    rows = []
    for _ in range(n):
        c = rng.choice([rng.randrange(12), 100 + rng.randrange(8), 300 + rng.randrange(5), 1_000_000 + rng.randrange(300)])
        rows += [(c, rng.choice([None, t, t]), *rng.choice(said)) for t in range(rng.randrange(1, longest))]
    rows += [(None, 1, "user", "nobody")] * 2
    hot = rng.randrange(12)
    return rows + [(hot, 10 + t, *rng.choice(said)) for t in range(len(rows) // 2)]  # a third of all rows


@pytest.mark.parametrize(("seed", "parts", "held"), [(1, 4, 50_000), (2, 40, 50_000), (3, 9, 5), (4, 200, 3), (5, 3, 1)])
def test_trie(spark, monkeypatch, seed, parts, held):
    rows = random_turns(seed)
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").selectExpr("*", "1 AS depth", "'n' AS node", "2 AS head", "3 AS block", "4 AS part")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    monkeypatch.setattr(prefix_trie, "HELD", held)
    monkeypatch.setattr(prefix_trie, "FAN_IN", 3)
    try:
        c = F.col("conv_id")
        got = prefix_trie.prefix_trie(df, block=c - c % 100, head=F.crc32(c.cast("string")) % 6, most_head=5)
        assert Counter(tuple(r) for r in got.collect()) == trie_by_brute_force(rows, lambda c: c - c % 100, lambda c: zlib.crc32(str(c).encode()) % 6)
        plain = prefix_trie.prefix_trie(df)
        assert Counter(tuple(r) for r in plain.collect()) == trie_by_brute_force(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_trie_on_odd_tables(spark):
    schema = "conv_id long, turn int, role string, text string"
    assert prefix_trie.prefix_trie(spark.createDataFrame([], schema)).collect() == []
    assert prefix_trie.prefix_trie(spark.createDataFrame([(None, 1, "a", "b")], schema)).collect() == []
    rows = [(c, t, "user", f"say {t}") for c in range(30) for t in range(40)]  # copies of one conversation, deeper than the doubling's first steps
    got = prefix_trie.prefix_trie(spark.createDataFrame(rows, schema)).collect()
    assert Counter(tuple(r) for r in got) == trie_by_brute_force(rows) and len(got) == 41


# page texts


def test_page_marks():
    html = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style></head><body class="home with-sidebar"><header><h1>Site</h1></header>
    <nav><ul><li>Menu</ul></nav><div class="layout has-sidebar"><article title="a hidden > gem"><header><h1>Head&amp;line</h1><span>by me</span></header>
    <p>one<b>two<i>three</b> four<p>five&nbsp;&#8364;<br>six<script>"</p>"</script><!-- <p>x</p> --></p>
    <div class="share-buttons">Share</div><form>Mail <input></form><table><tr><td>c1<td>c2</table><footer>by</footer></article>
    <section id="comments"><article class="comment"><p>first!</p></article></section></div><aside>side</aside><div hidden>h</div><div style="display: none">d</div>
    <footer>&copy; us</footer></body>"""
    assert Page(html).text() == "Head&line onetwothree four five € six c1 c2"


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("", ""),
        ("plain < text &lt;b&gt;", "plain < text <b>"),
        ("a<!-- open", "a"),
        ("a<script>open", "a"),
        ("<p>a<div", "a"),
        ("<main><p>m</p></main>rest", "m"),
        ("<main> </main>rest", "rest"),
        ("<article></article><p>body", "body"),
        ("<b><nav>x</b>y</nav>z", "z"),
        ("<div><p>x</div>y</p>z", "x y z"),
        ("<svg><path/><text>s</text></svg>t", "t"),
        ("<p>x</p " + "a" * 9 + ">y", "x y"),
        ("<div>" * 3_000 + "deep" + "</div>" * 3_000, "deep"),
        ("<b>" * 3_000 + "x", "x"),
        ('<p class="unclosed>x</p>y', "x y"),
        ("x\x00y &#0; &#xD800;", "x\x00y � �"),
    ],
)
def test_odd_markup(html, text):
    assert Page(html).text() == text


def site(host, n, article, own="div"):
    rows = []
    for k in range(n):
        main = f"<p>story {host} {k}</p><p>shared by all</p><div><b>Read</b> our terms</div>"
        body = f"<article>{main}</article>" if article else f"<{own}>{main}</{own}>"
        rows.append((f"https://{host}/p/{k}", f"<html><body><div class='top'>Welcome to {host} <a href='/{k}'>in</a></div>{body}<div>Call {host}</div>tail {k}</body></html>"))
    return rows


def texts_by_brute_force(rows, min_pages=3, share=0.3):
    where, every = defaultdict(set), defaultdict(set)
    for url, html in rows:
        host = url.split("/")[2].lower() if url else None
        p = Page(html or "")
        every[host].add(p.text())
        for s in p.subtrees():
            where[host, s].add(p.text())
    out = []
    for url, html in rows:
        host = url.split("/")[2].lower() if url else None
        gone = frozenset(s for (h, s), pages in where.items() if host and h == host and len(pages) >= max(min_pages, share * len(every[host])))
        out.append(Page(html or "").text(gone))
    return out


def test_templates_of_a_site(spark):
    rows = site("a.example", 8, False) + site("b.example", 8, True) + site("c.example", 2, False) + [(None, "<p>no host</p>")] * 4
    rows += [("https://copies.example/x", "<p>the same</p><div>again</div>")] * 20  # one distinct page
    rows += [("HTTP://A.example:80/z", "<div>Call a.example</div><p>other</p>"), ("https://a.example/n", None), ("https://a.example/e", "")]
    rows += [("https://hot.example/" + str(k), f"<div>hot menu</div><p>hot {k}</p>") for k in range(40)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "page_id long, url string, html string").selectExpr("*", "'t' AS text", "'h' AS host", "1 AS gone", "2 AS id")
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in html_extract.extract_text(df).collect()}
    texts = [got[k][1] for k in range(len(rows))]
    assert texts[:2] == ["story a.example 0 tail 0", "story a.example 1 tail 1"]
    assert texts[8] == "story b.example 0 shared by all"  # a paragraph of an article is no template
    assert texts[16].startswith("Welcome to c.example")  # two pages are not many
    assert texts[18] == "no host" and texts[22] == "the same again" and texts[-1] == "hot 39"
    assert {k: (rows[k][0], t, len(t)) for k, t in enumerate([*site_texts(rows)])} == got


def site_texts(rows):
    return texts_by_brute_force([(u.replace("HTTP://A.example:80", "http://a.example") if u else u, h) for u, h in rows])


def test_page_texts_on_odd_rows(spark):
    schema = "page_id long, url string, html string"
    assert html_extract.extract_text(spark.createDataFrame([], schema)).collect() == []
    rows = [(None, None, None), (1, "x", "<p>a"), (1, "x", "<p>a"), (2, "http://h", "<article>" + "<p>word</p>" * 50_000 + "</article>")]
    got = Counter((r.page_id, r.text, r.n_chars) for r in html_extract.extract_text(spark.createDataFrame(rows, schema)).collect())
    assert got == Counter([(None, "", 0), (1, "a", 1), (1, "a", 1), (2, " ".join(["word"] * 50_000), 249_999)])
    with pytest.raises(ValueError):
        html_extract.extract_text(spark.createDataFrame([(1, "u", "h")], "page_id long, text string, html string"), url_col="text")


def test_queries_on_empty_tables(spark, tmp_path):
    for name, schema in {"embeddings": "vec_id long, embedding array<float>, label int", "conversations": "conv_id long, turn long, role string, text string", "pages": "page_id long, url string, html string"}.items():
        spark.createDataFrame([], schema).write.parquet(f"file://{tmp_path}/{name}.parquet")
    for f in (queries.op11_vector_codes, queries.op12_prefix_trie, queries.op13_html_text):
        assert f(spark, f"file://{tmp_path}").collect() == []
