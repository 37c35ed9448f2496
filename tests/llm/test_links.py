"""All links of the Jaccard join against brute force."""

import itertools
import random

from test_llm import WORDS, corpus, frame, shingles

from loomgraph.llm import jaccard


def brute(sets):
    out = {}
    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * len(sets[a] | sets[b]):
            out[a, b] = (both, len(sets[a] | sets[b]))
    return out


def expanded(pairs, membership):
    """Links between rows from pairs of representatives and membership."""
    rows = membership.collect()
    by, size = {}, {r.row: r.n_shingles for r in rows}
    for r in rows:
        by.setdefault(r.representative, []).append(r.row)
    out = {(a, b): (size[a], size[a]) for c in by.values() for a, b in itertools.combinations(sorted(c), 2)}
    for p in pairs.collect():
        assert p.a < p.b and p.a in by and p.b in by
        for x, y in itertools.product(by[p.a], by[p.b]):
            assert (min(x, y), max(x, y)) not in out
            out[min(x, y), max(x, y)] = (p.n_common, p.n_union)
    return out


def test_links_of_clusters_are_complete(spark):
    rng = random.Random(11)
    base = rng.choices([f"{w}{k}" for w in WORDS for k in range(9)], k=80)
    cluster = []
    for i in range(14):
        w = list(base)
        for _ in range(rng.randrange(0, 3)):
            w[rng.randrange(len(w))] = f"new{rng.randrange(40)}"
        cluster.append((200 + i, " ".join(w)))
    rows = corpus(3, 90) + cluster + [(300, cluster[0][1]), (301, cluster[0][1].upper())]
    want = brute({i: shingles(t) for i, t in rows})
    pairs, membership = jaccard.near_duplicate_links(frame(spark, rows))
    assert membership.columns == ["doc_id", "row", "representative", "n_shingles"]
    assert {r.row: r.n_shingles for r in membership.collect()} == {i: len(shingles(t)) for i, t in rows}
    assert all(r.doc_id == r.row for r in membership.collect())
    assert expanded(pairs, membership) == want
    assert sum(a >= 200 for a, _ in want) > len(cluster)  # more links than a spanning tree has


def test_links_of_odd_rows(spark):
    near = "a b c d e f g h i j k l m n o p q r s t"
    rows = [(1, near), (1, near), (None, f"{near} u"), (2, None), (2, None), (3, "")]
    pairs, membership = jaccard.near_duplicate_links(frame(spark, rows))
    got = membership.collect()
    text = {r.row: r.doc_id for r in got}
    links = sorted(str(sorted([text[a], text[b]], key=str)) for a, b in expanded(pairs, membership))
    assert len(got) == 6 and links == sorted(["[1, 1]", "[1, None]", "[1, None]"])
    pairs, membership = jaccard.near_duplicate_links(frame(spark, []))
    assert pairs.count() == 0 and membership.count() == 0
