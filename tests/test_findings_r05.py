"""What the findings of the fifth round asked for."""

import numpy as np
import pytest

from loomgraph.operators import kernels


def arcs_of(n, u, v, w=None):
    order = np.lexsort((v, u))
    return kernels.Arcs(np.r_[0, np.cumsum(np.bincount(u, minlength=n))], v[order].astype(np.int32), None if w is None else w[order])


def made(n, m, directed, seed):
    rng = np.random.default_rng(seed)
    u, v = rng.integers(0, n, (2, m))
    u, v = np.unique(np.stack([u[u != v], v[u != v]]), axis=1) if directed else np.unique(np.sort(np.stack([u[u != v], v[u != v]]), axis=0), axis=1)
    if not directed:
        u, v = np.r_[u, v], np.r_[v, u]
    out = arcs_of(n, u, v)
    return kernels.Adjacency(out, arcs_of(n, v, u) if directed else out)


@pytest.mark.parametrize("directed", [False, True])
@pytest.mark.parametrize(("push", "pull", "look", "cell", "stretch"), [(2.2, 2.3, 6.0, 0.8, 32_768), (1e-9, 1.0, 1e9, 0.0, 7), (1.0, 1e-9, 1e9, 0.0, 5), (1e9, 1e9, 1e12, 1e-9, 2), (1e9, 1.0, 1e-9, 1.0, 3)])
def test_few_levels_by_any_way_equal_tables_of_rows(monkeypatch, directed, push, pull, look, cell, stretch):
    for name, x in {"PUSHED": push, "PULLED": pull, "LOOK": look, "CELL": cell, "STRETCH": stretch}.items():
        monkeypatch.setattr(kernels, name, x)
    for n, m in ((2, 9), (60, 150), (60, 900), (80, 60)):
        g = made(n, m, directed, n + m)
        sources = np.arange(n)[:: 1 + n // 20]
        for own in (None, np.random.default_rng(3).integers(0, 3, (n, len(sources))).astype(float)):
            want = kernels._by_levels(g, sources, own)
            got = kernels._by_few_levels(g, sources, None if own is None else own.T.ravel())
            assert np.allclose(got, want, rtol=1e-12, atol=1e-12) and (m < 100 or want.any())


def test_parts_of_few_levels_take_tables_of_their_own(monkeypatch):
    taken = []
    for name in ("_by_levels", "_by_few_levels"):
        monkeypatch.setattr(kernels, name, lambda g, sources, own, kept=getattr(kernels, name), name=name: taken.append(name) or kept(g, sources, own))
    path = np.arange(99)
    u, v = np.r_[path, 100 + path], np.r_[path + 1, np.full(99, 199)]  # a path and a star
    out = arcs_of(200, np.r_[u, v], np.r_[v, u])
    total = np.zeros(200)
    for rows, share in kernels.shares(kernels.Adjacency(out, out), np.arange(200), None):
        total[rows] += share
    assert set(taken[:4]) == {"_by_levels"} and set(taken[4:]) == {"_by_few_levels"}
    assert total.tolist() == [2.0 * k * (99 - k) for k in range(100)] + [0.0] * 99 + [99.0 * 98]


def weights_of(n, m, directed, seed, choice):
    g, rng = made(n, m, directed, seed), np.random.default_rng(seed)
    table = rng.choice(choice, (n, n)) if choice else rng.exponential(50, (n, n))
    table = table if directed else np.minimum(table, table.T)
    for arcs in (g.out, g.into):
        rows = np.repeat(np.arange(n), np.diff(arcs.start))
        arcs.weight = table[rows, arcs.to] if arcs is g.out else table[arcs.to, rows]
    return g


def way_lengths(n, arcs):
    d = np.full((n, n), np.inf)
    d[np.repeat(np.arange(n), np.diff(arcs.start)), arcs.to] = arcs.weight
    d[np.arange(n), np.arange(n)] = 0.0
    for k in range(n):
        d = np.minimum(d, d[:, [k]] + d[[k]])
    return d


@pytest.mark.parametrize("choice", [None, [0.5, 1.0, 1.5, 1e-6, 40.0]])
def test_arcs_longer_than_a_way_round_are_left_out(monkeypatch, choice):
    for stretch in (3, 32_768):
        monkeypatch.setattr(kernels, "STRETCH", stretch)
        for n, m in ((2, 9), (70, 60), (90, 4_000)):
            g = weights_of(n, m, False, n + m, choice)
            kept = kernels.without_detours(g.out)
            assert np.array_equal(way_lengths(n, g.out), way_lengths(n, kept))
            assert len(kept.to) <= (len(g.out.to) // 2 if m > 1_000 else len(g.out.to))
            for own in (None, np.random.default_rng(3).integers(0, 3, (n, n)).astype(float)):
                want = kernels._by_distance(g, np.arange(n), own)
                assert np.allclose(kernels._by_distance(kernels.Adjacency(kept, kept), np.arange(n), own), want, rtol=1e-12, atol=1e-9)


@pytest.mark.parametrize("directed", [False, True])
@pytest.mark.parametrize("choice", [None, [0.5, 1.0, 1.5, 1e-6, 40.0]])
@pytest.mark.parametrize(("step", "stretch"), [(0.25, 32_768), (0.0, 3), (1e9, 50)])
def test_distances_of_each_source_equal_tables_of_rows(monkeypatch, directed, choice, step, stretch):
    monkeypatch.setattr(kernels, "STEP", step)
    monkeypatch.setattr(kernels, "STRETCH", stretch)
    for n, m in ((2, 9), (60, 900), (80, 70)):
        g = weights_of(n, m, directed, n + m, choice)
        sources = np.arange(n)[:: 1 + n // 20]
        far = kernels._nearest(g, sources).reshape(len(sources), n)
        assert np.allclose(far, way_lengths(n, g.out)[sources], rtol=1e-12)
        for own in (None, np.random.default_rng(3).integers(0, 3, (n, len(sources))).astype(float)):
            want = kernels._by_distance(g, sources, own)
            got = kernels._by_few_distances(g, sources, None if own is None else own.T.ravel())
            assert np.allclose(got, want, rtol=1e-12, atol=1e-9) and (m < 100 or want.any())
