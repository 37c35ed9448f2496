"""Shares of shortest paths from blocks of sources, which run in parallel over a graph of a checked size.

A block holds a table of nodes by sources.  A step is a sum or a minimum over the neighbours of the rows that the last
step can have changed, for all sources of the block together, so the work per arc and source is that of adding numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes of a block's tables of nodes by sources, and most sources of a block.
BLOCK_BYTES, BLOCK_SOURCES = 160_000_000, 32
#: Cells of a table that a step works on at a time, so that they stay near the processor.
CELLS = 32_768


class Arcs:
    """Compressed rows: the places to[start[x]:start[x + 1]] are the neighbours of place x, with weights or none."""

    def __init__(self, start: np.ndarray, to: np.ndarray, weight: np.ndarray | None):
        self.start, self.to, self.weight = start, to, weight

    def of(self, rows: np.ndarray) -> np.ndarray:
        """Positions of the arcs of rows."""
        sizes = self.start[rows + 1] - self.start[rows]
        return np.repeat(self.start[rows] - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))

    def near(self, rows: np.ndarray) -> np.ndarray:
        """The neighbours of rows, ascending, each once."""
        if 16 * int((self.start[rows + 1] - self.start[rows]).sum()) < len(self.start):
            return np.unique(self.to[self.of(rows)]).astype(np.int64)
        seen = np.zeros(len(self.start) - 1, bool)
        for at in range(0, len(rows), CELLS):
            seen[self.to[self.of(rows[at : at + CELLS])]] = True
        return np.flatnonzero(seen)

    def within(self, rows: np.ndarray) -> Arcs:
        """The arcs of ascending rows that hold all their neighbours, by places among them."""
        at = self.of(rows)
        start = np.r_[0, np.cumsum(self.start[rows + 1] - self.start[rows])]
        return Arcs(start, np.searchsorted(rows, self.to[at]).astype(np.int32), None if self.weight is None else self.weight[at])

    def runs(self, rows: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, Iterator[tuple[int, np.ndarray]]]]:
        """Rows a run at a time, and for each run steps (c, positions): the next arc of each of its first c rows; at the end
        the many arcs left of few rows come as steps (-1 - i, positions) of row i alone."""
        sizes = self.start[rows + 1] - self.start[rows]
        order = np.argsort(-sizes, kind="stable")
        size = max(CELLS // width, 1)
        for at in range(0, len(rows), size):
            run = rows[order[at : at + size]]
            yield run, self._steps(run, sizes[order[at : at + size]], size)

    def _steps(self, run: np.ndarray, sizes: np.ndarray, size: int) -> Iterator[tuple[int, np.ndarray]]:
        first = self.start[run]
        upto = int(sizes[8]) if len(run) > 8 else 0  # the eight rows of most arcs go one by one beyond the ninth's
        counts = np.searchsorted(-sizes, -np.arange(upto), side="left")
        for k, c in enumerate(counts.tolist()):
            yield c, first[:c] + k
        for i in range(len(run)):
            if sizes[i] <= upto:
                break
            for lo in range(int(first[i]) + upto, int(first[i] + sizes[i]), size):
                yield -1 - i, np.arange(lo, min(lo + size, int(first[i] + sizes[i])))


class Adjacency:
    """A graph of places 0..n-1: arcs by their source (out) and by their end (into), one and the same if undirected."""

    def __init__(self, out: Arcs, into: Arcs):
        self.out, self.into = out, into
        self.n = len(out.start) - 1
        self.rounds = 0  # that a part took to be found from its first source
        self._last: tuple[np.ndarray, Adjacency] | None = None

    def around(self, sources: np.ndarray) -> tuple[np.ndarray, Adjacency]:
        """(ascending places, graph): a closed part of the graph that holds all that the sources reach; kept for the next block."""
        if self._last is not None:
            rows = self._last[0]
            at = np.minimum(np.searchsorted(rows, sources), len(rows) - 1)
            if (rows[at] == sources).all():
                return self._last
        self._last = None
        seen, rounds = np.zeros(self.n, bool), 0
        front = np.unique(sources)
        while len(front):
            rounds += 1
            seen[front] = True
            met = self.out.near(front)
            if self.into is not self.out:  # parts are closed both ways, so that sums over arcs that come in stay within
                met = np.union1d(met, self.into.near(front))
            front = met[~seen[met]]
        rows = np.flatnonzero(seen)
        part = self
        if len(rows) < self.n:
            out = self.out.within(rows)
            part = Adjacency(out, out if self.into is self.out else self.into.within(rows))
        part.rounds = rounds
        self._last = rows, part
        return self._last


def _sums(arcs: Arcs, rows: np.ndarray, x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, sums of x over their neighbours), a run at a time."""
    width = x.shape[1]
    for run, steps in arcs.runs(rows, width):
        total, room = np.zeros((len(run), width)), np.empty((len(run), width))
        for c, at in steps:
            if c < 0:
                total[-1 - c] += x[arcs.to[at]].sum(axis=0)
            else:
                total[:c] += np.take(x, arcs.to[at], axis=0, out=room[:c], mode="clip")
        yield run, total


def _each(arcs: Arcs, cells: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(cells, their numbers of arcs, cells at the other end of each arc), some at a time; a cell is row * width + source."""
    rows = cells // width
    upto = np.cumsum(arcs.start[rows + 1] - arcs.start[rows])
    at = 0
    while at < len(cells):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + 16 * CELLS, side="right")))
        sizes = np.diff(upto[at:end], prepend=upto[at - 1] if at else 0)
        yield cells[at:end], sizes, arcs.to[arcs.of(rows[at:end])].astype(np.int64) * width + np.repeat(cells[at:end] % width, sizes)
        at = end


def _once(x: np.ndarray) -> np.ndarray:
    """Sorted numbers, each once."""
    return x[np.diff(x, prepend=-1) != 0]


def _work(arcs: Arcs, rows: np.ndarray) -> int:
    return int((arcs.start[rows + 1] - arcs.start[rows]).sum())


#: Time of an arc that is followed for one cell, or for one cell whose neighbours are added up, by that of an arc in a sum of rows.
PUSH, PULL = 12, 6


def _by_levels(g: Adjacency, sources: np.ndarray, own: np.ndarray | None) -> np.ndarray:
    """For each place the sum, over the sources, of its shares of the shortest paths to own (all places if None); arcs count 1.

    A level is found from its front cell by cell, or where most cells are in it by sums of rows, whichever is less work.
    """
    width = len(sources)
    depth, paths, table = (np.full(g.n * width, x) for x in (np.int32(-1), 0.0, 0.0))
    rows_of = lambda x: x.reshape(g.n, width)
    cells = np.sort(sources.astype(np.int64) * width + np.arange(width))
    depth[cells], paths[cells] = 0, 1.0
    levels, owner = [], np.empty(g.n * width, np.int32)
    open_ = np.full(g.n, True)
    while len(cells):
        levels.append(cells)
        found = [np.empty(0, np.int64)]
        rows = _once(cells // width)
        push = PUSH * _work(g.out, cells // width)
        met = None
        if push > PUSH * CELLS:
            met = g.out.near(rows)
            met = met[open_[met]]
        if met is None or push < width * _work(g.into, met):
            for some, sizes, ends in _each(g.out, cells, width):
                known = depth[ends]
                np.add.at(paths, ends, np.where((known < 0) | (known == len(levels)), np.repeat(paths[some], sizes), 0.0))
                new = ends[known < 0]
                owner[new] = np.arange(len(new), dtype=np.int32)
                new = new[owner[new] == np.arange(len(new))]  # each once
                depth[new] = len(levels)
                found.append(new)
        else:
            table[cells] = paths[cells]
            for run, total in _sums(g.into, met, rows_of(table)):
                hit = (total > 0) & (rows_of(depth)[run] < 0)
                mine = (run[:, None] * width + np.arange(width))[hit]
                depth[mine], paths[mine] = len(levels), total[hit]
                found.append(mine)
            open_[met] = (rows_of(depth)[met] < 0).any(axis=1)
            table[cells] = 0.0
        cells = np.sort(np.concatenate(found))
    share = np.zeros(g.n)
    ends = 1.0 if own is None else own.ravel()
    part = np.zeros(len(levels[-1]))
    for d in range(len(levels) - 1, 1, -1):
        last, cells = levels[d], levels[d - 1]
        gives = ((1.0 if own is None else ends[last]) + part) / paths[last]
        rows = _once(cells // width)
        whole, pull, push = width * _work(g.out, rows), PULL * _work(g.out, cells // width), PUSH * _work(g.into, last // width)
        if push <= min(whole, pull):
            at = 0
            for some, sizes, befores in _each(g.into, last, width):
                hit = depth[befores] == d - 1
                np.add.at(table, befores[hit], np.repeat(gives[at : at + len(some)], sizes)[hit])
                at += len(some)
            got = table[cells]
            table[cells] = 0.0
        else:
            table[last] = gives
            if pull <= whole:
                got = np.zeros(len(cells))
                at = 0
                for some, sizes, afters in _each(g.out, cells, width):
                    has = np.flatnonzero(sizes)
                    if len(has):
                        got[at + has] = np.add.reduceat(table[afters], (np.cumsum(sizes) - sizes)[has])
                    at += len(some)
            else:
                got = np.empty(len(cells))
                owner[cells] = np.arange(len(cells), dtype=np.int32)
                for run, total in _sums(g.out, rows, rows_of(table)):
                    here = rows_of(depth)[run] == d - 1
                    got[rows_of(owner)[run][here]] = total[here]
            table[last] = 0.0
        part = got * paths[cells]
        share += np.bincount(cells // width, weights=part, minlength=g.n)
    return share


def _ends(arcs: Arcs, cells: np.ndarray, rows: np.ndarray, most: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, end, numbers of arcs, cells at the other end of each arc) of stretches of cells; a cell is source * places + row."""
    first = arcs.start[rows]
    sizes = arcs.start[rows + 1] - first
    upto = np.cumsum(sizes)
    first += sizes
    first -= upto
    base = cells - rows if len(cells) and cells[-1] >= len(arcs.start) - 1 else None
    at, done = 0, 0
    while at < len(cells):
        end = max(at + 1, int(np.searchsorted(upto, done + most, side="right")))
        some, upper = sizes[at:end], int(upto[end - 1])
        where = np.repeat(first[at:end], some)
        where += np.arange(done, upper)
        ends = arcs.to.take(where, mode="clip")
        if base is not None:
            ends = np.add(ends, np.repeat(base[at:end], some), out=where)
        else:
            where[:] = ends
            ends = where
        yield at, end, some, ends
        at, done = end, upper


def _given(arcs: Arcs, cells: np.ndarray, rows: np.ndarray, x: np.ndarray, size: int) -> np.ndarray:
    """For all cells, the sums of what x of cells gives along their arcs."""
    total = None
    for at, end, sizes, ends in _ends(arcs, cells, rows, max(STRETCH, 2 * size)):
        part = np.bincount(ends, weights=np.repeat(x[at:end], sizes), minlength=size)
        total = part if total is None else np.add(total, part, out=total)
    return total


def _taken(arcs: Arcs, cells: np.ndarray, rows: np.ndarray, table: np.ndarray) -> np.ndarray:
    """For cells, the sums of the table over their neighbours."""
    got = np.zeros(len(cells))
    for at, _, sizes, ends in _ends(arcs, cells, rows, STRETCH):
        has = np.flatnonzero(sizes)
        if len(has):
            got[at + has] = np.add.reduceat(table[ends], (np.cumsum(sizes) - sizes)[has])
    return got


def _cuts(arcs: Arcs) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about as many arcs."""
    cuts = np.r_[np.searchsorted(arcs.start[1:], np.arange(0, len(arcs.to), 4 * STRETCH)), len(arcs.start) - 1].tolist()
    return zip(cuts[:-1], cuts[1:], strict=True)


def _summed(arcs: Arcs, table: np.ndarray) -> np.ndarray:
    """For all cells, the sums of the table over their neighbours, arcs in the order they are held."""
    n = len(arcs.start) - 1
    got = np.zeros(len(table))
    for lo, hi in _cuts(arcs):
        has = lo + np.flatnonzero(np.diff(arcs.start[lo : hi + 1]))
        if len(has):
            to = arcs.to[arcs.start[lo] : arcs.start[hi]].astype(np.int64)
            for base in range(0, len(table), n):
                got[base + has] = np.add.reduceat(table[base : base + n][to], arcs.start[has] - arcs.start[lo])
    return got


#: Time of an arc that is followed from a cell, or over which a cell adds up, by that of an arc in a sum for all cells; of an
#: arc followed with a look at what is known, and of a cell of the tables.
PUSHED, PULLED, LOOK, CELL = 2.2, 2.3, 6.0, 0.8
#: Arcs that are followed at a time, and cells of a block of few levels: its tables stay near the processor.
STRETCH, BLOCK_CELLS = 32_768, 65_536
#: Draws of as many marks.
DRAWS = 2
#: Distances that are told on together, by the mean weight.
STEP = 0.25
#: Most rounds in which a part is found that is taken as one of few levels.
FEW_LEVELS = 16


def _by_few_levels(g: Adjacency, sources: np.ndarray, own: np.ndarray | None) -> np.ndarray:
    """As _by_levels, for few levels of many cells: each source has its own tables, one behind the other.

    A level is found from the last one, arc by arc, or from the cells not reached, or by sums for all cells, whichever is
    less work; so are the shares that go back.
    """
    n, size = g.n, g.n * len(sources)
    depth, paths, table = np.full(size, -1, np.int32), np.zeros(size), np.zeros(size)
    owner = np.empty(size, np.int32)
    row_of = (lambda x: x) if len(sources) == 1 else np.tile(np.arange(n), len(sources)).__getitem__
    cells, rows = np.arange(0, size, n) + sources, sources
    depth[cells], paths[cells] = 0, 1.0
    levels, left, arcs_left = [], size - len(cells), len(g.into.to) * len(sources)
    whole = len(g.out.to) * len(sources) + CELL * size
    while len(cells):
        push = _work(g.out, rows)
        levels.append((cells, rows, push, push if g.into is g.out else _work(g.into, rows)))
        if not left:
            break
        arcs_left -= levels[-1][3]
        if LOOK * push < PUSHED * push + 4 * CELL * size:
            found = [np.empty(0, np.int64)]
            for at, end, sizes, ends in _ends(g.out, cells, rows, STRETCH):
                new = depth[ends] < 0
                ends = ends[new]
                np.add.at(paths, ends, np.repeat(paths[cells[at:end]], sizes)[new])
                found.append(ends)
            found = np.concatenate(found)
            owner[found] = np.arange(len(found), dtype=np.int32)
            cells = np.sort(found[owner[found] == np.arange(len(found))])  # each once
        else:
            rest = np.flatnonzero(depth < 0)
            pull, push = PULLED * arcs_left, PUSHED * push + CELL * size
            if push <= min(pull, whole):
                got = _given(g.out, cells, rows, paths[cells], size)[rest]
            else:
                table[cells] = paths[cells]
                got = _taken(g.into, rest, row_of(rest), table) if pull <= whole else _summed(g.into, table)[rest]
                table[cells] = 0.0
            hit = got > 0
            cells = rest[hit]
            paths[cells] = got[hit]
        rows = row_of(cells)
        depth[cells] = len(levels)
        left -= len(cells)
    share = np.zeros(size)
    for d in range(len(levels) - 1, 1, -1):
        (last, ends, _, push), (cells, rows, pull, _) = levels[d], levels[d - 1]
        gives = ((1.0 if own is None else own[last]) + share[last]) / paths[last]
        pull, push = PULLED * pull, PUSHED * push + CELL * size
        if push < min(pull, whole):
            got = _given(g.into, last, ends, gives, size)[cells]
        else:
            table[last] = gives
            got = _taken(g.out, cells, rows, table) if pull <= whole else _summed(g.out, table)[cells]
            table[last] = 0.0
        share[cells] = got * paths[cells]
    return share.reshape(-1, n).sum(axis=0)


def _from_marks(arcs: Arcs, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distances of all places to their nearest mark, the marks); places that reach none are their own mark, infinitely far."""
    n = len(arcs.start) - 1
    far, top = np.full(n, np.inf), np.arange(n)
    far[marks] = 0.0
    front = np.unique(marks)
    while len(front):
        before = far.copy()
        for at, end, sizes, to in _ends(arcs, front, front, STRETCH):
            first = arcs.start[front[at:end]]
            where = np.repeat(first - np.cumsum(sizes) + sizes, sizes) + np.arange(len(to))
            np.minimum.at(far, to, np.repeat(far[front[at:end]], sizes) + arcs.weight[where])
        front = np.flatnonzero(far < before)
    for lo, hi, rows, to in _rows_of(arcs):
        last = (far[rows] + arcs.weight[lo:hi] == far[to]) & np.isfinite(far[to])
        top[to[last]] = rows[last]
    top[marks] = marks
    while True:
        above = top[top]
        if (above == top).all():
            return far, top
        top = above


def _rows_of(arcs: Arcs) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, end, rows, neighbours) of the arcs, some at a time."""
    for a, b in _cuts(arcs):
        lo, hi = int(arcs.start[a]), int(arcs.start[b])
        yield lo, hi, np.repeat(np.arange(a, b), np.diff(arcs.start[a : b + 1])), arcs.to[lo:hi].astype(np.int64)


def without_detours(arcs: Arcs) -> Arcs:
    """The arcs of an undirected graph without some that are longer than a way round them, and so on no shortest path.

    If two places have the same nearest mark, there is a way through it.  Marks are drawn, few and many, again and again; any
    draw leaves out right arcs only.  The slack is above that with which path lengths count as tied.
    """
    n = len(arcs.start) - 1
    rng, slack, marks = np.random.default_rng(0), 2e-9 * max(float(arcs.weight.sum()), 1.0), 1
    while marks * 8 < n:
        for _ in range(DRAWS):
            far, top = _from_marks(arcs, rng.choice(n, marks, replace=False))
            kept = np.empty(len(arcs.to), bool)
            sizes = np.zeros(n, np.int64)
            for lo, hi, rows, to in _rows_of(arcs):
                kept[lo:hi] = (top[rows] != top[to]) | ~(arcs.weight[lo:hi] > far[rows] + far[to] + slack)
                sizes += np.bincount(rows[kept[lo:hi]], minlength=n)
            arcs = Arcs(np.r_[0, np.cumsum(sizes)], arcs.to[kept], arcs.weight[kept])
        marks *= 4
    return arcs


def _least(g: Adjacency, sources: np.ndarray) -> np.ndarray:
    """Distances, places by sources: rows next to what became nearer take the least over their neighbours, until all stand."""
    width = len(sources)
    far = np.full((g.n, width), np.inf)
    far[sources, np.arange(width)] = 0.0
    changed = np.unique(sources)
    into = g.into
    while len(changed):
        nearer = []
        for run, steps in into.runs(g.out.near(changed), width):
            best, room = far[run], np.empty((len(run), width))
            for c, at in steps:
                if c < 0:
                    np.minimum(best[-1 - c], (far[into.to[at]] + into.weight[at][:, None]).min(axis=0), out=best[-1 - c])
                else:
                    x = np.take(far, into.to[at], axis=0, out=room[:c], mode="clip")
                    x += into.weight[at][:, None]
                    np.minimum(best[:c], x, out=best[:c])
            less = (best < far[run]).any(axis=1)
            far[run[less]] = best[less]
            nearer.append(run[less])
        changed = np.sort(np.concatenate(nearer)) if nearer else np.empty(0, np.int64)
    return far


def _last_arcs(g: Adjacency, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(from, to): arcs on shortest paths, for each source, as cells of the table.

    Path lengths count as tied by their relative difference above 1, by their absolute one below.
    """
    width, into = far.shape[1], g.into
    ends: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    for run, steps in into.runs(np.flatnonzero(np.isfinite(far).any(axis=1)), width):
        mine = far[run]
        slack = 1e-9 * np.maximum(1.0, mine)
        for c, at in steps:
            to = into.to[at].astype(np.int64)
            d, eps, row = (mine[:c], slack[:c], run[:c]) if c >= 0 else (mine[[-1 - c]], slack[[-1 - c]], np.repeat(run[-1 - c], len(at)))
            before = far[to]
            with np.errstate(invalid="ignore"):
                there = before + into.weight[at][:, None]
                tied = (np.abs(there - d) <= np.maximum(eps, 1e-9 * there)) & (before < d) & np.isfinite(d)
            i, b = np.nonzero(tied)
            ends.append((to[i] * width + b, row[i].astype(np.int64) * width + b))
    return np.concatenate([e[0] for e in ends]), np.concatenate([e[1] for e in ends])


def _nearest(g: Adjacency, sources: np.ndarray) -> np.ndarray:
    """Distances, a table for each source, one behind the other: the nearest cells that became nearer tell their neighbours."""
    n, arcs = g.n, g.out
    far, open_, place = np.full(n * len(sources), np.inf), np.zeros(n * len(sources), bool), np.tile(np.arange(n), len(sources))
    cells = np.arange(0, len(far), n) + sources
    far[cells], open_[cells] = 0.0, True
    step = STEP * float(arcs.weight.mean()) if len(arcs.weight) else 1.0
    while True:
        cells = np.flatnonzero(open_)
        if not len(cells):
            return far
        mine = far[cells]
        cells = cells[mine <= mine.min() + step]
        open_[cells] = False
        rows, mine = place[cells], far[cells]
        for at, end, sizes, ends in _ends(arcs, cells, rows, STRETCH):
            where = np.repeat(arcs.start[rows[at:end]] - np.cumsum(sizes) + sizes, sizes)
            where += np.arange(len(where))
            told = np.repeat(mine[at:end], sizes)
            told += arcs.weight[where]
            less = np.flatnonzero(told < far[ends])
            ends = ends[less]
            np.minimum.at(far, ends, told[less])
            open_[ends] = True


def _last_arcs_of_each(g: Adjacency, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As _last_arcs, of tables one behind the other."""
    arcs, n = g.out, g.n
    got: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    slack = 2e-9 * max(1.0, float(far[np.isfinite(far)].max()) + float(arcs.weight.max(initial=0.0)))
    for lo, hi, rows, to in _rows_of(arcs):
        w = arcs.weight[lo:hi]
        for base in range(0, len(far), n):
            mine = far[base : base + n]
            with np.errstate(invalid="ignore"):
                gap = mine[rows]
                gap += w
                gap -= mine[to]
                near = np.flatnonzero(gap <= slack)
            u, v = rows[near], to[near]
            there, d = mine[u] + w[near], mine[v]
            tied = (np.abs(there - d) <= 1e-9 * np.maximum(np.maximum(1.0, d), there)) & (mine[u] < d)
            got.append((u[tied] + base, v[tied] + base))
    return np.concatenate([x[0] for x in got]), np.concatenate([x[1] for x in got])


def _by_distance(g: Adjacency, sources: np.ndarray, own: np.ndarray | None) -> np.ndarray:
    """As _by_levels, along weights."""
    far = _least(g, sources)
    u, v = _last_arcs(g, far)
    width = len(sources)
    cells, x = _back(u, v, np.isfinite(far).ravel(), sources.astype(np.int64) * width + np.arange(width), own)
    return np.bincount(cells // width, weights=x, minlength=g.n)


def _by_few_distances(g: Adjacency, sources: np.ndarray, own: np.ndarray | None) -> np.ndarray:
    """As _by_few_levels, along weights."""
    far = _nearest(g, sources)
    u, v = _last_arcs_of_each(g, far)
    cells, x = _back(u, v, np.isfinite(far), np.arange(0, len(far), g.n) + sources, own)
    return np.bincount(cells % g.n, weights=x, minlength=g.n)


def _back(u: np.ndarray, v: np.ndarray, reached: np.ndarray, first: np.ndarray, own: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(cells reached, their shares) by the arcs (u, v) on shortest paths from the cells first."""
    width = len(first)
    order = np.argsort(u, kind="stable")
    u, v = u[order], v[order]
    cells = np.flatnonzero(reached)  # the tables of paths are lists over cells that are reached
    if len(cells) < len(reached):
        place = np.cumsum(reached) - 1
        u, v = place[u], place[v]
    start = np.r_[0, np.cumsum(np.bincount(u, minlength=len(cells)))]
    first = np.searchsorted(cells, first)
    paths, step = np.zeros(len(cells)), np.zeros(len(cells), np.int32)
    paths[first] = 1.0
    front, counts, rounds = first, np.ones(width), 0
    while len(front):
        rounds += 1
        sizes = start[front + 1] - start[front]
        at = np.repeat(start[front] - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))
        met, place = np.unique(v[at], return_inverse=True)
        counts = np.bincount(place, weights=np.repeat(counts, sizes), minlength=len(met))
        paths[met] += counts
        step[met] = rounds  # the most arcs of a shortest path to it
        front = met
    x = np.ones(len(cells)) if own is None else own.ravel()[cells]
    x[first] = 0.0
    mine = x.copy()
    order = np.argsort(step[v], kind="stable")
    u, v = u[order], v[order]
    cuts = np.searchsorted(step[v], np.arange(rounds + 1))
    for r in range(rounds - 1, 0, -1):
        a, b = u[cuts[r] : cuts[r + 1]], v[cuts[r] : cuts[r + 1]]
        np.add.at(x, a, x[b] * paths[a] / paths[b])
    x -= mine
    x[first] = 0.0
    return cells, x


def shares(g: Adjacency, sources: np.ndarray, targets: list[dict[int, float]] | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, shares), a block of sources at a time: for each inner node, the sum over the sources and their targets (all,
    or with multiplicities) of its share of the shortest paths between them."""
    weighted = g.out.weight is not None
    at = 0
    while at < len(sources):
        rows, part = g.around(sources[at : at + 1])
        few = part.rounds <= FEW_LEVELS
        many = max(min(BLOCK_CELLS // part.n if few else BLOCK_BYTES // (part.n * 48), BLOCK_SOURCES), 1)
        block = sources[at : at + many]
        inside = rows[np.minimum(np.searchsorted(rows, block), len(rows) - 1)] == block
        if not inside.all():  # the next ones lie in other parts
            block = block[: int(np.argmin(inside))]
        own = None
        if targets is not None:
            own = np.zeros((part.n, len(block)))
            for b, to in enumerate(targets[at : at + len(block)]):
                ids = np.fromiter(to, np.int64, len(to))
                place = np.minimum(np.searchsorted(rows, ids), len(rows) - 1)
                there = rows[place] == ids
                own[place[there], b] = np.fromiter(to.values(), float, len(to))[there]
        if few and own is not None:
            own = own.T.ravel()
        way = (_by_few_distances if few else _by_distance) if weighted else _by_few_levels if few else _by_levels
        got = way(part, np.searchsorted(rows, block), own)
        some = np.flatnonzero(got)
        yield rows[some], got[some]
        at += len(block)
