"""Iterative and path-based node measures of one graph."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from hashlib import md5

import numpy as np

from lattica.graphs import Local


def degrees(g: Local) -> np.ndarray:
    return np.bincount(g.src, minlength=g.n) + np.bincount(g.dst, minlength=g.n)


def spread(g: Local, x: np.ndarray) -> np.ndarray:
    """The sum of x over each node's neighbours."""
    return np.bincount(g.src, x[g.dst], g.n) + np.bincount(g.dst, x[g.src], g.n)


def pagerank(g: Local, alpha: float = 0.85, tol: float | None = 1e-6, max_iter: int = 100) -> np.ndarray | None:
    """Power iteration with uniform teleport and dangling mass; None if it does not settle. tol None: max_iter rounds."""
    if not g.n:
        return np.zeros(0)
    d = degrees(g)
    x = np.full(g.n, 1 / g.n)
    for _ in range(max_iter):
        last = x
        x = alpha * (spread(g, np.divide(last, d, out=np.zeros(g.n), where=d > 0)) + last[d == 0].sum() / g.n) + (1 - alpha) / g.n
        if tol is not None and np.abs(x - last).sum() < g.n * tol:
            return x
    return x if tol is None else None


def eigenvector(g: Local, tol: float | None = 1e-6, max_iter: int = 100) -> np.ndarray | None:
    """Iterates x + Ax, scaled to length 1; None if it does not settle. tol None: max_iter rounds."""
    if not g.n:
        return np.zeros(0)
    x = np.full(g.n, 1 / g.n)
    for _ in range(max_iter):
        last = x
        x = last + spread(g, last)
        x = x / (np.sqrt((x * x).sum()) or 1.0)
        if tol is not None and np.abs(x - last).sum() < g.n * tol:
            return x
    return x if tol is None else None


def core_numbers(g: Local) -> np.ndarray:
    """k-cores by peeling nodes of least degree from buckets."""
    near, d = g.neighbours(), degrees(g).tolist()
    buckets: list[set[int]] = [set() for _ in range(max(d, default=0) + 1)]
    for v, k in enumerate(d):
        buckets[k].add(v)
    core, k = np.zeros(g.n, np.int64), 0
    for _ in range(g.n):
        k = max(0, k - 1)
        while not buckets[k]:
            k += 1
        v = buckets[k].pop()
        core[v], d[v] = k, -1
        for u in near[v]:
            if d[u] > k:
                buckets[d[u]].discard(u)
                d[u] -= 1
                buckets[d[u]].add(u)
    return core


def distances(near: list[list[int]], source: int) -> list[int]:
    """Hops from source; -1 if out of reach."""
    out = [-1] * len(near)
    out[source] = 0
    queue = deque([source])
    while queue:
        v = queue.popleft()
        for u in near[v]:
            if out[u] < 0:
                out[u] = out[v] + 1
                queue.append(u)
    return out


#: Nodes of a lot at least, neighbours of a node taken column by column, and hops from which a search of single sources is the faster.
LOT, COLUMNS, DEEP = 1024, 32, 64


def lots(g: Local) -> tuple[list[np.ndarray], np.ndarray]:
    """All nodes, in lots of whole components (but for the last, a lot has LOT nodes or more), and each node's component."""
    root = np.arange(g.n)
    while True:
        was, low = root.copy(), np.minimum(root[g.src], root[g.dst])
        for end in (g.src, g.dst):
            np.minimum.at(root, was[end], low)
        while (root[root] != root).any():
            root = root[root]
        if (root == was).all():
            break
    order, cuts = np.argsort(root, kind="stable"), [0]
    for end in (np.flatnonzero(np.diff(root[order], append=-1)) + 1).tolist():
        if end - cuts[-1] >= LOT:
            cuts.append(end)
    return [x for x in np.split(order, cuts[1:]) if len(x)], root


class Near:
    """Neighbours within a lot, for a row of values per node: rows are the lot's nodes, those with most neighbours first."""

    def __init__(self, g: Local, lot: np.ndarray):
        d = degrees(g)[lot]
        order = np.argsort(-d, kind="stable")
        self.nodes, d = lot[order], d[order]
        at = np.full(g.n, -1)
        at[self.nodes] = np.arange(len(lot))
        a, b = at[np.concatenate((g.src, g.dst))], at[np.concatenate((g.dst, g.src))]
        b = b[np.argsort(a, kind="stable")[(a < 0).sum() :]]
        first = np.cumsum(d) - d
        self.columns = [b[first[:c] + j] for j in range(COLUMNS) if (c := int((d > j).sum()))]
        self.hubs = int((d > COLUMNS).sum())
        self.rest = np.concatenate([b[i + COLUMNS : i + k] for i, k in zip(first[: self.hubs], d[: self.hubs], strict=True)]) if self.hubs else b[:0]
        self.heads = np.cumsum(d[: self.hubs] - COLUMNS) - (d[: self.hubs] - COLUMNS)

    def reached(self, rows: np.ndarray) -> np.ndarray:
        """Whether each row has one of the given rows, in ascending order, as a neighbour."""
        out = np.zeros(len(self.nodes), bool)
        for c in self.columns:
            out[c[rows[: np.searchsorted(rows, len(c))]]] = True
        if self.hubs and len(rows) and rows[0] < self.hubs:
            out[self.rest] = True  # of any hub: too many, never too few
        return out

    def over(self, f: np.ufunc, x: np.ndarray, rows: np.ndarray | None = None, room: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        """f over the rows of the neighbours of all nodes, or of some rows in ascending order; 0 without any. room: two arrays like x to work in."""
        out, part = room or (np.empty_like(x), np.empty_like(x))
        out, first = out[: len(x) if rows is None else len(rows)], 0
        for i, c in enumerate(self.columns):
            own = c if rows is None else c[rows[: np.searchsorted(rows, len(c))]]
            if i:
                np.take(x, own, axis=0, out=part[: len(own)], mode="clip")  # with "raise", take works in a copy
                f(out[: len(own)], part[: len(own)], out=out[: len(own)])
            else:
                np.take(x, own, axis=0, out=out[: len(own)], mode="clip")
                first = len(own)
        out[first:] = 0
        hubs = slice(self.hubs) if rows is None else rows[: np.searchsorted(rows, self.hubs)]
        k = self.hubs if rows is None else len(hubs)
        if k:
            f(out[:k], f.reduceat(x[self.rest], self.heads, axis=0)[hubs], out=out[:k])
        return out


def within(g: Local) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(v, k, c): c nodes are k hops from v, c > 0; several times for the same v and k. Searches go side by side, a bit each.

    Rows are worked on only where a search has yet to come by, and, while few rows are new, only next to those. Within
    what is handed on at once, the k of a v rise.
    """
    near, (all_lots, root) = g.neighbours(), lots(g)
    for lot in all_lots:
        if max(distances(near, lot[-1])) > DEEP:
            for v in lot.tolist():
                c = np.bincount([x for x in distances(near, v) if x >= 0])
                yield np.full(len(c), v), np.arange(len(c)), c
            continue
        rows, n = Near(g, lot), len(lot)
        whole = np.unique(root[rows.nodes], return_inverse=True)[1]
        words = min(max(2**22 // n, 1), 16)
        new, *room = (np.empty((n, words), np.uint64) for _ in range(3))
        for s in range(0, n, 64 * words):
            own = np.arange(min(64 * words, n - s))
            live, k = s + own, 0
            new[:] = 0
            new[live, own // 64] = np.uint64(1) << (own % 64).astype(np.uint64)
            unseen = ~new
            left = np.bincount(whole[live], minlength=whole.max() + 1)[whole]  # searches that have yet to come by: those of a node's component
            left[live] -= 1
            yield rows.nodes[live], np.zeros(len(live), np.int64), np.ones(len(live), np.int64)
            while (wait := left > 0).any():
                k += 1
                some = np.flatnonzero(wait & rows.reached(live) if len(live) < n // 4 else wait)
                if len(some) == n:
                    got = rows.over(np.bitwise_or, new, None, room)
                    got &= unseen
                    unseen ^= got
                    new, room[0] = got, new
                else:
                    got = rows.over(np.bitwise_or, new, some, room)
                    got &= unseen[some]
                    unseen[some] ^= got
                    new[live] = 0
                    new[some] = got
                c = np.bitwise_count(got).sum(axis=1, dtype=np.uint16).astype(np.int64)  # as far from v to a source as back
                left[some] -= c
                live, c = some[c > 0], c[c > 0]
                yield rows.nodes[live], np.full(len(live), k), c


def closeness_and_eccentricity(g: Local) -> dict[str, np.ndarray]:
    """Wasserman-Faust closeness; eccentricity, or -1 everywhere if the graph is not connected; second: how many nodes are two hops away."""
    reached, far, ecc, second = np.zeros(g.n), np.zeros(g.n), np.zeros(g.n), np.zeros(g.n)
    for v, k, c in within(g):
        reached += np.bincount(v, c, g.n)
        far += np.bincount(v, k * c, g.n)
        ecc[v] = np.maximum(ecc[v], k)  # the last of equal v counts, and k rises
        second += np.bincount(v, np.where(k == 2, c, 0), g.n)
    other = reached - 1
    close = np.divide(other, far, out=np.zeros(g.n), where=far > 0) * other / max(g.n - 1, 1)
    return {"closeness": close, "eccentricity": ecc if (reached == g.n).all() else np.full(g.n, -1.0), "second": second}


def hop_counts(g: Local) -> np.ndarray:
    """How many pairs of a source and a node in its reach, itself too, are 0, 1, ... hops apart."""
    out = np.zeros(0, np.int64)
    for _, k, c in within(g):
        out = np.pad(out, (0, max(0, k.max() + 1 - len(out))))
        np.add.at(out, k, c)
    return out


#: Eight bits as eight bytes; links, times the searches, that _through works on at once.
SPREAD, ROOM = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0], 2**18


def _hops(near: Near, own: np.ndarray, wide: int) -> Iterator[np.ndarray]:
    """Hops to each row, 0 out of reach, from the rows own, a column each: wide, a multiple of 8, at a time and at most 1,024 in all.

    All are searched side by side; a level adds its bits to those of the hops.
    """
    n, columns = len(near.nodes), np.arange(len(own))
    new = np.zeros((n, -(-len(own) // 64)), np.uint64)
    new[own, columns // 64] = np.uint64(1) << (columns % 64).astype(np.uint64)
    unseen, live, k, planes = ~new, np.sort(own), 0, []
    room, wait = (np.empty_like(new), np.empty_like(new)), np.ones(n, bool)
    while True:
        k += 1
        some = np.flatnonzero(wait & near.reached(live))
        got = near.over(np.bitwise_or, new, some, room)
        got &= unseen[some]
        fresh = got.any(axis=1)
        new[live] = 0
        live, got = some[fresh], got[fresh]
        if not len(live):
            break
        new[live] = got
        still = unseen[live] ^ got
        unseen[live], wait[live] = still, still.any(axis=1)
        planes += [np.zeros_like(new) for _ in range(k.bit_length() - len(planes))]
        for j, plane in enumerate(planes):
            if k >> j & 1:
                plane[live] |= got
    for s in range(0, len(own), wide):
        out = np.zeros((n, wide // 8), np.uint64)
        for j, plane in enumerate(planes):
            out |= SPREAD.take(plane.view(np.uint8)[:, s // 8 : (s + wide) // 8]) << np.uint64(j)
        yield out.view(np.uint8)[:, : len(own) - s]


def _through(near: Near, a: np.ndarray, b: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Shares of the shortest paths from the rows own that go through each row; a and b are the links' rows.

    For some searches at once nodes are ranked by their hops, and links between nodes unequally far are numbers made of
    their ends' ranks: sorted, they go by levels. Each is worked on once each way. What is summed is a node's share over its paths.
    """
    n, total, wide = len(near.nodes), np.zeros(len(near.nodes)), 64
    while wide > 1 and (wide * n >= 2**16 or wide * len(a) > ROOM):
        wide //= 2
    half = 16 if wide * n < 2**16 else 32
    kind = np.dtype(f"u{half // 4}")
    for s in range(0, len(own), step := 64 * min(max(2**20 // n, 1), 16)):
        lot, at = own[s : s + step], s
        for block in _hops(near, lot, max(wide, 8)):
            level = np.ascontiguousarray(block.T)
            equal = np.ascontiguousarray((np.take(block, a, axis=0) == np.take(block, b, axis=0)).T)
            for c in range(0, len(level), wide):
                sources, at = own[at : at + wide][: len(level) - c], at + len(level[c : c + wide])
                _add_through(level[c : c + wide], equal[c : c + wide], a, b, sources, half, kind.type, total)
    return total


def _add_through(hops: np.ndarray, equal: np.ndarray, a: np.ndarray, b: np.ndarray, own: np.ndarray, half: int, kind: type, total: np.ndarray) -> None:
    """What _through sums, of the searches from own: a row of hops, and of which links' ends are equally far, each."""
    off, size = np.concatenate(([0], np.cumsum(np.bincount(hops.ravel())))).tolist(), hops.size
    rank = np.empty(size, kind)
    rank[np.argsort(hops.ravel(), kind="stable")] = np.arange(size, dtype=kind)
    rank = rank.reshape(hops.shape)
    x, y = rank.take(a, axis=1), rank.take(b, axis=1)
    link = np.minimum(x, y)
    link <<= kind(half)
    link |= np.maximum(x, y, out=x)
    link |= np.negative(equal.astype(kind))  # the largest number: last, and left out
    link = link.ravel()
    link.sort()
    link = link[: link.size - np.count_nonzero(equal)]
    farther, nearer = (link & kind(2**half - 1)).astype(np.int64), (link >> kind(half)).astype(np.int64)
    ends = np.searchsorted(nearer, off).tolist()
    paths, part, depth = np.zeros(size), np.zeros(size), len(off) - 2
    paths[rank[np.arange(len(own)), own]] = 1
    for k in range(depth):
        at = slice(ends[k], ends[k + 1])
        farther[at] -= off[k + 1]
        paths[off[k + 1] : off[k + 2]] = np.bincount(farther[at], paths.take(nearer[at]), off[k + 2] - off[k + 1])
    share = 1 / paths[off[depth] :] if depth else paths
    for k in range(depth - 1, 0, -1):
        at, own_paths = slice(ends[k], ends[k + 1]), paths[off[k] : off[k + 1]]
        nearer[at] -= off[k]
        beyond = np.bincount(nearer[at], share.take(farther[at]), off[k + 1] - off[k])
        np.multiply(beyond, own_paths, out=part[off[k] : off[k + 1]])
        share = 1 / own_paths + beyond
    total += part.take(rank).sum(axis=0)


def _through_from(near: list[list[int]], s: int, total: np.ndarray) -> None:
    """The same from one source, node by node, added to total."""
    sigma, dist, order, before = [0.0] * len(near), [-1] * len(near), [], [[] for _ in near]
    sigma[s], dist[s] = 1.0, 0
    queue = deque([s])
    while queue:
        v = queue.popleft()
        order.append(v)
        for u in near[v]:
            if dist[u] < 0:
                dist[u] = dist[v] + 1
                queue.append(u)
            if dist[u] == dist[v] + 1:
                sigma[u] += sigma[v]
                before[u].append(v)
    part = [0.0] * len(near)
    for v in reversed(order):
        for p in before[v]:
            part[p] += sigma[p] / sigma[v] * (1 + part[v])
        if v != s:
            total[v] += part[v]


def betweenness(g: Local, pivots: int | None = None, seed: int = 0, part: int = 0, parts: int = 1) -> np.ndarray:
    """Shares of shortest paths through each node (Brandes), normalised; in larger graphs from the pivots with the least hashes of (seed, node).

    part of parts: from some of the sources only; the parts add up to the whole.
    """
    near, total, chosen = g.neighbours(), np.zeros(g.n), np.ones(g.n, bool)
    if pivots is not None and g.n > pivots:
        chosen[np.lexsort((np.arange(g.n), coins(g.ids, str(seed))))[pivots:]] = False
    for lot in lots(g)[0]:
        if max(distances(near, lot[-1])) > DEEP:
            for s in lot[chosen[lot]][part::parts].tolist():
                _through_from(near, s, total)
            continue
        rows, at = Near(g, lot), np.full(g.n, -1)
        at[rows.nodes] = np.arange(len(lot))
        a, b = at[g.src], at[g.dst]
        total[rows.nodes] += _through(rows, a[a >= 0], b[a >= 0], np.flatnonzero(chosen[rows.nodes])[part::parts])
    if g.n > 2:
        total *= g.n / chosen.sum() / ((g.n - 1) * (g.n - 2))
    return total


def mwua(g: Local, max_iter: int = 200, tol: float | None = 1e-5) -> dict[str, np.ndarray]:
    """Multiplicative weights on the edge constraints x_u + x_v <= 1; a bound on rounds, never on time."""
    names = ("mwua_avg_x", "mwua_avg_w", "mwua_min_w", "mwua_max_w")
    if not len(g.src):
        return dict(zip(names, (np.ones(g.n), np.zeros(g.n), np.zeros(g.n), np.zeros(g.n)), strict=True))
    w, sums, last, rounds = np.ones(len(g.src)), np.zeros(g.n), None, 0
    for _ in range(max_iter):
        load = np.bincount(g.src, w, g.n) + np.bincount(g.dst, w, g.n)
        x = np.maximum(0, 1 - load / w.sum())
        sums, rounds = sums + x, rounds + 1
        if tol is not None and last is not None and np.abs(x - last).max() < tol:
            break
        last = x
        w = w * (1 + np.maximum(0, x[g.src] + x[g.dst] - 1))
        if w.max() > 1e8:
            w = w / w.max()
    d, least, most = degrees(g), np.full(g.n, np.inf), np.zeros(g.n)
    for end in (g.src, g.dst):
        np.minimum.at(least, end, w)
        np.maximum.at(most, end, w)
    load = np.bincount(g.src, w, g.n) + np.bincount(g.dst, w, g.n)
    return dict(zip(names, (sums / rounds, np.divide(load, d, out=np.zeros(g.n), where=d > 0), np.where(d > 0, least, 0), most), strict=True))


def coins(ids: np.ndarray, key: str) -> np.ndarray:
    """A whole number below 2^32 for each id: a hash that any SQL engine can repeat."""
    return np.array([int(md5(f"{key}:{v}".encode()).hexdigest()[:8], 16) for v in ids.tolist()], np.int64)


def mis_frequency(g: Local, runs: int = 20, seed: int = 0) -> np.ndarray:
    """How often each node is in Luby's random maximal independent set; a round's priorities are hashes of (seed, run, round, node)."""
    counts = np.zeros(g.n)
    a, b = np.concatenate((g.src, g.dst)), np.concatenate((g.dst, g.src))
    for run in range(runs):
        alive, k = np.ones(g.n, bool), 0
        while alive.any():
            r = np.zeros(g.n, np.int64)
            r[alive] = coins(g.ids[alive], f"{seed}:{run}:{k}")
            live = alive[a] & alive[b]
            beaten = np.zeros(g.n, bool)
            beaten[a[live & (r[a] >= r[b])]] = True
            win = alive & ~beaten
            counts[win] += 1
            gone = win.copy()
            gone[b[win[a]]] = True
            alive &= ~gone
            k += 1
    return counts / runs
