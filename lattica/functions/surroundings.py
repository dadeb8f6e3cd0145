"""Measures of a node's surroundings in one graph, by closed forms over its links; lists are built a part at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from lattica.functions.centrality import degrees, spread
from lattica.graphs import Local

#: Rows of a list at a time, but for those of a single link, which stay together.
ROWS = 2**18
#: Orbit of the nodes v < u < w < x by edges among the four.
ROLES = {3: (8, 9, 9, 9), 4: (16, 17, 17, 16), 5: (20, 21, 21, 22), 6: (24, 24, 24, 24)}


class Lists:
    """Sorted neighbours: of node v, to[first[v]:first[v + 1]]; code holds v * n + to."""

    def __init__(self, n: int, a: np.ndarray, b: np.ndarray):
        self.n, self.code = n, np.sort(a * n + b)
        self.to, self.d = self.code % max(n, 1), np.bincount(a, minlength=n)
        self.first = np.append(0, np.cumsum(self.d))

    def at(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Where the link from a to b stands, -1 if nowhere."""
        return found(self.code, a * self.n + b)

    def after(self, v: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Where the neighbours of v beyond b begin."""
        return np.searchsorted(self.code, v * self.n + b, side="right")


def found(codes: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(codes):
        return np.full(len(x), -1)
    i = np.minimum(np.searchsorted(codes, x), len(codes) - 1)
    return np.where(codes[i] == x, i, -1)


def ranges(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, p): p runs from begin[i] to end[i] - 1, one i after another."""
    k = end - begin
    i = np.repeat(np.arange(len(k)), k)
    return i, np.arange(len(i)) - np.repeat(np.cumsum(k) - k - begin, k)


def parts(k: np.ndarray) -> Iterator[slice]:
    """Slices of k with sums of about ROWS."""
    sums, start = np.cumsum(k), 0
    while start < len(k):
        end = max(start + 1, int(np.searchsorted(sums, (sums[start - 1] if start else 0) + ROWS, side="right")))
        yield slice(start, end)
        start = end


def shared(g: Local) -> np.ndarray:
    """How many neighbours the ends of each edge share. Links go from lower to higher (degree, id), so hubs start few."""
    d = degrees(g)
    up = d[g.src] <= d[g.dst]  # src < dst decides equal degrees
    a, b = np.where(up, g.src, g.dst), np.where(up, g.dst, g.src)
    order = np.argsort(a * g.n + b)
    a, b, out, own = a[order], b[order], Lists(g.n, a, b), np.zeros(len(order), np.int64)
    for part in parts(out.d[a]):
        i, p = ranges(out.first[a[part]], out.first[a[part] + 1])
        i += part.start
        third = out.at(b[i], out.to[p])
        for e in (i, p, third):
            own += np.bincount(e[third >= 0], minlength=len(own))
    result = np.empty_like(own)
    result[order] = own
    return result


def quad_orbits(g: Local) -> dict[int, np.ndarray]:
    """Counts of the orbits in ROLES over v < u < w < x with an edge v-u, and w and x each next to v or u.

    An edge's candidates w, x are listed once with k, to how many of its ends each is next; pairs of them are
    counted as if they had no edge, and corrected by their edges.
    """
    both = Lists(g.n, np.concatenate((g.src, g.dst)), np.concatenate((g.dst, g.src)))
    out = {o: np.zeros(g.n, np.int64) for o in sorted({o for r in ROLES.values() for o in r})}

    def add(role: int, v: np.ndarray, k: np.ndarray, times: np.ndarray) -> None:
        for edges, orbits in ROLES.items():
            out[orbits[role]] += np.bincount(v[k == edges], times[k == edges], g.n).astype(np.int64)

    for part in parts(both.d[g.src] + both.d[g.dst]):
        a, b = g.src[part], g.dst[part]
        codes = np.concatenate([i * g.n + both.to[p] for i, p in (ranges(both.after(end, b), both.first[end + 1]) for end in (a, b))])
        codes, k = np.unique(codes, return_counts=True)
        e, w = codes // max(g.n, 1), codes % max(g.n, 1)
        first, last = np.searchsorted(e, e, side="left"), np.searchsorted(e, e, side="right")
        for j in (1, 2):  # pairs whose other node is next to j ends
            upto = np.append(0, np.cumsum(k == j))
            here = np.arange(len(e))
            later, earlier = upto[last] - upto[here + 1], upto[here] - upto[first]
            add(0, a[e], 1 + k + j, later)
            add(1, b[e], 1 + k + j, later)
            add(2, w, 1 + k + j, later)
            add(3, w, 1 + k + j, earlier)
        begin = both.after(w, w)
        for some in parts(both.first[w + 1] - begin):
            i, p = ranges(begin[some], both.first[w[some] + 1])
            i += some.start
            x = found(codes, e[i] * g.n + both.to[p])
            i, x = i[x >= 0], x[x >= 0]
            for edges, times in ((1, -1), (2, 1)):
                for role, v in enumerate((a[e[i]], b[e[i]], w[i], w[x])):
                    add(role, v, edges + k[i] + k[x], np.full(len(i), times))
    return out


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a / b, 0 where b is 0."""
    return np.divide(a, b, out=np.zeros(len(b)), where=b != 0)


def walk_features(g: Local, shared_by: np.ndarray, second: np.ndarray) -> dict[str, np.ndarray]:
    """The random walk features that need no long paths. shared_by: shared(g); second: how many nodes are two hops away."""
    d, n, m = degrees(g), g.n, len(g.src)
    t = (np.bincount(g.src, shared_by, n) + np.bincount(g.dst, shared_by, n)) / 2
    most, least = np.zeros(n), np.full(n, np.inf)
    for a, b in ((g.src, g.dst), (g.dst, g.src)):
        np.maximum.at(most, a, d[b])
        np.minimum.at(least, a, d[b])
    mean, back = _ratio(spread(g, d), d), _ratio(spread(g, _ratio(np.ones(n), d)), d)
    central, hit = d / max(n - 1, 1), _ratio(np.full(n, 2.0 * m), d)
    closed = np.bincount(g.src, shared_by > 0, n) + np.bincount(g.dst, shared_by > 0, n)  # neighbours that a neighbour leads to as well
    return {
        "rw_degree": d, "rw_degree_normalized": central, "rw_return_prob_t2": back, "rw_return_prob_t4": back * back, "rw_stationary_prob": d / max(2 * m, 1), "rw_local_clustering": _ratio(2 * t, d * (d - 1)),
        "rw_avg_neighbor_degree": mean, "rw_max_neighbor_degree": most, "rw_min_neighbor_degree": np.where(d > 0, least, 0), "rw_degree_centrality": central if n > 1 else np.ones(n),
        "rw_avg_dist_2hop_nbrs": _ratio(2 * second + closed, second + closed), "rw_hitting_time_proxy": hit / max(hit.max(initial=0), 1), "rw_commute_time_proxy": _ratio(np.full(n, 2.0 * m), d * mean), "rw_triangle_count": t,
    }


def orbit3(g: Local, shared_by: np.ndarray) -> dict[int, np.ndarray]:
    """Counts of 3-node orbits 0, 1 and 3; a triangle counts three times, once from each corner."""
    d = degrees(g)
    t = (np.bincount(g.src, shared_by, g.n) + np.bincount(g.dst, shared_by, g.n)) / 2
    return {0: spread(g, d - 1) - 2 * t, 1: d * (d - 1) / 2 - t, 3: 3 * t}
