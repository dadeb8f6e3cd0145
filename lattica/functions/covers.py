"""Vertex covers of one graph: exact, bounds, and approximations."""

from __future__ import annotations

import heapq
import math
import random
import sys
from collections import deque

import numpy as np

from lattica.functions.centrality import distances
from lattica.graphs import Local


def greedy_scores(g: Local) -> np.ndarray:
    """Repeatedly the node with most uncovered edges (the smallest at ties); the r-th of R scores (R - r + 1) / R, others 0."""
    near = [set(x) for x in g.neighbours()]
    heap = [(-len(x), v) for v, x in enumerate(near) if x]
    heapq.heapify(heap)
    picked = []
    while heap:
        d, v = heapq.heappop(heap)
        if len(near[v]) != -d:
            if near[v]:
                heapq.heappush(heap, (-len(near[v]), v))
            continue
        picked.append(v)
        for u in near[v]:
            near[u].discard(v)
        near[v] = set()
    out = np.zeros(g.n)
    out[picked] = (len(picked) - np.arange(len(picked))) / max(len(picked), 1)
    return out


def matching_cover(g: Local) -> set[int]:
    """Both ends of the edges of a maximal matching, edges in order."""
    used: set[int] = set()
    for a, b in sorted(zip(g.src.tolist(), g.dst.tolist(), strict=True)):
        if a not in used and b not in used:
            used |= {a, b}
    return used


def two_colours(g: Local) -> list[int] | None:
    """A colour 0 or 1 for each node, the smallest of a component 0; None if there is none."""
    near, out = g.neighbours(), [-1] * g.n
    for s in range(g.n):
        if out[s] < 0:
            for v, d in enumerate(distances(near, s)):
                if d >= 0:
                    out[v] = d % 2
    return None if any(out[a] == out[b] for a, b in zip(g.src.tolist(), g.dst.tolist(), strict=True)) else out


def hopcroft_karp(near: list[list[int]], n_right: int) -> tuple[list[int], list[int]]:
    """A maximum matching of a bipartite graph: partners of left and of right nodes, -1 if none."""
    left, right = [-1] * len(near), [-1] * n_right
    while True:
        layer = [0 if m < 0 else -1 for m in left]
        queue, found = deque(v for v, m in enumerate(left) if m < 0), False
        while queue:
            v = queue.popleft()
            for u in near[v]:
                w = right[u]
                if w < 0:
                    found = True
                elif layer[w] < 0:
                    layer[w] = layer[v] + 1
                    queue.append(w)
        if not found:
            return left, right
        at = [0] * len(near)
        for s in [v for v, m in enumerate(left) if m < 0]:
            path = [s]
            while path:
                v = path[-1]
                if at[v] == len(near[v]):
                    layer[v] = -1
                    path.pop()
                    continue
                u = near[v][at[v]]
                at[v] += 1
                w = right[u]
                if w < 0:
                    for x in reversed(path):  # shift the path's matches by one
                        u, left[x] = left[x], u
                        right[left[x]] = x
                    break
                if layer[w] == layer[v] + 1:
                    path.append(w)


def konig_cover(g: Local) -> set[int] | None:
    """A minimum cover of a bipartite graph by Konig's theorem; None if the graph is not bipartite."""
    colour = two_colours(g)
    if colour is None:
        return None
    near = [x if colour[v] == 0 else [] for v, x in enumerate(g.neighbours())]
    left, right = hopcroft_karp(near, g.n)
    seen = {v for v in range(g.n) if colour[v] == 0 and near[v] and left[v] < 0}
    queue, reached = deque(seen), set()
    while queue:
        for u in near[queue.popleft()]:
            if u not in reached:
                reached.add(u)
                if right[u] >= 0 and right[u] not in seen:
                    seen.add(right[u])
                    queue.append(right[u])
    return {v for v in range(g.n) if colour[v] == 0 and near[v] and v not in seen} | reached


def approximate_cover(g: Local) -> tuple[set[int], str]:
    cover = konig_cover(g)
    return (matching_cover(g), "approx_matching") if cover is None else (cover, "approx_konig")


def lp_bound(g: Local) -> int:
    """The relaxation's optimum, rounded up: half a maximum matching of the bipartite double cover."""
    left, _ = hopcroft_karp(g.neighbours(), g.n)
    return math.ceil(sum(m >= 0 for m in left) / 2 - 1e-6)


#: Graphs of more nodes look for parts and a new bound only once a tenth of their nodes is gone.
SMALL = 100
#: Tries a node to improve a cover that is not proven.
TRIES = 8


class Exact:
    """Branch and bound for a minimum cover; after max_branches it covers greedily what is open on its way, once, and ends.

    One graph is changed and changed back, so memory does not grow with the depth of the search. The bound is nodes
    less the cliques of a greedy clique cover; what is left of a clique is one, so it follows the nodes that go.
    """

    def __init__(self, near: list[list[int]], max_branches: int = 20_000):
        self.left, self.optimal = max_branches, True
        self.near, self.sets, self.deg = near, [set(x) for x in near], [len(x) for x in near]  # deg -1: gone
        self.trail: list[tuple[int, int]] = []
        self.of, self.size, self.low, self.count = list(range(len(near))), [1] * len(near), 0, 0

    def drop(self, v: int) -> None:
        deg, c = self.deg, self.of[v]
        self.trail.append((v, deg[v]))
        deg[v] = -1
        for u in self.near[v]:
            if deg[u] > 0:
                deg[u] -= 1
        self.size[c] -= 1
        self.low -= self.size[c] > 0
        self.count -= 1

    def undo(self, mark: int) -> None:
        deg = self.deg
        while len(self.trail) > mark:
            v, d = self.trail.pop()
            for u in self.near[v]:
                if deg[u] >= 0:
                    deg[u] += 1
            deg[v], c = d, self.of[v]
            self.count += 1
            self.low += self.size[c] > 0
            self.size[c] += 1

    def beside(self, v: int) -> list[int]:
        deg = self.deg
        return [u for u in self.near[v] if deg[u] >= 0]

    def reduce(self, queue: set[int]) -> list[int]:
        """Take what some minimum cover surely holds: neighbours of leaves, ends of degree-2 triangles, dominating nodes."""
        cover, deg, sets = [], self.deg, self.sets
        while queue:
            v = queue.pop()
            d = deg[v]
            if d == 0:
                self.drop(v)
            elif 0 < d <= 5:
                live = self.beside(v)
                for u in live:
                    if d == 1 or deg[u] >= d and all(w == u or w in sets[u] for w in live):  # N[v] within N[u]: u is in some minimum cover
                        queue.update(self.beside(u))
                        self.drop(u)
                        cover.append(u)
                        break
        return cover

    def parts(self, nodes: list[int]) -> list[list[int]]:
        left, out = set(nodes), []
        for s in nodes:
            if s in left:
                left.discard(s)
                part = [s]
                for v in part:
                    new = self.sets[v] & left
                    left -= new
                    part.extend(new)
                out.append(sorted(part))
        return out

    def bound(self, nodes: list[int]) -> None:
        """New cliques for nodes."""
        deg, of, size, found = self.deg, self.of, self.size, len(self.size)
        for v in nodes:
            of[v] = -1
        for v in sorted(nodes, key=deg.__getitem__):
            counts: dict[int, int] = {}
            for u in self.near[v]:
                if deg[u] >= 0 and of[u] >= 0:
                    counts[of[u]] = counts.get(of[u], 0) + 1
            best = max((c for c, k in counts.items() if k == size[c]), key=size.__getitem__, default=-1)
            if best < 0:
                best = len(size)
                size.append(0)
            of[v] = best
            size[best] += 1
        self.low = len(nodes) - (len(size) - found)

    def solve(self, nodes: list[int], limit: int, queue: set[int], base: float = math.inf) -> list[int] | None:
        """A smallest cover of what is left of nodes with fewer than limit nodes, or None; base: how many nodes the last new bound was for."""
        mark = len(self.trail)
        cover = self.reduce(queue)
        if len(cover) >= limit or not self.count or self.count > max(SMALL, 0.9 * base):
            out = None if len(cover) >= limit else self.branch(nodes, cover, limit, base) if self.count else cover
            self.undo(mark)
            return out
        live = [v for v in nodes if self.deg[v] >= 0]
        was, at, sizes = [self.of[v] for v in live], (self.low, self.count), len(self.size)
        split = self.parts(live)
        if len(split) == 1:
            self.bound(live)
            out = self.branch(live, cover, limit, len(live))
        else:
            lows = []
            for p in split:
                self.bound(p)
                lows.append(self.low)
            rest, out = sum(lows), cover
            for p, k in sorted(zip(split, lows, strict=True), key=lambda x: len(x[0])):
                rest -= k
                self.low, self.count = k, len(p)
                got = self.solve(p, limit - len(out) - rest, set())
                if got is None:
                    out = None
                    break
                out = out + got
            out = out if out is not None and len(out) < limit else None
        for v, c in zip(live, was, strict=True):
            self.of[v] = c
        del self.size[sizes:]
        self.low, self.count = at
        self.undo(mark)
        return out

    def branch(self, nodes: list[int], cover: list[int], limit: int, base: float) -> list[int] | None:
        if len(cover) + self.low >= limit:
            return None
        if self.left <= 0:
            self.optimal = False
            own = self.greedy(nodes, limit - len(cover))
            return None if own is None else cover + own
        self.left -= 1
        deg = self.deg
        most = max([deg[v] for v in nodes])
        v = next(v for v in nodes if deg[v] == most)
        best, near, mark = None, self.beside(v), len(self.trail)
        for i, taken in enumerate(([v], near) if len(near) > 2 else (near, [v])):
            if i and self.left <= 0:  # what is on the way back is not covered anew; improved() looks for less
                self.optimal = False
                break
            queue: set[int] = set()
            for x in taken:
                queue.update(self.beside(x))
                self.drop(x)
            got = self.solve(nodes, limit - len(cover) - len(taken), queue, base)
            self.undo(mark)
            if got is not None:
                best = [*cover, *taken, *got]
                limit = len(best)
        return best

    def greedy(self, nodes: list[int], limit: float = math.inf) -> list[int] | None:
        """The node with most neighbours left (the smallest at ties) and what reductions give, again and again; None once it can't be fewer than limit."""
        mark, deg = len(self.trail), self.deg
        out = self.reduce({v for v in nodes if deg[v] >= 0})
        heap = [(-deg[v], v) for v in nodes if deg[v] >= 0]
        heapq.heapify(heap)
        while heap:
            d, v = heapq.heappop(heap)
            if deg[v] != -d:
                if deg[v] >= 0:
                    heapq.heappush(heap, (-deg[v], v))
                continue
            queue = set(self.beside(v))
            self.drop(v)
            out += [v, *self.reduce(queue)]
            if len(out) + self.low >= limit:
                break
        self.undo(mark)
        return out if len(out) < limit and not heap else None


def improved(near: list[list[int]], cover: set[int], tries: int) -> set[int]:
    """A cover with no more nodes: as long as one outside can give way to two or more in it, those swap.

    Each try moves a node out that forces one or two in, swaps, and takes all back if the cover has grown. Nodes are drawn
    by a seed, so results repeat.
    """
    out, draw = [v not in cover for v in range(len(near))], random.Random(0)
    beside = [sum(out[u] for u in x) for x in near]  # neighbours outside
    sets, log = [set(x) for x in near], []

    def move(v: int) -> None:
        out[v] = not out[v]
        step = 1 if out[v] else -1
        for u in near[v]:
            beside[u] += step
        log.append(v)

    def free(v: int) -> list[int]:
        """Nodes next to v that need not be in the cover, moved out."""
        found = []
        for u in near[v]:
            if not out[u] and not beside[u]:
                move(u)
                found.append(u)
        return found

    def swap(queue: list[int]) -> int:
        """How many fewer there are after swaps that begin with the queue."""
        won = 0
        while queue:
            x = queue.pop()
            if not out[x]:
                continue
            ones = [u for u in near[x] if beside[u] == 1]
            pair = next(((u, w) for i, u in enumerate(ones) for w in ones[i + 1 :] if w not in sets[u]), None)
            if pair:
                move(x)
                for u in pair:
                    move(u)
                more = free(x)
                won += 1 + len(more)
                queue.extend((*pair, *more))
                queue.extend(w for u in near[x] if not out[u] and beside[u] == 1 for w in near[u] if out[w])
        return won

    for v in range(len(near)):
        if not out[v] and not beside[v]:
            move(v)
    swap([v for v, x in enumerate(out) if x])
    some = [v for v, x in enumerate(near) if x]
    for _ in range(tries if some else 0):
        v = some[int(draw.random() * len(some))]
        if out[v] or beside[v] > 2:
            continue
        log.clear()
        forced = [u for u in near[v] if out[u]]
        for u in forced:
            move(u)
        move(v)
        more = [w for u in forced for w in free(u)]
        lost = len(forced) - 1 - len(more)
        lost -= swap([v, *more, *(w for x in forced for u in near[x] if not out[u] and beside[u] == 1 for w in near[u] if out[w])])
        if lost > 0:
            for u in reversed(log[:]):
                move(u)
    return {v for v, x in enumerate(out) if not x}


def exact_cover(g: Local, max_branches: int = 20_000) -> tuple[set[int], bool]:
    """A cover, and whether it is proven to be minimum. One that is not is improved by as many tries as there were branches, and TRIES a node."""
    near = g.neighbours()
    nodes, solver, deepest = [v for v, x in enumerate(near) if x], Exact(near, max_branches), sys.getrecursionlimit()
    solver.count = len(nodes)
    first = solver.greedy(nodes) or []
    sys.setrecursionlimit(max(deepest, 4 * g.n + 1000))  # a branch, two calls; they take no room on the C stack
    try:
        better = solver.solve(nodes, len(first), set(nodes))
    finally:
        sys.setrecursionlimit(deepest)
    cover = set(first if better is None else better)
    if solver.optimal:
        return cover, True
    cover = improved(near, cover, max_branches + TRIES * len(nodes))
    return cover, len(cover) == lp_bound(g)
