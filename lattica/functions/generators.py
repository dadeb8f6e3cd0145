"""Random and structured graphs in memory, seeded with numpy; what networks libraries offer under these names."""

from __future__ import annotations

import numpy as np

Edges = set[tuple[int, int]]


def edge(a: int, b: int) -> tuple[int, int]:
    return (a, b) if a < b else (b, a)


def erdos_renyi(n: int, p: float, rng: np.random.Generator) -> Edges:
    """Every pair with probability p."""
    a, b = np.triu_indices(n, 1)
    on = rng.random(len(a)) < p
    return set(zip(a[on].tolist(), b[on].tolist(), strict=True))


def barabasi_albert(n: int, m: int, rng: np.random.Generator) -> Edges:
    """From a star of m leaves, each new node links to m others in proportion to their degrees."""
    out: Edges = {(0, i) for i in range(1, m + 1)}
    ends = [x for e in out for x in e]
    for v in range(m + 1, n):
        chosen: set[int] = set()
        while len(chosen) < m:
            chosen.add(ends[int(rng.integers(len(ends)))])
        for u in chosen:
            out.add(edge(u, v))
            ends += [u, v]
    return out


def watts_strogatz(n: int, k: int, p: float, rng: np.random.Generator) -> Edges:
    """A ring with k // 2 links to either side; each is moved with probability p to a random free end."""
    out: Edges = {edge(v, (v + j) % n) for j in range(1, k // 2 + 1) for v in range(n) if v != (v + j) % n}
    for j in range(1, k // 2 + 1):
        for v in range(n):
            old = edge(v, (v + j) % n)
            if old in out and rng.random() < p:
                free = [u for u in range(n) if u != v and edge(u, v) not in out]
                if free:
                    out.discard(old)
                    out.add(edge(v, free[int(rng.integers(len(free)))]))
    return out


def random_regular(n: int, d: int, rng: np.random.Generator, tries: int = 200) -> Edges | None:
    """Stubs are paired at random, unsuitable ones again, until all fit; None if that keeps failing or n * d is odd."""
    if n * d % 2 or d >= n:
        return None
    for _ in range(tries):
        out: Edges = set()
        stubs = np.repeat(np.arange(n), d)
        while len(stubs):
            rng.shuffle(stubs)
            left = []
            for a, b in stubs.reshape(-1, 2).tolist():
                e = edge(a, b)
                if a == b or e in out:
                    left += [a, b]
                else:
                    out.add(e)
            if len(left) == len(stubs):
                break
            stubs = np.array(left, np.int64)
        if not len(stubs):
            return out
    return None


def _power_law(rng: np.random.Generator, exponent: float, low: float, high: float, k: int) -> np.ndarray:
    """k numbers from low to high with density x ** -exponent."""
    a = 1 - exponent
    return (low**a + rng.random(k) * (high**a - low**a)) ** (1 / a)


def lfr(n: int, tau1: float, tau2: float, mu: float, average_degree: int, min_community: int, rng: np.random.Generator) -> Edges:
    """Communities and degrees with power laws; a share mu of each node's links leaves its community."""
    degree = _power_law(rng, tau1, 1, n / 2, n)
    degree = np.maximum(1, np.rint(degree * average_degree / degree.mean())).astype(int)
    sizes: list[int] = []
    while sum(sizes) < n:
        sizes.append(int(_power_law(rng, tau2, min_community, max(min_community + 1, n // 2), 1)[0]))
    sizes[-1] -= sum(sizes) - n
    if sizes[-1] < min_community and len(sizes) > 1:  # too small to stand alone
        last = sizes.pop()
        sizes[-1] += last
    home = np.repeat(np.arange(len(sizes)), sizes)
    rng.shuffle(home)
    inner = np.minimum(np.rint(degree * (1 - mu)).astype(int), np.array(sizes)[home] - 1)
    out: Edges = set()

    def pair(stubs: list[int], fits) -> None:
        for _ in range(20):
            rng.shuffle(stubs)
            left = []
            for a, b in zip(stubs[::2], stubs[1::2], strict=False):
                if a != b and edge(a, b) not in out and fits(a, b):
                    out.add(edge(a, b))
                else:
                    left += [a, b]
            stubs = left

    for c in range(len(sizes)):
        pair([v for v in np.flatnonzero(home == c).tolist() for _ in range(inner[v])], lambda a, b: True)
    pair([v for v in range(n) for _ in range(max(0, degree[v] - inner[v]))], lambda a, b: home[a] != home[b])
    return out


def random_graph(family: str, n: int, rng: np.random.Generator, density: tuple[float, float] = (0.1, 0.4)) -> Edges | None:
    """A graph of a family with parameters drawn as usual for it; None if it has no edge."""
    if family == "erdos_renyi":
        out = erdos_renyi(n, rng.uniform(*density), rng)
    elif family == "barabasi_albert":
        out = barabasi_albert(n, max(1, min(n // 4, int(rng.integers(1, 6)))), rng)
    elif family == "watts_strogatz":
        k = int(rng.integers(2, min(n - 1, 8) + 1))
        out = watts_strogatz(n, max(2, min(k + k % 2, n - 1)), rng.uniform(0.1, 0.5), rng)
    elif family == "random_regular":
        d = int(rng.integers(2, min(n - 1, 6) + 1))
        out = random_regular(n, max(2, d - 1) if n * d % 2 else d, rng)
    else:
        raise ValueError(f"unknown family {family!r}")
    return out or None


def grid(rows: int, cols: int) -> Edges:
    return {(r * cols + c, r * cols + c + 1) for r in range(rows) for c in range(cols - 1)} | {(r * cols + c, r * cols + c + cols) for r in range(rows - 1) for c in range(cols)}


def cycle(n: int) -> Edges:
    return {edge(i, (i + 1) % n) for i in range(n)}


def path(n: int) -> Edges:
    return {(i, i + 1) for i in range(n - 1)}


def star(leaves: int) -> Edges:
    return {(0, i) for i in range(1, leaves + 1)}


def complete(n: int, first: int = 0) -> Edges:
    return {(first + i, first + j) for j in range(n) for i in range(j)}


def wheel(n: int) -> Edges:
    """A hub 0 and a ring of n - 1."""
    return star(n - 1) | {edge(1 + i, 1 + (i + 1) % (n - 1)) for i in range(n - 1)}


def multipartite(sizes: list[int]) -> Edges:
    part = [i for i, k in enumerate(sizes) for _ in range(k)]
    return {(a, b) for b in range(len(part)) for a in range(b) if part[a] != part[b]}


def turan(n: int, r: int) -> Edges:
    return multipartite([n // r] * (r - n % r) + [n // r + 1] * (n % r))


def barbell(m: int, between: int) -> Edges:
    """Two complete graphs of m with a path of so many nodes between them."""
    chain = range(m - 1, m + between + 1)
    return complete(m) | complete(m, m + between) | {(i, i + 1) for i in list(chain)[:-1]}


def petersen() -> Edges:
    return cycle(5) | {(i, i + 5) for i in range(5)} | {edge(5 + i, 5 + (i + 2) % 5) for i in range(5)}


def from_jumps(jumps: list[int], repeats: int) -> Edges:
    """A ring in which node i also links to i + jump, jumps repeating (the LCF notation)."""
    n = len(jumps) * repeats
    return cycle(n) | {edge(i, (i + jumps[i % len(jumps)]) % n) for i in range(n)}


def dodecahedron() -> Edges:
    return from_jumps([10, 7, 4, -4, -7, 10, -4, 7, -7, 4], 2)


def icosahedron() -> Edges:
    """Two poles over two rings of five, the rings linked by an antiprism."""
    top, low = [1 + i for i in range(5)], [6 + i for i in range(5)]
    rings = {edge(r[i], r[(i + 1) % 5]) for r in (top, low) for i in range(5)}
    return rings | {(0, x) for x in top} | {(x, 11) for x in low} | {edge(top[i], low[j % 5]) for i in range(5) for j in (i, i + 1)}


def triangular_lattice(rows: int, cols: int) -> Edges:
    """A lattice of rows by cols triangles; every other row is half a step aside."""
    width = (cols + 1) // 2 + 1
    at = {(r, c): i for i, (r, c) in enumerate((r, c) for r in range(rows + 1) for c in range(width - (r % 2 and not cols % 2)))}
    out: Edges = set()
    for r, c in at:
        side = (r + 1, c), (r + 1, c + 1 if r % 2 else c - 1)
        out |= {edge(at[r, c], at[x]) for x in ((r, c + 1), *side) if x in at}
    return out


def hexagonal_lattice(rows: int, cols: int) -> Edges:
    """A lattice of rows by cols hexagons: columns of nodes, with a rung at every other height."""
    height = 2 * rows + 2
    keep = {(c, r) for c in range(cols + 1) for r in range(height)} - {(0, height - 1), (cols, (height - 1) * (cols % 2))}
    at = {x: i for i, x in enumerate(sorted(keep))}
    column = {edge(at[c, r], at[c, r + 1]) for c, r in keep if (c, r + 1) in keep}
    rung = {edge(at[c, r], at[c + 1, r]) for c, r in keep if (c + 1, r) in keep and r % 2 == c % 2}
    return column | rung
