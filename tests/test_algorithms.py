"""Functions of one graph against closed forms and brute force."""

import itertools
import math
import time
import tracemalloc

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lattica.functions import centrality as ct
from lattica.functions import covers
from lattica.functions import generators as gen
from lattica.functions import surroundings as sr
from lattica.graphs import Local


def local(edges, n=None) -> Local:
    e = np.array(sorted(edges), np.int64).reshape(-1, 2)
    n = (int(e.max()) + 1 if len(e) else 0) if n is None else n
    return Local(0, np.arange(n), e[:, 0], e[:, 1])


@st.composite
def graphs(draw, most=11):
    n = draw(st.integers(1, most))
    pairs = [(i, j) for j in range(n) for i in range(j)]
    return local({p for p in pairs if draw(st.booleans())}, n)


def is_cover(g, cover):
    return all(a in cover or b in cover for a, b in zip(g.src.tolist(), g.dst.tolist(), strict=True))


def brute_cover(g):
    return next(k for k in range(g.n + 1) for s in itertools.combinations(range(g.n), k) if is_cover(g, set(s)))


@settings(max_examples=150, deadline=None)
@given(graphs())
def test_covers_against_brute_force(g):
    best = brute_cover(g)
    exact, optimal = covers.exact_cover(g)
    assert optimal and len(exact) == best and is_cover(g, exact)
    assert covers.lp_bound(g) <= best <= 2 * covers.lp_bound(g)
    matching = covers.matching_cover(g)
    assert is_cover(g, matching) and len(matching) <= 2 * best
    greedy = {v for v, s in enumerate(covers.greedy_scores(g)) if s > 0}
    assert is_cover(g, greedy)
    konig = covers.konig_cover(g)
    if konig is not None:
        assert len(konig) == best and is_cover(g, konig)
    else:
        assert covers.two_colours(g) is None


@settings(max_examples=60, deadline=None)
@given(graphs())
def test_capped_solver_still_covers(g):
    cover, _ = covers.exact_cover(g, max_branches=0)
    assert is_cover(g, cover)


@settings(max_examples=60, deadline=None)
@given(graphs(8))
def test_cores_paths_and_betweenness(g):
    near, core = g.neighbours(), ct.core_numbers(g)
    for k in range(int(core.max()) + 1):  # the k-core by removing nodes until none has fewer than k
        alive = set(range(g.n))
        while gone := {v for v in alive if sum(u in alive for u in near[v]) < k}:
            alive -= gone
        assert alive == {v for v in range(g.n) if core[v] >= k}
    d = [ct.distances(near, s) for s in range(g.n)]
    want = np.zeros(g.n)
    for s, t in itertools.combinations(range(g.n), 2):
        if d[s][t] > 0:
            paths = [p for p in itertools.permutations(range(g.n), d[s][t] - 1) if all(b in near[a] for a, b in zip((s, *p), (*p, t), strict=True))]
            for p in paths:
                want[list(p)] += 1 / len(paths)
    scale = (g.n - 1) * (g.n - 2) / 2
    assert ct.betweenness(g) == pytest.approx(want / scale if scale else want)
    got = ct.closeness_and_eccentricity(g)
    connected = all(x >= 0 for row in d for x in row)
    assert got["eccentricity"].tolist() == ([max(r) for r in d] if connected else [-1.0] * g.n)


def test_goldens():
    k5, p4, star = local(gen.complete(5)), local(gen.path(4)), local(gen.star(5))
    assert [len(covers.exact_cover(x)[0]) for x in (k5, p4, star, local(gen.cycle(20)), local(gen.complete(3)))] == [4, 2, 1, 10, 2]
    assert covers.lp_bound(k5) == 3
    assert covers.greedy_scores(p4).tolist() == [0, 1, 0.5, 0] and covers.greedy_scores(star).tolist() == [1, 0, 0, 0, 0, 0]
    assert covers.greedy_scores(local([], 5)).tolist() == [0] * 5
    empty = local([], 5)
    assert ct.mis_frequency(empty).tolist() == [1] * 5
    assert [x.tolist() for x in ct.mwua(empty).values()] == [[1] * 5, [0] * 5, [0] * 5, [0] * 5]
    assert abs(ct.mis_frequency(k5).sum() - 1) < 1e-9
    w = ct.mwua(local(gen.petersen()))
    assert (w["mwua_min_w"] <= w["mwua_avg_w"] + 1e-12).all() and (w["mwua_avg_w"] <= w["mwua_max_w"] + 1e-12).all()


@settings(max_examples=60, deadline=None)
@given(graphs())
def test_pagerank_eigenvector_and_independent_sets(g):
    x = ct.pagerank(g)
    assert x.sum() == pytest.approx(1)
    y = ct.eigenvector(g, 1e-10, 5000)
    if y is not None and len(g.src):
        lam = (y @ ct.spread(g, y)) / (y @ y)
        assert ct.spread(g, y) == pytest.approx(lam * y, abs=1e-3)
    f = ct.mis_frequency(g, 20, 1)
    assert (f >= 0).all() and (f <= 1).all() and f.sum() >= 1 - 1e-9


def test_generators():
    rng = np.random.default_rng(3)
    deg = lambda e: np.bincount(np.array(sorted(e)).ravel())
    assert set(deg(gen.random_regular(30, 4, rng))) == {4} and gen.random_regular(5, 3, rng) is None
    assert len(gen.barabasi_albert(60, 4, rng)) == 4 + 55 * 4
    assert len(gen.watts_strogatz(50, 6, 0.3, rng)) == 150
    assert abs(len(gen.erdos_renyi(200, 0.2, rng)) / (200 * 199 / 2) - 0.2) < 0.02
    e = gen.lfr(200, 3.0, 1.5, 0.1, 6, 25, rng)
    assert 350 < len(e) < 800 and all(0 <= a < b < 200 for a, b in e)
    for f, n, k in ((gen.petersen(), 10, 3), (gen.dodecahedron(), 20, 3), (gen.icosahedron(), 12, 5), (gen.turan(50, 5), 50, 40), (gen.cycle(20), 20, 2)):
        assert deg(f).tolist() == [k] * n
    assert len(gen.barbell(15, 5)) == 216 and len(gen.wheel(30)) == 58 and len(gen.grid(5, 7)) == 5 * 6 + 7 * 4
    girth6 = gen.hexagonal_lattice(2, 2)
    assert covers.two_colours(local(girth6)) is not None and max(deg(girth6)) == 3
    for family in ("erdos_renyi", "barabasi_albert", "watts_strogatz", "random_regular"):
        assert gen.random_graph(family, 20, np.random.default_rng(0))
    with pytest.raises(ValueError, match="unknown family"):
        gen.random_graph("other", 5, rng)


def test_exact_solver_is_fast_on_the_hard_regime():
    for seed in range(3):
        g = local(gen.erdos_renyi(70, 0.35, np.random.default_rng(seed)), 70)
        cover, optimal = covers.exact_cover(g)
        assert optimal and is_cover(g, cover) and len(cover) >= math.ceil(len(g.src) / max(ct.degrees(g)))


def test_classical_networks():
    from lattica.sources.catalogue import catalogue

    makers = catalogue()
    karate, florentine = makers["karate"](), makers["florentine"]()
    deg = np.bincount(np.array(sorted(karate)).ravel())
    assert (len(karate), deg[0], deg[33], len(covers.exact_cover(local(karate))[0])) == (78, 16, 17, 14)
    assert len(florentine) == 20 and len({x for e in florentine for x in e}) == 15
    davis = makers["davis"]()
    assert len(davis) == 89 and len({x for e in davis for x in e}) == 32 and all(a < 18 <= b for a, b in davis)
    assert len(makers) == 55


def linked(n, m, seed=0):
    return local({(min(a, b), max(a, b)) for a, b in np.random.default_rng(seed).integers(0, n, (m, 2)).tolist() if a != b}, n)


def seconds(f, *given):
    began = time.perf_counter()
    f(*given)
    return time.perf_counter() - began


@pytest.mark.parametrize("key", ["closeness", "eccentricity"])
def test_paths_of_a_large_graph_cost_less_than_a_search_from_each_node(key):
    g = linked(4000, 12000)
    near = g.neighbours()
    some = range(0, 4000, 20)
    one = seconds(lambda: [ct.distances(near, v) for v in some])  # a twentieth of all
    got = ct.closeness_and_eccentricity(g)[key]
    assert min(seconds(ct.closeness_and_eccentricity, g) for _ in range(3)) < 5 * one
    d = [[x for x in ct.distances(near, v) if x >= 0] for v in some]
    whole = all(len(x) == g.n for x in d)
    want = {"closeness": [(len(x) - 1) ** 2 / max(sum(x), 1) / (g.n - 1) for x in d], "eccentricity": [max(x) if whole else -1 for x in d]}[key]
    assert got[list(some)] == pytest.approx(want)


def test_searches_work_only_on_rows_where_something_can_be_new(monkeypatch):
    g, rows, over = linked(4000, 9000), [], ct.Near.over
    monkeypatch.setattr(ct.Near, "over", lambda *given: rows.append(len(out := over(*given))) or out)
    got = ct.closeness_and_eccentricity(g)["closeness"]
    some = {v: [x for x in ct.distances(g.neighbours(), v) if x >= 0] for v in range(0, 4000, 40)}
    assert got[list(some)] == pytest.approx([(len(d) - 1) ** 2 / max(sum(d), 1) / (g.n - 1) for d in some.values()])
    assert sum(rows) < 0.7 * 4 * g.n * max(map(max, some.values()))  # four times 1,024 searches, of so many levels or more


@settings(max_examples=60, deadline=None)
@given(graphs(), st.integers(1, 3))
def test_searches_side_by_side_are_those_of_single_sources(g, columns):
    near, was = g.neighbours(), (ct.LOT, ct.COLUMNS, ct.DEEP)
    found = []
    try:
        for ct.LOT, ct.COLUMNS, ct.DEEP in ((1, columns, 64), (1024, 32, 64), (2, 32, 0)):  # small lots and hubs; as ever; node by node
            found.append((ct.hop_counts(g).tolist(), ct.closeness_and_eccentricity(g), ct.betweenness(g), ct.betweenness(g, 3)))
    finally:
        ct.LOT, ct.COLUMNS, ct.DEEP = was
    d = [[x for x in ct.distances(near, v) if x >= 0] for v in range(g.n)]
    assert found[0][0] == np.bincount(sum(d, [])).tolist()
    assert found[0][1]["closeness"] == pytest.approx([(len(x) - 1) ** 2 / max(sum(x), 1) / max(g.n - 1, 1) for x in d])
    assert found[0][1]["eccentricity"].tolist() == [max(x) if min(map(len, d)) == g.n else -1 for x in d]
    for counts, paths, *shares in found[1:]:
        assert counts == found[0][0] and all((paths[k] == found[0][1][k]).all() for k in paths)
        assert all(a == pytest.approx(b) for a, b in zip(shares, found[0][2:], strict=True))


def test_a_capped_search_ends_without_covering_its_way_back_anew(monkeypatch):
    g, runs, greedy = linked(1500, 4000), [], covers.Exact.greedy
    monkeypatch.setattr(covers.Exact, "greedy", lambda *given: runs.append(1) or greedy(*given))
    cover, optimal = covers.exact_cover(g, max_branches=60)
    assert not optimal and len(runs) < 10 and all(a in cover or b in cover for a, b in zip(g.src.tolist(), g.dst.tolist(), strict=True))
    assert covers.exact_cover(g, max_branches=60)[0] == cover


@settings(max_examples=60, deadline=None)
@given(graphs())
def test_improved_covers_cover_and_are_no_larger(g):
    links, first = list(zip(g.src.tolist(), g.dst.tolist(), strict=True)), covers.matching_cover(g)
    cover = covers.improved(g.neighbours(), first, 200)
    assert len(cover) <= len(first) and all(a in cover or b in cover for a, b in links)


def test_betweenness_works_on_a_link_once_a_search_and_its_parts_add_up(monkeypatch):
    g, worked, over = linked(3000, 7000), [], ct.Near.over
    monkeypatch.setattr(ct.Near, "over", lambda *given: worked.append((out := over(*given)).size) or out)
    whole = ct.betweenness(g)
    assert sum(worked) < g.n * g.n  # levels took each row for each search
    want, near = np.zeros(g.n), g.neighbours()
    for v in range(g.n):
        ct._through_from(near, v, want)
    assert whole == pytest.approx(want / ((g.n - 1) * (g.n - 2)))
    assert sum(ct.betweenness(g, part=i, parts=3) for i in range(3)) == pytest.approx(whole)


def test_betweenness_of_all_costs_less_than_a_search_from_each_node():
    g = linked(2500, 7500)
    near = g.neighbours()
    one = seconds(lambda: [ct.distances(near, v) for v in range(0, 2500, 10)])  # a tenth of all
    assert min(seconds(ct.betweenness, g) for _ in range(2)) < 10 * one


def test_exact_solver_takes_little_memory_however_deep_it_goes():
    g = linked(300, 4000)
    tracemalloc.start()
    cover, optimal = covers.exact_cover(g, max_branches=200)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert is_cover(g, cover) and not optimal and most < 20e6


@settings(max_examples=60, deadline=None)
@given(graphs(9), st.sampled_from([1, 3, sr.ROWS]))
def test_surroundings_are_those_of_lists(g, rows):
    near, was = [set(x) for x in g.neighbours()], sr.ROWS
    try:
        sr.ROWS = rows
        by, quads = sr.shared(g), sr.quad_orbits(g)
    finally:
        sr.ROWS = was
    assert by.tolist() == [len(near[a] & near[b]) for a, b in zip(g.src.tolist(), g.dst.tolist(), strict=True)]
    want = {o: [0] * g.n for o in quads}
    for four in itertools.combinations(range(g.n), 4):
        v, u, w, x = four
        if u in near[v] and {v, u} & near[w] and {v, u} & near[x]:
            for a, o in zip(four, sr.ROLES[sum(b in near[a] for a, b in itertools.combinations(four, 2))], strict=True):
                want[o][a] += 1
    assert {o: x.tolist() for o, x in quads.items()} == want
    walk = sr.walk_features(g, by, ct.closeness_and_eccentricity(g)["second"])
    reach = [{x for u in near[v] for x in near[u]} - {v} for v in range(g.n)]
    assert walk["rw_avg_dist_2hop_nbrs"] == pytest.approx([sum(2 - (x in near[v]) for x in r) / max(len(r), 1) for v, r in enumerate(reach)])
    assert walk["rw_triangle_count"].tolist() == [sum(b in near[a] for a, b in itertools.combinations(near[v], 2)) for v in range(g.n)]


def test_four_node_orbits_of_a_star_are_counted_not_listed():
    n = 4001
    got = sr.quad_orbits(local(gen.star(n - 1), n))  # a hub with 4,000 leaves: 1e10 threes of them, each with it a four
    assert got[8].tolist() == [math.comb(n - 1, 3)] + [0] * (n - 1) and set(got[9][1:].tolist()) == {math.comb(n - 2, 2)}
