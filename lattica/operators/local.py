"""Node features from a node's surroundings: joins and aggregates only.

The one expensive join is the triangle's: edges are pointed from lower to higher (degree, id), so a hub
starts few wedges, whatever its degree.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lattica.functions.surroundings import ROLES
from lattica.graphs import KEY, GraphSet


def zero() -> Column:
    """0.0; made when used, since literals need a session and workers import this module without one."""
    return F.lit(0.0)


def ratio(a, b) -> Column:
    """a / b as a double, 0 where b is 0."""
    return F.when(b == 0, zero()).otherwise(a.cast("double") / F.when(b == 0, 1).otherwise(b))


def degree(g: GraphSet) -> DataFrame:
    """(graph_id, node_id, d, n, m): a node's degree and its graph's size."""
    d = g.adj.groupBy("graph_id", F.col("v").alias("node_id")).agg(F.count("*").alias("d"))
    own = W.partitionBy("graph_id")
    full = g.nodes.select(*KEY).join(d, KEY, "left").select(*KEY, F.coalesce("d", F.lit(0)).cast("long").alias("d"))
    return full.select(*KEY, "d", F.count("*").over(own).alias("n"), (F.sum("d").over(own) / 2).cast("long").alias("m"))


def neighbour(g: GraphSet, attrs: DataFrame, aggs: list[Column]) -> DataFrame:
    """Aggregates over the attributes of each node's neighbours: (graph_id, node_id, ...); isolated nodes are left out."""
    return g.adj.join(attrs.withColumnRenamed("node_id", "u"), ["graph_id", "u"]).groupBy("graph_id", F.col("v").alias("node_id")).agg(*aggs)


def degree_features(g: GraphSet) -> DataFrame:
    d = degree(g)
    return d.select(
        *KEY,
        F.col("d").cast("double").alias("rw_degree"),
        (F.col("d") / F.greatest(F.col("n") - 1, F.lit(1))).alias("rw_degree_normalized"),
        (F.col("d") / F.greatest(2 * F.col("m"), F.lit(1))).alias("rw_stationary_prob"),
        F.when(F.col("n") <= 1, F.lit(1.0)).otherwise(F.col("d") / F.greatest(F.col("n") - 1, F.lit(1))).alias("rw_degree_centrality"),
    )


def neighbour_degree_stats(g: GraphSet, d: DataFrame | None = None) -> DataFrame:
    d = degree(g) if d is None else d
    s = neighbour(g, d.select(*KEY, "d"), [F.avg("d").alias("a"), F.max("d").alias("x"), F.min("d").alias("i")])
    return d.select(*KEY).join(s, KEY, "left").select(*KEY, *(F.coalesce(F.col(c).cast("double"), zero()).alias(f"rw_{k}_neighbor_degree") for c, k in (("a", "avg"), ("x", "max"), ("i", "min"))))


def return_probability(g: GraphSet, d: DataFrame | None = None, exact: bool = False) -> DataFrame:
    """Chance to be back after 2 and 4 steps; the latter is the square of the former, or with exact the true one."""
    d = degree(g) if d is None else d
    s = neighbour(g, d.select(*KEY, "d"), [F.sum(1 / F.col("d")).alias("inv")])
    t2 = d.join(s, KEY, "left").select(*KEY, F.when(F.col("d") > 0, F.coalesce("inv", zero()) / F.greatest("d", F.lit(1))).otherwise(zero()).alias("rw_return_prob_t2"))
    if not exact:
        return t2.withColumn("rw_return_prob_t4", F.col("rw_return_prob_t2") * F.col("rw_return_prob_t2"))
    # P^4(v, v) = sum over w of P^2(v, w) P^2(w, v); P^2(v, w) = (1 / d(v)) * sum over common neighbours of 1 / d(u)
    inv = d.filter("d > 0").select("graph_id", F.col("node_id").alias("u"), (1 / F.col("d")).alias("x"))
    a = g.adj.select("graph_id", "u", "v").join(inv, ["graph_id", "u"])
    two = a.join(g.adj.select("graph_id", "u", F.col("v").alias("w")), ["graph_id", "u"]).groupBy("graph_id", "v", "w").agg(F.sum("x").alias("c"))
    dw = d.filter("d > 0").select("graph_id", F.col("node_id").alias("w"), F.col("d").alias("dw"))
    back = two.join(dw, ["graph_id", "w"]).groupBy("graph_id", F.col("v").alias("node_id")).agg(F.sum(F.col("c") * F.col("c") / F.col("dw")).alias("s"))
    return t2.join(d.select(*KEY, "d"), KEY).join(back, KEY, "left").select(*KEY, "rw_return_prob_t2", F.coalesce(F.col("s") / F.greatest("d", F.lit(1)), zero()).alias("rw_return_prob_t4"))


def triangles(g: GraphSet, d: DataFrame | None = None) -> DataFrame:
    """(graph_id, node_id, triangles) of nodes that have any."""
    d = degree(g) if d is None else d
    rank = d.select("graph_id", "node_id", "d")
    e = g.edges.join(rank.toDF("graph_id", "src", "ds"), ["graph_id", "src"]).join(rank.toDF("graph_id", "dst", "dd"), ["graph_id", "dst"])
    up = F.col("ds") <= F.col("dd")  # src < dst decides equal degrees
    e = e.select("graph_id", F.when(up, F.col("src")).otherwise(F.col("dst")).alias("a"), F.when(up, F.col("dst")).otherwise(F.col("src")).alias("b"))
    wedge = e.join(e.withColumnRenamed("b", "c"), ["graph_id", "a"]).filter("b < c")
    closed = wedge.join(g.edges.select("graph_id", F.col("src").alias("b"), F.col("dst").alias("c")), ["graph_id", "b", "c"], "left_semi")
    return closed.select("graph_id", F.explode(F.array("a", "b", "c")).alias("node_id")).groupBy(*KEY).agg(F.count("*").alias("triangles"))


def with_triangles(g: GraphSet, d: DataFrame | None = None) -> DataFrame:
    """degree() with t, the triangles of each node, and lcc, its local clustering."""
    d = degree(g) if d is None else d
    t = d.join(triangles(g, d), KEY, "left").withColumn("t", F.coalesce("triangles", F.lit(0))).drop("triangles")
    return t.withColumn("lcc", F.when(F.col("d") < 2, zero()).otherwise(2.0 * F.col("t") / F.greatest(F.col("d") * (F.col("d") - 1), F.lit(1))))


def clustering(g: GraphSet) -> DataFrame:
    return with_triangles(g).select(*KEY, F.col("lcc").alias("rw_local_clustering"), F.col("t").cast("double").alias("rw_triangle_count"))


def two_hop(g: GraphSet, d: DataFrame | None = None) -> DataFrame:
    """Mean distance to the neighbours of one's neighbours (oneself left out): 1 for direct ones, else 2."""
    a, b = g.adj, g.adj.select("graph_id", F.col("v").alias("u"), F.col("u").alias("w"))
    reach = a.join(b, ["graph_id", "u"]).filter("w <> v").select("graph_id", "v", "w").distinct()
    near = reach.join(a.select("graph_id", "v", F.col("u").alias("w"), F.lit(1).alias("direct")), ["graph_id", "v", "w"], "left")
    s = near.groupBy("graph_id", F.col("v").alias("node_id")).agg(F.count("*").alias("k"), F.count("direct").alias("j"))
    d = degree(g) if d is None else d
    return d.select(*KEY).join(s, KEY, "left").select(*KEY, F.coalesce((2 * F.col("k") - F.col("j")) / F.col("k"), zero()).alias("rw_avg_dist_2hop_nbrs"))


def hitting_commute(g: GraphSet, d: DataFrame | None = None) -> DataFrame:
    d = degree(g) if d is None else d
    inv = F.when(F.col("d") > 0, 2.0 * F.col("m") / F.greatest("d", F.lit(1))).otherwise(zero())
    most = F.greatest(F.max(inv).over(W.partitionBy("graph_id")), F.lit(1.0))
    near = neighbour_degree_stats(g, d).select(*KEY, F.col("rw_avg_neighbor_degree").alias("a"))
    both = d.withColumn("hit", inv / most).join(near, KEY)
    return both.select(*KEY, F.col("hit").alias("rw_hitting_time_proxy"), ratio(2.0 * F.col("m"), F.col("d") * F.col("a")).alias("rw_commute_time_proxy"))


def orbit3(g: GraphSet, d: DataFrame | None = None) -> DataFrame:
    """Counts of 3-node orbits 0, 1 and 3 in closed form; a triangle counts three times, once from each corner."""
    t = with_triangles(g, d)
    s = neighbour(g, t.select(*KEY, "d"), [F.sum(F.col("d") - 1).alias("s")])
    return t.join(s, KEY, "left").select(*KEY, (F.coalesce("s", F.lit(0)) - 2 * F.col("t")).cast("double").alias("orbit_0"), (F.col("d") * (F.col("d") - 1) / 2 - F.col("t")).cast("double").alias("orbit_1"), (3.0 * F.col("t")).alias("orbit_3"))


#: The symmetry types; and how often each occurs in graphlets 0 to 28.
SYMMETRY_TYPES = ("2_1", "3", "2_1_1", "2_2", "3_1", "4", "2_1_1_1", "2_2_1", "2_3", "3_1_1", "3_2", "4_1", "5")
SYMMETRIES = (
    {"2_1": 1},  # 0
    {"3": 1, "2_1": 3},  # 1
    {"2_1_1": 1},  # 2
    {"2_1_1": 3, "3_1": 1},  # 3
    {"2_1_1": 1, "2_2": 1},  # 4
    {"2_1_1": 2, "2_2": 2},  # 5
    {"2_1_1": 1, "2_2": 1, "3_1": 1},  # 6
    {"2_2": 3, "3_1": 4, "4": 3},  # 7
    {"2_1_1_1": 1},  # 8
    {"2_1_1_1": 1, "2_2_1": 1},  # 9
    {"2_1_1_1": 1, "2_2_1": 1},  # 10
    {"2_1_1_1": 2, "2_2_1": 2},  # 11
    {"2_1_1_1": 1, "3_1_1": 1},  # 12
    {"2_3": 5},  # 13
    {"2_1_1_1": 2, "2_2_1": 2},  # 14
    {"2_1_1_1": 1, "2_2_1": 2, "3_1_1": 1},  # 15
    {"2_1_1_1": 1, "2_2_1": 2, "2_3": 1},  # 16
    {"2_2_1": 2, "2_3": 2, "3_1_1": 2},  # 17
    {"2_2_1": 3, "3_1_1": 1, "3_2": 2},  # 18
    {"2_1_1_1": 1, "2_2_1": 1, "3_1_1": 1},  # 19
    {"2_2_1": 2, "2_3": 2, "4_1": 1},  # 20
    {"2_2_1": 1, "3_1_1": 1, "3_2": 2, "4_1": 2},  # 21
    {"2_2_1": 2, "3_2": 4, "4_1": 2},  # 22
    {"2_3": 5, "4_1": 5},  # 23
    {"3_2": 2, "4_1": 4, "5": 1},  # 24
    {"2_2_1": 1, "3_2": 3, "4_1": 4},  # 25
    {"3_2": 2, "4_1": 4, "5": 4},  # 26
    {"2_3": 3, "3_2": 6, "4_1": 6, "5": 6},  # 27
    {"2_2": 15, "3_2": 20, "4_1": 30, "5": 24},  # 28
)


def graphlet_orbits(i: int) -> range:
    """Which of the 73 orbits graphlet i takes: two for those of 3 nodes, four of 4, then three each while there are any."""
    if i < 2:
        return range(2 * i, 2 * i + 2)
    if i < 8:
        return range(4 * i - 4, 4 * i)
    return range(min(28 + 3 * (i - 8), 73), min(31 + 3 * (i - 8), 73))


def graphlet_shares(orbits: dict[int, Column]) -> list[Column]:
    """Share of each graphlet from counts of orbits (those not given are 0); all 0 where nothing is counted."""
    raw = []
    for i in range(len(SYMMETRIES)):
        own = [orbits[k] for k in graphlet_orbits(i) if k in orbits]
        raw.append(reduce(lambda a, b: a + b, own) / float(3 if i < 2 else 4 if i < 8 else 5) if own else zero())
    whole = reduce(lambda a, b: a + b, raw)
    return [ratio(x, whole) for x in raw]


def symmetry_features(shares: list[Column]) -> list[Column]:
    """The 13 symmetry-type features: graphlet shares times the types' multiplicities."""
    out = []
    for name in SYMMETRY_TYPES:
        terms = [shares[i] * float(SYMMETRIES[i][name]) for i in range(len(shares)) if name in SYMMETRIES[i]]
        out.append(reduce(lambda a, b: a + b, terms, zero()).alias(f"vsko_sym{name}"))
    return out


def ego_edges(g: GraphSet, hops: int = 2) -> DataFrame:
    """(graph_id, centre, src, dst): the subgraph induced by the nodes within some hops of each node."""
    ball = g.nodes.select("graph_id", F.col("node_id").alias("centre"), "node_id")
    for _ in range(hops):
        out = ball.join(g.adj.toDF("graph_id", "node_id", "u"), KEY).select("graph_id", "centre", F.col("u").alias("node_id"))
        ball = ball.union(out).distinct()
    inside = ball.select("graph_id", "centre", F.col("node_id").alias("dst"))
    return ball.withColumnRenamed("node_id", "src").join(g.edges, ["graph_id", "src"]).join(inside, ["graph_id", "centre", "dst"], "left_semi").select("graph_id", "centre", "src", "dst")


def ego_sizes(g: GraphSet, hops: int = 2) -> DataFrame:
    e = ego_edges(g, hops).groupBy("graph_id", F.col("centre").alias("node_id")).agg(F.count("*").alias("ego_edges"))
    return g.nodes.select(*KEY).join(e, KEY, "left").select(*KEY, F.coalesce("ego_edges", F.lit(0)).alias("ego_edges"))


def vsko(g: GraphSet, d: DataFrame | None = None, ego_hops: int = 2) -> DataFrame:
    """Symmetry-type features of each node in its ego graph.

    From two hops on, the centre's orbits in its ego graph are those in the whole graph, so no ego graph is cut
    out. Within one hop nobody is two steps away, so orbit 0 is 0; with none there is nothing to count.
    """
    return orbit3(g, d).select(*KEY, *ego_symmetry(ego_hops))


def ego_symmetry(ego_hops: int = 2) -> list[Column]:
    """vsko()'s features from the columns of orbit3()."""
    if ego_hops < 1:
        return [zero().alias(f"vsko_sym{t}") for t in SYMMETRY_TYPES]
    return symmetry_features(graphlet_shares({0: F.col("orbit_0") if ego_hops > 1 else zero(), 1: F.col("orbit_1"), 3: F.col("orbit_3")}))


def quads(g: GraphSet) -> DataFrame:
    """(graph_id, v, u, w, x, k): v < u < w < x with edge v-u, w and x each next to v or u, and k edges among the four."""
    e = g.edges.toDF("graph_id", "v", "u")
    side = lambda c: (
        e.join(g.adj.toDF("graph_id", "v", c), ["graph_id", "v"]).select("graph_id", "v", "u", c, F.lit(1).alias("k")).union(e.join(g.adj.toDF("graph_id", "u", c), ["graph_id", "u"]).select("graph_id", "v", "u", c, F.lit(1).alias("k"))).filter(f"{c} > u").groupBy("graph_id", "v", "u", c).agg(F.count("*").alias(f"k{c}"))
    )
    both = side("w").join(side("x"), ["graph_id", "v", "u"]).filter("w < x")
    wx = g.edges.select("graph_id", F.col("src").alias("w"), F.col("dst").alias("x"), F.lit(1).alias("wx"))
    return both.join(wx, ["graph_id", "w", "x"], "left").select("graph_id", "v", "u", "w", "x", (1 + F.col("kw") + F.col("kx") + F.coalesce("wx", F.lit(0))).alias("k"))


#: Candidates taken at each step of growing five nodes, and subgraphs of a graph at most.
BRANCHES, FIVES = (10, 5, 3, 2), 1000


def fives(g: GraphSet, limit: int = FIVES) -> DataFrame:
    """(graph_id, path, k): the first connected subgraphs of five nodes in order of their paths, and their edges.

    Paths start at every node; a step ranks the candidates next to a path (the second: next to both of its
    nodes) by id and keeps the first few, so there are at most 300 paths a node.
    """
    near, rows = g.adj.toDF("graph_id", "at", "c"), g.nodes.select("graph_id", F.array("node_id").alias("path"))
    for i, most in enumerate(BRANCHES):
        own = rows.withColumn("at", F.explode("path")).join(near, ["graph_id", "at"]).filter(~F.array_contains("path", F.col("c")))
        met = own.groupBy("graph_id", "path", "c").agg(F.count("*").alias("k")).filter(F.col("k") >= (2 if i == 1 else 1))
        rank = F.row_number().over(W.partitionBy("graph_id", "path").orderBy("c"))
        rows = met.withColumn("r", rank).filter(F.col("r") <= most).select("graph_id", F.concat("path", F.array("c")).alias("path"))
    rows = rows.withColumn("r", F.row_number().over(W.partitionBy("graph_id").orderBy("path"))).filter(F.col("r") <= limit).drop("r")
    pairs = F.array(*(F.struct(F.least(F.col("path")[a], F.col("path")[b]).alias("src"), F.greatest(F.col("path")[a], F.col("path")[b]).alias("dst")) for a in range(5) for b in range(a)))
    return rows.select("graph_id", "path", F.inline(pairs)).join(g.edges, ["graph_id", "src", "dst"], "left_semi").groupBy("graph_id", "path").agg(F.count("*").alias("k"))


def gdv(g: GraphSet, d: DataFrame | None = None, max_graphlet_size: int = 4) -> DataFrame:
    """73 orbit columns: 3-node orbits in closed form, 4-node ones by positions in id order and edge counts, 5-node ones
    (max_graphlet_size 5 only, else 0) from a bounded sample in id order."""
    out = orbit3(g, d).select(*KEY, F.col("orbit_0").alias("o0"), F.col("orbit_1").alias("o1"), F.col("orbit_3").alias("o3"))
    have = {0: "o0", 1: "o1", 3: "o3"}
    if max_graphlet_size >= 4:
        q = quads(g)
        roles = F.array(*(F.struct(F.col(c).alias("node_id"), reduce(lambda a, b: a.when(F.col("k") == b[0], b[1][i]), list(ROLES.items())[1:], F.when(F.col("k") == 3, ROLES[3][i])).alias("orbit")) for i, c in enumerate("vuwx")))
        seen = q.select("graph_id", F.explode(roles).alias("r")).select("graph_id", "r.node_id", "r.orbit")
        orbits = sorted({o for r in ROLES.values() for o in r})
        counts = seen.groupBy(*KEY).agg(*(F.count(F.when(F.col("orbit") == o, 1)).alias(f"q{o}") for o in orbits))
        out = out.join(counts, KEY, "left")
        have |= {o: f"q{o}" for o in orbits}
    if max_graphlet_size >= 5:
        late = [k for k in range(28, 73) if (k - 28) % 3 == 0 or k == 72]
        orbit = F.least(28 + 3 * F.greatest(F.col("k") - 4, F.lit(0)), F.lit(72))
        five = fives(g).select("graph_id", F.explode("path").alias("node_id"), orbit.alias("orbit")).groupBy(*KEY).agg(*(F.count(F.when(F.col("orbit") == k, 1)).alias(f"f{k}") for k in late))
        out = out.join(five, KEY, "left")
        have |= {k: f"f{k}" for k in late}
    return out.select(*KEY, *((F.coalesce(F.col(have[k]).cast("double"), zero()) if k in have else zero()).alias(f"gdv_orbit_{k}") for k in range(73)))


def squared_excess(col: str) -> Column:
    """(x - mean)^2 / mean within the graph."""
    mean = F.avg(col).over(W.partitionBy("graph_id"))
    return F.pow(F.col(col) - mean, F.lit(2.0)) / F.greatest(mean, F.lit(1e-9))


def lauri_local(g: GraphSet, d: DataFrame | None = None) -> DataFrame:
    """The nine handcrafted features but the eigenvector."""
    t = with_triangles(g, d).select(*KEY, F.col("n").cast("double").alias("n_nodes"), F.col("m").cast("double").alias("n_edges"), F.col("d").cast("double").alias("degree"), "lcc")
    x = t.withColumns({"chi2_degree": squared_excess("degree"), "chi2_lcc": squared_excess("lcc")})
    near = neighbour(g, x.select(*KEY, "chi2_degree", "chi2_lcc"), [F.avg("chi2_degree").alias("a"), F.avg("chi2_lcc").alias("b")])
    return x.join(near, KEY, "left").select(*KEY, "n_nodes", "n_edges", "degree", "lcc", "chi2_degree", F.coalesce("a", zero()).alias("chi2_degree_nbr"), "chi2_lcc", F.coalesce("b", zero()).alias("chi2_lcc_nbr"))


def normalised_rank(d: DataFrame, col: str = "d") -> Column:
    """Dense rank from 0 to 1 within the graph; 0 where all are equal."""
    rank = F.col("dr") - 1
    return ratio(rank, F.max("dr").over(W.partitionBy("graph_id")) - 1)


def degree_ranks(g: GraphSet, d: DataFrame | None = None) -> DataFrame:
    """degree_rank, and its least, most and mean among neighbours."""
    d = degree(g) if d is None else d
    r = d.withColumn("dr", F.dense_rank().over(W.partitionBy("graph_id").orderBy("d"))).withColumn("degree_rank", normalised_rank(d)).select(*KEY, "degree_rank")
    s = neighbour(g, r, [F.min("degree_rank").alias("i"), F.max("degree_rank").alias("x"), F.avg("degree_rank").alias("a")])
    return r.join(s, KEY, "left").select(*KEY, "degree_rank", *(F.coalesce(c, zero()).alias(f"{k}_nbr_deg_rank") for c, k in (("i", "min"), ("x", "max"), ("a", "avg"))))
