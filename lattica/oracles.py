"""DuckDB SQL for the graph queries, put together from common table expressions."""

from __future__ import annotations

#: The parts graphs: nodes(g, v), edges(g, a, b) with a < b, adj(g, v, u), deg(g, v, d, n, m).
PARTS = """
pn AS (SELECT regexp_replace(p_brand, '[^0-9]', '', 'g')::BIGINT AS g, p_partkey AS k, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS v FROM part),
nodes AS MATERIALIZED (SELECT g, v FROM pn),
li AS (SELECT DISTINCT l_orderkey AS o, g, v FROM lineitem JOIN pn ON l_partkey = k),
edges AS MATERIALIZED (SELECT DISTINCT x.g, x.v AS a, y.v AS b FROM li x JOIN li y ON x.o = y.o AND x.g = y.g AND x.v < y.v),
"""
USERS = """
ev AS (SELECT DISTINCT strftime(ts, '%Y%m%d')::BIGINT AS g, user_id AS k, event_type AS t, hour(ts) AS h FROM events),
up AS (SELECT DISTINCT x.g, x.k AS a, y.k AS b FROM ev x JOIN ev y ON x.g = y.g AND x.t = y.t AND x.h = y.h AND x.k < y.k),
pn AS (SELECT g, k, row_number() OVER (PARTITION BY g ORDER BY k) - 1 AS v FROM (SELECT g, a AS k FROM up UNION SELECT g, b FROM up)),
nodes AS MATERIALIZED (SELECT g, v FROM pn),
edges AS MATERIALIZED (SELECT up.g, x.v AS a, y.v AS b FROM up JOIN pn x ON x.g = up.g AND x.k = up.a JOIN pn y ON y.g = up.g AND y.k = up.b),
"""
SUPPLIERS = """
pn AS (SELECT s_nationkey::BIGINT AS g, s_suppkey AS k, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS v FROM supplier),
nodes AS MATERIALIZED (SELECT g, v FROM pn),
li AS (SELECT DISTINCT l_orderkey AS o, g, v FROM lineitem JOIN pn ON l_suppkey = k),
edges AS MATERIALIZED (SELECT DISTINCT x.g, x.v AS a, y.v AS b FROM li x JOIN li y ON x.o = y.o AND x.g = y.g AND x.v < y.v),
"""
TRADE = """
tp AS (SELECT DISTINCT c_nationkey::BIGINT AS g, c_custkey * 2 AS x, l_suppkey * 2 + 1 AS y FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey),
pn AS (SELECT g, k, row_number() OVER (PARTITION BY g ORDER BY k) - 1 AS v FROM (SELECT g, x AS k FROM tp UNION SELECT g, y FROM tp)),
nodes AS MATERIALIZED (SELECT g, v FROM pn),
edges AS MATERIALIZED (SELECT tp.g, least(p.v, q.v) AS a, greatest(p.v, q.v) AS b FROM tp JOIN pn p ON p.g = tp.g AND p.k = tp.x JOIN pn q ON q.g = tp.g AND q.k = tp.y),
"""
LINES = """
tp AS (SELECT DISTINCT s_nationkey::BIGINT AS g, -l_linenumber AS a, s_suppkey AS b FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_quantity = 50 AND l_discount = 0.10),
pn AS (SELECT g, k, row_number() OVER (PARTITION BY g ORDER BY k) - 1 AS v FROM (SELECT g, a AS k FROM tp UNION SELECT g, b FROM tp)),
nodes AS MATERIALIZED (SELECT g, v FROM pn),
edges AS MATERIALIZED (SELECT tp.g, p.v AS a, q.v AS b FROM tp JOIN pn p ON p.g = tp.g AND p.k = tp.a JOIN pn q ON q.g = tp.g AND q.k = tp.b),
"""
#: Least covers of bipartite graphs with few nodes on the low side: choose some of these, and every other node with a neighbour that is not chosen.
BIPARTITE = """mask AS (SELECT g, b AS v, sum(1 << a)::BIGINT AS bits FROM edges GROUP BY ALL),
low AS (SELECT g, max(a) + 1 AS k FROM edges GROUP BY g),
mc AS MATERIALIZED (SELECT g, min(size)::BIGINT AS size FROM (
  SELECT c.g, c.s, any_value(bit_count(c.s)) + sum(((mask.bits & ~c.s) <> 0)::INT) AS size FROM (SELECT g, unnest(range(0, (1 << k)::BIGINT)) AS s FROM low) c JOIN mask ON mask.g = c.g GROUP BY c.g, c.s) GROUP BY g)"""
#: is_bipartite: no edge whose ends are equally far, modulo 2, from their component's least node. After apsp().
ODD = """root AS (SELECT g, v, min(struct_pack(s := s, dist := dist)) AS r FROM sp GROUP BY ALL),
odd AS (SELECT DISTINCT e.g FROM edges e JOIN root x ON x.g = e.g AND x.v = e.a JOIN root y ON y.g = e.g AND y.v = e.b WHERE x.r.dist % 2 = y.r.dist % 2)"""
#: Half a least cover of the bipartite double cover, rounded up: choose some left copies, and the right copies next to others.
LP = """ng AS (SELECT g, count(*) AS n FROM nodes GROUP BY g),
near AS (SELECT nodes.g, nodes.v, coalesce(sum(1 << u), 0)::BIGINT AS bits FROM nodes LEFT JOIN adj USING (g, v) GROUP BY ALL),
lp AS (SELECT g, min(size) AS twice FROM (
  SELECT c.g, c.s, bit_count(any_value(c.s)) + bit_count(bit_or(CASE WHEN (c.s >> near.v) & 1 = 0 THEN near.bits ELSE 0 END)) AS size
  FROM (SELECT g, unnest(range(0, (1 << n)::BIGINT)) AS s FROM ng) c JOIN near ON near.g = c.g GROUP BY c.g, c.s) GROUP BY g)"""
COMMON = """
adj AS MATERIALIZED (SELECT g, a AS v, b AS u FROM edges UNION ALL SELECT g, b, a FROM edges),
deg AS MATERIALIZED (
  SELECT *, count(*) OVER (PARTITION BY g) AS n, sum(d) OVER (PARTITION BY g) / 2 AS m
  FROM (SELECT g, v, count(u) AS d FROM nodes LEFT JOIN adj USING (g, v) GROUP BY g, v)),
tri AS MATERIALIZED (
  SELECT g, v, count(*) AS t FROM (
    SELECT e.g, unnest([e.a, e.b, f.b]) AS v FROM edges e JOIN edges f ON f.g = e.g AND f.a = e.b JOIN edges h ON h.g = e.g AND h.a = e.a AND h.b = f.b) GROUP BY ALL),
loc AS MATERIALIZED (
  SELECT deg.*, coalesce(t, 0) AS t, CASE WHEN d < 2 THEN 0.0 ELSE 2.0 * coalesce(t, 0) / (d * (d - 1)) END AS lcc FROM deg LEFT JOIN tri USING (g, v)),
nb AS MATERIALIZED (
  SELECT adj.g, adj.v, avg(deg.d) AS nd_avg, max(deg.d) AS nd_max, min(deg.d) AS nd_min, sum(1.0 / deg.d) AS inv, sum(deg.d - 1) AS ends
  FROM adj JOIN deg ON deg.g = adj.g AND deg.v = adj.u GROUP BY ALL)
"""
ID = "g AS graph_id, v AS node_id"


def over(sql: str, corpus: str = PARTS, more: str = "") -> str:
    return f"WITH RECURSIVE {corpus} {COMMON.strip()} {', ' + more if more else ''} {sql}"


def r6(**cols: str) -> str:
    return ", ".join(f"round({x}, 6)::DOUBLE AS {name}" for name, x in cols.items())


#: Pairs of nodes with their distance, by levels.
def apsp(depth: int) -> str:
    out = ["l0 AS MATERIALIZED (SELECT g, v AS s, v, 0 AS dist, 1.0::DOUBLE AS sigma FROM nodes), all0 AS MATERIALIZED (SELECT * FROM l0)"]
    for k in range(1, depth + 1):
        out.append(
            f"l{k} AS MATERIALIZED (SELECT l.g, l.s, adj.u AS v, {k} AS dist, sum(l.sigma) AS sigma FROM l{k - 1} l JOIN adj ON adj.g = l.g AND adj.v = l.v "
            f"WHERE NOT EXISTS (SELECT 1 FROM all{k - 1} x WHERE x.g = l.g AND x.s = l.s AND x.v = adj.u) GROUP BY ALL), "
            f"all{k} AS MATERIALIZED (SELECT * FROM all{k - 1} UNION ALL SELECT * FROM l{k})"
        )
    return ", ".join(out) + f", sp AS MATERIALIZED (SELECT * FROM all{depth})"


DEPTH = 14


def core_sql(rounds: int) -> str:
    """Cores as the limit of h-indices of the neighbours' values, from the degrees."""
    out = ["c0 AS MATERIALIZED (SELECT g, v, d AS c FROM deg)"]
    for k in range(1, rounds + 1):
        out.append(
            f"r{k} AS (SELECT adj.g, adj.v, c.c, row_number() OVER (PARTITION BY adj.g, adj.v ORDER BY c.c DESC) AS k FROM adj JOIN c{k - 1} c ON c.g = adj.g AND c.v = adj.u), "
            f"i{k} AS (SELECT g, v, max(least(c, k)) AS h FROM r{k} GROUP BY ALL), "
            f"c{k} AS MATERIALIZED (SELECT c.g, c.v, least(c.c, coalesce(h, 0)) AS c FROM c{k - 1} c LEFT JOIN i{k} USING (g, v))"
        )
    return ", ".join(out)


CORES = 40


#: adj with every node as its own neighbour too: a recursion may name its table once, and so sees old and new values.
SELF = "adjs AS MATERIALIZED (SELECT g, v, u FROM adj UNION ALL SELECT g, v, v FROM nodes)"


def settled(name: str, tol: float, fallback: str) -> str:
    return f"{name}x AS MATERIALIZED (SELECT g, v, CASE WHEN err < n * {tol} THEN x ELSE {fallback} END AS x FROM {name} JOIN deg USING (g, v) QUALIFY k = max(k) OVER (PARTITION BY g))"


def pagerank_until(tol: float = 1e-6, rounds: int = 100, fallback: str = "0", name: str = "pt") -> str:
    """Rounds until a graph's values move by less than n * tol in all: {name}x(g, v, x). Needs SELF."""
    return (
        f"""{name}(g, v, k, x, err) AS (
  SELECT g, v, 0, 1.0::DOUBLE / n, n::DOUBLE FROM deg
  UNION ALL
  SELECT g, v, k + 1, y, sum(abs(y - x)) OVER (PARTITION BY g) FROM (
    SELECT q.g, j.u AS v, q.k, sum(q.x) FILTER (j.u = j.v) AS x, 0.85 * (coalesce(sum(q.x / q.d) FILTER (j.u <> j.v), 0) + any_value(z) / any_value(n)) + 0.15 / any_value(n) AS y
    FROM (SELECT p.g, p.v, p.k, p.x, deg.d, deg.n, sum(CASE WHEN deg.d = 0 THEN p.x ELSE 0 END) OVER (PARTITION BY p.g) AS z FROM {name} p JOIN deg ON deg.g = p.g AND deg.v = p.v WHERE p.err >= deg.n * {tol} AND p.k < {rounds}) q
    JOIN adjs j ON j.g = q.g AND j.v = q.v GROUP BY q.g, j.u, q.k)),
"""
        + settled(name, tol, fallback)
    )


def eigenvector_until(tol: float = 1e-4, rounds: int = 100, fallback: str = "0", name: str = "et") -> str:
    return (
        f"""{name}(g, v, k, x, err) AS (
  SELECT g, v, 0, 1.0::DOUBLE / n, n::DOUBLE FROM deg
  UNION ALL
  SELECT g, v, k + 1, y, sum(abs(y - x)) OVER (PARTITION BY g) FROM (
    SELECT g, v, k, x, s / sqrt(sum(s * s) OVER (PARTITION BY g)) AS y FROM (
      SELECT p.g, j.u AS v, p.k, sum(p.x) FILTER (j.u = j.v) AS x, sum(p.x) AS s
      FROM (SELECT e.* FROM {name} e JOIN deg ON deg.g = e.g AND deg.v = e.v WHERE e.err >= deg.n * {tol} AND e.k < {rounds}) p JOIN adjs j ON j.g = p.g AND j.v = p.v GROUP BY p.g, j.u, p.k))),
"""
        + settled(name, tol, fallback)
    )


def mwua_until(tol: float = 1e-5, rounds: int = 200) -> str:
    """mx(g, v, ax) and mw(g, v, aw, iw, xw). The loads that a round starts from end with it, so weights move only where values did."""
    return f"""mt(g, a, b, k, w, xa, xb, moved) AS (
  SELECT g, a, b, 0, 1.0::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE FROM edges
  UNION ALL
  SELECT g, a, b, k + 1, CASE WHEN moved < {tol} THEN w WHEN max(t) OVER (PARTITION BY g) > 1e8 THEN t / max(t) OVER (PARTITION BY g) ELSE t END, xa, xb, moved FROM (
    SELECT *, w * (1 + greatest(0, xa + xb - 1)) AS t FROM (
      SELECT g, a, b, any_value(k) AS k, any_value(w) AS w, any_value(x) FILTER (v = a) AS xa, any_value(x) FILTER (v = b) AS xb, any_value(moved) AS moved FROM (
        SELECT *, max(abs(x - was)) OVER (PARTITION BY g) AS moved FROM (
          SELECT *, greatest(0, 1 - sum(w) OVER (PARTITION BY g, v) / (sum(w) OVER (PARTITION BY g) / 2)) AS x FROM (
            SELECT g, a, b, k, w, unnest([a, b]) AS v, unnest([xa, xb]) AS was FROM mt WHERE (moved IS NULL OR moved >= {tol}) AND k < {rounds})))
      GROUP BY g, a, b))),
mv AS (SELECT g, v, k, any_value(x) AS x FROM (SELECT g, k, unnest([a, b]) AS v, unnest([xa, xb]) AS x FROM mt WHERE k > 0) GROUP BY g, v, k),
mx AS MATERIALIZED (SELECT nodes.g, nodes.v, coalesce(avg(x), 1) AS ax FROM nodes LEFT JOIN mv USING (g, v) GROUP BY ALL),
ml AS (SELECT * FROM mt QUALIFY k = max(k) OVER (PARTITION BY g)),
mw AS MATERIALIZED (SELECT g, v, avg(w) AS aw, min(w) AS iw, max(w) AS xw FROM (SELECT g, w, unnest([a, b]) AS v FROM ml) GROUP BY ALL)"""


#: How often a node is in Luby's set, 20 runs with seed 0: lu holds the nodes alive at each round, and those that have won. Needs SELF.
LUBY = """lu(g, run, k, v, won) AS (
  SELECT g, run, 0, v, false FROM nodes, range(20) t(run)
  UNION ALL
  SELECT g, run, k + 1, v, mine FROM (
    SELECT c.g, c.run, c.k, j.u AS v, bool_or(j.u = j.v) AS here, bool_or(j.u = j.v AND c.win) AS mine, bool_or(j.u <> j.v AND c.win) AS beside FROM (
      SELECT g, run, k, v, coalesce(own < other, true) AS win FROM (
        SELECT p.g, p.run, p.k, j.u AS v, min(p.r) FILTER (j.u = j.v) AS own, min(p.r) FILTER (j.u <> j.v) AS other
        FROM (SELECT g, run, k, v, ('0x' || md5('0:' || run || ':' || k || ':' || v)[1:8])::BIGINT AS r FROM lu WHERE NOT won) p JOIN adjs j ON j.g = p.g AND j.v = p.v GROUP BY p.g, p.run, p.k, j.u)
      WHERE own IS NOT NULL) c JOIN adjs j ON j.g = c.g AND j.v = c.v GROUP BY c.g, c.run, c.k, j.u)
  WHERE here AND (mine OR NOT beside)),
lf AS MATERIALIZED (SELECT g, v, count(*) FILTER (won) / 20.0::DOUBLE AS f FROM lu GROUP BY g, v)"""


#: A score for each node that both engines compute alike: its degree scaled within the graph.
PROBS = "pr AS MATERIALIZED (SELECT g, v, CASE WHEN max(d) OVER (PARTITION BY g) = 0 THEN 0.0 ELSE d::DOUBLE / max(d) OVER (PARTITION BY g) END AS p, n FROM deg)"


def pruned(threshold: float, fix: float, keep_node: bool = False, least: int = 2) -> str:
    """st(g, v, p, high, removed, forced)"""
    blocked = "AND NOT EXISTS (SELECT 1 FROM adj JOIN hi x ON x.g = adj.g AND x.v = adj.u WHERE adj.g = hi.g AND adj.v = hi.v AND x.high = 0)" if keep_node else ""
    return f"""{PROBS},
hi AS MATERIALIZED (SELECT g, v, p, n, ({fix} <= 1.0 AND p >= {fix})::INT AS high FROM pr),
cand AS (SELECT g, v, row_number() OVER (PARTITION BY g ORDER BY p, v) AS k, n FROM hi WHERE p < {threshold} AND high = 0 {blocked}),
rem AS MATERIALIZED (SELECT g, v FROM cand WHERE k <= greatest(0, n - {least})),
st AS MATERIALIZED (
  SELECT hi.g, hi.v, p, high, (rem.v IS NOT NULL)::INT AS removed,
         (high = 1 OR (rem.v IS NULL AND EXISTS (SELECT 1 FROM adj JOIN rem y ON y.g = adj.g AND y.v = adj.u WHERE adj.g = hi.g AND adj.v = hi.v)))::INT AS forced
  FROM hi LEFT JOIN rem ON rem.g = hi.g AND rem.v = hi.v)"""


#: The structural score.
STRUCTURAL = (
    core_sql(CORES)
    + f""",
raw AS (SELECT loc.g, loc.v, d AS f1, t AS f2, CASE WHEN d > 0 THEN coalesce(inv, 0) / d ELSE 0 END AS f3, coalesce(nd_min, 0) AS f4, coalesce(ends, 0) AS f5, c AS f6, coalesce(nd_avg, 0) AS f7
        FROM loc LEFT JOIN nb USING (g, v) JOIN c{CORES} USING (g, v)),
scaled AS (SELECT g, v, """
    + ", ".join(f"CASE WHEN max(f{i}) OVER (PARTITION BY g) = min(f{i}) OVER (PARTITION BY g) THEN 0 ELSE (f{i} - min(f{i}) OVER (PARTITION BY g))::DOUBLE / (max(f{i}) OVER (PARTITION BY g) - min(f{i}) OVER (PARTITION BY g)) END AS s{i}" for i in range(1, 8))
    + """ FROM raw),
ss AS MATERIALIZED (SELECT g, v, (73 * s1 + 41 * s2 + 24.6 * s3 + 20.5 * s4 + 11.4 * s5 + 9.9 * s6 + 7.7 * s7) / 188.1 AS score FROM scaled)"""
)
