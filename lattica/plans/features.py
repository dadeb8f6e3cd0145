"""Feature sets as one wide plan, and the scaler."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions import centrality as ct
from lattica.functions import surroundings as sr
from lattica.graphs import KEY, GraphSet, Local, per_graph
from lattica.operators import iterative, local

SETS = ("kernel", "lauri", "both", "ajwani", "kernel+ajwani")
VSKO = [f"vsko_sym{t}" for t in local.SYMMETRY_TYPES]
GDV = [f"gdv_orbit_{i}" for i in range(73)]
WALK = [f"rw_{c}" for c in (
    "degree", "degree_normalized", "return_prob_t2", "return_prob_t4", "stationary_prob", "local_clustering", "avg_neighbor_degree", "max_neighbor_degree", "min_neighbor_degree", "degree_centrality",
    "closeness_centrality", "betweenness_centrality", "eigenvector_centrality", "pagerank", "core_number", "eccentricity", "avg_dist_2hop_nbrs", "hitting_time_proxy", "commute_time_proxy", "triangle_count")]
LAURI = ["n_nodes", "n_edges", "degree", "lcc", "eigenvec_centrality", "chi2_degree", "chi2_degree_nbr", "chi2_lcc", "chi2_lcc_nbr"]
AJWANI = ["lcc", "degree_centrality", "core_number", "degree_rank", "min_nbr_deg_rank", "max_nbr_deg_rank", "avg_nbr_deg_rank", "pagerank", "mis_freq", "mwua_avg_x", "mwua_avg_w", "mwua_min_w", "mwua_max_w"]


def joined(frames: list[DataFrame]) -> DataFrame:
    """Side by side on (graph_id, node_id); all are hashed on it, so the joins share one partitioning."""
    return reduce(lambda a, b: a.join(b, KEY), frames)


def kernel(g: GraphSet, families: list[str], ego_hops: int = 2, betweenness_k: int = 50, eigenvector_max_iter: int = 100) -> DataFrame:
    """The families of the kernel set and the label, graph by graph in one pass: links are derived and dealt out once."""
    orbits = [0, 1, 3] if {"vsko", "gdv"} & set(families) else []
    quads = sorted({o for r in sr.ROLES.values() for o in r}) if "gdv" in families else []
    names = [*(f"orbit_{o}" for o in orbits + quads), *(WALK if "rw" in families else [])]

    def work(x: Local) -> pd.DataFrame:
        by, out = sr.shared(x), {}
        if orbits:
            out |= {f"orbit_{o}": v for o, v in (sr.orbit3(x, by) | (sr.quad_orbits(x) if quads else {})).items()}
        if "rw" in families:
            paths, zero = ct.closeness_and_eccentricity(x), np.zeros(x.n)
            eigen, rank = ct.eigenvector(x, 1e-4, eigenvector_max_iter), ct.pagerank(x)
            out |= sr.walk_features(x, by, paths["second"]) | {"rw_closeness_centrality": paths["closeness"], "rw_eccentricity": paths["eccentricity"], "rw_betweenness_centrality": ct.betweenness(x, betweenness_k)}
            out |= {"rw_eigenvector_centrality": zero if eigen is None else eigen, "rw_pagerank": zero if rank is None else rank, "rw_core_number": ct.core_numbers(x)}
        return pd.DataFrame({"graph_id": np.full(x.n, x.graph_id), "node_id": x.ids, **{k: out[k].astype(float) for k in names}, "label": x.labels})

    kind = g.nodes.schema["label"].dataType.simpleString()
    rows = per_graph(g, work, "graph_id long, node_id long, " + "".join(f"{k} double, " for k in names) + f"label {kind}", labels=True)
    make = {
        "vsko": lambda: local.ego_symmetry(ego_hops),
        "gdv": lambda: [(F.col(f"orbit_{k}") if k in orbits + quads else F.lit(0.0)).alias(f"gdv_orbit_{k}") for k in range(73)],
        "rw": lambda: [F.col(c) for c in WALK],
    }
    return rows.select(*KEY, *(c for f in families for c in make[f]()), "label")


def lauri(g: GraphSet) -> DataFrame:
    return joined([local.lauri_local(g), iterative.eigenvector(g, 1e-6, 1000, "degree", "eigenvec_centrality")]).select(*KEY, *LAURI)


def ajwani(g: GraphSet, mis_freq_runs: int = 20, mis_freq_seed: int = 0, mwua_max_iter: int = 200) -> DataFrame:
    from pyspark.sql import Window as W

    base = local.with_triangles(g).select(*KEY, "lcc", F.when(F.col("n") <= 1, 1.0).otherwise(F.col("d") / F.greatest(F.col("n") - 1, F.lit(1))).alias("degree_centrality"))
    most = F.greatest(F.max("rw_core_number").over(W.partitionBy("graph_id")), F.lit(1.0))
    core = iterative.core_numbers(g).select(*KEY, (F.col("rw_core_number") / most).alias("core_number"))
    frames = [base, core, local.degree_ranks(g), iterative.pagerank(g, max_iter=200, fallback="uniform", name="pagerank"), iterative.mis_frequency(g, mis_freq_runs, mis_freq_seed), iterative.mwua(g, mwua_max_iter)]
    return joined(frames).select(*KEY, *AJWANI)


@dataclass(frozen=True)
class FeaturePipeline:
    feature_set: str = "kernel"
    ego_hops: int = 2
    use_vsko: bool = True
    use_gdv: bool = True
    use_rw: bool = True
    normalize: bool = True
    betweenness_k: int = 50

    def __post_init__(self):
        if self.feature_set not in SETS:
            raise ValueError(f"unknown feature set {self.feature_set!r}")
        if not self.names():
            raise ValueError("no feature family is enabled")

    def families(self) -> list[str]:
        kernel = [k for k, on in (("vsko", self.use_vsko), ("gdv", self.use_gdv), ("rw", self.use_rw)) if on]
        return {"kernel": kernel, "lauri": ["lauri"], "both": [*kernel, "lauri"], "ajwani": ["ajwani"], "kernel+ajwani": [*kernel, "ajwani"]}[self.feature_set]

    def names(self) -> list[str]:
        own = {"vsko": VSKO, "gdv": GDV, "rw": WALK, "lauri": LAURI, "ajwani": AJWANI}
        return [n for f in self.families() for n in own[f]]

    @property
    def n_features(self) -> int:
        return len(self.names())

    def extract(self, g: GraphSet) -> DataFrame:
        """(graph_id, node_id, features in order, label), -1 where unlabelled. Only what is enabled is computed."""
        more = {"lauri": lauri, "ajwani": ajwani}
        own = [f for f in self.families() if f not in more]
        first = kernel(g, own, self.ego_hops, self.betweenness_k) if own else g.nodes.select(*KEY, F.coalesce("label", F.lit(-1)).alias("label"))
        return joined([first, *(more[f](g) for f in self.families() if f in more)]).select(*KEY, *self.names(), "label")


@dataclass(frozen=True)
class Scaler:
    """Zero mean and unit population deviation; constant columns are only centred."""

    stats: dict[str, tuple[float, float]]

    @classmethod
    def fit(cls, features: DataFrame) -> Scaler:
        cols = [c for c in features.columns if c not in (*KEY, "label")]
        row = features.agg(*(f for i, c in enumerate(cols) for f in (F.avg(c).alias(f"m{i}"), F.stddev_pop(c).alias(f"s{i}")))).first()
        return cls({c: (row[f"m{i}"] or 0.0, row[f"s{i}"] or 1.0) for i, c in enumerate(cols)})

    def transform(self, features: DataFrame) -> DataFrame:
        return features.select(*(((F.col(c) - self.stats[c][0]) / self.stats[c][1]).alias(c) if c in self.stats else F.col(c) for c in features.columns))


def queries() -> dict:
    from lattica.queries import rounded, scaled_weights
    from lattica.sources import tables

    return {
        "features_lauri": lambda spark, d: rounded(lauri(tables.parts(spark, d))),
        "features_ajwani": lambda spark, d: rounded(scaled_weights(ajwani(tables.parts(spark, d)))),
        "features_kernel": lambda spark, d: rounded(FeaturePipeline().extract(tables.parts(spark, d))),
    }


def oracle_sql() -> dict[str, str]:
    from lattica import oracles as o
    from lattica import queries as q

    own = f"SELECT {o.ID}, "
    lauri_sql = own + o.r6(n_nodes="n", n_edges="m", degree="d", lcc="lcc", eigenvec_centrality="x", chi2_degree="cd", chi2_degree_nbr="coalesce(a, 0)", chi2_lcc="cl", chi2_lcc_nbr="coalesce(b, 0)")
    core = f"c{o.CORES}"
    ajwani_sql = own + o.r6(
        lcc="lcc", degree_centrality="CASE WHEN n <= 1 THEN 1.0 ELSE d / greatest(n - 1, 1) END", core_number="c::DOUBLE / greatest(max(c) OVER (PARTITION BY g), 1)", degree_rank="nr.x", min_nbr_deg_rank="coalesce(ni, 0)", max_nbr_deg_rank="coalesce(nx, 0)",
        avg_nbr_deg_rank="coalesce(na, 0)", pagerank="ptx.x", mis_freq="f", mwua_avg_x="ax", **q.WEIGHTS,
    )
    symmetry = {f"vsko_sym{t}": q.symmetry(" + ".join(f"{local.SYMMETRIES[i][t]} * g{i}" for i in (0, 1) if t in local.SYMMETRIES[i]) or "0") for t in local.SYMMETRY_TYPES}
    orbits = {f"gdv_orbit_{k}": f"coalesce(o{k}, 0)" if k in q.SOME_ORBITS else "0" for k in range(73)}
    walks = {
        "rw_degree": "d", "rw_degree_normalized": "d / greatest(n - 1, 1)", "rw_return_prob_t2": "t2", "rw_return_prob_t4": "t2 * t2", "rw_stationary_prob": "d / greatest(2 * m, 1)", "rw_local_clustering": "lcc",
        "rw_avg_neighbor_degree": "coalesce(nd_avg, 0)", "rw_max_neighbor_degree": "coalesce(nd_max, 0)", "rw_min_neighbor_degree": "coalesce(nd_min, 0)", "rw_degree_centrality": "CASE WHEN n <= 1 THEN 1.0 ELSE d / greatest(n - 1, 1) END",
        "rw_closeness_centrality": "CASE WHEN r < 2 THEN 0 ELSE (r - 1) / far * (r - 1) / (n - 1) END", "rw_betweenness_centrality": "CASE WHEN n > 2 THEN coalesce(bt, 0) * n / least(n, 50) / ((n - 1) * (n - 2)) ELSE coalesce(bt, 0) END",
        "rw_eigenvector_centrality": "etx.x", "rw_pagerank": "ptx.x", "rw_core_number": "c", "rw_eccentricity": "CASE WHEN min(r) OVER (PARTITION BY g) = n THEN ecc ELSE -1 END", "rw_avg_dist_2hop_nbrs": "coalesce((2.0 * th.k - th.j) / th.k, 0)",
        "rw_hitting_time_proxy": "h / greatest(max(h) OVER (PARTITION BY g), 1)", "rw_commute_time_proxy": "CASE WHEN d * hit.a = 0 THEN 0 ELSE 2.0 * m / (d * hit.a) END", "rw_triangle_count": "t",
    }
    counted = ", ".join(f"count(*) FILTER (o = {k}) AS o{k}" for k in q.SOME_ORBITS[3:])
    kernel_more = f"""{o.SELF}, {o.pagerank_until()}, {o.eigenvector_until()}, {o.core_sql(o.CORES)}, {o.apsp(o.DEPTH)}, {q.RETURN}, {q.ORBITS}, {q.QUADS}, {q.TWO_HOP}, {q.HIT},
qo AS (SELECT g, v, {counted} FROM role GROUP BY g, v),
piv AS (SELECT g, v FROM nodes QUALIFY row_number() OVER (PARTITION BY g ORDER BY ('0x' || md5('0:' || v)[1:8])::BIGINT, v) <= 50),
bw AS (SELECT x.g, x.v, sum(x.sigma * y.sigma / z.sigma) AS bt FROM sp x JOIN piv ON piv.g = x.g AND piv.v = x.s JOIN sp y ON y.g = x.g AND y.s = x.v JOIN sp z ON z.g = x.g AND z.s = x.s AND z.v = y.v AND z.dist = x.dist + y.dist WHERE x.dist > 0 AND y.dist > 0 GROUP BY ALL),
pd AS (SELECT g, s AS v, count(*)::DOUBLE AS r, sum(dist) AS far, max(dist) AS ecc FROM sp GROUP BY g, sp.s),
sh AS (SELECT g, v, o0, o1, o3, (o0 + o1) / 3.0 AS g0, o3 / 3.0 AS g1 FROM orb)"""
    kernel_sql = own + o.r6(**symmetry, **orbits, **walks) + f", -1 AS label FROM loc JOIN sh USING (g, v) JOIN ret USING (g, v) JOIN (SELECT g, v, h, a FROM hit) hit USING (g, v) JOIN ptx USING (g, v) JOIN etx USING (g, v) JOIN {core} USING (g, v) JOIN pd USING (g, v) LEFT JOIN nb USING (g, v) LEFT JOIN qo USING (g, v) LEFT JOIN bw USING (g, v) LEFT JOIN th USING (g, v)"
    return {
        "features_lauri": o.over(lauri_sql + " FROM chi JOIN etx USING (g, v) LEFT JOIN cn USING (g, v)", more=f"{o.SELF}, {o.eigenvector_until(1e-6, 1000, 'd / greatest(n - 1, 1)')}, {q.CHI}, {q.CHI_NEAR}"),
        "features_ajwani": o.over(
            ajwani_sql + f" FROM loc JOIN {core} USING (g, v) JOIN nr USING (g, v) JOIN ptx USING (g, v) JOIN lf USING (g, v) JOIN mx USING (g, v) LEFT JOIN mw USING (g, v) LEFT JOIN rn USING (g, v)",
            more=f"{o.SELF}, {o.pagerank_until(rounds=200, fallback='1.0 / n')}, {o.LUBY}, {o.mwua_until()}, {o.core_sql(o.CORES)}, {q.RANK}, rn AS (SELECT adj.g, adj.v, min(nr.x) AS ni, max(nr.x) AS nx, avg(nr.x) AS na FROM adj JOIN nr ON nr.g = adj.g AND nr.v = adj.u GROUP BY ALL)",
        ),
        "features_kernel": o.over(kernel_sql, more=kernel_more),
    }
