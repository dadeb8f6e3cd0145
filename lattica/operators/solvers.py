"""Minimum vertex cover solvers, one call for a whole corpus.

backend "exact" is branch and bound with reductions, bounded by branches, never by time, so results repeat.
A capped result says is_optimal = 0 and carries the bound of the linear relaxation. Edgeless graphs have
the empty cover. "approx" is Konig's cover where the graph is bipartite, else both ends of a matching.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions import covers
from lattica.graphs import GraphSet, Local, per_graph

#: What callers may ask for; every name of an integer solver is served by the one exact backend.
BACKENDS = ("exact", "ilp", "approx", "matching", "konig", "greedy")
ILP_SOLVERS = ("auto", "gurobi", "xpress", "highs", "scip", "cbc", "glpk")
SOLVED = "graph_id long, cover array<long>, size long, lp_bound long, backend string, is_optimal int, runtime_s double"


def _solve(g: Local, backend: str, max_branches: int, fallback: bool) -> tuple[set[int], str, bool]:
    if not len(g.src):
        return set(), "trivial", True
    if backend in ("exact", "ilp"):
        cover, optimal = covers.exact_cover(g, max_branches)
        if not optimal and not fallback:
            raise RuntimeError(f"graph {g.graph_id}: no proof within {max_branches} branches")
        return cover, "exact" if optimal else "exact_capped", optimal
    if backend == "matching":
        return covers.matching_cover(g), "matching", False
    if backend == "greedy":
        return set(np.flatnonzero(covers.greedy_scores(g) > 0).tolist()), "greedy", False
    if backend == "konig":
        cover = covers.konig_cover(g)
        if cover is None:
            raise RuntimeError(f"graph {g.graph_id} is not bipartite")
        return cover, "konig", True
    return (*covers.approximate_cover(g), False)


@dataclass(frozen=True)
class Solver:
    backend: str = "exact"
    max_branches: int = 20_000
    fallback_to_approx: bool = True
    ilp_solver: str = "auto"

    def __post_init__(self):
        if self.backend not in BACKENDS or self.ilp_solver not in ILP_SOLVERS:
            raise ValueError(f"unknown backend {self.backend!r} or solver {self.ilp_solver!r}")

    def solve(self, g: GraphSet) -> DataFrame:
        """SOLVED rows: one per graph, with the cover as an array."""
        how = self.backend, self.max_branches, self.fallback_to_approx

        def work(x: Local) -> pd.DataFrame:
            began = time.perf_counter()
            cover, name, optimal = _solve(x, *how)
            took = time.perf_counter() - began
            return pd.DataFrame([(x.graph_id, x.ids[sorted(cover)].tolist(), len(cover), covers.lp_bound(x), name, int(optimal), took)], columns=["graph_id", "cover", "size", "lp_bound", "backend", "is_optimal", "runtime_s"])

        return per_graph(g, work, SOLVED)


def members(solved: DataFrame) -> DataFrame:
    """(graph_id, node_id) of SOLVED rows."""
    return solved.select("graph_id", F.explode("cover").alias("node_id"))


def stats(solved: DataFrame) -> DataFrame:
    return solved.drop("cover")


def approximation_ratio(solved: DataFrame) -> DataFrame:
    return solved.select("graph_id", F.when(F.col("lp_bound") > 0, F.col("size") / F.col("lp_bound")).alias("approximation_ratio"))


def labelled(g: GraphSet, solved: DataFrame) -> GraphSet:
    """g with label 1 for the cover's nodes, 0 for others."""
    own = members(solved).withColumn("label", F.lit(1))
    return GraphSet(g.nodes.drop("label").join(own, ["graph_id", "node_id"], "left").select("graph_id", "node_id", F.coalesce("label", F.lit(0)).alias("label")), g.edges)


def bipartite(g: GraphSet) -> DataFrame:
    """(graph_id, is_bipartite)"""
    return per_graph(g, lambda x: pd.DataFrame({"graph_id": [x.graph_id], "is_bipartite": [int(covers.two_colours(x) is not None)]}), "graph_id long, is_bipartite int")


def lp_bounds(g: GraphSet) -> DataFrame:
    return per_graph(g, lambda x: pd.DataFrame({"graph_id": [x.graph_id], "lp_bound": [covers.lp_bound(x)]}), "graph_id long, lp_bound long")
