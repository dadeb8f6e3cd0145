"""Measures that need many rounds or whole paths.

Corpora of many small graphs go graph by graph in Arrow batches: one shuffle by graph_id, all rounds in
memory. For graphs too large for a task, pagerank, core numbers and components also come as DataFrame
rounds (spread=True), each written to the shared checkpoint folder.
"""

from __future__ import annotations

import tempfile

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lattica.functions import centrality as ct
from lattica.graphs import KEY, GraphSet, Local, per_graph, per_node
from lattica.operators.local import degree


def checkpointed(df: DataFrame) -> DataFrame:
    """df without its lineage, in spark.checkpoint.dir; a folder of our own only where that is unset."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="lattica-"))
    return df.checkpoint(eager=True)


def _or(values: np.ndarray | None, otherwise: np.ndarray) -> np.ndarray:
    return otherwise if values is None else values


def pagerank(g: GraphSet, alpha: float = 0.85, tol: float | None = 1e-6, max_iter: int = 100, fallback: str = "zero", name: str = "rw_pagerank", spread: bool = False) -> DataFrame:
    if spread:
        return _pagerank_rounds(g, alpha, tol, max_iter, fallback, name)
    return per_node(g, {name: lambda x: _or(ct.pagerank(x, alpha, tol, max_iter), np.zeros(x.n) if fallback == "zero" else np.full(x.n, 1 / max(x.n, 1)))})


def _pagerank_rounds(g: GraphSet, alpha: float, tol: float | None, rounds: int, fallback: str, name: str) -> DataFrame:
    """Rounds over all graphs that have not settled yet. A graph's sums are partial aggregates joined back, so no task holds a graph."""
    links = checkpointed(g.adj)
    d = links.groupBy("graph_id", F.col("v").alias("node_id")).agg(F.count("*").alias("d"))
    n = g.nodes.groupBy("graph_id").agg(F.count("*").alias("n"))
    open_ = checkpointed(g.nodes.select(*KEY).join(d, KEY, "left").join(n, "graph_id").select(*KEY, F.coalesce("d", F.lit(0)).alias("d"), "n", (1 / F.col("n")).alias("x")))
    done = None
    for _ in range(rounds):
        share = open_.filter("d > 0").select("graph_id", F.col("node_id").alias("u"), (F.col("x") / F.col("d")).alias("y"))
        got = links.join(share, ["graph_id", "u"]).groupBy("graph_id", F.col("v").alias("node_id")).agg(F.sum("y").alias("s"))
        lost = open_.groupBy("graph_id").agg(F.sum(F.when(F.col("d") == 0, F.col("x")).otherwise(0.0)).alias("z"))
        y = alpha * (F.coalesce("s", F.lit(0.0)) + F.col("z") / F.col("n")) + (1 - alpha) / F.col("n")
        new = checkpointed(open_.join(got, KEY, "left").join(lost, "graph_id").select(*KEY, "d", "n", F.col("x").alias("was"), y.alias("x")))
        open_ = new.drop("was")
        if tol is not None:
            moved = F.sum(F.abs(F.col("x") - F.col("was"))) < F.first("n") * tol
            settled = checkpointed(new.groupBy("graph_id").agg(moved.alias("settled")))
            if settled.filter("settled").isEmpty():
                continue
            ready = new.join(settled.filter("settled"), "graph_id", "left_semi").select(*KEY, "x")
            done = checkpointed(ready if done is None else done.union(ready))
            open_ = checkpointed(open_.join(settled.filter("not settled"), "graph_id", "left_semi"))
            if open_.isEmpty():
                return done.select(*KEY, F.col("x").alias(name))
    rest = open_.select(*KEY, (F.col("x") if tol is None else F.lit(0.0) if fallback == "zero" else 1 / F.col("n")).alias("x"))
    return (rest if done is None else done.union(rest)).select(*KEY, F.col("x").alias(name))


def eigenvector(g: GraphSet, tol: float | None = 1e-4, max_iter: int = 100, fallback: str = "zero", name: str = "rw_eigenvector_centrality") -> DataFrame:
    return per_node(g, {name: lambda x: _or(ct.eigenvector(x, tol, max_iter), np.zeros(x.n) if fallback == "zero" else ct.degrees(x) / max(x.n - 1, 1))})


def core_numbers(g: GraphSet, spread: bool = False, max_rounds: int | None = None) -> DataFrame:
    """Core number of every node; in rounds until no value changes, or an error where max_rounds do not suffice."""
    if not spread:
        return per_node(g, {"rw_core_number": lambda x: ct.core_numbers(x).astype(float)})
    # cores are the limit of h-indices of the neighbours' values, starting from the degrees
    x, links = checkpointed(degree(g).select(*KEY, F.col("d").alias("c"))), checkpointed(g.adj)
    k = 0
    while max_rounds is None or k < max_rounds:  # values only fall, so it ends; along a chain by one node a round from each end
        k += 1
        ranked = links.join(x.toDF("graph_id", "u", "c"), ["graph_id", "u"]).withColumn("k", F.row_number().over(W.partitionBy("graph_id", "v").orderBy(F.col("c").desc())))
        h = ranked.groupBy("graph_id", F.col("v").alias("node_id")).agg(F.max(F.least("c", "k")).alias("h"))
        new = checkpointed(x.join(h, KEY, "left").select(*KEY, F.least("c", F.coalesce("h", F.lit(0))).alias("c"), F.col("c").alias("was")))
        x = new.select(*KEY, "c")
        if not new.filter("c <> was").limit(1).count():
            return x.select(*KEY, F.col("c").cast("double").alias("rw_core_number"))
    raise RuntimeError(f"core numbers did not settle in {max_rounds} rounds")


def path_features(g: GraphSet) -> DataFrame:
    def both(x: Local) -> dict[str, np.ndarray]:
        got = ct.closeness_and_eccentricity(x)
        return {"rw_closeness_centrality": got["closeness"], "rw_eccentricity": got["eccentricity"]}

    return per_node(g, both, ["rw_closeness_centrality", "rw_eccentricity"])


#: Nodes times links of a graph for one task of betweenness.
SHARE = 3e8


def betweenness(g: GraphSet, k: int | None = 50, seed: int = 0) -> DataFrame:
    """From all nodes, or from k pivots. A large graph's sources go over tasks, and their sums are added in the same order each time."""
    if k is not None:
        return per_node(g, {"rw_betweenness_centrality": lambda x: ct.betweenness(x, k, seed)})

    def some(x: Local, part: int, parts: int) -> pd.DataFrame:
        return pd.DataFrame({"graph_id": [x.graph_id], "part": [part], "ids": [x.ids if part == 0 else x.ids[:0]], "x": [ct.betweenness(x, part=part, parts=parts)]})

    def whole(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("part")
        ids = rows["ids"].iloc[0]
        return pd.DataFrame({"graph_id": np.full(len(ids), rows["graph_id"].iloc[0]), "node_id": ids, "rw_betweenness_centrality": sum(rows["x"].tolist())})

    parts = F.ceil(F.greatest(F.size("ids").cast("double") * F.size("src") / SHARE, F.lit(1)))
    sums = per_graph(g, some, "graph_id long, part int, ids array<long>, x array<double>", parts=parts)
    return sums.groupBy("graph_id").applyInPandas(whole, "graph_id long, node_id long, rw_betweenness_centrality double")


def mwua(g: GraphSet, max_iter: int = 200, tol: float | None = 1e-5) -> DataFrame:
    return per_node(g, lambda x: ct.mwua(x, max_iter, tol), ["mwua_avg_x", "mwua_avg_w", "mwua_min_w", "mwua_max_w"])


def mis_frequency(g: GraphSet, runs: int = 20, seed: int = 0) -> DataFrame:
    return per_node(g, {"mis_freq": lambda x: ct.mis_frequency(x, runs, seed)})


def hops(g: GraphSet, max_hops: int | None = None) -> DataFrame:
    """(graph_id, source, node_id, hops) of all pairs in reach, by rounds of joins over the newest pairs."""
    links = g.adj.toDF("graph_id", "node_id", "next")
    known = new = g.nodes.select("graph_id", F.col("node_id").alias("source"), "node_id", F.lit(0).cast("long").alias("hops"))
    k = 0
    while max_hops is None or k < max_hops:
        k += 1
        out = new.join(links, KEY).select("graph_id", "source", F.col("next").alias("node_id")).distinct()
        new = checkpointed(out.join(known, ["graph_id", "source", "node_id"], "left_anti").withColumn("hops", F.lit(k).cast("long")))
        if new.isEmpty():
            break
        known = checkpointed(known.union(new))
    return known


def hop_counts(g: GraphSet) -> DataFrame:
    """(graph_id, hops, n_pairs): how many rows of hops() each graph has by hops, counted graph by graph without listing pairs."""

    def work(x: Local) -> pd.DataFrame:
        n = ct.hop_counts(x)
        return pd.DataFrame({"graph_id": np.full(len(n), x.graph_id), "hops": np.arange(len(n)), "n_pairs": n})

    return per_graph(g, work, "graph_id long, hops long, n_pairs long")


def components(g: GraphSet, max_rounds: int = 100) -> DataFrame:
    """(graph_id, node_id, component): the smallest node in reach, by spreading minima and doubling jumps."""
    links = checkpointed(g.adj)
    x = checkpointed(g.nodes.select(*KEY, F.col("node_id").alias("c")))
    for _ in range(max_rounds):
        near = links.join(x.toDF("graph_id", "u", "cu"), ["graph_id", "u"]).groupBy("graph_id", F.col("v").alias("node_id")).agg(F.min("cu").alias("cu"))
        low = x.join(near, KEY, "left").select(*KEY, F.col("c").alias("was"), F.least("c", F.coalesce("cu", "c")).alias("c"))
        jump = low.select("graph_id", F.col("node_id").alias("c"), F.col("c").alias("far"))
        new = checkpointed(low.join(jump, ["graph_id", "c"]).select(*KEY, "was", F.least("c", "far").alias("c")))
        x = new.select(*KEY, "c")
        if not new.filter("c <> was").limit(1).count():
            return x.select(*KEY, F.col("c").alias("component"))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def largest_component(g: GraphSet, min_nodes: int = 5) -> GraphSet:
    """Each graph's largest component (the one with the smallest node at ties), renumbered; graphs below min_nodes go."""
    c = components(g)
    sizes = c.groupBy("graph_id", "component").agg(F.count("*").alias("k"))
    best = sizes.withColumn("r", F.row_number().over(W.partitionBy("graph_id").orderBy(F.col("k").desc(), "component"))).filter((F.col("r") == 1) & (F.col("k") >= min_nodes))
    inside = c.join(best, ["graph_id", "component"], "left_semi").withColumn("new", (F.row_number().over(W.partitionBy("graph_id").orderBy("node_id")) - 1).cast("long"))
    nodes = g.nodes.join(inside, KEY).select("graph_id", F.col("new").alias("node_id"), "label")
    e = g.edges.join(inside.select("graph_id", F.col("node_id").alias("src"), F.col("new").alias("s")), ["graph_id", "src"]).join(inside.select("graph_id", F.col("node_id").alias("dst"), F.col("new").alias("t")), ["graph_id", "dst"])
    return GraphSet(nodes, e.select("graph_id", F.col("s").alias("src"), F.col("t").alias("dst")))
