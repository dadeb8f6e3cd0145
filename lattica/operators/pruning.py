"""Pruning by confidence, cover reconstruction and its check: windows and anti-joins, no loops.

All candidates of force_neighbor go in order of score until the graph is down to min_remaining nodes;
keep_node's test (all neighbours locked in) does not depend on what went before, so both are one rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lattica.functions.covers import greedy_scores as _greedy
from lattica.graphs import KEY, GraphSet, per_node
from lattica.operators.iterative import core_numbers
from lattica.operators.local import degree, neighbour, ratio, with_triangles, zero

THRESHOLD, NO_FIX, MIN_REMAINING = 0.10, 1.1, 2


def prune(g: GraphSet, probs: DataFrame, threshold: float = THRESHOLD, fix_threshold: float = NO_FIX, repair_strategy: str = "force_neighbor", min_remaining_nodes: int = MIN_REMAINING) -> DataFrame:
    """(graph_id, node_id, prob, forced_high, removed, forced), flags as 0 and 1; nodes without a score have 0.5.

    At or above fix_threshold (if it is at most 1) a node is locked into the cover; below threshold it may
    go; the neighbours of what goes are forced.
    """
    if repair_strategy not in ("force_neighbor", "keep_node"):
        raise ValueError(f"unknown repair strategy {repair_strategy!r}")
    p = F.coalesce("prob", F.lit(0.5))
    fix = (p >= fix_threshold) if fix_threshold <= 1.0 else F.lit(False)
    s = g.nodes.select(*KEY).join(probs.select(*KEY, "prob"), KEY, "left").select(*KEY, p.alias("prob"), fix.cast("int").alias("forced_high"), F.count("*").over(W.partitionBy("graph_id")).alias("n"))
    candidates = s.filter((F.col("prob") < threshold) & (F.col("forced_high") == 0))
    if repair_strategy == "keep_node":
        open_ends = g.adj.join(s.filter("forced_high = 0").select("graph_id", F.col("node_id").alias("u")), ["graph_id", "u"], "left_semi").select("graph_id", F.col("v").alias("node_id")).distinct()
        candidates = candidates.join(open_ends, KEY, "left_anti")
    rank = F.row_number().over(W.partitionBy("graph_id").orderBy("prob", "node_id"))
    removed = candidates.withColumn("k", rank).filter(F.col("k") <= F.greatest(F.lit(0), F.col("n") - min_remaining_nodes)).select(*KEY, F.lit(1).alias("removed"))
    pulled = g.adj.join(removed.select("graph_id", F.col("node_id").alias("u")), ["graph_id", "u"], "left_semi").select("graph_id", F.col("v").alias("node_id"), F.lit(1).alias("pulled")).distinct()
    forced = (F.col("forced_high") == 1) | (F.col("removed").isNull() & F.col("pulled").isNotNull())
    return s.join(removed, KEY, "left").join(pulled, KEY, "left").select(*KEY, "prob", "forced_high", F.coalesce("removed", F.lit(0)).alias("removed"), forced.cast("int").alias("forced"))


def prune_with_arrays(g: GraphSet, arrays: DataFrame, **how) -> DataFrame:
    """prune() for (graph_id, probs): one array per graph, in the order of node ids; a wrong length is an error."""
    own = g.nodes.select(*KEY, (F.row_number().over(W.partitionBy("graph_id").orderBy("node_id")) - 1).alias("i"), F.count("*").over(W.partitionBy("graph_id")).alias("n"))
    fits = F.when(F.size("probs") == F.col("n"), F.get("probs", F.col("i"))).otherwise(F.raise_error(F.lit("an array's length is not its graph's number of nodes")).cast("double"))
    return prune(g, own.join(arrays, "graph_id").select(*KEY, fits.alias("prob")), **how)


def reduced(g: GraphSet, status: DataFrame) -> GraphSet:
    """What is left to solve: nodes neither removed nor locked (those forced by repair stay), and edges among them."""
    kept = status.filter("removed = 0 and forced_high = 0").select(*KEY)
    e = g.edges
    for end in ("src", "dst"):
        e = e.join(kept.withColumnRenamed("node_id", end), ["graph_id", end], "left_semi")
    return GraphSet(g.nodes.join(kept, KEY, "left_semi").select(*KEY, "label"), e.select("graph_id", "src", "dst"))


def sizes(g: GraphSet, n: str = "n_nodes", m: str = "n_edges") -> DataFrame:
    own = g.nodes.groupBy("graph_id").agg(F.count("*").alias(n))
    return own.join(g.edges.groupBy("graph_id").agg(F.count("*").alias(m)), "graph_id", "left").select("graph_id", n, F.coalesce(m, F.lit(0)).alias(m))


def reduction(g: GraphSet, status: DataFrame) -> DataFrame:
    """Per graph: sizes before and after, ratios, counts of removed, locked and forced nodes.

    node_reduction counts removed nodes alone; node_ratio also what was locked.
    """
    after = sizes(reduced(g, status), "n_nodes_reduced", "n_edges_reduced")
    flags = status.groupBy("graph_id").agg(*(F.sum(c).alias(f"n_{c}") for c in ("removed", "forced_high", "forced")))
    out = sizes(g).join(after, "graph_id", "left").join(flags, "graph_id", "left")
    gone = lambda now, was: 1 - F.coalesce(now, F.lit(0)) / F.greatest(was, F.lit(1))
    return out.select(
        "graph_id", "n_nodes", "n_edges", F.coalesce("n_nodes_reduced", F.lit(0)).alias("n_nodes_reduced"), F.coalesce("n_edges_reduced", F.lit(0)).alias("n_edges_reduced"), "n_removed", "n_forced_high", "n_forced",
        gone(F.col("n_nodes_reduced"), F.col("n_nodes")).alias("node_ratio"), gone(F.col("n_edges_reduced"), F.col("n_edges")).alias("edge_reduction"), (F.col("n_removed") / F.greatest("n_nodes", F.lit(1))).alias("node_reduction"),
    )


def uncovered(g: GraphSet, cover: DataFrame) -> DataFrame:
    """Edges without an end in cover(graph_id, node_id)."""
    e = g.edges
    for end in ("src", "dst"):
        e = e.join(cover.select("graph_id", F.col("node_id").alias(end)), ["graph_id", end], "left_anti")
    return e.select("graph_id", "src", "dst")


def reconstruct(status: DataFrame, solved: DataFrame, g: GraphSet | None = None) -> DataFrame:
    """(graph_id, node_id, repaired): forced nodes and the solver's; with g also the smaller end of each edge still open."""
    base = status.filter("forced = 1").select(*KEY).union(solved.select(*KEY)).distinct()
    if g is None:
        return base.withColumn("repaired", F.lit(0))
    fix = uncovered(g, base).select("graph_id", F.col("src").alias("node_id")).distinct()
    return base.withColumn("repaired", F.lit(0)).union(fix.withColumn("repaired", F.lit(1)))


def verify(g: GraphSet, cover: DataFrame) -> DataFrame:
    """(graph_id, uncovered_edges, cover_valid) for every graph."""
    bad = uncovered(g, cover).groupBy("graph_id").agg(F.count("*").alias("k"))
    return g.nodes.select("graph_id").distinct().join(bad, "graph_id", "left").select("graph_id", F.coalesce("k", F.lit(0)).alias("uncovered_edges"), F.col("k").isNull().alias("cover_valid"))


def minmax(col: str) -> Column:
    """A column from 0 to 1 within its graph; 0 where it is constant."""
    own = W.partitionBy("graph_id")
    return ratio(F.col(col) - F.min(col).over(own), F.max(col).over(own) - F.min(col).over(own))


#: Fixed weights of the structural score.
WEIGHTS = {"d": 73.0, "t": 41.0, "t2": 24.6, "least": 20.5, "ends": 11.4, "core": 9.9, "mean": 7.7}


def structural_scores(g: GraphSet) -> DataFrame:
    """(graph_id, node_id, prob): a weighted mean of scaled local features, no training."""
    d = degree(g)
    near = neighbour(g, d.select(*KEY, "d"), [F.avg("d").alias("mean"), F.min("d").alias("least"), F.sum(1 / F.col("d")).alias("inv"), F.sum(F.col("d") - 1).alias("ends")])
    x = with_triangles(g, d).join(near, KEY, "left").join(core_numbers(g).withColumnRenamed("rw_core_number", "core"), KEY)
    x = x.select(*KEY, "d", "t", "core", ratio(F.coalesce("inv", zero()), F.col("d")).alias("t2"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("least", "ends", "mean")))
    score = sum((w * minmax(c) for c, w in WEIGHTS.items()), zero()) / sum(WEIGHTS.values())
    return x.select(*KEY, score.alias("prob"))


def greedy_scores(g: GraphSet) -> DataFrame:
    return per_node(g, {"prob": _greedy})


def structural_pruner(g: GraphSet, threshold: float = THRESHOLD) -> DataFrame:
    return prune(g, structural_scores(g), threshold)


def greedy_pruner(g: GraphSet, threshold: float = THRESHOLD, fix_threshold: float = NO_FIX) -> DataFrame:
    return prune(g, greedy_scores(g), threshold, fix_threshold)


def no_pruner(g: GraphSet) -> DataFrame:
    """The identity: every score 0.5, nothing removed or locked."""
    return g.nodes.select(*KEY, F.lit(0.5).alias("prob"), *(F.lit(0).alias(c) for c in ("forced_high", "removed", "forced")))


def degree_scores(g: GraphSet) -> DataFrame:
    """(graph_id, node_id, prob): a node's degree over its graph's largest."""
    d = degree(g)
    return d.select(*KEY, ratio(F.col("d"), F.max("d").over(W.partitionBy("graph_id"))).alias("prob"))
