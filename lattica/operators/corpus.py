"""Corpora as wholes: union, splits, summaries, subsets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lattica.graphs import KEY, GraphSet


def union_all(sets: list[GraphSet], tags: list[str]) -> tuple[GraphSet, DataFrame]:
    """One corpus of several; also (graph_id, dataset, old_id). Empty sources add nothing.

    New ids are old_id * number of sources + source: no two meet, order within a source stays, and no row moves.
    """
    k = len(sets)

    def moved(frames: list[DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionByName, [f.withColumn("graph_id", F.col("graph_id") * k + i) for i, f in enumerate(frames)])

    g = GraphSet(moved([s.nodes.select("graph_id", "node_id", "label") for s in sets]), moved([s.edges.select("graph_id", "src", "dst") for s in sets]))
    ids = reduce(DataFrame.union, [s.nodes.select((F.col("graph_id") * k + i).alias("graph_id"), F.lit(t).alias("dataset"), F.col("graph_id").alias("old_id")).distinct() for i, (s, t) in enumerate(zip(sets, tags, strict=True))])
    return g, ids


def order_key(seed: int, col: str = "graph_id"):
    """A shuffle that both SQL engines can repeat."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(col).cast("string")))


def split(graphs: DataFrame, train_ratio: float = 0.8, seed: int = 42) -> DataFrame:
    """graphs(graph_id, dataset) with is_train: per dataset a shuffle's first max(1, floor(n * ratio))."""
    own = W.partitionBy("dataset")
    k = F.row_number().over(own.orderBy(order_key(seed), "graph_id"))
    return graphs.withColumn("is_train", (k <= F.greatest(F.lit(1), F.floor(F.count("*").over(own) * train_ratio))).cast("int"))


def per_graph_stats(g: GraphSet) -> DataFrame:
    """(graph_id, n_nodes, n_edges, n_positive, n_labelled)"""
    n = g.nodes.groupBy("graph_id").agg(F.count("*").alias("n_nodes"), F.sum((F.coalesce("label", F.lit(0)) == 1).cast("long")).alias("n_positive"), F.count("label").alias("n_labelled"))
    m = g.edges.groupBy("graph_id").agg(F.count("*").alias("n_edges"))
    return n.join(m, "graph_id", "left").select("graph_id", "n_nodes", F.coalesce("n_edges", F.lit(0)).alias("n_edges"), "n_positive", "n_labelled")


def summary_table(stats: DataFrame) -> DataFrame:
    """stats(dataset, n_nodes, n_edges, n_positive) by dataset with a TOTAL row; positives are pooled over nodes."""
    out = stats.rollup("dataset").agg(F.count("*").alias("n_graphs"), F.avg("n_nodes").alias("avg_nodes"), F.avg("n_edges").alias("avg_edges"), (F.sum("n_positive") / F.greatest(F.sum("n_nodes"), F.lit(1))).alias("positive_fraction"), F.grouping("dataset").alias("g"))
    return out.select(F.when(F.col("g") == 1, "TOTAL").otherwise(F.col("dataset")).alias("dataset"), "n_graphs", "avg_nodes", "avg_edges", "positive_fraction")


def graph_summary(stats: DataFrame) -> DataFrame:
    """One row; positives as the mean of each graph's own share. Of no graphs: counts 0, others null."""
    return stats.agg(F.count("*").alias("n_graphs"), F.avg("n_nodes").alias("avg_nodes"), F.avg("n_edges").alias("avg_edges"), F.avg(F.col("n_positive") / F.greatest("n_nodes", F.lit(1))).alias("avg_positive_fraction"), F.min("n_nodes").alias("min_nodes"), F.max("n_nodes").alias("max_nodes"))


def node_labels(g: GraphSet) -> DataFrame:
    """Labels in id order, -1 where there is none."""
    return g.nodes.select(*KEY, F.coalesce("label", F.lit(-1)).alias("label"))


def evaluation_subset(stats: DataFrame, first: int = 50, min_nodes: int = 0) -> DataFrame:
    """The first graphs by id, then those of them with enough nodes."""
    return stats.orderBy("graph_id").limit(first).filter(F.col("n_nodes") >= min_nodes)


def size_filter(stats: DataFrame, min_nodes: int = 5, max_nodes: int | None = 500, max_graphs: int | None = None, by: str | None = None) -> DataFrame:
    """Graphs of min_nodes to max_nodes (both count; None: no upper end), at most max_graphs of each source in id order."""
    out = stats.filter(F.col("n_nodes") >= min_nodes)
    out = out if max_nodes is None else out.filter(F.col("n_nodes") <= max_nodes)
    if max_graphs is None:
        return out
    w = W.partitionBy(*([by] if by else [F.lit(0)])).orderBy("graph_id")
    return out.withColumn("__k", F.row_number().over(w)).filter(F.col("__k") <= max_graphs).drop("__k")


def sample_rows(df: DataFrame, k: int = 200, seed: int = 42) -> DataFrame:
    """At most k rows without replacement, by a hash of the whole row, the same at every run."""
    return df.orderBy(F.xxhash64(F.lit(seed), *df.columns), *df.columns).limit(k)
