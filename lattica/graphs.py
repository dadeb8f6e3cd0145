"""A corpus of undirected graphs as DataFrames, and work that goes graph by graph.

nodes(graph_id, node_id, label) holds every node, isolated ones too; edges(graph_id, src, dst) holds each
edge once with src < dst. Everything is keyed by graph_id, so one plan serves all graphs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.session import ship

KEY = ["graph_id", "node_id"]


@dataclass(frozen=True)
class GraphSet:
    nodes: DataFrame
    edges: DataFrame

    @property
    def adj(self) -> DataFrame:
        """(graph_id, v, u): every edge from both ends, in one pass over the edges."""
        ends = F.array(F.struct(F.col("src").alias("v"), F.col("dst").alias("u")), F.struct(F.col("dst").alias("v"), F.col("src").alias("u")))
        return self.edges.select("graph_id", F.inline(ends))

    @property
    def spark(self):
        return self.nodes.sparkSession

    def cached(self) -> GraphSet:
        return GraphSet(self.nodes.cache(), self.edges.cache())


def canonical(nodes: DataFrame, pairs: DataFrame) -> GraphSet:
    """Simple undirected graphs from any (graph_id, u, v) pairs: no loops, no end outside nodes, each edge once."""
    lo, hi = F.least("u", "v").cast("long").alias("src"), F.greatest("u", "v").cast("long").alias("dst")
    e = pairs.filter("u <> v").select("graph_id", lo, hi).distinct()
    known = nodes.select("graph_id", "node_id")
    for end in ("src", "dst"):
        e = e.join(known.withColumnRenamed("node_id", end), ["graph_id", end], "left_semi")
    return GraphSet(nodes, e.select("graph_id", "src", "dst"))


@dataclass
class Local:
    """One graph inside a task: ids in ascending order, edges as positions in them, src before dst."""

    graph_id: int
    ids: np.ndarray
    src: np.ndarray
    dst: np.ndarray
    labels: np.ndarray | None = None

    @property
    def n(self) -> int:
        return len(self.ids)

    def neighbours(self) -> list[list[int]]:
        out: list[list[int]] = [[] for _ in range(self.n)]
        for a, b in zip(self.src.tolist(), self.dst.tolist(), strict=True):
            out[a].append(b)
            out[b].append(a)
        return out


#: Rows that a task hands on together; a graph's stay together.
ROWS = 2**16


def packed(g: GraphSet, labels: bool = False) -> DataFrame:
    """One row a graph: its sorted node ids, its edges and, if asked for, its labels (null: -1). Graphs must fit in a task; corpora need not."""
    if labels:
        each = F.struct("node_id", F.coalesce("label", F.lit(-1)).alias("label"))
        own = g.nodes.groupBy("graph_id").agg(F.sort_array(F.collect_list(each)).alias("x")).select("graph_id", F.col("x.node_id").alias("ids"), F.col("x.label").alias("labels"))
    else:
        own = g.nodes.groupBy("graph_id").agg(F.sort_array(F.collect_list("node_id")).alias("ids"))
    e = g.edges.groupBy("graph_id").agg(F.sort_array(F.collect_list(F.struct("src", "dst"))).alias("e"))
    return own.join(e, "graph_id", "left").select(*own.columns, F.coalesce("e.src", F.array().cast("array<bigint>")).alias("src"), F.coalesce("e.dst", F.array().cast("array<bigint>")).alias("dst"))


def per_graph(g: GraphSet, work: Callable[..., pd.DataFrame], schema: str | T.StructType, labels: bool = False, parts: Column | None = None) -> DataFrame:
    """work on every graph of the corpus, many graphs a task, in Arrow batches.

    parts: how many tasks a graph's work is for, from the arrays ids, src and dst; work then gets its part and the parts too.
    """
    ship(g.spark)
    split = parts is not None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[pd.DataFrame] = []
        rows = 0
        for batch in batches:
            for r in batch.itertuples(index=False):
                ids = np.asarray(r.ids, np.int64)
                src, dst = (np.searchsorted(ids, np.asarray(x, np.int64)) for x in (r.src, r.dst))
                out.append(work(Local(r.graph_id, ids, src, dst, np.asarray(r.labels) if labels else None), *((r.part, r.parts) if split else ())))
                rows += len(out[-1])
                if rows >= ROWS:
                    yield pd.concat(out, ignore_index=True)
                    out, rows = [], 0
        if out:
            yield pd.concat(out, ignore_index=True)

    # a stated number of partitions, since little data may be much work: adaptive execution would merge them. By a hash
    # of the key, since Spark leaves out a shuffle by the key itself that follows another; eight to a core, so few graphs meet
    n = max(8 * g.spark.sparkContext.defaultParallelism, int(g.spark.conf.get("spark.sql.shuffle.partitions")))
    if not split:
        return packed(g, labels).repartition(n, F.xxhash64("graph_id")).mapInPandas(run, schema)
    each = packed(g, labels).withColumn("parts", parts.cast("int")).select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return each.repartition(4 * n, F.xxhash64("graph_id", "part")).mapInPandas(run, schema)


def per_node(g: GraphSet, columns: dict[str, Callable[[Local], np.ndarray]] | Callable[[Local], dict[str, np.ndarray]], names: list[str] | None = None, kind: str = "double") -> DataFrame:
    """(graph_id, node_id, ...): one value per node from functions of the whole graph."""
    names = names or list(columns)

    def work(x: Local) -> pd.DataFrame:
        values = {k: f(x) for k, f in columns.items()} if isinstance(columns, dict) else columns(x)
        return pd.DataFrame({"graph_id": np.full(x.n, x.graph_id), "node_id": x.ids, **{k: values[k] for k in names}})

    return per_graph(g, work, "graph_id long, node_id long, " + ", ".join(f"{k} {kind}" for k in names))
