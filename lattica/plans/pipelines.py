"""End to end: train, prune, solve, reconstruct, evaluate, infer. One plan for all graphs of a corpus.

The solver is the only step in Python; features, scores, pruning, repair and metrics are joins and
aggregates. Times are measured inside the solver for each graph; the pruning's share is its wall time
divided among the graphs.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.graphs import KEY, GraphSet
from lattica.operators import corpus, evaluation, pruning, solvers
from lattica.operators.iterative import checkpointed
from lattica.operators.learning import NodeClassifier
from lattica.plans.features import FeaturePipeline


def evaluate(g: GraphSet, status: DataFrame, sources: DataFrame | None = None, solver: solvers.Solver | None = None, baseline: solvers.Solver | None = None, threshold: float = 0.5, scored: bool = False, feature_seconds: float = 0.0) -> DataFrame:
    """One row per graph with evaluation.RESULT_COLUMNS; status as pruning.prune gives it; sources(graph_id, source)."""
    solver, baseline = solver or solvers.Solver(), baseline or solvers.Solver()
    g = GraphSet(checkpointed(g.nodes), checkpointed(g.edges))  # read by every step below
    began = time.perf_counter()
    status = checkpointed(status)
    n_graphs = max(g.nodes.select("graph_id").distinct().count(), 1)
    prune_seconds = (time.perf_counter() - began) / n_graphs
    left = pruning.reduced(g, status)
    solved, whole = checkpointed(solver.solve(left)), checkpointed(baseline.solve(g))
    cover = pruning.reconstruct(status, solvers.members(solved), g)
    sizes = cover.groupBy("graph_id").agg(F.count("*").alias("pipeline_cover_size"))
    out = pruning.reduction(g, status).join(sizes, "graph_id", "left").join(pruning.verify(g, cover).select("graph_id", "cover_valid"), "graph_id")
    out = out.join(solved.select("graph_id", F.col("runtime_s").alias("r")), "graph_id", "left").join(whole.select("graph_id", F.col("size").alias("baseline_cover_size"), F.col("runtime_s").alias("baseline_runtime")), "graph_id")
    out = out.withColumns({"pipeline_cover_size": F.coalesce("pipeline_cover_size", F.lit(0)), "pipeline_runtime": F.coalesce("r", F.lit(0.0)) + prune_seconds, "feature_extraction_time": F.lit(feature_seconds / n_graphs)})
    if scored:
        labels = g.nodes.select(*KEY, F.coalesce("label", F.lit(-1)).alias("label"))
        out = out.join(evaluation.classification(status.join(labels, KEY), ["graph_id"], threshold), "graph_id", "left")
    else:
        out = out.withColumns({c: F.lit(None).cast("double") for c in ("clf_f1", "clf_auc", "clf_precision", "clf_recall")})
    out = out.join(sources, "graph_id", "left") if sources is not None else out.withColumn("source", F.lit("unknown"))
    return evaluation.quality(out).select(*evaluation.RESULT_COLUMNS)


def pruner(name: str, threshold: float = pruning.THRESHOLD, fix_threshold: float = pruning.NO_FIX) -> Callable[[GraphSet], DataFrame]:
    """A pruner without a model: structural, greedy or none."""
    return {"structural": lambda g: pruning.structural_pruner(g, threshold), "greedy": lambda g: pruning.greedy_pruner(g, threshold, fix_threshold), "none": pruning.no_pruner}[name]


def subset(g: GraphSet, ids: DataFrame) -> GraphSet:
    """The graphs of ids(graph_id)."""
    own = ids.select("graph_id")
    return GraphSet(g.nodes.join(own, "graph_id", "left_semi"), g.edges.join(own, "graph_id", "left_semi"))


def train(g: GraphSet, dataset: DataFrame, features: FeaturePipeline | None = None, classifier: NodeClassifier | None = None, prune_threshold: float = 0.10, fix_threshold: float = 1.1, pruner_name: str = "ml", solver: solvers.Solver | None = None, eval_min_nodes: int = 0, skip_cv: bool = True, seed: int = 42) -> tuple[DataFrame, NodeClassifier | None]:
    """Split by dataset(graph_id, dataset), fit on the training graphs, run the pruner on the first 50 others; (results, model)."""
    parts = checkpointed(corpus.split(dataset, seed=seed))
    tested = corpus.evaluation_subset(corpus.per_graph_stats(subset(g, parts.filter("is_train = 0"))), 50, eval_min_nodes)
    test, sources = subset(g, tested), dataset.select("graph_id", F.col("dataset").alias("source"))
    if pruner_name != "ml":
        return evaluate(test, pruner(pruner_name, prune_threshold, fix_threshold)(test), sources, solver), None
    began = time.perf_counter()
    x = checkpointed((features or FeaturePipeline()).extract(g))
    seconds = time.perf_counter() - began
    own = classifier or NodeClassifier(random_state=seed)
    train_rows = x.join(parts.filter("is_train = 1").select("graph_id"), "graph_id", "left_semi")
    if not skip_cv:
        own.cross_validate(train_rows)
    own.fit(train_rows)
    probs = own.predict_proba(x.join(tested.select("graph_id"), "graph_id", "left_semi"))
    status = pruning.prune(test, probs, prune_threshold, fix_threshold)
    return evaluate(test, status, sources, solver, threshold=own.threshold or 0.5, scored=True, feature_seconds=seconds), own


def infer(g: GraphSet, model: NodeClassifier, features: FeaturePipeline | None = None, prune_threshold: float = 0.10, solver: solvers.Solver | None = None) -> DataFrame:
    """One row per graph: probabilities, cover, pruning and solution, and the same as JSON. Covers are always repaired."""
    probs = checkpointed(model.predict_proba((features or FeaturePipeline()).extract(g)))
    status = checkpointed(pruning.prune(g, probs, prune_threshold))
    results = evaluate(g, status, None, solver)
    solved = checkpointed((solver or solvers.Solver()).solve(pruning.reduced(g, status)))
    cover = pruning.reconstruct(status, solvers.members(solved), g)
    lists = cover.groupBy("graph_id").agg(F.sort_array(F.collect_list("node_id")).alias("predicted_cover"), F.sum("repaired").alias("repaired_edges"))
    scores = probs.groupBy("graph_id").agg(F.sort_array(F.collect_list(F.struct("node_id", "prob"))).alias("node_probabilities"))
    kinds = solved.select("graph_id", "backend", "is_optimal", "lp_bound")
    out = results.drop("source").join(lists, "graph_id", "left").join(scores, "graph_id", "left").join(kinds, "graph_id", "left")
    return out.withColumn("json", F.to_json(F.struct(*out.columns)))


def queries() -> dict:
    from lattica.operators import local
    from lattica.sources import tables

    fixed = ("graph_id", "n_nodes", "n_edges", "n_nodes_reduced", "n_edges_reduced", "pipeline_cover_size", "baseline_cover_size", "optimality_gap", "cover_valid", "node_reduction", "edge_reduction", "n_forced")

    def run(name):
        def query(spark: SparkSession, d: str) -> DataFrame:
            g = tables.suppliers(spark, d)
            g = GraphSet(checkpointed(g.nodes), checkpointed(g.edges))
            return evaluate(g, pruner(name)(g)).select(*fixed)

        return query

    def ml(spark: SparkSession, d: str) -> DataFrame:
        g = tables.parts(spark, d)
        g = solvers.labelled(g, solvers.Solver("approx").solve(g))
        g = GraphSet(checkpointed(g.nodes), checkpointed(g.edges))
        x = local.degree_features(g).join(local.clustering(g), KEY).join(pruning.structural_scores(g), KEY).join(g.nodes, KEY)
        model = NodeClassifier(n_estimators=10, max_depth=3).fit(x)
        status = pruning.prune(g, model.predict_proba(x), 0.1, 0.9)
        return evaluate(g, status, None, solvers.Solver("approx"), solvers.Solver("approx"), model.threshold, True).select(*fixed, "clf_f1", "clf_auc")

    return {"pipeline_structural": run("structural"), "pipeline_greedy": run("greedy"), "pipeline_none": run("none"), "ml_prune_pipeline": ml}


def oracle_sql() -> dict[str, str]:
    return {}
