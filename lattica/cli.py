"""Command lines: train, infer, run-all, generate, label, catalogue, convert, aggregate.

    python -m lattica.cli train --datasets erdos,synthetic:small --data data --output-dir results
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import functions as F

from lattica.operators import corpus, experiments, pruning, solvers, statistics
from lattica.operators.learning import NodeClassifier
from lattica.plans import pipelines
from lattica.plans.features import SETS, FeaturePipeline
from lattica.session import get_spark
from lattica.sources import catalogue, files


def _sizes(p: argparse.ArgumentParser, low: int = 5, high: int = 500) -> None:
    p.add_argument("--max-graphs", type=int, default=500)
    p.add_argument("--min-nodes", type=int, default=low)
    p.add_argument("--max-nodes", type=int, default=high)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lattica")
    top.add_argument("--master", default="local[8]")
    top.add_argument("--data", default="data", help="folder with erdos/, synthetic/, pace/, tudataset/, realworld/")
    sub = top.add_subparsers(dest="command", required=True)

    t = sub.add_parser("train")
    t.add_argument("--datasets", default="erdos")
    _sizes(t)
    t.add_argument("--ego-hops", type=int, default=2)
    t.add_argument("--prune-threshold", type=float, default=pruning.THRESHOLD)
    t.add_argument("--fix-threshold", type=float, default=pruning.NO_FIX)
    t.add_argument("--output-dir", default="results")
    t.add_argument("--feature-set", choices=SETS, default="kernel")
    for k in ("vsko", "gdv", "rw"):
        t.add_argument(f"--no-{k}", action="store_true")
    t.add_argument("--cv-only", action="store_true")
    t.add_argument("--skip-cv", action="store_true")
    t.add_argument("--pruner", choices=("ml", "structural", "greedy", "none"), default="ml")
    t.add_argument("--solver-backend", choices=("ilp", "approx"), default="ilp")
    t.add_argument("--max-branches", type=int, default=20_000, help="the exact solver's bound, in place of seconds")
    t.add_argument("--ilp-solver", choices=solvers.ILP_SOLVERS, default="auto")
    t.add_argument("--eval-min-nodes", type=int, default=0)
    t.add_argument("--seed", type=int, default=42)

    i = sub.add_parser("infer")
    i.add_argument("--graph-file")
    i.add_argument("--model", required=True)
    i.add_argument("--prune-threshold", type=float, default=pruning.THRESHOLD)
    i.add_argument("--solver-backend", choices=("ilp", "approx"), default="ilp")
    i.add_argument("--ego-hops", type=int, default=2)
    i.add_argument("--demo", action="store_true")
    i.add_argument("--output-json")

    r = sub.add_parser("run-all")
    r.add_argument("--group")
    r.add_argument("--skip-large", action="store_true")
    r.add_argument("--skip-realworld", action="store_true")
    r.add_argument("--dry-run", action="store_true")
    r.add_argument("--seeds", type=int, nargs="*")
    r.add_argument("--output-dir", default="results")

    g = sub.add_parser("generate")
    g.add_argument("--split", choices=tuple(catalogue.SPLITS), default="small")
    g.add_argument("--families", nargs="*", default=list(catalogue.FAMILIES))
    g.add_argument("--n-per-family", type=int)
    g.add_argument("--seed", type=int, default=42)
    g.add_argument("--out", required=True)

    u = sub.add_parser("label-tu")
    u.add_argument("--dataset", required=True)
    _sizes(u)
    u.add_argument("--out", required=True)

    c = sub.add_parser("catalogue")
    c.add_argument("--dataset", nargs="*")
    c.add_argument("--out", required=True)

    e = sub.add_parser("convert")
    e.add_argument("--rows", required=True, help="JSON lines with task, nodes, edges, answer, source_file")
    e.add_argument("--min-nodes", type=int, default=0)
    e.add_argument("--max-nodes", type=int, default=10**9)
    e.add_argument("--max-examples", type=int)
    e.add_argument("--out", required=True)

    a = sub.add_parser("aggregate")
    a.add_argument("--results-dir", default="results")
    a.add_argument("--pattern", default="*")
    a.add_argument("--out")
    return top


def train(spark, args) -> str:
    """One run into its own folder; returns its path."""
    g, ids = files.load(spark, args.data, args.datasets.split(","), min_nodes=args.min_nodes, max_nodes=args.max_nodes, max_graphs=args.max_graphs)
    g = g.cached()
    corpus.summary_table(corpus.per_graph_stats(g).join(ids, "graph_id")).orderBy("dataset").show(truncate=False)
    row = spark.createDataFrame([(args.datasets, args.pruner, args.ilp_solver, args.feature_set, args.prune_threshold, args.fix_threshold, args.no_vsko, args.no_gdv, args.no_rw, args.seed)], "datasets string, pruner string, ilp_solver string, feature_set string, prune_threshold double, fix_threshold double, no_vsko boolean, no_gdv boolean, no_rw boolean, seed int")
    out = f"{args.output_dir}/{row.select(experiments.stamped(experiments.run_tag()).alias('t')).first().t}"
    features = FeaturePipeline(args.feature_set, args.ego_hops, not args.no_vsko, not args.no_gdv, not args.no_rw) if args.pruner == "ml" else None
    if args.cv_only:
        found = NodeClassifier(random_state=args.seed).cross_validate(features.extract(g).cache())
        spark.createDataFrame([(json.dumps(found),)], "value string").coalesce(1).write.text(f"{out}/cv_results")
        return out
    solver = solvers.Solver("exact" if args.solver_backend == "ilp" else "approx", args.max_branches, True, args.ilp_solver)
    results, model = pipelines.train(g, ids.select("graph_id", "dataset"), features, None, args.prune_threshold, args.fix_threshold, args.pruner, solver, args.eval_min_nodes, args.skip_cv, args.seed)
    results = results.cache()
    files.write_results(results, f"{out}/pipeline_results.csv")
    if model is not None:
        model.save(f"{out}/model")
        model.importance().coalesce(1).write.option("header", True).csv(f"{out}/feature_importance.csv")
        model.importance().show(10, truncate=False)
    from lattica.operators import evaluation

    evaluation.by_source(results).show(truncate=False)
    evaluation.summary(results).show(truncate=False)
    return out


def infer(spark, args) -> None:
    if args.demo:
        g = catalogue.hashed_erdos_renyi(spark, 1, 30, 0.15)
    elif args.graph_file:
        g = files.read_graph(spark, args.graph_file)
    else:
        raise SystemExit("--graph-file or --demo is needed")
    model = NodeClassifier.load(spark, args.model)
    # the model's own columns say which families it needs
    own = set(model.names)
    names = next(s for s in SETS if own <= set(FeaturePipeline(s).names()))
    features = FeaturePipeline(names, args.ego_hops, any(n.startswith("vsko") for n in own), any(n.startswith("gdv") for n in own), any(n.startswith("rw_") for n in own))
    out = pipelines.infer(g.cached(), model, features, args.prune_threshold, solvers.Solver("exact" if args.solver_backend == "ilp" else "approx")).select("json")
    if args.output_json:
        out.coalesce(1).write.mode("overwrite").text(args.output_json)
    else:
        for r in out.toLocalIterator():
            print(r.json)


def run_all(spark, args) -> None:
    runs = experiments.grid(spark, args.group, args.skip_large, args.skip_realworld, tuple(args.seeds) if args.seeds else None)
    rows = runs.withColumn("tag", experiments.run_tag()).orderBy("config_id", "seed").collect()  # some hundred rows
    for r in rows:
        print(r.tag)
        if not args.dry_run:
            flags = ["--data", args.data, "train", "--skip-cv", "--datasets", r.datasets, "--output-dir", args.output_dir, "--seed", str(r.seed)]
            for k in ("pruner", "ilp_solver", "feature_set", "prune_threshold", "fix_threshold", "eval_min_nodes", "max_graphs"):
                flags += [f"--{k.replace('_', '-')}", str(r[k])]
            train(spark, parser().parse_args(flags + [f"--no-{k}" for k in ("vsko", "gdv", "rw") if r[f"no_{k}"]]))


def aggregate(spark, args) -> None:
    table = statistics.compare_configs(files.read_results(spark, args.results_dir, args.pattern)).cache()
    print(statistics.format_table(table))
    if args.out:
        table.coalesce(1).write.mode("overwrite").option("header", True).csv(args.out)


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = get_spark("lattica", args.master)
    if args.command == "train":
        print(train(spark, args))
    elif args.command in ("infer", "run-all", "aggregate"):
        {"infer": infer, "run-all": run_all, "aggregate": aggregate}[args.command](spark, args)
    elif args.command == "generate":
        how = {"families": tuple(args.families), "seed": args.seed} | ({"n_graphs": args.n_per_family} if args.n_per_family else {})
        catalogue.generate_split(spark, args.split, **how).write.mode("overwrite").json(args.out)
    elif args.command == "label-tu":
        g = files.read_tu(spark, f"{args.data}/tudataset", args.dataset)
        kept = corpus.size_filter(corpus.per_graph_stats(g), args.min_nodes, args.max_nodes, args.max_graphs)
        g = pipelines.subset(g, kept)
        tag = g.nodes.select("graph_id").distinct().withColumn("source", F.lit(f"tudataset:{args.dataset}"))
        files.write_records(solvers.labelled(g, solvers.Solver().solve(g)), args.out, tag)
    elif args.command == "catalogue":
        g, table = catalogue.labelled_catalogue(spark, args.dataset or None)
        files.write_records(g, args.out, table.select("graph_id", F.col("dataset").alias("source")))
        table.show(100, truncate=False)
    elif args.command == "convert":
        rows = spark.read.schema("task string, nodes string, edges string, answer string, source_file string").json(args.rows).withColumn("id", F.monotonically_increasing_id())
        files.convert_encoded(rows, args.min_nodes, args.max_nodes, args.max_examples).write.mode("overwrite").json(args.out)


if __name__ == "__main__":
    main()
