"""Operators on small graphs with known values, degenerate inputs, and the invariants of pruning."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lattica.functions import generators as gen
from lattica.graphs import GraphSet, canonical, per_graph
from lattica.operators import corpus, evaluation, experiments, iterative, learning, local, pruning, solvers, statistics
from lattica.plans import features, pipelines
from lattica.sources import catalogue, files, tables


def graphs(spark, *parts, labels=None) -> GraphSet:
    """parts: (edges, number of nodes or list of ids) for graphs 0, 1, ..."""
    nodes = [(g, int(v), None if labels is None else labels(v)) for g, (_, n) in enumerate(parts) for v in (range(n) if isinstance(n, int) else n)]
    pairs = [(g, int(a), int(b)) for g, (e, _) in enumerate(parts) for a, b in e]
    return canonical(spark.createDataFrame(nodes, "graph_id long, node_id long, label int"), spark.createDataFrame(pairs, "graph_id long, u long, v long"))


@pytest.fixture(scope="module")
def g(spark):
    """P4, K5, a star, five isolated nodes, K4 with node 99 apart, two triangles, and one node."""
    two = gen.complete(3) | gen.complete(3, 3)
    return graphs(spark, (gen.path(4), 4), (gen.complete(5), 5), (gen.star(5), 6), ([], 5), (gen.complete(4), [0, 1, 2, 3, 99]), (two, 6), ([], 1)).cached()


def column(df, graph, name):
    return [r[name] for r in df.filter(F.col("graph_id") == graph).orderBy("node_id").collect()]


def test_canonical_drops_loops_repeats_and_strangers(spark):
    x = graphs(spark, ([(0, 0), (1, 0), (0, 1), (2, 7)], 3))
    assert [tuple(r) for r in x.edges.collect()] == [(0, 0, 1)] and x.nodes.count() == 3


def test_local_goldens(g):
    d, o = local.degree_features(g), local.orbit3(g)
    assert column(d, 0, "rw_degree") == [1, 2, 2, 1] and column(d, 3, "rw_degree") == [0] * 5 and column(d, 6, "rw_degree_centrality") == [1.0]
    assert column(o, 0, "orbit_0") == [1] * 4 and column(o, 0, "orbit_1") == [0, 1, 1, 0]
    assert column(o, 1, "orbit_3") == [18] * 5 and column(o, 2, "orbit_1") == [10, 0, 0, 0, 0, 0] and column(o, 2, "orbit_0") == [0] + [4] * 5
    v = local.vsko(g)
    assert column(v, 5, "vsko_sym2_1") == [3] * 6 and column(v, 5, "vsko_sym3") == [1] * 6 and column(v, 2, "vsko_sym2_1") == [1] * 6 and column(v, 3, "vsko_sym3") == [0] * 5
    assert column(local.vsko(g, ego_hops=0), 1, "vsko_sym3") == [0] * 5
    assert column(local.clustering(g), 1, "rw_local_clustering") == [1] * 5
    assert column(local.lauri_local(g), 1, "chi2_degree") == [0] * 5 and column(local.lauri_local(g), 4, "chi2_lcc_nbr")[-1] == 0
    assert column(local.gdv(g), 1, "gdv_orbit_24") == [4] * 5 and len(local.gdv(g).columns) == 75
    five = local.gdv(graphs(g.spark, (gen.complete(5), 5), (gen.path(5), 5)), max_graphlet_size=5)
    assert column(five, 0, "gdv_orbit_46") == column(five, 0, "gdv_orbit_46")[:1] * 5 != [0] * 5 and column(five, 1, "gdv_orbit_28") == [0] * 5
    assert column(local.degree_ranks(g), 1, "degree_rank") == [0] * 5 and column(local.degree_ranks(g), 0, "degree_rank") == [0, 1, 1, 0]
    assert column(local.two_hop(g), 0, "rw_avg_dist_2hop_nbrs") == [2.0] * 4 and column(local.two_hop(g), 1, "rw_avg_dist_2hop_nbrs") == [1.0] * 5


def test_graphlet_tables():
    assert [list(local.graphlet_orbits(i)) for i in (0, 1, 2, 7, 8, 22, 23, 28)] == [[0, 1], [2, 3], [4, 5, 6, 7], [24, 25, 26, 27], [28, 29, 30], [70, 71, 72], [], []]
    assert len(local.SYMMETRIES) == 29 and len(local.SYMMETRY_TYPES) == 13 and len(features.GDV) == 73 and len(features.WALK) == 20


def test_iterative_agree_with_rounds_and_components(g):
    a, b = iterative.core_numbers(g), iterative.core_numbers(g, spread=True)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert column(iterative.components(g), 5, "component") == [0, 0, 0, 3, 3, 3] and column(iterative.components(g), 4, "component") == [0, 0, 0, 0, 99]
    big = iterative.largest_component(g)
    assert {r.graph_id: r.n_nodes for r in pruning.sizes(big).collect()} == {1: 5, 2: 6}
    ecc = iterative.path_features(g)
    assert column(ecc, 5, "rw_eccentricity") == [-1] * 6 and column(ecc, 0, "rw_eccentricity") == [3, 2, 2, 3]
    h = iterative.hops(g)
    assert h.filter("graph_id = 0 and source = 0").orderBy("node_id").select("hops").toPandas().hops.tolist() == [0, 1, 2, 3]


def test_graphs_are_spread_over_tasks(spark):
    h = graphs(spark, *((gen.path(5), 5) for _ in range(40)))
    at = per_graph(h, lambda x: pd.DataFrame({"graph_id": [x.graph_id]}), "graph_id long").select(F.spark_partition_id().alias("p")).collect()
    assert len({r.p for r in at}) > 8  # with the shuffle left out they all met in one or two


def test_hop_counts_list_no_pairs(spark, g):
    pairs = iterative.hops(g).groupBy("graph_id", "hops").agg(F.count("*").alias("n_pairs"))
    counts = iterative.hop_counts(g)
    assert sorted(map(tuple, counts.collect())) == sorted(map(tuple, pairs.collect()))
    plan = entry.queries()["bfs_apsp"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "MapInPandas" in plan and "source" not in plan


def test_rounds_that_do_not_settle_are_an_error(spark):
    nodes = spark.range(12).selectExpr("0L graph_id", "id node_id", "cast(null as int) label")
    path = GraphSet(nodes, spark.range(11).selectExpr("0L graph_id", "id src", "id + 1 dst"))
    with pytest.raises(RuntimeError, match="core numbers did not settle in 3 rounds"):
        iterative.core_numbers(path, spread=True, max_rounds=3)
    assert {r.rw_core_number for r in iterative.core_numbers(path, spread=True).collect()} == {1.0}
    with pytest.raises(RuntimeError, match="components did not settle in 1 rounds"):
        iterative.components(path, 1)


@pytest.mark.parametrize(("name", "n"), [("kernel", 106), ("lauri", 9), ("both", 115), ("ajwani", 13), ("kernel+ajwani", 119)])
def test_feature_sets(name, n):
    assert features.FeaturePipeline(name).n_features == n == len(set(features.FeaturePipeline(name).names()))


def test_kernel_features_are_those_of_the_operators_in_one_pass(spark, g):
    labelled = graphs(spark, ([(0, 1), (1, 2), (0, 2), (2, 3), (3, 4), (1, 4)], [0, 1, 2, 3, 4, 7]), labels=lambda v: None if v == 3 else v % 2)
    for x in (g, labelled):
        got = features.FeaturePipeline().extract(x)
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("MapInPandas") == 1 and plan.count("Join ") <= x.edges._jdf.queryExecution().optimizedPlan().toString().count("Join ") + 1
        wide = got.orderBy("graph_id", "node_id").toPandas()
        own = [local.vsko(x), local.gdv(x), local.degree_features(x), local.return_probability(x), local.clustering(x), local.neighbour_degree_stats(x), iterative.path_features(x), iterative.betweenness(x, 50), iterative.eigenvector(x), iterative.pagerank(x), iterative.core_numbers(x), local.two_hop(x), local.hitting_commute(x)]
        for want in own:
            columns = [c for c in want.columns if c not in ("graph_id", "node_id")]
            assert wide[columns].to_numpy(float) == pytest.approx(want.orderBy("graph_id", "node_id").select(*columns).toPandas().to_numpy(float)), columns
    assert column(got, 0, "label") == [0, 1, 0, -1, 0, 1]
    for some in ({"use_gdv": False}, {"use_rw": False, "ego_hops": 1}, {"use_vsko": False, "use_rw": False}):
        part = features.FeaturePipeline(**some)
        assert part.extract(labelled).columns == ["graph_id", "node_id", *part.names(), "label"]
    both = features.FeaturePipeline("both").extract(labelled)
    assert both.columns == ["graph_id", "node_id", *features.FeaturePipeline("both").names(), "label"] and both.count() == 6


def test_feature_pipeline_choices(g):
    counts = {(v, d, r): features.FeaturePipeline(use_vsko=v, use_gdv=d, use_rw=r).n_features for v, d, r in ((1, 1, 0), (1, 0, 1), (0, 1, 1), (1, 0, 0), (0, 1, 0), (0, 0, 1))}
    assert list(counts.values()) == [86, 33, 93, 13, 73, 20]
    for bad in ({"feature_set": "x"}, {"use_vsko": False, "use_gdv": False, "use_rw": False}):
        with pytest.raises(ValueError, match="feature"):
            features.FeaturePipeline(**bad)
    x = features.FeaturePipeline("lauri").extract(g)
    assert x.columns == ["graph_id", "node_id", *features.LAURI, "label"] and x.count() == g.nodes.count() and x.select("label").distinct().first().label == -1
    s = features.Scaler.fit(x).transform(x)
    row = s.agg(F.avg("degree").alias("m"), F.stddev_pop("degree").alias("s")).first()
    assert row.m == pytest.approx(0) and row.s == pytest.approx(1)


def probs(spark, rows):
    return spark.createDataFrame(rows, "graph_id long, node_id long, prob double")


def test_pruning_rules(spark):
    x = graphs(spark, (gen.path(4), 4))
    p = probs(spark, [(0, 0, 0.02), (0, 1, 0.95), (0, 2, 0.02)])  # node 3 has no score: 0.5
    out = {r.node_id: r for r in pruning.prune(x, p, 0.1).collect()}
    assert {v for v, r in out.items() if r.removed} == {0, 2} and {v for v, r in out.items() if r.forced} == {1, 3} and out[3].prob == 0.5
    two = {r.node_id: r for r in pruning.prune(x, p, 0.1, 0.95).collect()}
    assert two[1].forced_high == 1 and pruning.reduced(x, pruning.prune(x, p, 0.1, 0.95)).nodes.count() == 1
    keep = {r.node_id for r in pruning.prune(x, p, 0.1, 0.95, "keep_node").collect() if r.removed}
    assert keep == {0}  # node 2 has neighbour 3, which is not locked
    low = pruning.prune(x, probs(spark, [(0, i, 0.01) for i in range(4)]))
    assert low.filter("removed = 1").count() == 2  # two nodes stay
    with pytest.raises(ValueError, match="repair"):
        pruning.prune(x, p, repair_strategy="other")
    arrays = spark.createDataFrame([(0, [0.02, 0.95, 0.02, 0.5])], "graph_id long, probs array<double>")
    assert pruning.prune_with_arrays(x, arrays, threshold=0.1).filter("removed = 1").count() == 2
    with pytest.raises(Exception, match="length"):
        pruning.prune_with_arrays(x, spark.createDataFrame([(0, [0.5])], "graph_id long, probs array<double>")).collect()


def test_repair(spark):
    x = graphs(spark, (gen.path(3), 3))
    status = spark.createDataFrame([(0, 0, 0.5, 0, 0, 0), (0, 1, 0.0, 0, 1, 0), (0, 2, 0.5, 0, 0, 0)], "graph_id long, node_id long, prob double, forced_high int, removed int, forced int")
    none = status.filter("1 = 0").select("graph_id", "node_id")
    assert {r.node_id for r in pruning.reconstruct(status, none, x).collect()} == {0, 1}
    assert pruning.verify(x, pruning.reconstruct(status, none)).first().uncovered_edges == 2


@pytest.mark.parametrize("name", ["structural", "greedy", "none"])
def test_pipelines_give_valid_covers(g, name):
    rows = pipelines.evaluate(g, pipelines.pruner(name, 0.4)(g)).collect()
    assert len(rows) == 7 and all(r.cover_valid for r in rows) and list(rows[0].asDict()) == list(evaluation.RESULT_COLUMNS)
    assert all(r.pipeline_cover_size >= r.baseline_cover_size for r in rows)
    if name == "none":
        assert all(r.optimality_gap == 0 and r.node_reduction == 0 for r in rows)


def test_solvers(g):
    sizes = {b: {r.graph_id: r["size"] for r in solvers.Solver(b).solve(g).collect()} for b in ("exact", "approx", "matching", "greedy")}
    assert sizes["exact"] == {0: 2, 1: 4, 2: 1, 3: 0, 4: 3, 5: 4, 6: 0}
    for b in ("approx", "matching", "greedy"):
        assert all(sizes["exact"][k] <= v <= 2 * sizes["exact"][k] for k, v in sizes[b].items())
    assert {r.graph_id for r in solvers.bipartite(g).collect() if r.is_bipartite} == {0, 2, 3, 6}
    with pytest.raises(ValueError, match="unknown"):
        solvers.Solver("other")
    with pytest.raises(Exception, match="bipartite"):
        solvers.Solver("konig").solve(g).collect()
    one = solvers.labelled(g, solvers.Solver().solve(g)).nodes
    assert one.filter("label = 1").count() == 14 and one.filter("label is null").count() == 0


def test_corpus(spark, g):
    stats = corpus.per_graph_stats(g).withColumn("dataset", F.lit("a"))
    assert corpus.split(stats.select("graph_id", "dataset")).agg(F.sum("is_train").alias("k")).first().k == 5
    assert corpus.split(stats.filter("graph_id = 0").select("graph_id", "dataset")).first().is_train == 1
    assert corpus.graph_summary(stats.limit(0)).first().n_graphs == 0
    assert {r.graph_id for r in corpus.size_filter(stats, 5, 5).collect()} == {1, 3, 4}
    assert corpus.sample_rows(g.nodes, 3).count() == 3
    both, ids = corpus.union_all([g, g], ["a", "b"])
    assert both.edges.count() == 2 * g.edges.count() and ids.count() == 14


def test_statistics(spark):
    rows = [("up", i % 2, x, 0.1, 0.2, 0.3) for i, x in enumerate([1.5, 2.0, 1.8, 3.0, 2.5, 1.2, 1.9, 4.0, 2.2, 1.6])] + [("flat", 0, 1.0, 0.0, 0.0, 0.0)] * 3 + [("one", 0, 2.0, None, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "config string, run int, speedup double, optimality_gap double, node_reduction double, edge_reduction double")
    out = {r.config: r for r in statistics.summarise_runs(df).collect()}
    assert out["up"].wilcoxon_p == pytest.approx(1 / 1024) and out["up"].wilcoxon_significant and out["up"].n_seeds == 2 and out["up"].pct_above_1 == 100
    assert out["flat"].wilcoxon_p == 1 and out["one"].std_speedup == 0 and out["one"].mean_gap is None
    assert [r.config for r in statistics.compare_configs(df).collect()][0] in ("up", "one") and statistics.compare_configs(df.limit(0)).count() == 0
    ci = {r.config: r for r in statistics.bootstrap_ci(df, ["config"], n_bootstrap=300).collect()}
    assert ci["up"].ci_low <= ci["up"].estimate <= ci["up"].ci_high and ci["flat"].ci_low == 1 == ci["flat"].ci_high
    pair = spark.createDataFrame([(0, "a", x + 1) for x in (1.0, 2.0, 3.0)] + [(0, "b", x) for x in (1.0, 2.0, 3.0)], "k int, grp string, speedup double")
    assert statistics.cohens_d(pair, ["k"], "grp", "a", "b").first().cohens_d == pytest.approx(1.0)
    assert statistics.exact_signed_rank(0, 5) == 1 and statistics.signed_rank_p(None, 0, 0) == 1
    assert "config" in statistics.format_table(statistics.summarise_runs(df))


def test_metrics(spark):
    rows = spark.createDataFrame([(0, 1, 0.9), (0, 0, 0.1), (0, 1, 0.8), (0, 0, 0.2), (1, 1, 0.5), (1, 1, 0.6), (2, 0, 0.5), (2, 1, 0.5)], "graph_id long, label int, prob double")
    out = {r.graph_id: r for r in evaluation.classification(rows, ["graph_id"]).collect()}
    assert out[0].clf_auc == 1 and out[0].clf_f1 == 1 and out[1].clf_auc is None and out[2].clf_auc == 0.5
    best = {r.graph_id: r.threshold for r in evaluation.tune_threshold(rows, ["graph_id"]).collect()}
    assert best == {0: 0.8, 1: 0.5, 2: 0.5}


def test_experiments(spark):
    every = experiments.configurations()
    assert len([c for c in every if c.grp == "ablation"]) == 11 and len(every) == 64
    runs = experiments.grid(spark)
    assert runs.count() == 108
    tags = [r.t for r in runs.filter("grp = 'ablation'").select(experiments.run_tag().alias("t")).collect()]
    assert len(set(tags)) == 55 and any(t.endswith("_vsko-only_ft0.85") for t in tags) and "synthetic-hard_greedy-pruner_ft0.85_s123" in tags
    assert experiments.grid(spark, skip_large=True).filter("datasets like '%large%'").count() == 0
    stamp = spark.range(1).select(experiments.strip_timestamp(experiments.stamped(F.lit("a_b"))).alias("x")).first().x
    assert stamp == "a_b"


def test_model_round_trip_and_training(spark, tmp_path):
    parts = [(gen.barabasi_albert(24, 2, __import__("numpy").random.default_rng(i)), 24) for i in range(10)]
    x = graphs(spark, *parts)
    x = solvers.labelled(x, solvers.Solver().solve(x)).cached()
    data = spark.createDataFrame([(i, "ba") for i in range(10)], "graph_id long, dataset string")
    own = learning.NodeClassifier(n_estimators=5, max_depth=3)
    results, model = pipelines.train(x, data, features.FeaturePipeline("lauri"), own, 0.3, solver=solvers.Solver())
    rows = results.collect()
    assert len(rows) == 2 and all(r.cover_valid and r.source == "ba" and r.clf_f1 is not None for r in rows)
    assert model.importance().count() == 9 and model.importance().first().importance > 0
    model.save(f"file://{tmp_path}/m")
    again = learning.NodeClassifier.load(spark, f"file://{tmp_path}/m")
    feats = features.FeaturePipeline("lauri").extract(x)
    a, b = ({(r.graph_id, r.node_id): r.prob for r in m.predict_proba(feats).collect()} for m in (model, again))
    assert a == b and again.threshold == model.threshold
    assert model.explain(feats, ["degree", "lcc"]).count() == 2
    found = pipelines.infer(x, again, features.FeaturePipeline("lauri")).collect()
    assert len(found) == 10 and all(r.cover_valid and '"predicted_cover"' in r.json for r in found)
    folds = learning.group_folds(feats, 5)
    assert folds.count() == 10 and folds.groupBy("fold").count().select("count").distinct().count() == 1


def test_file_formats(spark, tmp_path):
    def put(name, text):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
        return f"file://{p}"

    def edges(x):
        return sorted(tuple(r) for r in x.edges.collect())

    tri = [(0, 0, 1), (0, 0, 2), (0, 1, 2)]
    assert edges(files.read_graph(spark, put("a.edgelist", "# c\n0 1 {}\n2 1\n0 2\nbad line\n"))) == tri
    adj = files.read_graph(spark, put("a.adjlist", "0 1 2\n1 2\n2\n9\n"))
    assert edges(adj) == tri and adj.nodes.count() == 4
    ml = '<graphml><graph edgedefault="undirected"><node id="0"/><node id="1"/><node id="2"/><edge source="0" target="1"/><edge source="1" target="2"/><edge source="2" target="0"/></graph></graphml>'
    assert edges(files.read_graph(spark, put("a.graphml", ml))) == tri
    gml = "graph [ node [ id 0 label \"a\" ] node [ id 1 ] node [ id 2 ] edge [ source 0 target 1 ] edge [ source 1 target 2 ] edge [ source 0 target 2 ] ]"
    assert edges(files.read_graph(spark, put("a.gml", gml))) == tri
    with pytest.raises(ValueError, match="unknown graph format"):
        files.read_graph(spark, "a.xyz")
    record = '{"n_nodes": 3, "edges": [[0,1],[1,2],[0,2],[1,1],[0,7]], "mvc": [0,1], "source": "t"}'
    root = str(tmp_path)
    put("realworld/tiny.json", f"[{record}, {record.replace('3,', '400,', 1)}]")
    got = files.read_records(spark, f"file://{root}/realworld/*.json", min_nodes=1, max_nodes=10)
    x = files.from_records(got)
    assert edges(x) == tri and sorted((r.node_id, r.label) for r in x.nodes.collect()) == [(0, 1), (1, 1), (2, 0)]
    put("pace/g.gr", "c x\np td 5 2\n1 2\n2 3\n3 9\n"), put("pace/g.sol", "c\ns vc 5 1\n2\n"), put("pace/h.gr", "p td 5 1\n1 2\n")
    pace, names = files.read_pace(spark, f"file://{root}/pace")
    assert edges(pace) == [(0, 0, 1), (0, 1, 2)] and names.count() == 1 and [r.node_id for r in pace.nodes.filter("label = 1").collect()] == [1]
    put("tudataset/T/T_A.txt", "1, 2\n2, 1\n3, 4\n"), put("tudataset/T/T_graph_indicator.txt", "1\n1\n2\n2\n2\n")
    tu = files.read_tu(spark, f"file://{root}/tudataset", "T")
    assert edges(tu) == [(1, 0, 1), (2, 0, 1)] and tu.nodes.count() == 5
    labelled = catalogue.labelled_tu(spark, f"file://{root}/tudataset", "T", 1)
    assert labelled.nodes.filter("label = 1").count() == 2 and edges(catalogue.labelled_tu(spark, f"file://{root}/tudataset", "T", 1)) == edges(tu)
    with pytest.raises(FileNotFoundError):
        files.read_tu(spark, f"file://{root}/tudataset", "absent")
    assert files.list_available(spark, f"file://{root}") == ["tiny"] and files.list_available(spark, f"file://{root}", "absent") == []
    with pytest.warns(UserWarning, match="left out"):
        every, ids = files.load(spark, f"file://{root}", ["realworld:tiny", "pace", "nothing"], min_nodes=1, max_nodes=10)
    assert sorted(r.dataset for r in ids.collect()) == ["pace", "realworld:tiny"] and every.edges.count() == 5
    rows = spark.createDataFrame([(0, "min_vertex_cover", "(1, 3)", "[(1, 2), (2, 3)]", "[2]", "f"), (1, "other", "", "", "", ""), (2, "min_vertex_cover", "(1, 2)", "[]", "[5]", "f")], "id int, task string, nodes string, edges string, answer string, source_file string")
    conv = files.convert_encoded(rows).collect()
    assert len(conv) == 1 and conv[0].edges == [[0, 1], [1, 2]] and conv[0].mvc == [1] and conv[0].n_nodes == 3
    results = pipelines.evaluate(x, pruning.no_pruner(x))
    for run in ("cfg_20250101_000000", "cfg_20250102_000000", "other_20250101_000000"):
        files.write_results(results, f"file://{root}/results/{run}/pipeline_results.csv")
    back = files.read_results(spark, f"file://{root}/results")
    assert {(r.config, r.n) for r in back.groupBy("config").agg(F.count("*").alias("n")).collect()} == {("cfg", 2), ("other", 1)}
    assert statistics.summarise_runs(back).count() == 2


def test_edgelist_query_has_the_edges_of_all_graphs(spark):
    d = "/root/testdata/sf0.001"
    want = {(0, (r.graph_id << 32) + r.src, (r.graph_id << 32) + r.dst) for r in tables.parts(spark, d).edges.collect()}
    assert len({a >> 32 for _, a, _ in want}) > 1
    got = [tuple(r) for r in files.queries()["parse_edgelist"](spark, d).collect()]
    assert set(got) == want and len(got) == len(want)


def test_five_node_sample(spark):
    tail = [(0, 1), (0, 2), (1, 2), (2, 3), (3, 4)]
    h = graphs(spark, (gen.complete(6), 6), (gen.complete(7), 7), (tail, 5), (gen.path(6), 6))
    out = local.gdv(h, max_graphlet_size=5)
    # all 720 paths of K6, each with 10 edges; of K7 the first 1000; a triangle in 6 orders and its tail; no triangle
    assert column(out, 0, "gdv_orbit_46") == [600] * 6 and sum(column(out, 1, "gdv_orbit_46")) == 5000
    assert column(out, 2, "gdv_orbit_31") == [6] * 5 and column(out, 3, "gdv_orbit_28") == [0] * 6
    paths = [r.path for r in local.fives(h).filter("graph_id = 1").orderBy("path").collect()]
    assert paths[0] == [0, 1, 2, 3, 4] and len(paths) == 1000 and paths[-1] < [6, 6, 6, 6, 6]
