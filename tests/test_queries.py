"""Registered queries against their SQL on the smallest tables, as the driver compares them on larger ones."""

import math
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).parents[1]))
import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
SOME = [
    "graph_stats", "corpus_summary_rollup", "train_test_split", "degree_features", "triangle_count", "gdv4_counts", "nbr_degree_rank", "core_number", "betweenness", "pagerank", "mwua", "structural_score",
    "prune_two_sided", "prune_keep_node", "reduced_graph_stats", "reconstruct_repair", "greedy_scores", "prune_greedy", "matching_cover", "exact_cover_small", "pipeline_none", "threshold_tuning", "clf_metrics", "wilcoxon", "parse_pace",
    "parse_json_arrays", "parse_adjlist", "parse_graphml", "parse_gml", "parse_edgelist", "config_tags", "eigenvector", "luby_mis", "konig_cover", "lp_bound_small", "bootstrap_median_ci", "features_lauri", "features_ajwani", "features_kernel", "pagerank_rounds",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in Path(SF).glob("*.parquet"):
        con.sql(f"create view {t.stem} as select * from '{t}'")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 9)
    return [plain(y) for y in x] if isinstance(x, list | tuple) else x


@pytest.mark.parametrize("name", SOME)
def test_matches_sql(spark, duck, name):
    df, sql = entry.queries()[name](spark, SF), duck.sql(entry.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(sql.columns)
    at = [sql.columns.index(c) for c in columns]
    got = sorted((plain([r[c] for c in columns]) for r in df.collect()), key=repr)
    assert got == sorted((plain([r[i] for i in at]) for r in sql.fetchall()), key=repr)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
