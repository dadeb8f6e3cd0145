"""Generated corpora: random families with exact labels, and a catalogue of named graphs."""

from __future__ import annotations

import functools
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions import covers
from lattica.functions import generators as gen
from lattica.graphs import GraphSet, Local
from lattica.operators.iterative import largest_component
from lattica.session import ship
from lattica.sources.files import from_records

FAMILIES = ("erdos_renyi", "barabasi_albert", "watts_strogatz", "random_regular")


@dataclass(frozen=True)
class Split:
    n_range: tuple[int, int]
    n_per_family: int
    density: tuple[float, float] = (0.1, 0.4)


#: Fixed values of the study's splits.
SPLITS = {"small": Split((20, 50), 200), "medium": Split((50, 150), 100), "large": Split((150, 500), 50), "hard": Split((50, 80), 75, (0.3, 0.5))}
RECORDS = "graph_id long, n_nodes int, edges array<array<int>>, mvc array<int>, source string"


def _record(graph_id: int, n: int, edges: gen.Edges, source: str, max_branches: int) -> tuple | None:
    e = np.array(sorted(edges), np.int64).reshape(-1, 2)
    cover, optimal = covers.exact_cover(Local(graph_id, np.arange(n), e[:, 0], e[:, 1]), max_branches)
    return (graph_id, n, e.tolist(), sorted(cover), source) if optimal else None


def generate(spark: SparkSession, n_graphs: int, n_range: tuple[int, int], families: tuple[str, ...] = FAMILIES, density: tuple[float, float] = (0.1, 0.4), seed: int = 42, max_branches: int = 20_000, attempts: int = 20) -> DataFrame:
    """Records of n_graphs graphs per family with minimum covers.

    Each graph has a generator of its own, seeded by (seed, family, number), so tasks can be retried; graphs
    without an edge or without a proof are drawn again, at most `attempts` times.
    """
    ship(spark)
    rows = spark.range(n_graphs * len(families), numPartitions=max(1, min(n_graphs * len(families), 64)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for i in batch["id"].tolist():
                family = families[i // n_graphs]
                rng = np.random.default_rng([seed, zlib.crc32(family.encode()), i % n_graphs])
                for _ in range(attempts):
                    n = int(rng.integers(n_range[0], n_range[1] + 1))
                    edges = gen.random_graph(family, n, rng, density)
                    if edges and (r := _record(i, n, edges, f"synthetic:{family}:n{n}", max_branches)):
                        out.append(r)
                        break
            yield pd.DataFrame(out, columns=["graph_id", "n_nodes", "edges", "mvc", "source"])

    return rows.mapInPandas(run, RECORDS)


def generate_split(spark: SparkSession, name: str, **how) -> DataFrame:
    s = SPLITS[name]
    return generate(spark, **{"n_graphs": s.n_per_family, "n_range": s.n_range, "density": s.density, **how})


def hashed_erdos_renyi(spark: SparkSession, n_graphs: int, n: int, p: float) -> GraphSet:
    """G(n, p) with coins that any SQL engine can toss: a hash of (graph, pair)."""
    nodes = spark.range(n_graphs).select(F.col("id").alias("graph_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("node_id"), F.lit(None).cast("int").alias("label"))
    pairs = nodes.select("graph_id", F.col("node_id").alias("dst")).filter("dst > 0").select("graph_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("dst") - 1)).alias("src"), "dst")
    coin = F.conv(F.substring(F.md5(F.concat_ws(":", *(F.col(c).cast("string") for c in ("graph_id", "src", "dst")))), 1, 8), 16, 10).cast("long") / float(1 << 32)
    return GraphSet(nodes, pairs.filter(coin < p))


#: The classical social networks as lists of "node: neighbours of higher number".
NAMED = {
    "karate": "0: 1 2 3 4 5 6 7 8 10 11 12 13 17 19 21 31; 1: 2 3 7 13 17 19 21 30; 2: 3 7 8 9 13 27 28 32; 3: 7 12 13; 4: 6 10; 5: 6 10 16; 6: 16; 8: 30 32 33; 9: 33; 13: 33; 14: 32 33; 15: 32 33; 18: 32 33; 19: 33; 20: 32 33; 22: 32 33; 23: 25 27 29 32 33; 24: 25 27 31; 25: 31; 26: 29 33; 27: 33; 28: 31 33; 29: 32 33; 30: 32 33; 31: 32 33; 32: 33",
    # 18 women, 0 to 17, and the 14 meetings they came to, 18 to 31
    "davis": "0: 18 19 20 21 22 23 25 26; 1: 18 19 20 22 23 24 25; 2: 19 20 21 22 23 24 25 26; 3: 18 20 21 22 23 24 25; 4: 20 21 22 24; 5: 20 22 23 25; 6: 22 23 24 25; 7: 23 25 26; 8: 22 24 25 26; 9: 24 25 26 29; 10: 25 26 27 29; 11: 25 26 27 29 30 31; 12: 24 25 26 27 29 30 31; 13: 23 24 26 27 28 29 30 31; 14: 24 25 27 28 29; 15: 25 26; 16: 26 28; 17: 26 28",
    "florentine": "0: 1; 1: 5 6 7 8 9; 2: 3 4 5; 3: 4 11; 4: 6 11; 6: 7; 7: 12; 8: 12 13; 9: 10; 11: 12; 12: 14",
}


def _named(name: str) -> gen.Edges:
    return {gen.edge(int(a), int(b)) for line in NAMED[name].split(";") for a, near in [line.split(":")] for b in near.split()}


def _with(f: Callable, seed: int, *how) -> Callable[[], gen.Edges]:
    return lambda: f(*how, np.random.default_rng(seed))


def catalogue() -> dict[str, Callable[[], gen.Edges]]:
    """Name to a maker of edges. One of the classical networks (les miserables) is not carried."""
    out: dict[str, Callable[[], gen.Edges]] = {
        "karate": functools.partial(_named, "karate"), "florentine": functools.partial(_named, "florentine"), "davis": functools.partial(_named, "davis"), "petersen": gen.petersen, "dodecahedron": gen.dodecahedron, "icosahedron": gen.icosahedron,
        "complete_bipartite_5_5": lambda: gen.multipartite([5, 5]), **{f"grid_{k}x{k}": functools.partial(gen.grid, k, k) for k in (5, 7, 8, 10)}, "cycle_20": lambda: gen.cycle(20), "wheel_30": lambda: gen.wheel(30),
        "barbell_15": lambda: gen.barbell(15, 5), "triangular_lattice": lambda: gen.triangular_lattice(6, 8), "hexagonal_lattice": lambda: gen.hexagonal_lattice(5, 6), "turan_50_5": lambda: gen.turan(50, 5),
    }
    for n, d in ((50, 3), (76, 4), (100, 3)):
        out[f"rreg_{n}_{d}"] = _with(gen.random_regular, 42, n, d)
    worlds = [(50, 4, 1), (50, 6, 2), (75, 4, 1), (75, 6, 2), (100, 4, 1), (100, 6, 2), (100, 8, 3), (150, 6, 2), (200, 6, 1), (200, 8, 2)]
    out |= {f"ws_{n}_{k}_{p:02d}": _with(gen.watts_strogatz, s, n, k, p / 10) for s, (n, k, p) in enumerate(worlds, 1)}
    out |= {f"ba_{n}_{m}": _with(gen.barabasi_albert, s, n, m) for s, (n, m) in enumerate([(n, m) for n in (50, 75, 100, 150, 200) for m in (2, 3)], 11)}
    mixed = [(n, mu) for n in (50, 75, 100, 150, 200) for mu in (1, 2, 3)]
    return out | {f"lfr_{n}_mu{mu:02d}": _with(gen.lfr, s, n, 3.0, 1.5, mu / 10, 5 if n < 100 else 6, max(10, n // 8)) for s, (n, mu) in enumerate(mixed, 21)}


def catalogue_graphs(spark: SparkSession, names: list[str] | None = None) -> tuple[GraphSet, DataFrame]:
    """The catalogue as a corpus of largest components of at least five nodes; also (graph_id, dataset)."""
    makers = catalogue()
    names = names or list(makers)
    made = [(i, sorted(makers[n]())) for i, n in enumerate(names)]
    records = spark.createDataFrame([(i, max(map(max, e)) + 1, [list(x) for x in e], [], f"realworld:{names[i]}") for i, e in made], RECORDS)
    return largest_component(from_records(records)), records.select("graph_id", F.col("source").alias("dataset"))


def labelled_catalogue(spark: SparkSession, names: list[str] | None = None) -> tuple[GraphSet, DataFrame]:
    """The same with exact covers as labels, and (graph_id, dataset, n_nodes, n_edges, cover)."""
    from lattica.operators import pruning, solvers

    g, tags = catalogue_graphs(spark, names)
    solved = solvers.Solver().solve(g)
    table = tags.join(pruning.sizes(g), "graph_id").join(solved.select("graph_id", F.col("size").alias("cover")), "graph_id")
    return solvers.labelled(g, solved), table


def labelled_tu(spark: SparkSession, root: str, name: str, min_nodes: int = 5, max_nodes: int = 500, max_graphs: int | None = None, recompute: bool = False) -> GraphSet:
    """A TU dataset with exact labels, from root/labels/name if that is there, else parsed, solved, written and read."""
    from lattica.operators import corpus, solvers
    from lattica.plans.pipelines import subset
    from lattica.sources import files

    kept = f"{root}/labels/{name}"
    where = spark._jvm.org.apache.hadoop.fs.Path(kept)
    if recompute or not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        g = files.read_tu(spark, root, name)
        g = subset(g, corpus.size_filter(corpus.per_graph_stats(g), min_nodes, max_nodes, max_graphs))
        tag = g.nodes.select("graph_id").distinct().withColumn("source", F.lit(f"tudataset:{name}"))
        files.write_records(solvers.labelled(g, solvers.Solver().solve(g)), kept, tag)
    return from_records(files.read_record_lines(spark, kept))


def queries() -> dict:
    from lattica.operators import pruning

    def split(spark: SparkSession, _: str) -> DataFrame:
        r = generate(spark, 10, (20, 40))
        return r.select("graph_id", "n_nodes", F.size("edges").alias("n_edges"), F.size("mvc").alias("cover"), F.split("source", ":")[1].alias("family"))

    return {
        "generate_er_hashed": lambda spark, _: pruning.sizes(hashed_erdos_renyi(spark, 20, 30, 0.2)),
        "generate_synthetic": split,
        "catalogue": lambda spark, _: labelled_catalogue(spark)[1],
    }


def oracle_sql() -> dict[str, str]:
    return {
        "generate_er_hashed": "WITH p AS (SELECT g, a, b FROM range(20) t(g), range(30) u(a), range(30) v(b) WHERE a < b) SELECT g AS graph_id, 30::BIGINT AS n_nodes, count(*) FILTER (('0x' || md5(g || ':' || a || ':' || b)[1:8])::BIGINT / 4294967296.0 < 0.2)::BIGINT AS n_edges FROM p GROUP BY g"
    }
