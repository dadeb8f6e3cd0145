"""The experiment grid as a table: configurations, seeds, run names."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the study.
SEEDS = (42, 123, 456, 789, 1337)
LARGE = "synthetic:large"
HARD = "synthetic:hard"


@dataclass(frozen=True)
class Config:
    grp: str
    datasets: str
    pruner: str = "ml"
    ilp_solver: str = "auto"
    feature_set: str = "kernel"
    prune_threshold: float = 0.10
    fix_threshold: float = 1.1
    no_vsko: bool = False
    no_gdv: bool = False
    no_rw: bool = False
    eval_min_nodes: int = 0
    max_graphs: int = 500


def _joined(*names: str) -> str:
    return ",".join(names)


def configurations() -> list[Config]:
    """Every group in order; the ablation group's ten conditions and the real-world check are for all seeds."""
    small, medium, large = (f"synthetic:{s}" for s in ("small", "medium", "large"))
    mutag, nci, proteins, collab = (f"tudataset:{t}" for t in ("MUTAG", "NCI1", "PROTEINS", "COLLAB"))
    fixed = {"fix_threshold": 0.85}
    out = [Config("1", d) for d in ("erdos", small, medium, HARD, mutag, nci, collab)]
    out += [Config("2", HARD, p) for p in ("none", "ml", "structural", "greedy")] + [Config("2", HARD, "greedy", **fixed)]
    out += [Config("2b", HARD, prune_threshold=t) for t in (0.2, 0.3)] + [Config("2b", HARD, prune_threshold=t, **fixed) for t in (0.1, 0.2, 0.3)] + [Config("2b", HARD, prune_threshold=0.2, eval_min_nodes=30, **fixed)]
    out += [Config("2c", HARD, "none", s) for s in ("cbc", "highs", "gurobi", "scip", "xpress")]
    out += [Config("3", _joined("erdos", *x)) for x in ((small,), (small, medium), (small, medium, HARD), (small, medium, large), (small, medium, HARD, large))]
    out += [Config("4", _joined("erdos", *x)) for x in ((mutag,), (mutag, nci, proteins), (mutag, nci, proteins, collab))]
    base = ("erdos", small, medium, HARD, mutag, nci, proteins)
    out += [Config("5", _joined(*x), max_graphs=1000) for x in (base, (*base, collab))]
    out += [Config("sensitivity", HARD, fix_threshold=round(0.6 + 0.05 * i, 2)) for i in range(8)] + [Config("sensitivity", HARD, prune_threshold=round(0.05 * i, 2)) for i in range(1, 9)]
    out += [Config("realworld", "realworld", "none"), Config("realworld", "realworld", **fixed), Config("realworld", "realworld", "structural"), Config("realworld", _joined(HARD, "realworld"), **fixed)]
    out.append(Config("ablation", HARD, "none"))
    for off in (("gdv", "rw"), ("vsko", "rw"), ("vsko", "gdv"), ()):
        out.append(Config("ablation", HARD, **fixed, **{f"no_{x}": True for x in off}))
    out += [Config("ablation", HARD, feature_set=f, **fixed) for f in ("lauri", "both", "ajwani", "kernel+ajwani")]
    return [*out, Config("ablation", HARD, "greedy", **fixed), Config("ablation", "realworld", **fixed)]


def grid(spark: SparkSession, group: str | None = None, skip_large: bool = False, skip_realworld: bool = False, seeds: tuple[int, ...] | None = None) -> DataFrame:
    """One row per run: configurations crossed with seeds (the ablation with all, others with the first), a table of some hundred rows."""
    rows = [(i, *asdict(c).values()) for i, c in enumerate(configurations())]
    kinds = "config_id int, grp string, datasets string, pruner string, ilp_solver string, feature_set string, prune_threshold double, fix_threshold double, no_vsko boolean, no_gdv boolean, no_rw boolean, eval_min_nodes int, max_graphs int"
    c = spark.createDataFrame(rows, kinds)
    if group:
        c = c.filter(F.col("grp") == group)
    if skip_large:
        c = c.filter(~F.array_contains(F.split("datasets", ","), LARGE))
    if skip_realworld:
        c = c.filter(~F.array_contains(F.split("datasets", ","), "realworld"))
    s = spark.createDataFrame([(x,) for x in (seeds or SEEDS)], "seed int")
    crossed = c.crossJoin(F.broadcast(s))
    return crossed if seeds else crossed.filter((F.col("grp") == "ablation") | (F.col("seed") == SEEDS[0]))


def run_tag() -> Column:
    """The run's directory name without its time."""
    kernel = F.col("feature_set").isin("kernel", "both", "kernel+ajwani")  # the last one too, else its ablations share a name
    active = F.concat_ws("+", *(F.when(~F.col(f"no_{k}"), k) for k in ("vsko", "gdv", "rw")))
    off = F.col("no_vsko") | F.col("no_gdv") | F.col("no_rw")
    return F.concat(
        F.replace(F.replace(F.replace("datasets", F.lit(","), F.lit("_")), F.lit(":"), F.lit("-")), F.lit(" "), F.lit("")),
        F.when(F.col("pruner") != "ml", F.format_string("_%s-pruner", "pruner")).otherwise(""),
        F.when(F.col("ilp_solver") != "auto", F.format_string("_%s-solver", "ilp_solver")).otherwise(""),
        F.when(F.col("feature_set") != "kernel", F.format_string("_%s-feat", "feature_set")).otherwise(""),
        F.when(kernel & off, F.when(active == "", "_no-kernel").otherwise(F.concat(F.lit("_"), active, F.lit("-only")))).otherwise(""),
        F.when(F.col("prune_threshold") != 0.10, F.format_string("_pt%.2f", "prune_threshold")).otherwise(""),
        F.when(F.col("fix_threshold") <= 1.0, F.format_string("_ft%.2f", "fix_threshold")).otherwise(""),
        F.when(F.col("seed") != 42, F.format_string("_s%d", "seed")).otherwise(""),
    )


def stamped(tag: Column) -> Column:
    return F.concat(tag, F.lit("_"), F.date_format(F.current_timestamp(), "yyyyMMdd_HHmmss"))


def strip_timestamp(name: Column) -> Column:
    return F.regexp_replace(name, r"_[0-9]{8}_[0-9]{6}$", "")
