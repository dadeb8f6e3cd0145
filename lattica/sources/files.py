"""Graph corpora in files: JSON records, PACE, TU, edge and adjacency lists, GraphML, GML, encoded rows, result CSVs.

Each parser takes lines or rows as a DataFrame, so a whole folder of files is one plan; the readers only
add the right scan. Lines that do not parse are left out.
"""

from __future__ import annotations

import tempfile
import uuid
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.graphs import KEY, GraphSet, canonical
from lattica.operators.corpus import size_filter
from lattica.operators.experiments import strip_timestamp

RECORD = T.StructType(
    [T.StructField("n_nodes", T.IntegerType()), T.StructField("edges", T.ArrayType(T.ArrayType(T.IntegerType()))), T.StructField("mvc", T.ArrayType(T.IntegerType())), T.StructField("source", T.StringType()), T.StructField("_corrupt_record", T.StringType())]
)
RESULTS = "graph_id long, source string, n_nodes long, n_edges long, n_nodes_reduced long, n_edges_reduced long, clf_f1 double, clf_auc double, clf_precision double, clf_recall double, pipeline_cover_size long, baseline_cover_size long, optimality_gap double, cover_valid boolean, feature_extraction_time double, pipeline_runtime double, baseline_runtime double, speedup double, node_reduction double, edge_reduction double, n_forced long"


def numbered(rows: DataFrame, *order: Column) -> DataFrame:
    """rows with graph_id 0.. in the given order; one row a graph."""
    return rows.withColumn("graph_id", (F.row_number().over(W.orderBy(*order)) - 1).cast("long"))


def read_records(spark: SparkSession, path: str | list[str], tag: str | None = None, min_nodes: int = 5, max_nodes: int | None = 500, max_graphs: int | None = None) -> DataFrame:
    """(graph_id, dataset, n_nodes, edges, mvc, source) of JSON arrays of records, in file order; the size filter (max_nodes None: no upper end) comes before the cap, which holds per file."""
    raw = spark.read.schema(RECORD).option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    rows = raw.filter("_corrupt_record is null and n_nodes is not null").withColumns({"file": F.col("_metadata.file_path"), "at": F.monotonically_increasing_id()})
    kept = size_filter(rows.withColumn("graph_id", F.col("at")), min_nodes, max_nodes, max_graphs, "file").drop("graph_id")
    # ids run on from file to file: a rank within the file plus the rows of the files before it; only counts meet
    counts = kept.groupBy("file").agg(F.count("*").alias("k"))
    offsets = counts.select("file", F.coalesce(F.sum("k").over(W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    again = kept.join(F.broadcast(offsets), "file").withColumn("graph_id", (F.row_number().over(W.partitionBy("file").orderBy("at")) - 1 + F.col("before")).cast("long"))
    return again.select("graph_id", (F.lit(tag) if tag else F.col("source")).alias("dataset"), "n_nodes", "edges", "mvc", "source")


def from_records(records: DataFrame) -> GraphSet:
    """Records to graphs: every node of 0..n-1, label 1 in the cover and 0 else, edges made canonical."""
    ids = records.filter("n_nodes > 0").select("graph_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_nodes").cast("long") - 1)).alias("node_id"))
    cover = records.select("graph_id", F.explode(F.col("mvc").cast("array<long>")).alias("node_id")).distinct().withColumn("c", F.lit(1))
    nodes = ids.join(cover, KEY, "left").select(*KEY, F.coalesce("c", F.lit(0)).alias("label"))
    pairs = records.select("graph_id", F.explode("edges").alias("e")).filter("size(e) = 2").select("graph_id", F.col("e")[0].cast("long").alias("u"), F.col("e")[1].cast("long").alias("v"))
    return canonical(nodes, pairs)


def to_records(g: GraphSet, sources: DataFrame | None = None) -> DataFrame:
    """Graphs to records (with graph_id); covers sorted, nodes renumbered 0..n-1 if they are not."""
    ids = g.nodes.withColumn("i", (F.row_number().over(W.partitionBy("graph_id").orderBy("node_id")) - 1).cast("int"))
    n = ids.groupBy("graph_id").agg(F.count("*").cast("int").alias("n_nodes"), F.sort_array(F.collect_list(F.when(F.col("label") == 1, F.col("i")))).alias("mvc"))
    e = g.edges.join(ids.select("graph_id", F.col("node_id").alias("src"), F.col("i").alias("a")), ["graph_id", "src"]).join(ids.select("graph_id", F.col("node_id").alias("dst"), F.col("i").alias("b")), ["graph_id", "dst"])
    lists = e.groupBy("graph_id").agg(F.sort_array(F.collect_list(F.array("a", "b"))).alias("edges"))
    out = n.join(lists, "graph_id", "left").withColumn("edges", F.coalesce("edges", F.array().cast("array<array<int>>")))
    out = out.join(sources.select("graph_id", "source"), "graph_id", "left") if sources is not None else out.withColumn("source", F.lit("unknown"))
    return out.select("graph_id", "n_nodes", "edges", "mvc", "source")


def write_records(g: GraphSet, path: str, sources: DataFrame | None = None) -> None:
    """Records as JSON lines, one file per partition; read_record_lines reads them."""
    to_records(g, sources).write.mode("overwrite").json(path)


def read_record_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("graph_id long, n_nodes int, edges array<array<int>>, mvc array<int>, source string").json(path)


def lines_of(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """(path, value) of every line of the files below path with that suffix."""
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").text(path).select(F.col("_metadata.file_path").alias("path"), "value")


def _whole(text: Column) -> Column:
    return F.when(text.rlike("^-?[0-9]{1,18}$"), text).cast("long")


def _fields(lines: DataFrame, skip: str) -> DataFrame:
    """lines with w, their words; blank lines and those that start with one of skip are left out."""
    text = F.trim("value")
    return lines.filter((text != "") & ~F.substring(text, 1, 1).isin(*skip)).withColumn("w", F.split(text, r"\s+"))


def stem(path: Column) -> Column:
    return F.regexp_replace(path, r"\.[A-Za-z]+$", "")


def parse_pace(gr: DataFrame, sol: DataFrame, min_nodes: int = 5, max_nodes: int | None = 2000, max_graphs: int | None = None) -> tuple[GraphSet, DataFrame]:
    """Lines(path, value) of .gr and .sol files to graphs with labels; graphs without a solution are left out, and so are those beyond max_nodes (None: no upper end). Also (graph_id, stem)."""
    head = _fields(gr, "c").filter(F.get("w", F.lit(0)) == "p").select(stem(F.col("path")).alias("stem"), _whole(F.get("w", F.lit(2))).alias("n_nodes")).filter("n_nodes > 0").groupBy("stem").agg(F.max("n_nodes").alias("n_nodes"))
    answered = sol.select(stem(F.col("path")).alias("stem")).distinct()
    ids = numbered(head.join(answered, "stem", "left_semi"), F.col("stem"))
    ids = numbered(size_filter(ids, min_nodes, max_nodes, max_graphs).drop("graph_id"), F.col("stem"))
    key = F.broadcast(ids.select("stem", "graph_id"))  # one row a file
    pairs = _fields(gr, "cp").select(stem(F.col("path")).alias("stem"), (_whole(F.get("w", F.lit(0))) - 1).alias("u"), (_whole(F.get("w", F.lit(1))) - 1).alias("v")).filter("u is not null and v is not null").join(key, "stem").select("graph_id", "u", "v")
    cover = _fields(sol, "cs").select(stem(F.col("path")).alias("stem"), (_whole(F.get("w", F.lit(0))) - 1).alias("node_id")).join(key, "stem").select(*KEY).distinct().withColumn("c", F.lit(1))
    nodes = ids.select("graph_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_nodes") - 1)).alias("node_id")).join(cover, KEY, "left").select(*KEY, F.coalesce("c", F.lit(0)).alias("label"))
    return canonical(nodes, pairs), ids.select("graph_id", "stem")


def read_pace(spark: SparkSession, path: str, **how) -> tuple[GraphSet, DataFrame]:
    return parse_pace(lines_of(spark, path, ".gr"), lines_of(spark, path, ".sol"), **how)


def parse_tu(pairs: DataFrame, indicator: DataFrame) -> GraphSet:
    """TU files: pairs(value) lines `u, v`, and indicator(node, gid), both counted from 1. A pair is in the graph of u."""
    ids = indicator.withColumn("new", F.row_number().over(W.partitionBy("gid").orderBy("node")) - 1).select(F.col("gid").cast("long").alias("graph_id"), "node", F.col("new").cast("long").alias("node_id"))
    w = F.split(F.trim("value"), r"\s*,\s*")
    p = pairs.select(_whole(F.get(w, F.lit(0))).alias("a"), _whole(F.get(w, F.lit(1))).alias("b")).filter("a is not null and b is not null and a <> b")
    e = p.join(ids.select("graph_id", F.col("node").alias("a"), F.col("node_id").alias("u")), "a").join(ids.select("graph_id", F.col("node").alias("b"), F.col("node_id").alias("v")), ["graph_id", "b"])
    return canonical(ids.select("graph_id", "node_id", F.lit(None).cast("int").alias("label")), e.select("graph_id", "u", "v"))


def read_tu(spark: SparkSession, folder: str, name: str) -> GraphSet:
    """The files of a TU dataset, flat or in a folder of its name; the graph of node i is on line i."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path
    bases = [f"{folder}/{name}", f"{folder}/{name}/{name}", f"{folder}/{name}/{name}/{name}"]
    base = next((b for b in bases if jpath(f"{b}_A.txt").getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath(f"{b}_A.txt"))), None)
    if base is None:
        raise FileNotFoundError(f"no {name}_A.txt below {folder}")
    whole = spark.read.text(f"{base}_graph_indicator.txt", wholetext=True)
    rows = whole.select(F.posexplode(F.split(F.rtrim("value"), r"\r?\n")).alias("i", "g")).select((F.col("i") + 1).cast("long").alias("node"), _whole(F.trim("g")).alias("gid"))
    return parse_tu(spark.read.text(f"{base}_A.txt"), rows.filter("gid is not null"))


def _from_pairs(pairs: DataFrame, alone: DataFrame | None = None) -> GraphSet:
    """Pairs of whole-number ids as one graph 0; ids stay as they are."""
    ends = pairs.select(F.explode(F.array("u", "v")).alias("node_id"))
    ids = (ends if alone is None else ends.union(alone.select("node_id"))).filter("node_id is not null").distinct()
    zero = F.lit(0).cast("long").alias("graph_id")
    return canonical(ids.select(zero, "node_id", F.lit(None).cast("int").alias("label")), pairs.filter("u is not null and v is not null").select(zero, "u", "v"))


def parse_edgelist(lines: DataFrame) -> GraphSet:
    w = _fields(lines, "#")
    return _from_pairs(w.select(_whole(F.get("w", F.lit(0))).alias("u"), _whole(F.get("w", F.lit(1))).alias("v")).filter("u is not null and v is not null"))


def parse_adjlist(lines: DataFrame) -> GraphSet:
    """`v u1 u2 ...` lines; a line with v alone is a node without links of its own."""
    w = _fields(lines, "#").select(_whole(F.get("w", F.lit(0))).alias("u"), "w")
    pairs = w.select("u", F.explode(F.slice("w", 2, 1 << 30)).alias("x")).select("u", _whole(F.col("x")).alias("v"))
    return _from_pairs(pairs, w.select(F.col("u").alias("node_id")))


def _named(names: DataFrame, pairs: DataFrame) -> GraphSet:
    """Nodes with names as text: numbered in order of name, whole numbers first by value."""
    order = W.orderBy(_whole(F.col("name")).asc_nulls_last(), "name")
    ids = names.distinct().withColumn("node_id", (F.row_number().over(order) - 1).cast("long"))
    e = pairs.join(ids.toDF("a", "u"), "a").join(ids.toDF("b", "v"), "b").select(F.lit(0).cast("long").alias("graph_id"), "u", "v")
    return canonical(ids.select(F.lit(0).cast("long").alias("graph_id"), "node_id", F.lit(None).cast("int").alias("label")), e)


def read_graphml(spark: SparkSession, path: str) -> GraphSet:
    names = spark.read.format("xml").option("rowTag", "node").schema("_id string").load(path).select(F.col("_id").alias("name"))
    pairs = spark.read.format("xml").option("rowTag", "edge").schema("_source string, _target string").load(path).select(F.col("_source").alias("a"), F.col("_target").alias("b"))
    return _named(names, pairs)


def read_gml(spark: SparkSession, path: str) -> GraphSet:
    text = spark.read.text(path, wholetext=True)
    block = lambda kind: text.select(F.explode(F.regexp_extract_all("value", F.lit(rf"\b{kind}\s*\[([^\]]*)\]"))).alias("x"))
    value = lambda key: F.regexp_extract("x", rf"\b{key}\s+(-?[0-9]+)", 1)
    return _named(block("node").select(value("id").alias("name")), block("edge").select(value("source").alias("a"), value("target").alias("b")))


def read_graph(spark: SparkSession, path: str) -> GraphSet:
    """One graph from a file, by its suffix."""
    suffix = PurePosixPath(path).suffix.lower()
    if suffix in (".edgelist", ".adjlist"):
        return {".edgelist": parse_edgelist, ".adjlist": parse_adjlist}[suffix](spark.read.text(path))
    if suffix in (".graphml", ".gml"):
        return {".graphml": read_graphml, ".gml": read_gml}[suffix](spark, path)
    raise ValueError(f"unknown graph format {suffix!r}: .edgelist, .graphml, .gml and .adjlist are known")


def convert_encoded(rows: DataFrame, min_nodes: int = 0, max_nodes: int = 10**9, max_examples: int | None = None) -> DataFrame:
    """Rows(id, task, nodes, edges, answer, source_file) whose lists are strings, counted from 1, to records.

    Only minimum vertex cover rows; the node count is the last number of `nodes`; a cover out of range or
    an unreadable node field drops the row.
    """
    numbers = lambda c: F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"-?\d+"), F.lit(0)), lambda x: x.cast("int"))
    own = rows.filter("task = 'min_vertex_cover'").withColumn("ns", numbers("nodes")).filter(F.size("ns") > 0)
    own = own.withColumns({"n_nodes": F.try_element_at("ns", F.lit(-1)), "flat": numbers("edges"), "mvc": F.transform(numbers("answer"), lambda x: x - 1)})
    pairs = F.transform(F.sequence(F.lit(0), F.greatest(F.floor(F.size("flat") / 2).cast("int") - 1, F.lit(0))), lambda i: F.array(F.get("flat", 2 * i) - 1, F.get("flat", 2 * i + 1) - 1))
    good = own.filter(~F.exists("mvc", lambda x: (x < 0) | (x >= F.col("n_nodes"))) & F.col("n_nodes").between(min_nodes, max_nodes))
    out = numbered(good.withColumn("edges", F.when(F.size("flat") >= 2, pairs).otherwise(F.array().cast("array<array<int>>"))), F.col("id"))
    out = out if max_examples is None else out.filter(F.col("graph_id") < max_examples)
    return out.select("graph_id", "n_nodes", "edges", "mvc", F.coalesce("source_file", F.lit("")).alias("source"))


def read_results(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """All */pipeline_results.csv below folder with config (the run's directory without its time) and run."""
    rows = spark.read.schema(RESULTS).option("header", True).csv(f"{folder}/{pattern}/pipeline_results.csv")
    run = F.regexp_extract("_metadata.file_path", r"([^/]+)/pipeline_results\.csv", 1)  # one file, or a folder of Spark's
    return rows.withColumns({"run": run, "config": strip_timestamp(run)})


def write_results(results: DataFrame, path: str) -> None:
    """One CSV folder with a header; a summary of a run, a row per graph."""
    results.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def list_available(spark: SparkSession, root: str, kind: str = "realworld") -> list[str]:
    """Names of the record files of a kind below root, in order; none if there is no such folder."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{kind}")
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [str(x.getPath().getName()) for x in fs.listStatus(where)] if fs.exists(where) else []
    return sorted(n.removesuffix(".json") for n in found if n.endswith(".json"))


SCHEMES = ("erdos", "synthetic", "pace", "tudataset", "realworld")


def load_source(spark: SparkSession, root: str, source: str, split: str | None = None, min_nodes: int = 5, max_nodes: int = 500, max_graphs: int | None = None) -> tuple[GraphSet, str] | None:
    """erdos, synthetic:X, pace, tudataset:X, realworld[:X] below root; None (with a warning) if unknown or not there."""
    import warnings

    kind, _, name = source.partition(":")
    how = {"min_nodes": min_nodes, "max_nodes": max_nodes, "max_graphs": max_graphs}
    try:
        if kind not in SCHEMES:
            raise ValueError(f"unknown source {source!r}")
        if kind == "pace":
            return read_pace(spark, f"{root}/pace", **how)[0], source
        if kind == "tudataset" and not name:
            raise ValueError("tudataset needs a name")
        where = {"erdos": f"{root}/erdos/{split or '*'}.json", "synthetic": f"{root}/synthetic/{name}.json", "tudataset": f"{root}/tudataset/{name}.json", "realworld": f"{root}/realworld/{name or '*'}.json"}[kind]
        records = read_records(spark, where, source, **how)
        return from_records(records), source
    except Exception as e:
        warnings.warn(f"{source} is left out: {str(e)[:200]}", stacklevel=2)
        return None


def load(spark: SparkSession, root: str, sources: list[str], **how) -> tuple[GraphSet, DataFrame]:
    """Several sources as one corpus with (graph_id, dataset, old_id)."""
    from lattica.operators.corpus import union_all

    found = [x for s in sources if (x := load_source(spark, root, s, **how)) is not None]
    if not found:
        raise FileNotFoundError(f"none of {sources} is below {root}")
    return union_all([g for g, _ in found], [t for _, t in found])


def _scratch(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="lattica-")
    return f"{base.rstrip('/')}/lattica/{uuid.uuid4().hex}"


def shape(g: GraphSet) -> DataFrame:
    """(graph_id, node_id, label, dst): every node with its neighbours of higher number, or null."""
    return g.nodes.join(g.edges.withColumnRenamed("src", "node_id"), KEY, "left").select(*KEY, F.coalesce("label", F.lit(-1)).alias("label"), "dst")


def queries() -> dict:
    from lattica.sources import tables

    def labelled(spark: SparkSession, d: str) -> GraphSet:
        g = tables.suppliers(spark, d)
        return GraphSet(g.nodes.withColumn("label", (F.col("node_id") % 3 == 0).cast("int")), g.edges)

    def joint(spark: SparkSession, d: str) -> GraphSet:
        """All graphs side by side as one: a node's number is its graph's times 2^32 plus its own."""
        g, node = tables.suppliers(spark, d), lambda c: (F.shiftleft("graph_id", 32) + F.col(c)).alias(c)
        return GraphSet(g.nodes.select(node("node_id")), g.edges.select(node("src"), node("dst")))

    def saved(spark: SparkSession, lines: DataFrame, suffix: str) -> str:
        path = _scratch(spark) + suffix
        lines.write.text(path)
        return path

    def json_arrays(spark: SparkSession, d: str) -> DataFrame:
        path, r = _scratch(spark), to_records(labelled(spark, d))
        one = F.concat(F.lit("["), F.to_json(F.struct("n_nodes", "edges", "mvc", "source")), F.lit("]"))
        r.select(F.col("graph_id").alias("part"), one.alias("value")).write.partitionBy("part").text(path)
        return shape(from_records(read_records(spark, path, min_nodes=0, max_nodes=None)))

    def adjlist(spark: SparkSession, d: str) -> DataFrame:
        g = joint(spark, d)
        near = g.edges.groupBy(F.col("src").alias("node_id")).agg(F.array_join(F.collect_list(F.col("dst").cast("string")), " ").alias("near"))
        return shape(read_graph(spark, saved(spark, g.nodes.join(near, "node_id", "left").select(F.concat_ws(" ", "node_id", "near").alias("value")), ".adjlist")))

    def graphml(spark: SparkSession, d: str) -> DataFrame:
        g, part = joint(spark, d), F.shiftright
        ids = g.nodes.select(part("node_id", 32).alias("part"), F.lit(0).alias("k"), F.format_string('<node id="%d"/>', "node_id").alias("x"))
        links = g.edges.select(part("src", 32), F.lit(1), F.format_string('<edge source="%d" target="%d"/>', "src", "dst"))
        body = F.array_join(F.sort_array(F.collect_list(F.struct("k", "x"))).getField("x"), "")
        path = _scratch(spark) + ".graphml"  # a document a graph
        ids.union(links).groupBy("part").agg(F.concat(F.lit("<graphml><graph>"), body, F.lit("</graph></graphml>")).alias("value")).write.partitionBy("part").text(path)
        return shape(read_graph(spark, path))

    def gml(spark: SparkSession, d: str) -> DataFrame:
        g = joint(spark, d)
        ids = g.nodes.select(F.format_string("node [ id %d ]", "node_id").alias("value"))
        return shape(read_graph(spark, saved(spark, ids.union(g.edges.select(F.format_string("edge [ source %d target %d ]", "src", "dst"))), ".gml")))

    def json_round_trip(spark: SparkSession, d: str) -> DataFrame:
        path = _scratch(spark)
        write_records(tables.suppliers(spark, d), path)
        return from_records(read_record_lines(spark, path)).edges

    def edgelist(spark: SparkSession, d: str) -> DataFrame:
        g = tables.parts(spark, d)
        # all graphs side by side as one list: a node's number is its graph's times 2^32 plus its own
        node = lambda c: F.shiftleft("graph_id", 32) + F.col(c)
        lines = g.edges.select(F.concat_ws(" ", node("dst"), node("src"), F.lit("{}")).alias("value"))
        return parse_edgelist(lines).edges

    def pace(spark: SparkSession, d: str) -> DataFrame:
        g = tables.suppliers(spark, d)
        name = F.format_string("g%03d", "graph_id")
        heads = g.nodes.groupBy("graph_id").count().select(F.concat(name, F.lit(".gr")).alias("path"), F.concat_ws(" ", F.lit("p td"), "count", F.lit("0")).alias("value"))
        body = g.edges.select(F.concat(name, F.lit(".gr")).alias("path"), F.concat_ws(" ", F.col("src") + 1, F.col("dst") + 1).alias("value"))
        sol = g.nodes.filter("node_id % 3 = 0").select(F.concat(name, F.lit(".sol")).alias("path"), (F.col("node_id") + 1).cast("string").alias("value"))
        got, names = parse_pace(heads.union(body), sol, 0, None)
        return shape(got).join(names, "graph_id").drop("graph_id")

    def tu(spark: SparkSession, d: str) -> DataFrame:
        g = tables.suppliers(spark, d)
        ids = g.nodes.withColumn("node", F.row_number().over(W.orderBy(*KEY)).cast("long"))
        a = ids.select("graph_id", F.col("node_id").alias("src"), F.col("node").alias("x"))
        b = ids.select("graph_id", F.col("node_id").alias("dst"), F.col("node").alias("y"))
        e = g.edges.join(a, ["graph_id", "src"]).join(b, ["graph_id", "dst"])
        lines = e.select(F.concat_ws(", ", "x", "y").alias("value")).union(e.select(F.concat_ws(", ", "y", "x").alias("value")))
        return parse_tu(lines, ids.select("node", F.col("graph_id").alias("gid"))).edges

    def encoded(spark: SparkSession, d: str) -> DataFrame:
        r = to_records(tables.suppliers(spark, d))
        pair = F.transform("edges", lambda e: F.concat(F.lit("("), (e[0] + 1).cast("string"), F.lit(", "), (e[1] + 1).cast("string"), F.lit(")")))
        rows = r.select(F.col("graph_id").alias("id"), F.lit("min_vertex_cover").alias("task"), F.concat(F.lit("(1, "), F.col("n_nodes").cast("string"), F.lit(")")).alias("nodes"), F.concat(F.lit("["), F.array_join(pair, ", "), F.lit("]")).alias("edges"), F.lit("[1]").alias("answer"), F.lit("f").alias("source_file"))
        return from_records(convert_encoded(rows)).edges

    return {"parse_json_records": json_round_trip, "parse_json_arrays": json_arrays, "parse_adjlist": adjlist, "parse_graphml": graphml, "parse_gml": gml, "parse_edgelist": edgelist, "parse_pace": pace, "parse_tudataset": tu, "parse_encoded_rows": encoded}


def oracle_sql() -> dict[str, str]:
    from lattica import oracles as o

    plain = o.over("SELECT g AS graph_id, a AS src, b AS dst FROM edges", o.SUPPLIERS)
    named = o.over(
        "SELECT 0::BIGINT AS graph_id, x.i AS node_id, -1 AS label, y.i AS dst FROM num x LEFT JOIN edges e ON e.g = x.g AND e.a = x.v LEFT JOIN num y ON y.g = e.g AND y.v = e.b",
        o.SUPPLIERS,
        "num AS MATERIALIZED (SELECT g, v, row_number() OVER (ORDER BY g, v) - 1 AS i FROM nodes)",
    )
    return {
        "parse_json_records": plain,
        "parse_tudataset": plain,
        "parse_encoded_rows": plain,
        "parse_pace": o.over("SELECT 'g' || lpad(g::VARCHAR, 3, '0') AS stem, v AS node_id, (v % 3 = 0)::INT AS label, b AS dst FROM nodes LEFT JOIN (SELECT g, a AS v, b FROM edges) USING (g, v)", o.SUPPLIERS),
        "parse_json_arrays": o.over("SELECT dense_rank() OVER (ORDER BY g || '/') - 1 AS graph_id, v AS node_id, (v % 3 = 0)::INT AS label, b AS dst FROM nodes LEFT JOIN (SELECT g, a AS v, b FROM edges) USING (g, v)", o.SUPPLIERS),
        "parse_adjlist": o.over("SELECT 0::BIGINT AS graph_id, (g << 32) + v AS node_id, -1 AS label, (g << 32) + b AS dst FROM nodes LEFT JOIN (SELECT g, a AS v, b FROM edges) USING (g, v)", o.SUPPLIERS),
        "parse_graphml": named,
        "parse_gml": named,
        "parse_edgelist": o.over("SELECT 0::BIGINT AS graph_id, (g << 32) + a AS src, (g << 32) + b AS dst FROM edges"),
    }
