"""The corpus pipeline: toxicity, SimHash near-dedup, decontamination, mixing, token output.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import decontaminate, mixing, simhash, token_store, toxicity
from lattica.llm.common import table, written


def _packed(docs: DataFrame) -> DataFrame:
    """The columns that operators read, and the whole row as one, which no column of an operator can touch."""
    given = [c for c in docs.columns if c.lower() == "topic"]
    return docs.select(F.struct(*docs.columns).alias("__doc"), "doc_id", "text", "lang", "source", *given)


def _unpacked(rows: DataFrame) -> DataFrame:
    return rows.select("__doc.*")


def _toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is 0.5 or more go."""
    scored = toxicity.score(_packed(docs), toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return _unpacked(scored.filter("predicted = 0"))


def _near_dups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays, that with the smallest id; rows without an id stay.

    Where several rows of a group have that id, the one with the least fingerprint stays, then the least
    text, then the least digest of the row. Unlike texts that share an id are groups of their own.
    """
    found = simhash.near_dups(docs)
    keep = found.filter("doc_id = component_id").groupBy("root").agg(F.min(F.struct("fp", "doc_id")).alias("x")).select("x.fp", "x.doc_id")
    with_id = docs.filter("doc_id is not null")
    repeated = with_id.groupBy("doc_id").count().filter("count > 1").select("doc_id")
    if repeated.isEmpty():
        kept = with_id.join(keep, "doc_id", "left_semi")
    else:
        repeated = written(repeated, "pipeline-repeated")
        rows = simhash.marked(with_id.join(repeated, "doc_id", "left_semi").select(F.struct(*docs.columns).alias("__doc"), "doc_id", "text"))
        chosen = rows.join(keep, ["doc_id", "fp"], "left_semi").groupBy("doc_id", "fp").agg(F.min_by("__doc", F.struct("text", F.xxhash64("__doc"))).alias("__doc"))
        kept = with_id.join(repeated, "doc_id", "left_anti").join(keep, "doc_id", "left_semi").select(*docs.columns).unionByName(_unpacked(chosen))
    return kept.unionByName(docs.filter("doc_id is null")).select(*docs.columns)


def _benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents that are mostly benchmark go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def _mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are drawn by their cell's calibrated probability."""
    rows = written(mixing.profiled(_packed(docs)).drop("text"), "pipeline-profile")  # texts are read once
    return _unpacked(mixing.mix(mixing.with_topics(rows)).filter("kept"))


def _tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token store's documents, as read back."""
    return token_store.op4(docs)


STAGES = [("toxicity", _toxicity), ("simhash near-dedup", _near_dups), ("benchmark decontamination", _benchmark), ("mixing", _mixing), ("token output", _tokens)]

#: None: scores that are learned from labels, fingerprints and token ids are beyond SQL; see tests/llm/test_pipeline.py.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{i}")
    return docs
