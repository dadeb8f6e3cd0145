"""Line dedup: a line that several documents share stays in the smallest document id alone.

Lines are exploded and hashed; the hashes alone are shuffled and counted (min and max of the ids
are combined on the map side, so one line in a third of all documents costs one row a task). The
doomed positions are gathered per document and the text is reassembled by position. Nothing that grows
is broadcast by hint; where a join meets one hash very often, adaptive execution splits its rows.

Defined cases: null or empty text is one empty line; null ids never share a line and lose none;
rows that repeat an id count as one document and keep or lose lines alike; an empty table stays
empty; columns of the input called n_lines, n_dropped are replaced, all others pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.llm.common import ascii_lower, map_rows, replaced, written

BLANKS = " \t\n\x0b\x0c\r"


def line_key(line):
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def _identity(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows that repeat an id with other texts stay apart by the hash of the text."""
    return docs.withColumns({"__id": F.col(id_col), "__text": F.coalesce(F.col(text_col), F.lit(""))}).withColumn("__row", F.xxhash64("__text"))


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """(__id, __row, positions) of the lines that go."""
    keyed = (
        _identity(docs.select(id_col, text_col), id_col, text_col)
        .filter(F.col("__id").isNotNull())
        .select("__id", "__row", F.posexplode(F.split("__text", "\n", -1)).alias("pos", "line"))
        .filter(F.length("line") >= min_chars)
        .withColumn("key", line_key(F.col("line")))
        .filter(F.length("key") >= min_chars)
        # 128 bits: two hashes under seeds that do not follow from each other
        .select("__id", "__row", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), "key").alias("h2"))
    )
    keyed = written(keyed, "lines")  # texts are split once; hashes are what is read again
    if min_docs <= 2:
        shared = keyed.groupBy("h1", "h2").agg(F.min("__id").alias("keep"), F.max("__id").alias("last")).filter("keep < last")
    else:
        shared = keyed.select("h1", "h2", "__id").distinct().groupBy("h1", "h2").agg(F.min("__id").alias("keep"), F.count("*").alias("n")).filter(F.col("n") >= min_docs)
    # written, so that the join deals out both its sides itself and may split a hash with very many lines
    doomed = keyed.join(written(shared.select("h1", "h2", "keep"), "shared-lines"), ["h1", "h2"]).filter("__id <> keep")
    return doomed.groupBy("__id", "__row").agg(F.collect_set("pos").alias("positions"))


def _cut(texts: list, positions: list) -> dict[str, list]:
    kept, lines, gone = [], [], []
    for text, doomed in zip(texts, positions, strict=True):
        if doomed:
            parts, doomed = text.split("\n"), set(doomed)
            kept.append("\n".join(x for i, x in enumerate(parts) if i not in doomed))
            lines.append(len(parts))
            gone.append(len(doomed))
        else:
            kept.append(text)
            lines.append(text.count("\n") + 1)
            gone.append(0)
    return {"__kept": kept, "n_lines": lines, "n_dropped": gone}


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """docs with the kept lines as text, and n_lines, n_dropped."""
    gone = dropped_lines(docs, id_col, text_col, min_chars, min_docs)
    whole = _identity(docs, id_col, text_col).join(gone, ["__id", "__row"], "left")
    schema = replaced(T.StructType([f for f in docs.schema.fields if f.name.lower() != text_col.lower()]), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("__kept", T.StringType()))
    cut = map_rows(whole, schema, ["__text", "positions"], _cut)
    return cut.withColumnRenamed("__kept", text_col)


def op1(docs: DataFrame) -> DataFrame:
    return dedup_lines(docs.select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
shared AS (
  SELECT key, min(doc_id) AS keep FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
marked AS (
  SELECT k.doc_id, k.pos, k.line, coalesce(s.keep <> k.doc_id, false) AS gone FROM keyed k LEFT JOIN shared s ON k.key = s.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
