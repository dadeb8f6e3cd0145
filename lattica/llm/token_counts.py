"""Token counts: an exact histogram of encoded lengths, and suffix sums over it.

Documents are aggregated by length; the histogram has at most sqrt(2 * all tokens) rows. Suffix sums are
taken in two levels, within blocks of BLOCK lengths and over the blocks, so no task holds the whole
histogram. A row answers, for its length as the context limit: documents and tokens at or above it, the
tokens left when every document is truncated there, and the share of documents at or below it (quantiles).

Defined cases: null or empty text has length 0; repeated rows count each; an empty table has no rows.
"""

from __future__ import annotations

import base64

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.llm.common import held, map_rows, written

BLOCK = 256


def _encoding(path: str, pattern: str):
    return held(("ranks", path, pattern), lambda: _read_encoding(path, pattern))


def _read_encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def lengths(docs: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """(n_tokens) of every row; special tokens' strings are ordinary text."""

    def run(texts):
        encode = _encoding(path, pattern).encode_ordinary
        return {"n_tokens": [len(encode(t)) if t else 0 for t in texts]}

    return map_rows(docs.select(text_col), T.StructType([T.StructField("n_tokens", T.LongType())]), [text_col], run)


def histogram(counted: DataFrame) -> DataFrame:
    """Of a table with n_tokens: one row per length, with its suffix sums."""
    own = written(counted.groupBy("n_tokens").agg(F.count("*").alias("n_docs")), "token-histogram").withColumn("block", F.floor(F.col("n_tokens") / BLOCK))
    blocks = own.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("t"))
    after = W.orderBy(F.col("block").desc()).rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy()
    later = blocks.select("block", *(F.coalesce(F.sum(c).over(after), F.lit(0)).alias(f"later_{c}") for c in "dt"), *(F.sum(c).over(every).alias(f"total_{c}") for c in "dt"))
    down = W.partitionBy("block").orderBy(F.col("n_tokens").desc()).rowsBetween(W.unboundedPreceding, W.currentRow)
    out = own.join(later, "block").select(
        "n_tokens",
        "n_docs",
        (F.sum("n_docs").over(down) + F.col("later_d")).alias("docs_at_least"),
        (F.sum(F.col("n_docs") * F.col("n_tokens")).over(down) + F.col("later_t")).alias("tokens_at_least"),
        F.col("total_d").alias("docs_total"),
        F.col("total_t").alias("tokens_total"),
    )
    truncated = F.col("tokens_total") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")
    share = (F.col("docs_total") - F.col("docs_at_least") + F.col("n_docs")) / F.col("docs_total")
    return out.withColumns({"truncated_total": truncated, "share_at_most": share})


def at_limits(rows: DataFrame, limits: list[int]) -> DataFrame:
    """(context, truncated_total) for any limits, from histogram()'s rows: the next length at or above each decides."""
    wanted = rows.sparkSession.createDataFrame([(int(x),) for x in limits], "context long")
    # the stated limits against the histogram: a bounded list, not rows against rows
    near = wanted.join(rows, F.col("n_tokens") >= F.col("context"), "left").groupBy("context").agg(F.min_by(F.struct("docs_at_least", "tokens_at_least"), "n_tokens").alias("x"))
    whole = rows.agg(F.max("tokens_total").alias("tokens_total"))
    value = F.col("tokens_total") - F.coalesce(F.col("x.tokens_at_least"), F.lit(0)) + F.col("context") * F.coalesce(F.col("x.docs_at_least"), F.lit(0))
    return near.join(F.broadcast(whole)).select("context", value.alias("truncated_total"))


def quantile(rows: DataFrame, q: float) -> DataFrame:
    """The least length that at least a share q of the documents does not exceed."""
    return rows.filter(F.col("share_at_most") >= q).agg(F.min("n_tokens").alias("n_tokens"))


def op10(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    if path is None or pattern is None:
        import public_tokenizers

        path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return histogram(lengths(docs, path, pattern))
