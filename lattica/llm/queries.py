"""The queries of this subpackage and their SQL; __spark_entry__ adds them if the subpackage is there."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lattica.llm import chat, decontaminate, line_dedup, media, mixing, pii, simhash, token_counts, token_store, toxicity
from lattica.llm.common import table


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_line_dedup": lambda spark, d: line_dedup.op1(table(spark, d, "documents")),
        "op2_chat_format": lambda spark, d: chat.op2(table(spark, d, "conversations")),
        "op3_pii": lambda spark, d: pii.op3(table(spark, d, "documents")),
        "op4_token_store": lambda spark, d: token_store.op4(table(spark, d, "documents")),
        "op5_decontaminate": lambda spark, d: decontaminate.op5(table(spark, d, "documents"), table(spark, d, "benchmark")),
        "op6_toxicity": lambda spark, d: toxicity.op6(table(spark, d, "documents"), table(spark, d, "labels")),
        "op7_mixture": lambda spark, d: mixing.op7(table(spark, d, "documents")),
        "op8_simhash": lambda spark, d: simhash.op8(table(spark, d, "documents")),
        "op9_webp_media": lambda spark, d: media.op9(table(spark, d, "documents")),
        "op10_token_counts": lambda spark, d: token_counts.op10(table(spark, d, "documents")),
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": line_dedup.ORACLE, "op2_chat_format": chat.ORACLE, "op5_decontaminate": decontaminate.ORACLE}
