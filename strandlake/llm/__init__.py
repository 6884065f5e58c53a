"""Operators for large-scale training-data pipelines, and their registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandlake.llm import chat, decontamination, embedding_dedup, html_extract, line_dedup, minhash, packing, token_counts, toxicity, url_filter

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_line_dedup": line_dedup.op1_line_dedup,
        "op2_toxicity": toxicity.op2_toxicity,
        "op3_minhash_dedup": minhash.op3_minhash_dedup,
        "op4_chat_formatting": chat.op4_chat_formatting,
        "op5_decontamination": decontamination.op5_decontamination,
        "op6_html_extraction": html_extract.op6_html_extraction,
        "op7_packing": packing.op7_packing,
        "op8_token_counts": token_counts.op8_token_counts,
        "op9_url_filter": url_filter.op9_url_filter,
        "op10_embedding_dedup": embedding_dedup.op10_embedding_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_line_dedup": line_dedup.ORACLE,
        "op3_minhash_dedup": minhash.ORACLE,
        "op4_chat_formatting": chat.ORACLE,
        "op5_decontamination": decontamination.ORACLE,
        "op10_embedding_dedup": embedding_dedup.ORACLE,
    }
